"""Exact, near, line and embedding duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import components, embedding_dedup, exact_dedup, line_dedup, simhash


def closure(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in linked:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def near_texts(seed=1, groups=12):
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        words = [f"w{r.randrange(400)}" for _ in range(r.randint(1, 300))]
        for _ in range(r.randint(1, 4)):
            copy = list(words)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(9)}"
            out.append(" ".join(copy))
    return [*out, "", " \t", None, "One two", "one  TWO", "A", *out[:3]]


def test_exact_groups(spark):
    rows = list(enumerate([*near_texts(), "a b", "ab", " a\nb "]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in rows}
    groups = {}
    for i, t in rows:
        groups.setdefault(plain[i], []).append((-len(t or ""), i))
    for r in exact_dedup.exact_groups(docs).collect():
        own = groups[plain[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(own)[1], len(own), r["doc_id"] == min(own)[1])
        assert r["text_sha256"] == hashlib.sha256(plain[r["doc_id"]].encode()).hexdigest()
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs).collect()) == sorted(min(g)[1] for g in groups.values())


def test_exact_groups_split_collided_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "content_hash", lambda text: F.lit("same"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, " a")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(docs).collect()} == {1: 3, 2: 2, 3: 3}


@pytest.mark.parametrize("tau", [0, 2, 5])
def test_simhash_components(spark, tau):
    rows = list(enumerate(near_texts(4, 30)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in simhash.simhash_components(docs, tau).collect()}
    fps = simhash.fingerprints_of([t for _, t in rows], 3, 42)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= tau
    want = closure(range(len(rows)), zip(*np.nonzero(near)))
    assert {i: r["component_id"] for i, r in found.items()} == want
    assert all(int(found[i]["fingerprint"], 16) == int(fps[i]) for i in found)
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs, tau).collect()) == sorted(set(want.values()))


def test_simhash_large_buckets_are_cut_into_blocks(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(k)) for k in range(12)]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    linked = [(a["a"], a["b"]) for a in simhash.near_links(frame, 2, block=8).collect()]
    signed = fps.view(np.int64).tolist()
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    assert closure(signed, linked) == closure(signed, [(signed[i], signed[j]) for i, j in zip(*np.nonzero(near))])


def test_thresholds_cover_the_bound():
    both = np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500.0)
    for tau in range(8):
        for m in range(1, tau + 3):
            parts = simhash.correlated_parts(1000, both, m)
            assert sorted(b for p in parts for b in p) == list(range(64))
            cost, chosen = simhash.allocate(1000, both, parts, tau)
            assert sum(chosen) == tau - len(parts) + 1 and cost >= 0


def test_components_of_random_graphs(spark):
    r = random.Random(6)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    found = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = closure({n for e in edges for n in e}, edges)
    assert found == {n: c for n, c in want.items() if n in found} and all(n == c and list(want.values()).count(c) == 1 for n, c in want.items() if n not in found)


def test_tile_links_join_what_the_tile_joins():
    r = np.random.default_rng(0)
    for k in range(60):
        n, m = r.integers(1, 12, 2)
        if k % 2:
            near = r.random((n, n)) < 0.15
            near |= near.T
            nodes, links = range(n), list(zip(*components.tile_links(near, True)))
            want = list(zip(*np.nonzero(near)))
        else:
            near = r.random((n, m)) < 0.15
            nodes, links = range(n + m), list(zip(*components.tile_links(near, False)))
            want = [(i, n + j) for i, j in zip(*np.nonzero(near))]
        assert closure(nodes, links) == closure(nodes, want) and len(links) < len(nodes)


def vectors(seed=2):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(12):
        base = r.normal(size=16)
        for _ in range(int(r.integers(1, 9))):
            rows.append((len(rows), (base + r.normal(size=16) * r.choice([0, 0.05, 0.25])).astype(np.float32).tolist(), g % 3))
    nan, inf = float("nan"), float("inf")
    for bad in (None, [], [0.0] * 16, [nan] * 16, [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]):
        rows.append((len(rows), bad, 1))
    rows += [(len(rows), rows[0][1], None), (len(rows) + 1, rows[0][1], 0), (len(rows) + 2, [2 * v for v in rows[0][1]], 0), rows[3]]
    return rows


@pytest.mark.parametrize("block", [4, 2048])
def test_embedding_links(spark, block):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = embedding_dedup.embedding_components(frame, 0.93, block).collect()
    assert len(found) == len(rows)
    usable = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]

    def near(a, b):
        x, y = np.array(rows[a][1], np.float64), np.array(rows[b][1], np.float64)
        return rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93

    links = [(a, b) for a in usable for b in usable if a != b and near(a, b)]
    roots, counts = closure(range(len(rows)), links), {k: 0 for k in range(len(rows))}
    for a, _ in links:
        counts[a] += 1
    least = {}
    for k in range(len(rows)):
        least[roots[k]] = min(least.get(roots[k], 1 << 60), rows[k][0])
    want = sorted((rows[k][0], counts[k], least[roots[k]], rows[k][0] == least[roots[k]]) for k in range(len(rows)))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found) == want


def test_quantisation_bounds_hold():
    r = np.random.default_rng(9)
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (r.normal(size=(50, 64)), r.normal(size=(40, 64))))
    (qa, sa, ea), (qb, sb, eb) = embedding_dedup.quantise(a), embedding_dedup.quantise(b)
    estimate = (qa.astype(float) @ qb.astype(float).T) * sa[:, None] * sb[None, :]
    assert (np.abs(a @ b.T - estimate) <= ea[:, None] + eb[None, :] + ea[:, None] * eb[None, :] + 1e-12).all()


def brute_lines(rows):
    def words(line):
        return re.sub(r"[\x09\x0B-\x0D ]+", " ", line.lower()).strip().split(" ")

    def within_one(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = (a, b) if len(a) > len(b) else (b, a)
        return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    seen, out = [], {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        gone = []
        for k, line in enumerate((text or "").split("\n") if text else []):
            w = words(line)
            if w == [""]:
                continue
            if any(w == s or (min(len(w), len(s)) >= line_dedup.LEAST_WORDS and within_one(w, s)) for s in seen):
                gone.append(k)
            seen.append(w)
        out[i] = gone
    return out


def line_rows():
    r = random.Random(12)
    lines = [" ".join(f"w{r.randrange(30)}" for _ in range(r.randint(1, 12))) for _ in range(40)]
    lines += ["a a b a a c", "a b a a c", "a a b a c", "x y", "X  y", "one two three four five", "zero one two three four five", "one two three four six", "lots " * 700]
    rows = []
    for i in range(25):
        picked = []
        for _ in range(r.randint(0, 8)):
            w = r.choice(lines).split(" ")
            if r.random() < 0.5:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + ["new"] + w[at:], w[:at] + [f"n{r.randrange(3)}"] + w[at + 1 :]])
            picked.append(r.choice(["", " ", "\t"]) + " ".join(w))
        rows.append((i, "\n".join(picked)))
    return [*rows, (90, None), (91, ""), (92, "\n \n"), (None, rows[3][1])]


def test_line_dedup(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    found = line_dedup.line_decisions(docs).collect()
    assert {r["doc_id"]: list(r["dropped_lines"]) for r in found} == want and len(found) == len(rows)
    texts = dict(rows)
    for r in line_dedup.drop_repeated_lines(docs).collect():
        gone = set(want[r["doc_id"]])
        assert r["text"] == (texts[r["doc_id"]] if not gone else "\n".join(x for k, x in enumerate(texts[r["doc_id"]].split("\n")) if k not in gone))


def shingle_links(texts):
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] & sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


@pytest.mark.parametrize("block", [simhash.BLOCK, 8])
def test_similar_texts(spark, block):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(150).collect()]
    r = random.Random(5)
    for text in texts[:60]:
        words = (text or "").split()
        for _ in range(len(words) // r.choice([30, 50, 80])):
            words[r.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    texts += near_texts(6, 20)
    links = shingle_links(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"__id": F.lit("a"), "__TH": F.lit("b"), "node": F.lit("c")})
    found = simhash.drop_similar(docs, 5, tau=6, block=block)  # so many bits that every link is a candidate
    assert found.columns == docs.columns
    words = [" ".join((t or "").lower().split()) for t in texts]
    same = [(i, words.index(w)) for i, w in enumerate(words) if words.index(w) < i]  # the blank texts are one node
    assert sorted(x["doc_id"] for x in found.collect()) == sorted(set(closure(range(len(texts)), links + same).values()))


def test_candidates_find_nine_tenths_of_similar_texts():
    """Recall of the fingerprints alone, on real texts edited to a similarity just above the bound."""
    import pyarrow.parquet as pq

    r, hits, n = random.Random(3), 0, 0
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:700]:
        words = (text or "").split()
        if len(words) < 60:
            continue
        edited = list(words)
        for k in r.sample(range(len(words)), max(1, len(words) // 48)):
            edited[k] = f"new{r.randrange(10**6)}"
        if not shingle_links([" ".join(words), " ".join(edited)]):
            continue
        a, b = simhash.sketches_of([[w.lower().encode() for w in x] for x in (words, edited)])
        hits, n = hits + (np.bitwise_count(a ^ b).min() <= simhash.SKETCH_TAU), n + 1
    assert n > 150 and hits / n > 0.9


def test_skewed_join_of_heavy_rows(spark, monkeypatch):
    from tessella.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 1000)
    rows = spark.range(6000).selectExpr("id", "if(id % 2 = 0, 1L, id) as k")  # 1 has 3,001 rows, the others one
    classes = common.materialize(rows.groupBy("k").count().selectExpr("k", "count as n", "repeat('x', 2000) as heavy"), "heavy")
    found = common.join_skewed(rows, classes, "k", "n", weight="heavy").collect()
    want = [(i, 1, 3001, 2000) if i % 2 == 0 or i == 1 else (i, i, 1, 2000) for i in range(6000)]
    assert sorted((r["id"], r["k"], r["n"], len(r["heavy"])) for r in found) == want


def test_only_lines_with_other_blanks_are_rewritten(spark):
    """Blanks of every kind become single ones; a line that has single blanks only stays out of the expression."""
    import re

    from pyspark.sql import functions as F

    from tessella.llm import line_dedup

    lines = ["a b c", "a  b", "a\tb", "a \x0b\x0c b", "a\rb\r", "  a", "", "a b", "a \t\t é"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line int, raw string")
    found = rows.select("line", line_dedup._single_blanks("raw").alias("norm")).orderBy("line").collect()
    assert [r["norm"] for r in found] == [re.sub("[\t\x0b-\r ]+", " ", x) for x in lines]
    table = line_dedup.line_table(rows.select(F.col("line").alias("doc_id"), F.col("raw").alias("text"))).orderBy("did").collect()
    assert [(r["did"], r["size"]) for r in table] == [(i, len(re.split("[\t\x0b-\r ]+", x.strip("\t\x0b\x0c\r ")))) for i, x in enumerate(lines) if x]
