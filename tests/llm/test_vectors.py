"""Hard negatives and vector codes against brute force in plain Python."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import hard_negatives, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, key string, rid int"
BAD = [(5000, None, 1), (5100, [1.0, None, 0.0, 0.0], 1), (5200, [float("nan")] * 4, 1), (5300, [float("inf"), 0.0, 0.0, 0.0], 1), (5400, [], 1), (5500, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0, 0.5, 0.25, 0.0], 1), (5700, [3e38, 0.0, 0.0, 0.0], 1)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)


def near(rows, scale, positives, negatives, low, high, step):
    """Rows as (vec_id, vector, label); every pair is scored."""
    ints = [[math.floor(scale * float(np.float32(x))) for x in v] for _, v, _ in rows]
    out = []
    for a, (anchor, _, label) in enumerate(rows):
        if anchor % step:
            continue
        scores = sorted((-sum(p * q for p, q in zip(ints[a], ints[b])), rows[b][0], rows[b][2]) for b in range(len(rows)) if b != a)
        for ps, pid, _ in [s for s in scores if s[2] == label][:positives]:
            fits = [s for s in scores if s[2] != label and low * -ps <= 100 * -s[0] <= high * -ps][:negatives]
            out += [(anchor, pid, k + 1, nid, -ps, -ns) for k, (ns, nid, _) in enumerate(fits)]
    return sorted(out)


def vectors(seed, n, kind):
    rng = random.Random(seed)
    if kind == "ties":  # few different vectors, many equal scores
        return [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)], rng.randrange(3)) for i in range(n)]
    if kind == "repeated":  # ids and rows that repeat, one vector of a third of all rows
        base = [(rng.randrange(n // 4), [1.0, 0.5, 0.5, 0.0] if rng.random() < 0.4 else [rng.random() for _ in range(4)], rng.randrange(3)) for _ in range(n)]
        return base + base[: n // 5]
    if kind == "signed":
        return [(i * 3 - n, [rng.uniform(-3, 3) for _ in range(4)], rng.randrange(4)) for i in range(n)]
    return [(i, [rng.gauss(0, 1) * 1e4 for _ in range(4)], i % 2) for i in range(n)]


@pytest.mark.parametrize(("kind", "digit", "spare"), [("ties", 2, 0), ("repeated", 3, 1), ("signed", 12, 24), ("large", 5, 2)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, kind, digit, spare):
    monkeypatch.setattr(hard_negatives, "DIGIT", digit)
    monkeypatch.setattr(hard_negatives, "SPARE", spare)
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
    rows = vectors(4, 120, kind)
    found = hard_negatives.hard_negatives(table(spark, [*rows, *BAD[:-1]]), F.col("vec_id") % 10 == 0, scale=256, positives=3, negatives=4, low=80, high=100)
    assert sorted(tuple(r) for r in found.collect()) == near(rows, 256, 3, 4, 80, 100, 10)


def test_hard_negatives_of_long_scores(spark):
    rows = [(i, [float(v) for v in np.random.default_rng(i).integers(-20000, 20000, 4)], i % 3) for i in range(40)]
    found = hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, scale=256, low=50)
    assert sorted(tuple(r) for r in found.collect()) == near(rows, 256, 5, 5, 50, 100, 10)
    mixed = [*rows, (100, [1.0, 2.0], 1), (110, [1.0, 2.5], 1), (120, [1.0, 2.25], 2)]  # vectors of unlike length never meet
    found = hard_negatives.hard_negatives(table(spark, mixed), F.col("vec_id") == 100)
    assert [tuple(r) for r in found.collect()] == near(mixed[-3:], 256, 5, 5, 80, 100, 100)


def test_hard_negatives_broadcast_no_growing_table(spark, monkeypatch):
    """Only the sizes by vector length are broadcast, whatever size Spark estimates for the stored tables."""
    plans = {}
    stored = hard_negatives.materialize

    def noted(df, name):
        plans[f"{name}-{len(plans)}"] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(hard_negatives, "materialize", noted)
    monkeypatch.setattr(hard_negatives, "SCORED", 3)
    monkeypatch.setattr(hard_negatives, "BLOCKS", 2)
    monkeypatch.setattr(hard_negatives, "BLOCK", 10)
    monkeypatch.setattr(hard_negatives, "LARGE_BLOCK", 50)
    rows = vectors(5, 120, "signed")
    found = hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 6 == 0)
    plans["last"] = found._jdf.queryExecution().executedPlan().toString()
    assert [k for k, plan in plans.items() if "Broadcast" in plan and not k.startswith(("negatives-vectors", "negatives-anchors"))] == []
    assert any("SortMergeJoin" in plan for plan in plans.values())
    assert sorted(tuple(r) for r in found.collect()) == near(rows, 256, 5, 5, 80, 100, 6)


def test_hard_negatives_without_rows(spark):
    assert hard_negatives.hard_negatives(table(spark, BAD[:6]), F.lit(True)).collect() == []
    alone = hard_negatives.hard_negatives(table(spark, [(0, [1.0] * 4, 1), (1, [1.0] * 4, 2)]), F.col("vec_id") == 0)
    assert alone.collect() == []  # no positive


def lloyd(rows, scale, parts, entries, rounds):
    """Every part is compared with every entry in every round. Rows as (vec_id, vector, label)."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (square(cut(v, p), books[p][e]), e)) for p in range(parts)] for _, v, _ in kept]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            groups = defaultdict(list)
            for (_, v, _), code in zip(kept, codes):
                groups[code[p]].append(cut(v, p))
            for e, own in groups.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out = [(i, label, "".join(f"{e:02x}" for e in code), sum(square(cut(v, p), books[p][e]) for p, e in enumerate(code))) for (i, v, label), code in zip(kept, assign())]
    return out, books


@pytest.mark.parametrize(("kind", "chunk", "entries", "rounds"), [("ties", 7, 5, 6), ("repeated", 50, 16, 6), ("signed", 33, 16, 3), ("signed", 10_000, 1, 2), ("large", 40, 6, 8), ("few", 10, 16, 6)])
def test_vector_codes_equal_brute_force(spark, monkeypatch, kind, chunk, entries, rounds):
    monkeypatch.setattr(vector_codes, "CHUNK", chunk)
    rows = vectors(9, 9 if kind == "few" else 150, "signed" if kind == "few" else kind)
    rows = [*rows, (None, [0.25, 0.5, 0.75, 1.0], None), (7, [0.25, 0.5, 0.75, 1.0], None)]
    dropped = [(99, None, 1), (98, [1.0, None, 0.0, 0.0], 1), (97, [float("nan")] * 4, 1), (96, [], 1), (95, [1.0], 1), (300, [1.0] * 6, 1), (94, [3e38] * 4, 1)]
    coded, books = vector_codes.vector_codes(table(spark, [*rows, *dropped]), scale=4096, parts=2, entries=entries, rounds=rounds)
    want, want_books = lloyd(rows, 4096, 2, entries, rounds)
    assert books.tolist() == want_books
    order = lambda r: (r[0] is None, r[0] or 0, str(r[1]), r[2], r[3])
    assert sorted(((r["vec_id"], None if r["label"] is None else int(r["label"]), r["code"], r["error"]) for r in coded.collect()), key=order) == sorted(want, key=order)
    sums = defaultdict(int)
    for _, label, _, error in want:
        sums[label] += error
    assert all(r["label_error"] == sums[None if r["label"] is None else int(r["label"])] for r in vector_codes.with_label_error(coded).collect())


def test_vector_codes_without_rows(spark):
    coded, books = vector_codes.vector_codes(table(spark, BAD[:5]), parts=2)
    assert coded.collect() == [] and books.size == 0 and len(vector_codes.digest(books)) == 64


def test_few_parts_are_compared_again():
    """Drift stays below most slacks once the entries settle; what is popped is a small part, and the codes are right."""
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.normal(c, 30, (500, 2)) for c in rng.uniform(-4000, 4000, (8, 2))]).astype(np.int32)
    entries = data[::500][None].astype(np.int64)
    books = vector_codes.Books(entries, np.zeros((1, 8)))
    chunk = vector_codes.Chunk(data, (1, 8, 2))
    chunk.start(books)
    popped = []
    for _ in range(5):
        total = chunk.sums[0]
        means = np.where(total[:, :1] > 0, total[:, 1:] // np.maximum(total[:, :1], 1), books.entries[0])[None]
        books = books.moved(means)
        popped.append(chunk.step(books))
        squares = ((data[:, None].astype(np.int64) - books.entries[0][None]) ** 2).sum(axis=2)
        assert np.array_equal(chunk.codes[:, 0], squares.argmin(axis=1))
        assert all(np.array_equal(np.sort(k), k) for k, _ in chunk.heaps[0]) and sum(len(k) for k, _ in chunk.heaps[0]) == len(data)
    assert popped[-1] < len(data) // 10
