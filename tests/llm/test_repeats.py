"""Repeated byte strings against brute force over all pairs of starts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tessella.llm import repeats


def brute(texts: list[bytes], length: int, keep: str) -> list[list[tuple[int, int]]]:
    """Removed ranges of texts in corpus order."""
    first, n = {}, {}
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            n[w] = n.get(w, 0) + 1
            first.setdefault(w, (i, s))
    out = []
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if n[w] > 1 and (keep == "none" or first[w] != (i, s)):
                gone[s : s + length] = b"\1" * length
        edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + bytes(gone) + b"\0", np.int8)))
        out.append([(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])])
    return out


def corpus(seed: int) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(50)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = [say(60) for _ in range(4)]
    out = ["", "short", "aaaa" * 40, "ab" * 60, "a" * 500]
    for _ in range(60):
        parts = [say(rng.randint(1, 40))]
        for _ in range(rng.randint(0, 3)):
            c = rng.choice(common)
            at = rng.randint(0, len(c) // 2)
            parts += [c[at : at + rng.randint(20, len(c))], say(rng.randint(0, 15))]
        out.append(" ".join(parts))
    out += [rng.choice(out) for _ in range(12)]
    return out


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize(("seed", "length", "hot"), [(1, 40, 1 << 20), (2, 40, 2000), (3, 7, 3000), (4, 1, 1 << 20)])
def test_equals_brute_force(spark, monkeypatch, seed, length, hot, keep):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in repeats.drop_repeats(docs, length, keep).collect()}
    # corpus order is that of distinct texts by least id; copies have their earlier one there
    order = sorted(range(len(texts)), key=lambda i: (texts.index(texts[i]), i))
    want = dict(zip(order, brute([texts[i].encode() for i in order], length, keep)))
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        body, row = text.encode(), found[i]
        kept = repeats._cut(body, want[i])
        assert [tuple(s) for s in row["spans"]] == want[i], (i, text)
        assert row["n_bytes"] == len(body) and row["n_removed"] == len(body) - len(kept)
        assert bytes(row["kept"]) == kept and row["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 300)
    texts = corpus(5)
    docs = spark.createDataFrame(list(enumerate(["\n".join(texts), *texts])), "doc_id long, text string")
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in repeats.repeat_spans(docs, 50, "none").collect()}
    assert [found[i] for i in range(len(texts) + 1)] == brute([t.encode() for t in ["\n".join(texts), *texts]], 50, "none")


def test_awkward_rows(spark):
    rows = [(1, None), (1, "x" * 250), (1, "x" * 250), (None, "y" * 250), (None, None), (2, ""), (3, "z" * 199)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as pos", "3 as hash", "4 as rid")
    none = repeats.repeat_spans(docs, 200, "none").collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"])) for r in none) == sorted([("1", 0, 0, 0), ("1", 250, 250, 1), ("1", 250, 250, 1), ("None", 250, 250, 1), ("None", 0, 0, 0), ("2", 0, 0, 0), ("3", 199, 0, 0)])
    first = repeats.repeat_spans(docs, 200, "first").collect()
    assert sorted(r["n_removed"] for r in first if r["n_bytes"] == 250) == [249, 249, 250]  # a run repeats itself from its second byte on


def test_ranks_and_previous_factors():
    rng = np.random.default_rng(0)
    for length in (1, 5, 8, 13, 64, 200):
        data = rng.integers(97, 99, 3000).astype(np.uint8)
        data[1000:1400] = data[200:600]
        ranks = repeats.prefix_ranks(data, length)
        n = len(data) - length + 1
        strings = [bytes(data[i : i + length]) for i in range(n)]
        order = {s: k for k, s in enumerate(sorted(set(strings)))}
        _, dense = np.unique(ranks[:n], return_inverse=True)
        assert [order[s] for s in strings] == dense.tolist()
        positions = rng.permutation(n)
        least = {}
        for s, p in zip(strings, positions):
            least[s] = min(p, least.get(s, p))
        assert repeats.has_previous_factor(ranks[:n], positions).tolist() == [least[s] < p for s, p in zip(strings, positions)]
