"""The pipeline's stages, one after the other on real documents, against brute force with the settings they run with."""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm.common import materialize

SF_DIR = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0d]")


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_kept(texts):
    """Ids of the least of each group of texts linked by a Jaccard similarity of 0.8 or more."""
    ids, sets = sorted(texts), {i: shingles(t) for i, t in texts.items()}
    group = {i: i for i in ids}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in ids:
        for b in ids:
            if a < b:
                common = len(sets[a] & sets[b])
                if common and 9 * common >= 4 * (len(sets[a]) + len(sets[b])):
                    group[max(find(a), find(b))] = min(find(a), find(b))
    return {i for i in ids if find(i) == i}


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    # near copies: one word of 60 changed, and of 12
    base = " ".join(f"wort{i}" for i in range(60))
    planted = [(9001, base, "de", "s", len(base)), (9002, base.replace("wort30 ", "anders "), "de", "s", len(base)), (9003, " ".join(f"wort{i}" for i in range(12)), "de", "s", 1), (9004, " ".join(f"wort{i}" for i in range(11)) + " anders", "de", "s", 1), (9005, "1 2 3", "de", "s", 5), (9006, base + "\n", None, "s", 1)]
    docs = materialize(docs.unionByName(spark.createDataFrame(planted, docs.schema)), "fixture")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    known = {i: t for i, t in texts.items() if t and any(map(str.isalpha, t))}
    docs = materialize(stages["language"](spark, docs, SF_DIR), "a")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == known
    best = {}
    for i, t in known.items():
        key = SPACE.sub("", t)
        best[key] = max(best.get(key, (0, 0)), (len(t), -i)) if key in best else (len(t), -i)
    unique = {-i: known[-i] for _, i in best.values()}
    docs = materialize(stages["exact_dedup"](spark, docs, SF_DIR), "b")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == unique and 9001 not in unique
    docs = materialize(stages["near_dedup"](spark, docs, SF_DIR), "c")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = near_kept(unique)
    assert kept == {i: unique[i] for i in want} and 9002 in want and 9006 not in want and {9003, 9004} & want
    docs = materialize(stages["surrogates"](spark, docs, SF_DIR), "d")
    replaced = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = re.compile(r"\S+@\S+\.\w+|\+1 \(\d+\) \d+-\d+|\d+\.\d+\.\d+\.\d+|\b\d{16}\b|[0-9a-fA-F]{40}")
    for i, t in kept.items():
        values = found.findall(t)
        assert not any(v in replaced[i] for v in values) and (values or replaced[i] == t or re.search(r"\d|[A-ZА-Я]", t))
    pieces = stages["packing"](spark, docs, SF_DIR).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, corpus_pipeline.END_ID], "<u4") for i, t in replaced.items()}
    places, room = {i: 0 for i in ids}, {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        own = ids[p["doc_id"]]
        assert p["start"] == places[p["doc_id"]] and p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
        places[p["doc_id"]] += p["length"]
        room.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert places == {i: len(own) for i, own in ids.items()}
    for own in room.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= corpus_pipeline.SEQUENCE_TOKENS
