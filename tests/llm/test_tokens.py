"""Byte-level BPE, word tokens, packing and the token store against the libraries."""

from __future__ import annotations

import base64
import hashlib
import random
import shutil
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tessella.llm import byte_bpe, packing, token_store
from tessella.llm.word_tokens import WordEncoder, cut_marks

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
TEXTS = ["", " \n\t ", "Hello  world's end... 12.5% of it!", "straße ÉTÉ naïve İstanbul ΟΔΟΣ ς", "a.b.c!!! *** word*** é!! İ-", "日本語テキスト。 русский 😀👍🏽", "<|endoftext|> x", "é<|startoftext|><|endoftext|>A b<|EndOfText|>", "a\x01b \x01", "x" * 5000, "ab " * 4000, "\n".join(["same line here"] * 30)]


def mixed(n=200, seed=1):
    r = random.Random(seed)
    letters = "ab é'.,!sßİσ1²̸=-\t\n日😀_ "
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)  # as the library gives it: special strings in a text get their ids


def docs_frame(spark, texts):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate([*texts, None])]
    return spark.createDataFrame([*rows, rows[2]], "doc_id long, text string, source string")


def test_byte_bpe_equals_tiktoken(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = docs_frame(spark, TEXTS + mixed()).withColumns({"ids": F.lit("clash"), "n_tokens": F.lit("clash")})
    done = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN).withColumn("at", F.col("doc_id")), RANKS, P.PATTERN).join(docs.select("doc_id", "text").distinct(), "doc_id")
    found = done.collect()
    assert len(found) == docs.count()
    for r in found:
        ids = own.encode_ordinary(r["text"] or "")
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes() and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]).decode() == (r["text"] or "")


@pytest.mark.parametrize("remembered", [700_000, 50])
def test_word_encoder_equals_the_library(tokenizer, monkeypatch, remembered):
    monkeypatch.setattr("tessella.llm.word_tokens.MAX_WORDS", remembered)
    encoder, texts = WordEncoder(WORDS), [*TEXTS, *mixed(600, 3), None]
    for at in range(0, len(texts), 100):
        ids, ends = encoder.encode(texts[at : at + 100])
        start = 0
        for text, end in zip(texts[at : at + 100], ends):
            assert ids[start:end].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
            start = end


def test_marks_are_cut_only_behind_letters():
    assert cut_marks(b"word...") == (b"word", b"...") and cut_marks("é!".encode()) == ("é".encode(), b"!")
    assert cut_marks("İ!".encode()) == ("İ!".encode(), None) and cut_marks(b"...") == (b"...", None) and cut_marks(b"it's") == (b"it's", None)


def expected(tokenizer, docs, end):
    return {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, end] for i, t in docs}


@pytest.mark.parametrize("mixture", [None, {"s0": 5, "s1": 1, "s2": 1}])
def test_packing_is_whole_and_gapless(spark, tokenizer, mixture):
    docs = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate([*TEXTS, *mixed(), None])], "doc_id long, text string, source string")
    pieces = packing.pack_documents(docs, WORDS, 2, 64, mixture).collect()
    want = expected(tokenizer, [(r["doc_id"], r["text"]) for r in docs.collect()], 2)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert by_doc.keys() == want.keys()
    for i, ids in want.items():
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            part = ids[at : at + p["length"]]
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += p["length"]
        assert at == len(ids)
    last = max(by_sequence)
    for s, found in by_sequence.items():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 64 or s == last and at <= 64


def test_windows_hold_the_mixture(spark):
    rows = [(i, f"s{0 if i < 3000 else 1 + i % 2}", 20) for i in range(6000)]
    encoded = spark.createDataFrame([(i, i, s, n) for i, s, n in rows], "rid long, doc_id long, source string, n int")
    sources = dict((i, s) for i, s, _ in rows)
    shares = defaultdict(lambda: defaultdict(int))
    for p in packing.pack(encoded, 100, {"s0": 2, "s1": 1, "s2": 1}, 4).collect():
        shares[p["sequence_id"] // 4][sources[p["doc_id"]]] += p["n"]
    for w in range(200):  # until a source runs out every window has 2 : 1 : 1
        assert abs(shares[w]["s0"] - 200) <= 1 and abs(shares[w]["s1"] - 100) <= 1


def test_store_round_trip(spark, tokenizer):
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate([*TEXTS, *mixed(60), *["long text " * 900] * 5, None])], "doc_id long, text string")
    folder = token_store.write_store(docs, WORDS, 1)
    want, start = expected(tokenizer, [(r["doc_id"], r["text"]) for r in docs.collect()], 1), 0
    checked = {r["doc_id"]: r for r in token_store.verify_documents(spark, folder).collect()}
    rebuilt = {r["doc_id"]: r for r in token_store.read_documents(spark, folder).collect()}
    for i in sorted(want):
        data = np.array(want[i], "<u4").tobytes()
        assert (checked[i]["start"], checked[i]["n_tokens"], checked[i]["ids_crc32"]) == (start, len(want[i]), zlib.crc32(data))
        assert bytes(rebuilt[i]["ids"]) == data
        start += len(want[i])
    manifest = spark.read.parquet(f"{folder}/manifest")
    assert manifest.agg(F.sum("tokens")).first()[0] == start
    keys = spark.read.parquet(f"{folder}/objects").filter("kind = 'chunk'")
    assert keys.count() == keys.select("key").distinct().count()


@pytest.fixture(scope="module")
def store(spark):
    docs = spark.createDataFrame([(i, f"some words here {i} " + "and more " * 100 * (i % 3)) for i in range(300)], "doc_id long, text string")
    return token_store.write_store(docs.repartition(4), WORDS, 1)


DAMAGE = {
    "chunk bytes": ("objects", lambda d: d.withColumn("ids", F.when((F.col("kind") == "chunk"), F.concat("ids", F.lit(b"\x01\x00"))).otherwise(F.col("ids"))), "damaged"),
    "missing chunk": ("objects", lambda d: d.filter((F.col("kind") != "chunk") | (F.hex("key").substr(1, 1) != "A")), "missing"),
    "missing recipe": ("recipes", lambda d: d.filter("doc_id <> 17"), "differ"),
    "sizes": ("recipes", lambda d: d.withColumn("sizes", F.expr("unhex(replace(hex(sizes), '0000000', '0000001'))")), "differ"),
    "n_tokens": ("recipes", lambda d: d.withColumn("n_tokens", F.expr("n_tokens + if(doc_id = 7, 7, 0)")), "differ"),
    "doc_id": ("recipes", lambda d: d.withColumn("doc_id", F.col("doc_id") + 1000), "differ"),
    "start": ("recipes", lambda d: d.withColumn("start", F.col("start") + 1), "differ"),
    "manifest": ("manifest", lambda d: d.filter("block < 0"), "differ"),
}


@pytest.mark.parametrize("kind", sorted(DAMAGE))
def test_damage_is_found(spark, store, tmp_path, kind):
    table, change, message = DAMAGE[kind]
    broken = str(tmp_path / "store")
    shutil.copytree(store, broken)
    shutil.rmtree(f"{broken}/{table}")
    changed = change(spark.read.parquet(f"{store}/{table}")).withColumn("__file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    for file in [r[0] for r in changed.select("__file").distinct().collect()]:  # each file keeps its name
        rows = changed.filter(F.col("__file") == file).drop("__file")
        (rows.write.partitionBy("kind") if table == "objects" else rows.coalesce(1).write).parquet(f"{tmp_path}/{file}")
        for part in Path(f"{tmp_path}/{file}").rglob("part-*"):
            target = Path(broken, table, part.relative_to(f"{tmp_path}/{file}").parent)
            target.mkdir(parents=True, exist_ok=True)
            shutil.copy(part, target / (file if table != "objects" else part.name))
    Path(broken, table).mkdir(exist_ok=True)
    for read in (token_store.verify_documents, token_store.read_documents):
        with pytest.raises(Exception, match=message):
            read(spark, broken).collect()


def test_lost_recipe_file_is_found(spark, store, tmp_path):
    broken = str(tmp_path / "store")
    shutil.copytree(store, broken)
    assert token_store.verify_documents(spark, broken).count() == 300
    next(Path(broken, "recipes").glob("part-*")).unlink()
    with pytest.raises(Exception, match="differ"):
        token_store.verify_documents(spark, broken).collect()


def test_crc_of_parts():
    data, cut = bytes(range(256)) * 5, 333
    parts = np.array([zlib.crc32(data[:cut]), zlib.crc32(data[cut:])])
    moved = token_store.crc32_shift(parts, np.array([len(data) - cut, 0]))
    assert moved[0] ^ moved[1] == zlib.crc32(data)


def test_cut_points_follow_content():
    r = np.random.default_rng(2)
    ids = r.integers(0, 49000, 20000).astype("<u2")
    ends = np.array(token_store.stream_cuts(ids, np.array([len(ids)]))[0])
    sizes = np.diff(ends, prepend=0)
    assert sizes.sum() == len(ids) and (sizes[:-1] >= token_store.LEAST_IDS).all() and (sizes <= token_store.MOST_IDS).all()
    moved = np.array(token_store.stream_cuts(np.concatenate([ids[:50], ids]), np.array([len(ids) + 50]))[0])
    assert len(set((moved - 50).tolist()) & set(ends.tolist())) > len(ends) * 0.8
    # documents of one stream are cut as each would be alone
    bounds = np.array([3, 3, 5000, 5100, 12345, len(ids)])
    alone = [token_store.stream_cuts(ids[a:b], np.array([b - a]))[0] for a, b in zip([0, *bounds[:-1]], bounds)]
    assert token_store.stream_cuts(ids, bounds) == alone


def test_merkle_root_depends_on_order():
    leaves = [hashlib.md5(bytes([i])).digest() for i in range(5)]
    assert token_store.merkle_root(leaves) != token_store.merkle_root(leaves[::-1]) and token_store.merkle_root([]) != token_store.merkle_root(leaves[:1])


def test_marks_cut_in_columns_equal_cut_marks():
    """Stems and marks of many words at once are those of each word; numbers go up by one as words are met, also behind known ones."""
    from tessella.llm.word_tokens import MARKS, _Index, cut_marks, split_marks

    rng = random.Random(9)
    letters = [*"az09'.,!-_`{~]\\&(/:@[", "é", "ß", "中", "٣", "°", "İ", "\x01", "—"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))).encode() for _ in range(20_000)]
    stems, cut = split_marks(words)
    want = [cut_marks(w) if w[-1] in MARKS else (w, None) for w in words]
    assert stems == [stem for stem, _ in want]
    assert sorted(cut) == [i for i, (_, marks) in enumerate(want) if marks is not None]
    index = _Index([(b"x", 0), (b"y", 1)])
    assert [index[w] for w in (b"z", b"x", b"w", b"z")] == [2, 0, 3, 2]
