"""The corpus pipeline: language, exact copies, near copies, personal data, packing.

``STAGES`` are (name, function) pairs; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame. Each stage works on all rows its predecessor kept. All but the last return the columns of
``documents``, the last one row a piece of a packed sequence.

Cases: nulls, empty texts, ties, repeated rows and empty tables are handled as each operator's module
states; extra columns of any names pass through to the last stage. Surrogates use the key of the session's setting
``tessella.surrogates.key``, or a random one where none is set.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, language, packing, pii, simhash
from tessella.llm.common import new_path, read_table, remove, temporary_tables

#: Words of a shingle; documents of a shingle similarity of 0.8 or more are linked.
SHINGLE_WORDS = 5
SEQUENCE_TOKENS, END_ID = 4096, 2


def _text_and_rest(docs: DataFrame) -> DataFrame:
    """``(text, rest)``: what an operator adds to it can't clash with a column of ``docs``."""
    return docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest"))


def _unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, in order and with their types, some of them changed."""
    values = {c: changed.get(c, F.col("text") if c == "text" else F.col(f"rest.`{c}`")) for c in docs.columns}
    return rows.select(*(v.cast(docs.schema[c].dataType).alias(c) for c, v in values.items()))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are null or without a letter go; a missing ``lang`` takes the predicted one.

    The text decides what goes, never the name of a predicted label. Without a labelled row to learn from nothing is predicted: the same texts go, and ``lang`` stays.
    """
    net = language.fit(docs)
    if net is None:
        return docs.filter(language.has_letter(F.col("text")))
    found = language.predict_language(_text_and_rest(docs), net).filter(language.has_letter(F.col("text")))
    return _unpacked(found, docs, lang=F.coalesce("rest.lang", "lang_pred"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row of least doc_id stays.

    Candidates come from several fingerprints of SimHash; links are pairs of a similarity of 0.8 or more, verified.
    """
    return simhash.drop_similar(docs, SHINGLE_WORDS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates take the place of personal data; ``n_chars`` follows the text."""
    replaced = pii.replace_pii(_text_and_rest(docs), pii.session_key(spark))
    if "n_chars" not in docs.columns:
        return _unpacked(replaced, docs)
    return _unpacked(replaced, docs, n_chars=F.when(F.col("n_entities") > 0, F.length("text")).otherwise(F.col("rest.n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of all documents in sequences of at most 4096, each window in the corpus's own mixture."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=END_ID, length=SEQUENCE_TOKENS)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("surrogates", replace_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express neither the network nor the shingles nor the tokenizer; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet in the shared folder and read again.

    The tables of a stage are removed when it is written, and its result when the next one is; the last one stays.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with temporary_tables(spark):
            done = stage(spark, docs, sf_dir)
            done.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
