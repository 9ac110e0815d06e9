"""The corpus queries ``opN_<name>``: whole tables in, the contract's columns out."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import byte_bpe, embedding_dedup, exact_dedup, hard_negatives, language, line_dedup, packing, pii, repeats, simhash, token_store, toxicity, vector_codes
from tessella.llm.common import held_out, read_table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path, pattern)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read_table(spark, sf_dir, "documents"), tau=2, width=3, seed=42)
    return found.select("doc_id", "fingerprint", "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=4096)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_decisions(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("dropped_lines").cast("long").alias("n_dropped"), F.array_join(F.col("dropped_lines").cast("array<string>"), ",").alias("dropped_lines"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.replace_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))
    return replaced.select("doc_id", "n_entities", "entities", "text", F.sha2("text", 256).alias("text_sha256"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.write_store(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.verify_documents(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", held_out())
    return language.predict_language(rows, language.fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, scale=256, positives=5, negatives=5, low=80, high=100)


def op12_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeat_spans(read_table(spark, sf_dir, "documents"), length=200, keep="none")
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.vector_codes(read_table(spark, sf_dir, "embeddings"), scale=4096, parts=8, entries=16, rounds=6)
    return vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_surrogates": op8_surrogates,
    "op9_token_store": op9_token_store,
    "op10_language": op10_language,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_suffix_repeats": op12_suffix_repeats,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op3_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_suffix_repeats": repeats.ORACLE_SQL,
    "op13_vector_codes": vector_codes.oracle_sql(),
}
