"""Exact duplicates by 128-bit content hash, confirmed by comparing bytes. DataFrame operations only.

Rows are grouped by the 128-bit hash of their normalised text. The row with the longest original
text, then the least id, represents its group. Whether a hash covers one text or several is decided
on the bytes: the distinct (hash, normalised text) pairs are formed with map-side combining, so
copies collapse before the shuffle, and a hash with more than one text is split by text.

Cases: null counts as the empty text, and all empty or blank-only texts are one group; ties go to the
least id; rows repeated with the same id are one kept row and its copies are not kept apart (they
share ``keep_id``); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import free_name, join_skewed, materialize

#: ASCII white space, as a Java character class.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def content_hash(text: Column) -> Column:
    """128 bits of the text, as 32 hexadecimal digits."""
    return F.md5(text.cast("binary"))


def collided_hashes(docs: DataFrame) -> DataFrame:
    """Hashes that more than one normalised text shares, by the bytes themselves."""
    pairs = docs.select(normalised().alias("norm")).select(content_hash(F.col("norm")).alias("h"), "norm").distinct()
    return pairs.groupBy("h").count().filter("count > 1").select("h")


def exact_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs(doc_id, text)``.

    Texts cross the network once, as distinct (hash, text) pairs; all else is narrow. Groups that
    hold a large share of the rows are joined by broadcast of their single representative.
    """
    texts = docs.select("doc_id", "text").withColumn("norm", normalised())
    rows = texts.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), content_hash(F.col("norm")).alias("h"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    rows = materialize(rows, "exact-rows")
    collided = materialize(collided_hashes(docs), "exact-collided")
    # within a collided hash the second, independent digest tells the texts apart
    rows = rows.join(F.broadcast(collided.withColumn("split", F.lit(True))) if not collided.head(1) else collided.withColumn("split", F.lit(True)), "h", "left")
    rows = rows.withColumn("class", F.when(F.col("split"), F.concat("h", "text_sha256")).otherwise(F.col("h")))
    best = F.max(F.struct("size", (-F.col("doc_id")).alias("minus"), "doc_id"))
    groups = rows.groupBy("class").agg(best["doc_id"].alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialize(groups, "exact-groups")
    out = join_skewed(rows, groups, "class", "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with all their columns; of rows repeated with one id and text, one stays."""
    id_, own, sha = (free_name(docs, n) for n in ("id", "own", "sha"))
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).distinct()
    rows = docs.withColumn(own, F.sha2(normalised().cast("binary"), 256))
    rows = rows.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(sha)), "left_semi")
    return rows.dropDuplicates(["doc_id", own]).drop(own)


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY size DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY size DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
