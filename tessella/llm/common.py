"""Shared plumbing of the corpus operators: shared-folder tables, skew-safe joins, prefix sums.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` so that every executor
(and a re-run task) can read them; nothing is kept only in one executor's memory or disk.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows. At most ``1 / HOT_SHARE`` keys
#: can be hot, which is the proven bound of what :func:`join_skewed` broadcasts.
HOT_SHARE = 0.002

#: Rows of hot keys are broadcast up to this many bytes of the column that a join names as their weight.
BROADCAST_BYTES = 4 << 20

#: Bytes of text handled at once inside a Python task.
TEXT_BLOCK_BYTES = 3 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; only local sessions may fall back to a temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="tessella-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


_OPEN: list[list[str]] = []


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that :func:`materialize` writes within; what is read from them must be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str, compression: str = "zstd", keep: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, survives lost executors.

    ``keep``: the table outlives the innermost :func:`temporary_tables`.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    for paths in _OPEN[: -1 if keep else None][-1:]:
        paths.append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_skewed(rows: DataFrame, classes: DataFrame, key: str, size: str, how: str = "inner", sizes: tuple[int | None, int | None] | None = None, weight: str | None = None) -> DataFrame:
    """Joins ``rows`` to ``classes`` (one row a key, ``size`` = rows of that key) without a hot partition.

    Keys with more than ``HOT_SHARE`` of all rows, at most ``1 / HOT_SHARE`` of them, are joined by
    broadcast where their rows already are; only the rest is shuffled by the key. ``classes`` should
    be a stored table, it is read three times. ``sizes``: the sum and the largest of ``size``, if known.
    ``weight``: a column of ``classes`` without a bound on its length; hot keys whose values are longer than
    ``BROADCAST_BYTES`` together are not broadcast but sent once to each part of their dealt rows.
    """
    total, most = sizes or classes.agg(F.sum(size), F.max(size)).first()
    bound = max(1000, int((total or 0) * HOT_SHARE))
    if (most or 0) <= bound:
        return rows.join(classes, key, how)
    hot, cold = classes.filter(F.col(size) > bound), classes.filter(F.col(size) <= bound)
    if weight and (hot.agg(F.sum(F.octet_length(weight))).first()[0] or 0) > BROADCAST_BYTES:
        parts = hot.select(key, F.ceil(F.col(size) / bound).cast("int").alias("__parts"))
        dealt = rows.join(F.broadcast(parts), key).withColumn("__part", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.col("__parts")).cast("int")).drop("__parts")
        sent = hot.join(F.broadcast(parts), key).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
        at_hand = dealt.join(sent, [key, "__part"]).drop("__part")
    else:
        at_hand = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return at_hand.unionByName(rest.select(*at_hand.columns))


def running_total(df: DataFrame, order: list[str], value: str, out: str, name: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one in the total order ``order``.

    Range partitions are sorted and stored with their number; the totals of the partitions (one row
    each, so their number is bounded by the partitioning and not by the data) are summed in one
    small window and added to the running sums inside each partition.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy("__part").agg(F.sum(value).alias("__sum")).select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(F.broadcast(bases), "__part").withColumn(out, (F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")).drop("__part", "__base")


def blocks(texts: list, limit: int = TEXT_BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of ``texts`` (bytes or str) of about ``limit`` bytes at most, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def column_blocks(texts: pa.Array, limit: int = TEXT_BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """:func:`blocks` of an Arrow column, by its texts' bytes; nulls count as empty."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    start = 0
    while start < len(sizes):
        before = int(sizes[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield start, stop
        start = stop


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4; remainder 2 is held out of all learning."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def held_out() -> Column:
    """Whether a row is held out of learning; a row without an id is not, but nothing is learned from it either."""
    return F.coalesce(fold() == 2, F.lit(False)).alias("held_out")


def free_name(df: DataFrame, name: str) -> str:
    """A name for a passing column that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"__{name}{k}" for k in ["", *range(len(taken) + 1)]) if n not in taken)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
