"""Rasters and palettes seen in the driver's tables, by whole-number arithmetic.

A raster is the relation ``pixels(image_id, pos, x, y, rgb)`` with ``pos = y * width + x``; a palette is
``palette(idx, number, name, rgb)``. All columns but the name are BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _rgb(x: Column, y: Column, user: Column) -> Column:
    k = (F.floor(x / 13) * 3 + F.floor(y / 11) * 5 + F.when(user % 9 == 0, 1).otherwise(0)) % 6
    red, green, blue = k * 45 + user % 4, 250 - k * 40 + user % 5, (k * 85 + 10) % 250
    return (red * 65536 + green * 256 + blue).cast("long")


def event_tiles(spark: SparkSession, sf_dir: str, side: int = 50) -> DataFrame:
    """Many images of ``side`` x ``side`` pixels, one pixel an event; the last may be cut short."""
    area = side * side
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    at = e.select(F.floor(F.col("event_id") / area).alias("image_id"), (F.col("event_id") % area).alias("pos"), "user_id")
    at = at.withColumns({"x": F.col("pos") % side, "y": F.floor(F.col("pos") / side)})
    return at.select("image_id", "pos", "x", "y", _rgb(F.col("x"), F.col("y"), F.col("user_id")).alias("rgb"))


def nation_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 colours, one a nation."""
    n = F.col("n_nationkey").cast("long")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.alias("idx"), (n + 1).alias("number"), F.col("n_name").alias("name"), ((n * 53 % 256) * 65536 + (n * 97 % 256) * 256 + n * 193 % 256).alias("rgb"))


# The same in SQL.
def _rgb_sql() -> str:
    k = "((x // 13) * 3 + (y // 11) * 5 + CASE WHEN user_id % 9 = 0 THEN 1 ELSE 0 END) % 6"
    return f"(({k}) * 45 + user_id % 4) * 65536 + (250 - ({k}) * 40 + user_id % 5) * 256 + (({k}) * 85 + 10) % 250"


TILES_SQL = f"px AS (SELECT image_id, pos, x, y, {_rgb_sql()} AS rgb FROM (SELECT event_id // 2500 AS image_id, event_id % 2500 AS pos, event_id % 50 AS x, event_id % 2500 // 50 AS y, user_id FROM events))"
PALETTE_SQL = "palette AS (SELECT n_nationkey::BIGINT AS idx, n_nationkey::BIGINT + 1 AS number, n_name AS name, (n_nationkey::BIGINT * 53 % 256) * 65536 + (n_nationkey::BIGINT * 97 % 256) * 256 + n_nationkey::BIGINT * 193 % 256 AS rgb FROM nation)"
