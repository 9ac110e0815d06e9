"""Rasters made by rule, for tests of behaviour at extremes and for benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _grid(spark: SparkSession, width: int, height: int, image_id: int) -> DataFrame:
    at = spark.range(width * height).withColumnRenamed("id", "pos")
    return at.select(F.lit(image_id).cast("long").alias("image_id"), "pos", (F.col("pos") % width).alias("x"), F.floor(F.col("pos") / width).alias("y"))


def _rgb(r: Column | int, g: Column | int, b: Column | int) -> Column:
    one = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("long")
    return one(r) * 65536 + one(g) * 256 + one(b)


def raster(spark: SparkSession, kind: str, width: int, height: int, image_id: int = 0, seed: int = 1) -> DataFrame:
    """``pixels`` of a kind: flat, checkerboard, comb, gradient, noise."""
    x, y = F.col("x"), F.col("y")
    depth = F.lit(height - 2) + F.floor(x / 2) % 2
    colours = {
        "flat": _rgb(128, 64, 32),
        "checkerboard": F.when((x + y) % 2 == 1, _rgb(255, 255, 255)).otherwise(_rgb(0, 0, 0)),
        "comb": F.when((x % 2 == 0) & (y < depth), _rgb(0, 0, 0)).otherwise(_rgb(255, 255, 255)),
        "gradient": _rgb(x * 7 % 256, y * 11 % 256, (x + y) * 13 % 256),
        "noise": F.pmod(F.xxhash64("pos", F.lit(seed)), F.lit(1 << 24)),
    }
    return _grid(spark, width, height, image_id).withColumn("rgb", colours[kind].cast("long"))


def benchmark_palette(spark: SparkSession, colours: int) -> DataFrame:
    """A palette of ``colours`` entries by rule."""
    n = F.col("id")
    return spark.range(colours).select(n.alias("idx"), (n + 1).alias("number"), F.concat(F.lit("colour "), n + 1).alias("name"), _rgb(n * 53 % 256, n * 97 % 256, n * 193 % 256).alias("rgb"))


def benchmark_colours(spark: SparkSession, unique: int) -> DataFrame:
    """``unique`` distinct colours by rule, one pixel each."""
    n = F.col("id")
    return spark.range(unique).select(F.lit(0).cast("long").alias("image_id"), n.alias("pos"), n.alias("x"), F.lit(0).cast("long").alias("y"), (n * 40503 % (1 << 24)).alias("rgb"))
