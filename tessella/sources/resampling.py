"""Resampling of rasters by a separable windowed sinc (Lanczos, three lobes), as weighted sums.

A table of taps says how much each source column weighs in each new one; a join and a sum give the new
columns, the same over rows the new rows. When an image shrinks the window grows with it, so each source
pixel weighs in about six new ones a direction, whatever the factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.color import pack_rgb

LOBES = 3


def taps(sizes: DataFrame) -> DataFrame:
    """``(image_id, i, k, weight)`` of ``sizes(image_id, n, m)``: the weight of source place k in new place i; they sum to 1 over k."""
    scale = F.col("n") / F.col("m")
    rows = sizes.select("image_id", "n", scale.alias("scale"), F.greatest(scale, F.lit(1.0)).alias("wide"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("i"))
    rows = rows.withColumn("centre", (F.col("i") + 0.5) * F.col("scale"))
    low = F.greatest(F.lit(0), F.floor(F.col("centre") - LOBES * F.col("wide") + 0.5))
    high = F.least(F.col("n"), F.floor(F.col("centre") + LOBES * F.col("wide") + 0.5))
    each = rows.withColumn("k", F.explode(F.sequence(low, high - 1))).withColumn("t", (F.col("k") + 0.5 - F.col("centre")) / F.col("wide"))
    each = each.withColumn("u", F.pi() * F.col("t"))
    bell = F.when(F.col("t") == 0, F.lit(1.0)).when(F.abs("t") >= LOBES, F.lit(0.0)).otherwise(LOBES * F.sin("u") * F.sin(F.col("u") / LOBES) / (F.col("u") * F.col("u")))
    weighed = each.select("image_id", "i", "k", bell.alias("bell"))
    total = weighed.groupBy("image_id", "i").agg(F.sum("bell").alias("total"))
    return weighed.join(total, ["image_id", "i"]).select("image_id", "i", "k", (F.col("bell") / F.col("total")).alias("weight"))


def _whole(value: str) -> Column:
    return F.least(F.greatest(F.floor(F.col(value) + 0.5), F.lit(0)), F.lit(255))


def resample(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """``pixels(image_id, x, y, rgb)`` at the sizes of ``sizes(image_id, width, height, process_width, process_height)``; ``pos`` counts anew.

    Images that keep their size keep their pixels.
    """
    same = (F.col("width") == F.col("process_width")) & (F.col("height") == F.col("process_height"))
    kept = pixels.join(sizes.filter(same).select("image_id", "width"), "image_id").select("image_id", (F.col("y") * F.col("width") + F.col("x")).alias("pos"), "x", "y", "rgb")
    changed = sizes.filter(~same)
    across = taps(changed.select("image_id", F.col("width").alias("n"), F.col("process_width").alias("m")))
    down = taps(changed.select("image_id", F.col("height").alias("n"), F.col("process_height").alias("m")))
    channels = pixels.select("image_id", F.col("x").alias("k"), "y", *(F.shiftright("rgb", s).bitwiseAND(255).alias(c) for c, s in (("r", 16), ("g", 8), ("b", 0))))
    sums = [F.sum(F.col(c) * F.col("weight")).alias(c) for c in "rgb"]
    rows = channels.join(across, ["image_id", "k"]).groupBy("image_id", F.col("i").alias("x"), F.col("y").alias("k")).agg(*sums)
    found = rows.join(down, ["image_id", "k"]).groupBy("image_id", "x", F.col("i").alias("y")).agg(*sums)
    sized = found.join(changed.select("image_id", "process_width"), "image_id")
    packed = pack_rgb(*(_whole(c) for c in "rgb"))
    return kept.unionByName(sized.select("image_id", (F.col("y") * F.col("process_width") + F.col("x")).alias("pos"), "x", "y", packed.alias("rgb")))
