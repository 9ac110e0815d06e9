"""Leader clusters of colours: each joins the earliest leader within a threshold, or leads itself.

Taken one by one, a colour leads if no earlier leader is near it: the leaders are the first independent set
in order of appearance. Rounds find them without that order: an open colour with no earlier open one near
it leads, and what is near it is covered; both leave. At least the earliest open colour of each image leads
in a round, and most colours leave in the first few. Near pairs come from cells in Lab; how many a colour
has is bounded by the colours that fit in its cells, not by the image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.color import with_distance
from tessella.tables import stored

_KEY = ["image_id", "pos"]


def lab_reach(distance: str, threshold: float) -> tuple[float, float]:
    """How far apart two colours within the threshold can be in lightness, and in the plane of a and b.

    For CIEDE2000: its lightness weight stays below 1.75, its rotation term takes at most a factor of
    1 - sqrt(3) / 2 off the squares of chroma and hue, and their weights grow with a chroma of 200 at most (a scaled by 1.5).
    """
    if distance == "delta_e_76":
        return threshold, threshold
    loosened = threshold / (1 - 3**0.5 / 2) ** 0.5
    return 1.75 * threshold, loosened * ((1 + 0.045 * 200) ** 2 + (1 + 0.015 * 200 * 1.93) ** 2) ** 0.5


def near_pairs(colours: DataFrame, threshold: float, distance: str = "delta_e_76") -> DataFrame:
    """``(image_id, pos, earlier)``: colours, by where they appear first, with each earlier one within the threshold."""
    dl, dab = (max(r, 1e-6) for r in lab_reach(distance, threshold))
    cell = lambda c, side: F.floor(F.col(c) / side)
    own = colours.select("image_id", F.col("first_pos").alias("pos"), "l", "a", "b", cell("l", dl).alias("cl"), cell("a", dab).alias("ca"), cell("b", dab).alias("cb"))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    asked = own.select("image_id", F.col("pos").alias("earlier"), F.col("l").alias("l2"), F.col("a").alias("a2"), F.col("b").alias("b2"), "cl", "ca", "cb", F.explode(steps).alias("s"))
    asked = asked.select("image_id", "earlier", "l2", "a2", "b2", *((F.col(c) + F.col(f"s.{s}")).alias(c) for c, s in (("cl", "i"), ("ca", "j"), ("cb", "k"))))
    met = own.withColumnsRenamed({"l": "l1", "a": "a1", "b": "b1"}).join(asked.hint("merge"), ["image_id", "cl", "ca", "cb"]).filter("earlier < pos")
    if distance == "delta_e_76":
        return met.filter(f"(l1 - l2) * (l1 - l2) + (a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2) <= {threshold * threshold!r}D").select(*_KEY, "earlier")
    return with_distance(met, distance).filter(F.col("de") <= threshold).select(*_KEY, "earlier")


def leader_clusters(colours: DataFrame, threshold: float, distance: str = "delta_e_76") -> DataFrame:
    """``colours(image_id, rgb, first_pos, l, a, b)`` as ``(image_id, rgb, leader)``: the earliest leader within the threshold, else itself."""
    if threshold < 0:
        raise ValueError("a threshold is at least 0")
    colours = stored(colours.select("image_id", "rgb", "first_pos", "l", "a", "b"), "leader-colours")
    pairs = stored(near_pairs(colours, threshold, distance), "leader-pairs")
    alone = colours.select("image_id", F.col("first_pos").alias("pos")).join(pairs.select(*_KEY).distinct().hint("merge"), _KEY, "left_anti")
    leaders, left = [stored(alone, "leaders")], pairs
    fresh = leaders[0]
    while True:
        # what has a leader before it is covered; pairs of what is settled leave
        led = left.join(fresh.select("image_id", F.col("pos").alias("earlier")).hint("merge"), ["image_id", "earlier"], "left_semi").select(*_KEY).distinct()
        led = stored(led, "leader-covered")
        left = left.join(led.hint("merge"), _KEY, "left_anti")
        open_ = stored(left, "leader-open")  # later colours are open; earlier ones open or covered just now
        if not open_.head(1):
            break
        gone = led.select("image_id", F.col("pos").alias("earlier"))
        left = stored(open_.join(gone.hint("merge"), ["image_id", "earlier"], "left_anti"), "leader-left")
        # a colour all of whose earlier neighbours are covered leads
        fresh = stored(open_.select(*_KEY).distinct().join(left.select(*_KEY).distinct().hint("merge"), _KEY, "left_anti"), "leaders")
        leaders.append(fresh)
    every = leaders[0]
    for more in leaders[1:]:
        every = every.unionByName(more)
    first = pairs.join(every.select("image_id", F.col("pos").alias("earlier")).hint("merge"), ["image_id", "earlier"], "left_semi").groupBy(*_KEY).agg(F.min("earlier").alias("first"))
    named = colours.select("image_id", F.col("first_pos").alias("pos"), "rgb").join(first.hint("merge"), _KEY, "left").withColumn("first", F.coalesce("first", "pos"))
    return named.select("image_id", "rgb", "first").join(colours.select("image_id", F.col("first_pos").alias("first"), F.col("rgb").alias("leader")).hint("merge"), ["image_id", "first"]).select("image_id", "rgb", "leader")
