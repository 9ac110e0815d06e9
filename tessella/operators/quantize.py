"""Quantization: distinct colours, nearest palette colours, join back.

A palette has at most :data:`MOST_COLOURS` colours, which is checked, so it travels inside the plan as
a literal array: the search for the nearest colour is a generator and a hash aggregation on a packed
``(distance, idx)`` long that stay within the partitioning of the distinct colours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.color import with_distance, with_lab
from tessella.tables import stored

MOST_COLOURS = 256
#: Distances are compared after rounding to this many parts, so engines agree on ties.
PARTS = 1_000_000_000


class PaletteError(ValueError):
    """The palette cannot be used: empty, or too many colours."""


def palette_array(palette: DataFrame) -> Column:
    """The palette as a literal array of structs ``(idx, number, rgb, l2, a2, b2)`` in order of idx."""
    rows = with_lab(palette.select("idx", "number", "rgb"), suffix="2").orderBy("idx").limit(MOST_COLOURS + 1).collect()
    if not rows:
        raise PaletteError("a palette needs at least one colour")
    if len(rows) > MOST_COLOURS:
        raise PaletteError(f"a palette has at most {MOST_COLOURS} colours")
    return F.array(*(F.struct(*(F.lit(r[c]).cast("double" if c in ("l2", "a2", "b2") else "long").alias(c) for c in ("idx", "number", "rgb", "l2", "a2", "b2"))) for r in rows))


def unique_colours(pixels: DataFrame) -> DataFrame:
    """``(image_id, rgb, first_pos, pixels)``: the distinct colours of each image and where they appear first."""
    return pixels.groupBy("image_id", "rgb").agg(F.min("pos").alias("first_pos"), F.count("*").alias("pixels"))


def palette_pairs(colours: DataFrame, palette: DataFrame, distance: str = "delta_e_2000") -> DataFrame:
    """Each row of ``colours(rgb, ...)`` with every palette colour: ``idx``, ``number``, ``palette_rgb`` and ``de``."""
    pairs = with_lab(colours, suffix="1").withColumn("p", F.explode(palette_array(palette)))
    pairs = pairs.select(*colours.columns, "l1", "a1", "b1", "p.idx", "p.number", F.col("p.rgb").alias("palette_rgb"), "p.l2", "p.a2", "p.b2")
    return with_distance(pairs, distance).drop("l1", "a1", "b1", "l2", "a2", "b2")


def _key() -> Column:
    return F.round(F.col("de") * PARTS).cast("long") * MOST_COLOURS + F.col("idx")


def nearest_colours(colours: DataFrame, palette: DataFrame, distance: str = "delta_e_2000") -> DataFrame:
    """``(rgb, idx, de)`` for the distinct ``colours(rgb)``; ties go to the lower palette position."""
    best = palette_pairs(colours.select("rgb").distinct(), palette, distance).groupBy("rgb").agg(F.min(_key()).alias("key"))
    return best.select("rgb", (F.col("key") % MOST_COLOURS).alias("idx"), (F.floor(F.col("key") / MOST_COLOURS) / PARTS).alias("de"))


#: Distinct colours up to which the table of matches is broadcast, counted first (a few megabytes).
BROADCAST_COLOURS = 200_000
#: A colour is hot when it has more than this share of all pixels; at most as many colours as its inverse can be.
HOT_SHARE = 0.002


def quantize(pixels: DataFrame, palette: DataFrame, distance: str = "delta_e_2000") -> DataFrame:
    """``pixels`` with ``idx`` and ``de``: the nearest palette colour of each.

    Colours are matched once each, and the matches stored. While they are few they are broadcast and no pixel
    moves; else hot colours are, and only the other pixels are shuffled by their colour.
    """
    counts = pixels.groupBy("rgb").agg(F.count("*").alias("n"))
    matches = stored(counts.join(nearest_colours(counts, palette, distance).hint("merge"), "rgb"), "colour-matches")
    colours, total, most = matches.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if colours <= BROADCAST_COLOURS:
        return pixels.join(F.broadcast(matches.drop("n")), "rgb")
    bound = max(1000, int(total * HOT_SHARE))
    if most <= bound:
        return pixels.join(matches.drop("n").hint("merge"), "rgb")
    hot, cold = matches.filter(F.col("n") > bound).drop("n"), matches.filter(F.col("n") <= bound).drop("n")
    at_hand = pixels.join(F.broadcast(hot), "rgb")
    rest = pixels.join(F.broadcast(hot.select("rgb")), "rgb", "left_anti").join(cold.hint("merge"), "rgb")
    return at_hand.unionByName(rest)


def ranked_candidates(colours: DataFrame, palette: DataFrame, limit: int = 3, distance: str = "delta_e_2000") -> DataFrame:
    """The ``limit`` nearest palette colours of each distinct colour: ``(rgb, rank, idx, number, de, additional)``."""
    window = Window.partitionBy("rgb").orderBy("key")
    pairs = palette_pairs(colours.select("rgb").distinct(), palette, distance).withColumn("key", _key())
    ranked = pairs.withColumn("rank", F.row_number().over(window).cast("long")).withColumn("nearest", F.min("de").over(Window.partitionBy("rgb")))
    return ranked.filter(F.col("rank") <= limit).select("rgb", "rank", "idx", "number", "de", (F.col("de") - F.col("nearest")).alias("additional"))
