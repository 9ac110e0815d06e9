"""What quantization loses: palette use, collapsed boundaries, rescue costs, thin structures.

Input is the quantized raster ``(image_id, pos, x, y, rgb, idx, de)`` of
:func:`tessella.operators.quantize.quantize`. Neighbours are found by windows along a row or a column,
so a raster is shuffled once a direction and an image's rows are spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.color import colour_distance

#: Direction -> (columns that stay, column that moves).
LINES = {"horizontal": ("y", "x"), "vertical": ("x", "y")}


def neighbour(columns: list[str], offset: int, orientation: str) -> Column:
    """The columns of the pixel ``offset`` further along a line, as a struct; null where there is none.

    The struct is made after the window: inside it, Spark would shuffle and sort it beside the columns it repeats.
    """
    fixed, moving = LINES[orientation]
    window = Window.partitionBy("image_id", fixed).orderBy(moving).rangeBetween(offset, offset)
    return F.when(F.count(F.lit(1)).over(window) > 0, F.struct(*(F.first(c).over(window).alias(c) for c in columns)))


def source_pixel_counts(quantized: DataFrame) -> DataFrame:
    return quantized.groupBy("image_id", "rgb", "idx").agg(F.count("*").alias("pixels"), F.first("de").alias("de"))


def palette_usage(quantized: DataFrame) -> DataFrame:
    """``(image_id, idx, sources, pixels, fraction)`` of the palette colours in use."""
    used = source_pixel_counts(quantized).groupBy("image_id", "idx").agg(F.count("*").alias("sources"), F.sum("pixels").alias("pixels"))
    return used.withColumn("fraction", F.col("pixels") / F.sum("pixels").over(Window.partitionBy("image_id")))


def palette_utilization(quantized: DataFrame, palette_colours: int) -> DataFrame:
    """One row an image: colours in the palette, in use, their share, distinct sources, pixels."""
    usage = palette_usage(quantized).groupBy("image_id").agg(F.count("*").alias("used_colours"), F.sum("sources").alias("sources"), F.sum("pixels").alias("pixels"))
    return usage.withColumn("palette_colours", F.lit(palette_colours).cast("long")).withColumn("utilization", F.coalesce(F.try_divide(F.col("used_colours"), F.col("palette_colours")), F.lit(0.0)))


def source_spread(quantized: DataFrame) -> DataFrame:
    """Distances of the distinct sources of each palette colour, not weighted by pixels."""
    return source_pixel_counts(quantized).groupBy("image_id", "idx").agg(F.count("*").alias("sources"), F.sum("pixels").alias("pixels"), F.min("de").alias("min_de"), F.max("de").alias("max_de"), F.avg("de").alias("mean_de"))


def adjacent_pairs(quantized: DataFrame) -> DataFrame:
    """Every pixel with its right and its lower neighbour: ``(image_id, x, y, orientation, rgb, idx, n)``."""
    both = quantized.select("image_id", "x", "y", "rgb", "idx", *(neighbour(["rgb", "idx"], 1, o).alias(o) for o in LINES))
    pairs = both.select("image_id", "x", "y", "rgb", "idx", F.explode(F.create_map(*(c for o in LINES for c in (F.lit(o), F.col(o))))).alias("orientation", "n"))
    return pairs.filter("n is not null")


def collapsed_boundaries(quantized: DataFrame) -> DataFrame:
    """Adjacent unequal sources of one palette colour: ``(image_id, first_rgb, second_rgb, idx, length, source_pixels)``."""
    unequal = adjacent_pairs(quantized).filter("n.idx = idx and n.rgb <> rgb")
    pairs = unequal.groupBy("image_id", F.least("rgb", "n.rgb").alias("first_rgb"), F.greatest("rgb", "n.rgb").alias("second_rgb"), "idx").agg(F.count("*").alias("length"))
    counts = quantized.groupBy("image_id", "rgb").agg(F.count("*").alias("pixels"))
    for side in ("first", "second"):
        pairs = pairs.join(counts.select("image_id", F.col("rgb").alias(f"{side}_rgb"), F.col("pixels").alias(f"{side}_pixels")), ["image_id", f"{side}_rgb"])
    return pairs.select("image_id", "first_rgb", "second_rgb", "idx", "length", (F.col("first_pixels") + F.col("second_pixels")).alias("source_pixels"))


def rescue_diagnostics(boundaries: DataFrame, candidates: DataFrame, distance: str = "delta_e_2000") -> DataFrame:
    """Boundaries with their source distance and, for each side, the cheapest other palette colour among the candidates (null if none)."""
    out = colour_distance(boundaries, "first_rgb", "second_rgb", "source_de", distance)
    current = boundaries.select(F.explode(F.array("first_rgb", "second_rgb")).alias("rgb"), "idx").distinct().withColumnRenamed("idx", "own")
    other = candidates.join(current, "rgb").filter("idx <> own").groupBy("rgb", "own").agg(F.min(F.struct("rank", "idx", "additional")).alias("best"))
    for side in ("first", "second"):
        named = other.select(F.col("rgb").alias(f"{side}_rgb"), F.col("own").alias("idx"), F.col("best.idx").alias(f"{side}_alternative"), F.col("best.additional").alias(f"{side}_cost"))
        out = out.join(named, [f"{side}_rgb", "idx"], "left")
    return out.withColumn("rescue_cost", F.least("first_cost", "second_cost"))


def ranked_rescues(diagnostics: DataFrame, threshold: float = 5.0, by: str = "cost") -> DataFrame:
    """Boundaries whose sources differ by more than ``threshold``, numbered within their image by rescue cost or by boundary length."""
    cost, length = F.asc_nulls_last(F.round("rescue_cost", 6)), F.desc("length")
    first = [cost, length] if by == "cost" else [length, cost]
    window = Window.partitionBy("image_id").orderBy(*first, F.desc(F.round("source_de", 6)), F.desc("source_pixels"), "idx", "first_rgb", "second_rgb")
    return diagnostics.filter(F.col("source_de") > threshold).withColumn("rank", F.row_number().over(window).cast("long"))


def rescue_summary(diagnostics: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Counts and boundary lengths by rescue cost, one row an image."""
    far, cost = F.col("source_de") > threshold, F.col("rescue_cost")
    classes = {"all": F.lit(True), "low": ~far, "meaningful": far, "cost_le_1": far & (cost <= 1), "cost_le_2": far & (cost <= 2), "cost_le_5": far & (cost <= 5), "expensive": far & (cost > 5), "unavailable": far & cost.isNull()}
    counts = [F.count_if(c).alias(f"{n}_count") for n, c in classes.items()]
    lengths = [F.coalesce(F.sum(F.when(c, F.col("length"))), F.lit(0)).alias(f"{n}_length") for n, c in classes.items()]
    return diagnostics.groupBy("image_id").agg(*counts, *lengths)


def offset_pairs(quantized: DataFrame, offsets: list[int], threshold: float = 5.0, distance: str = "delta_e_2000") -> DataFrame:
    """Pixels and those some offset right of or below them, of one palette colour and more than ``threshold`` apart."""
    parts = []
    for o in LINES:
        rows = quantized.select("image_id", "x", "y", "rgb", "idx", *(neighbour(["rgb", "idx"], k, o).alias(f"n_{k}") for k in offsets))
        at = [F.struct(F.lit(k).cast("long").alias("offset_px"), F.col(f"n_{k}").alias("n")) for k in offsets]
        rows = rows.select("image_id", "x", "y", "rgb", "idx", F.inline(F.array(*at))).filter("n.idx = idx and n.rgb <> rgb")
        parts.append(rows.select("image_id", "offset_px", F.lit(o).alias("orientation"), "x", "y", "rgb", F.col("n.rgb").alias("other_rgb"), "idx"))
    return _with_distances(parts[0].unionAll(parts[1]), [("rgb", "other_rgb", "de", F.col("de") > threshold)], distance)


def _with_distances(rows: DataFrame, wanted: list[tuple[str, str, str, Column]], distance: str) -> DataFrame:
    """Adds the distances of pairs of colour columns, each only to the rows that the conditions before it kept; this costs no shuffle."""
    for first, second, out, kept in wanted:
        rows = colour_distance(rows, first, second, out, distance).filter(kept)
    return rows


def offset_summary(pairs: DataFrame, offsets: list[int], images: DataFrame) -> DataFrame:
    """A row for each image and offset: pairs and their least, greatest and mean distance (null without pairs)."""
    grid = images.select("image_id").distinct().withColumn("offset_px", F.explode(F.array(*(F.lit(o).cast("long") for o in offsets))))
    stats = pairs.groupBy("image_id", "offset_px").agg(F.count("*").alias("n"), F.min("de").alias("min_de"), F.max("de").alias("max_de"), F.avg("de").alias("mean_de"))
    return grid.join(stats.hint("merge"), ["image_id", "offset_px"], "left").select("image_id", "offset_px", F.coalesce("n", F.lit(0)).alias("pairs"), "min_de", "max_de", "mean_de")


def center_surround(quantized: DataFrame, offsets: list[int], background: float = 5.0, center: float = 5.0, distance: str = "delta_e_2000") -> DataFrame:
    """Centres unlike both pixels some offset away on a line, which are alike, all three of one palette colour."""
    parts = []
    for o in LINES:
        sides = [neighbour(["rgb", "idx"], sign * k, o).alias(f"{side}_{k}") for k in offsets for side, sign in (("a", -1), ("b", 1))]
        rows = quantized.select("image_id", "x", "y", F.col("rgb").alias("center_rgb"), "idx", *sides)
        at = [F.struct(F.lit(k).cast("long").alias("offset_px"), F.col(f"a_{k}").alias("a"), F.col(f"b_{k}").alias("b")) for k in offsets]
        rows = rows.select("image_id", "x", "y", "center_rgb", "idx", F.inline(F.array(*at)))
        rows = rows.filter("a.idx = idx and b.idx = idx and a.rgb <> center_rgb and b.rgb <> center_rgb")
        parts.append(rows.select("image_id", "offset_px", F.lit(o).alias("orientation"), "x", "y", "center_rgb", F.col("a.rgb").alias("first_rgb"), F.col("b.rgb").alias("second_rgb"), "idx"))
    wanted = [("center_rgb", "first_rgb", "first_de", F.col("first_de") > center), ("center_rgb", "second_rgb", "second_de", F.col("second_de") > center), ("first_rgb", "second_rgb", "background_de", F.col("background_de") <= background)]
    rows = _with_distances(parts[0].unionAll(parts[1]), wanted, distance)
    return rows.select("image_id", "offset_px", "orientation", "x", "y", "center_rgb", "first_rgb", "second_rgb", "idx", "background_de", "first_de", "second_de")


def center_surround_summary(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("image_id", "offset_px").agg(F.count("*").alias("candidates"), F.count_distinct("x", "y").alias("centers"), F.count_if(F.col("orientation") == "horizontal").alias("horizontal"), F.count_if(F.col("orientation") == "vertical").alias("vertical"))


def center_surround_persistence(candidates: DataFrame, least_offsets: int = 2) -> DataFrame:
    """Centres found at ``least_offsets`` distinct offsets or more."""
    found = candidates.groupBy("image_id", "x", "y").agg(F.sort_array(F.collect_set("offset_px")).alias("offsets"), F.count("*").alias("candidates"), F.count_if(F.col("orientation") == "horizontal").alias("horizontal"), F.count_if(F.col("orientation") == "vertical").alias("vertical"))
    return found.filter(F.size("offsets") >= least_offsets)


def persistence_histogram(persistent: DataFrame) -> DataFrame:
    return persistent.groupBy("image_id", F.size("offsets").cast("long").alias("support")).agg(F.count("*").alias("centers"))


def boundary_edges(quantized: DataFrame, diagnostics: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Unit edges between collapsed sources more than ``threshold`` apart, with the grid points they join."""
    meaningful = diagnostics.filter(F.col("source_de") > threshold).select("image_id", "first_rgb", "second_rgb", "idx", "source_de", "rescue_cost")
    edges = adjacent_pairs(quantized).filter("n.idx = idx and n.rgb <> rgb").withColumns({"first_rgb": F.least("rgb", "n.rgb"), "second_rgb": F.greatest("rgb", "n.rgb")})
    right = F.col("orientation") == "horizontal"
    points = edges.withColumns({"x1": F.when(right, F.col("x") + 1).otherwise(F.col("x")), "y1": F.when(right, F.col("y")).otherwise(F.col("y") + 1), "x2": F.col("x") + 1, "y2": F.col("y") + 1})
    return points.join(meaningful, ["image_id", "first_rgb", "second_rgb", "idx"]).select("image_id", "orientation", "x", "y", "x1", "y1", "x2", "y2", "idx", "source_de", "rescue_cost")
