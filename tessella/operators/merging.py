"""Costs of merging a region into a neighbour, from borders and region measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.color import with_distance, with_lab
from tessella.functions.steps import Steps, apply_steps

# Weights (colour, area, border, geometry) by name, and the colour scale.
WEIGHTS = {"production": (0.40, 0.25, 0.15, 0.20), "colour-focused": (0.60, 0.15, 0.15, 0.10)}
COLOUR_SCALE = 10.0
ENCLOSURE, COMPACTNESS = 0.50, 0.15
# Weightings compared by experiments: name, colour scale and the four weights.
STRATEGIES = [
    ("balanced-c10", 10.0, 0.40, 0.20, 0.20, 0.20),
    ("balanced-c25", 25.0, 0.40, 0.20, 0.20, 0.20),
    ("color-focused-c10", 10.0, 0.60, 0.15, 0.15, 0.10),
    ("color-focused-c25", 25.0, 0.60, 0.15, 0.15, 0.10),
    ("geometry-focused-c10", 10.0, 0.40, 0.15, 0.15, 0.30),
    ("geometry-focused-c25", 25.0, 0.40, 0.15, 0.15, 0.30),
]
LOW_COST_SHARE = 0.10

#: Derived measures of a candidate from de, source_area, target_area, border, source_perimeter and target_perimeter.
DERIVED: Steps = [
    {"merged_area": "source_area + target_area", "merged_perimeter": "source_perimeter + target_perimeter - 2 * border"},
    {
        "area_ratio": "source_area * 1e0 / merged_area",
        "source_border_ratio": "border * 1e0 / source_perimeter",
        "target_border_ratio": "border * 1e0 / target_perimeter",
        "source_compactness": "least(1e0, 4e0 * pi() * source_area / (source_perimeter * 1e0 * source_perimeter))",
        "target_complexity": "target_perimeter * 1e0 * target_perimeter / target_area",
        "merged_complexity": "merged_perimeter * 1e0 * merged_perimeter / merged_area",
    },
    {"complexity_change": "merged_complexity - target_complexity"},
    {"border_penalty": "1e0 - source_border_ratio", "worse": "greatest(0e0, complexity_change)"},
    {"geometry_penalty": "CASE WHEN worse = 0e0 THEN 0e0 ELSE worse / (target_complexity + worse) END"},
]
MEASURES = ["merged_area", "merged_perimeter", "area_ratio", "source_border_ratio", "target_border_ratio", "source_compactness", "target_complexity", "merged_complexity", "complexity_change"]


def check_weights(weights: tuple[float, ...]) -> tuple[float, ...]:
    if len(weights) != 4 or any(not 0 <= w < float("inf") for w in weights) or abs(sum(weights) - 1) > 1e-12:
        raise ValueError("weights must be four finite numbers of at least 0 that sum to 1")
    return weights


def cost_steps(weights: tuple[float, ...] = WEIGHTS["production"], enclosure: float = ENCLOSURE, compactness: float = COMPACTNESS) -> Steps:
    """Penalties, weighted base cost, and the cost after the enclosure and then the compactness adjustment."""
    c, a, b, g = check_weights(weights)
    return [
        {"color_penalty": f"de / (de + {COLOUR_SCALE}e0)"},
        {"base_cost": f"{c}e0 * color_penalty + {a}e0 * area_ratio + {b}e0 * border_penalty + {g}e0 * geometry_penalty", "protect": "color_penalty * (1e0 - area_ratio)"},
        {"enclosed_cost": f"base_cost + {enclosure}e0 * source_border_ratio * protect * (1e0 - base_cost)"},
        {"cost": f"enclosed_cost + {compactness}e0 * (1e0 - source_compactness) * protect * (1e0 - enclosed_cost)"},
    ]


COSTS = ["color_penalty", "border_penalty", "geometry_penalty", "base_cost", "enclosed_cost", "cost"]


def candidates(regions: DataFrame, borders: DataFrame, palette: DataFrame, distance: str = "delta_e_2000", touching: DataFrame | None = None) -> DataFrame:
    """Directed merge candidates with their raw measures and derived ones.

    ``touching(image_id, region_id)``: only candidates with an end in it.
    """
    if touching is not None:
        ends = borders.select("image_id", "src", "dst", F.explode(F.array("src", "dst")).alias("region_id"))
        kept = ends.join(touching.select("image_id", "region_id").distinct().hint("merge"), ["image_id", "region_id"], "left_semi").select("image_id", "src", "dst").distinct()
        borders = borders.join(kept.hint("merge"), ["image_id", "src", "dst"], "left_semi")
    measured = lambda side, end: regions.select("image_id", F.col("region_id").alias(end), F.col("idx").alias(f"{side}_idx"), F.col("area").alias(f"{side}_area"), F.col("perimeter").alias(f"{side}_perimeter"))
    rows = borders.withColumnRenamed("length", "border").join(measured("source", "src").hint("merge"), ["image_id", "src"]).join(measured("target", "dst").hint("merge"), ["image_id", "dst"])
    colours = palette_distances(palette, distance)
    rows = rows.join(F.broadcast(colours), ["source_idx", "target_idx"])  # at most 256 x 256 rows
    return apply_steps(rows, DERIVED, [*MEASURES, "border_penalty", "geometry_penalty"]).withColumnsRenamed({"src": "source_id", "dst": "target_id"})


def union_measures(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(image_id, src, dst)`` with ``union_area`` and ``union_perimeter`` of regions that may share pixels.

    A side of a region's pixel counts if neither region lies beyond it: what the other region covers of
    each one's sides comes off, and sides that both have count once. No pixel is sent once a pair.
    """
    offsets = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    own = members.select("image_id", "region_id", "x", "y").distinct()
    sides = own.select("image_id", "region_id", "x", "y", F.explode(offsets).alias("o")).select("image_id", "region_id", "x", "y", (F.col("x") + F.col("o.dx")).alias("nx"), (F.col("y") + F.col("o.dy")).alias("ny"))
    beyond = own.select("image_id", "region_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    open_ = sides.join(beyond, ["image_id", "region_id", "nx", "ny"], "left_anti")
    sizes = own.groupBy("image_id", "region_id").agg(F.count("*").alias("area")).join(open_.groupBy("image_id", "region_id").agg(F.count("*").alias("perimeter")), ["image_id", "region_id"])
    named = lambda df, name: df.withColumnRenamed("region_id", name)
    count = lambda met, name: met.filter("src <> dst").groupBy("image_id", "src", "dst").agg(F.count("*").alias(name))
    shared = count(named(own, "src").join(named(own, "dst"), ["image_id", "x", "y"]), "shared")
    covered = count(named(open_, "src").join(named(beyond, "dst"), ["image_id", "nx", "ny"]), "covered")
    common = count(named(open_, "src").join(named(open_, "dst"), ["image_id", "x", "y", "nx", "ny"]), "common")
    back = covered.select("image_id", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("covered").alias("covered_back"))
    key = ["image_id", "src", "dst"]
    rows = pairs.select(*key).distinct()
    for end in ("src", "dst"):
        rows = rows.join(sizes.select("image_id", F.col("region_id").alias(end), F.col("area").alias(f"{end}_area"), F.col("perimeter").alias(f"{end}_perimeter")), ["image_id", end])
    for table in (shared, covered, back, common):
        rows = rows.join(table, key, "left")
    rows = rows.fillna(0, ["shared", "covered", "covered_back", "common"])
    return rows.select(*key, F.expr("src_area + dst_area - shared").alias("union_area"), F.expr("src_perimeter + dst_perimeter - covered - covered_back - common").alias("union_perimeter"))


def palette_distances(palette: DataFrame, distance: str = "delta_e_2000") -> DataFrame:
    """``(source_idx, target_idx, de)`` of all pairs of palette colours; a palette has 256 at most."""
    lab = with_lab(palette.select("idx", "rgb"))
    a = lab.select(F.col("idx").alias("source_idx"), F.col("l").alias("l1"), F.col("a").alias("a1"), F.col("b").alias("b1"))
    b = lab.select(F.col("idx").alias("target_idx"), F.col("l").alias("l2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    return with_distance(a.crossJoin(F.broadcast(b)), distance).select("source_idx", "target_idx", "de")


def costed(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS["production"], enclosure: float = ENCLOSURE, compactness: float = COMPACTNESS) -> DataFrame:
    return apply_steps(rows, cost_steps(weights, enclosure, compactness), [c for c in COSTS if c not in rows.columns])


def ranked(rows: DataFrame, cost: str = "cost") -> DataFrame:
    """``rank`` within the image by (cost, source, target); costs are compared after rounding to 9 places."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.round(cost, 9), "source_id", "target_id")).cast("long"))


def protected_cost(strength: float, kind: str = "enclosure", cost: str = "base_cost") -> Column:
    """One protection of a given strength on top of a cost."""
    shape = F.col("source_border_ratio") if kind == "enclosure" else 1 - F.col("source_compactness")
    return F.col(cost) + F.lit(strength) * shape * F.col("color_penalty") * (1 - F.col("area_ratio")) * (1 - F.col(cost))


def strategy_scores(rows: DataFrame) -> DataFrame:
    """Every candidate under every experimental weighting: ``strategy`` and ``score``."""
    table = F.array(*(F.struct(F.lit(n).alias("strategy"), *(F.lit(v).alias(k) for k, v in zip(("scale", "c", "a", "b", "g"), values))) for n, *values in STRATEGIES))
    s = rows.withColumn("s", F.explode(table))
    color = F.col("de") / (F.col("de") + F.col("s.scale"))
    total = F.col("s.c") + F.col("s.a") + F.col("s.b") + F.col("s.g")
    score = (color * F.col("s.c") + F.col("area_ratio") * F.col("s.a") + F.col("border_penalty") * F.col("s.b") + F.col("geometry_penalty") * F.col("s.g")) / total
    return s.withColumns({"strategy": F.col("s.strategy"), "score": score}).drop("s")


def strategy_cohorts(scored: DataFrame) -> DataFrame:
    """Means over the tenth of candidates with the lowest score (one at least), by image and strategy."""
    group = Window.partitionBy("image_id", "strategy")
    rows = scored.withColumns({"r": F.row_number().over(group.orderBy(F.round("score", 9), "source_id", "target_id")), "n": F.count("*").over(group)})
    low = rows.filter(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * LOW_COST_SHARE)))
    return low.groupBy("image_id", "strategy").agg(F.count("*").alias("cohort"), F.avg("de").alias("mean_de"), F.avg("area_ratio").alias("mean_area_ratio"), F.avg("source_border_ratio").alias("mean_border_ratio"), F.avg("complexity_change").alias("mean_complexity_change"), F.max("score").alias("max_score"))


def neighbour_contrast(rows: DataFrame) -> DataFrame:
    """All neighbours of each source: coverage of its perimeter, shares of borders, colour contrast plain and by border length."""
    length = F.col("border")
    stats = rows.groupBy("image_id", "source_id").agg(
        F.count("*").alias("neighbours"), F.sum(length).alias("total_border"), F.max(length).alias("longest"), F.max("source_perimeter").alias("perimeter"),
        F.min("de").alias("min_de"), F.max("de").alias("max_de"), F.avg("de").alias("mean_de"),
        F.sum(length * F.col("de")).alias("weighted"), F.sum(length * F.col("de") / (F.col("de") + COLOUR_SCALE)).alias("penalty"),
    )
    total = F.col("total_border")
    return stats.select("image_id", "source_id", "neighbours", "total_border", (total / F.col("perimeter")).alias("coverage"), (F.col("longest") / total).alias("dominant_share"), "min_de", "max_de", "mean_de", (F.col("weighted") / total).alias("weighted_de"), (F.col("penalty") / total).alias("weighted_penalty"))


def fragile_details(regions: DataFrame, rows: DataFrame, diameter: int, contrast: float = 5.0) -> DataFrame:
    """Small (three disc areas at most) or stretched regions that stand out from every neighbour."""
    import math

    least = rows.groupBy("image_id", F.col("source_id").alias("region_id")).agg(F.min("de").alias("min_de"))
    roundness = 4 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter"))
    small = (F.col("area") <= 3 * math.pi * (diameter / 2) ** 2) | (roundness <= 0.30)
    return regions.join(least.hint("merge"), ["image_id", "region_id"]).filter(small & (F.col("min_de") >= contrast)).select("image_id", "region_id", "area", "perimeter", "min_de")


def metric_distributions(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Count, least, greatest and interpolated percentiles of each measure, one row a measure."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select("m.*")
    at = [0.05, 0.25, 0.5, 0.75, 0.95]
    out = long.groupBy("metric").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.percentile("value", F.array(*map(F.lit, at))).alias("p"), F.max("value").alias("greatest"))
    return out.select("metric", "n", "least", *(F.col("p")[i].alias(f"p{int(v * 100):02d}") for i, v in enumerate(at)), "greatest")
