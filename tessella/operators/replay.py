"""Accepted merges looked at again: what source, target and neighbours were at each step.

A trace says which region joined which, and when. A region's owner changes with the steps, so its owners are
versions with a first and a last step; measures at a step come from the versions that hold then. A region is
the source of one merge at most, so a source's members are met once a merge; a target's measures are running
sums over its merges. No region is put together again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.steps import apply_steps
from tessella.operators.merging import DERIVED, MEASURES, costed, neighbour_contrast, palette_distances
from tessella.tables import stored

#: After all steps.
LAST = (1 << 31) - 1
_BOX = ["min_x", "min_y", "max_x", "max_y"]


def owners(regions: DataFrame, trace: DataFrame) -> DataFrame:
    """``(image_id, region_id, owner, since, until)``: who holds a region from after step ``since`` up to before step ``until``.

    One round for each merge on a region's way; a way is as long as the merges are nested.
    """
    gone = trace.select("image_id", F.col("source_id").alias("owner"), F.col("target_id").alias("next"), F.col("step").alias("at"))
    own = regions.select("image_id", "region_id", F.col("region_id").alias("owner"), F.lit(0).cast("long").alias("since"))
    found = None
    while True:
        ended = stored(own.join(gone, ["image_id", "owner"], "left").withColumn("until", F.coalesce("at", F.lit(LAST))), "owner-versions")
        part = ended.select("image_id", "region_id", "owner", "since", "until")
        found = part if found is None else found.unionByName(part)
        moved = ended.filter("at is not null")
        if not moved.head(1):
            return found
        own = moved.select("image_id", "region_id", F.col("next").alias("owner"), F.col("at").alias("since"))


def step_neighbours(regions: DataFrame, borders: DataFrame, trace: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each step's source borders on: ``(image_id, step, source_id, other, border)``, and ``(image_id, step, area, perimeter, ...)`` of the source itself."""
    held = stored(owners(regions, trace), "owners")
    steps = trace.select("image_id", "step", F.col("source_id").alias("owner"))
    members = steps.join(held, ["image_id", "owner"]).filter("since < step and step <= until").select("image_id", "step", F.col("owner").alias("source_id"), "region_id")
    measured = members.join(regions.select("image_id", "region_id", "area", "perimeter", *_BOX), ["image_id", "region_id"])
    sums = measured.groupBy("image_id", "step", "source_id").agg(F.sum("area").alias("area"), F.sum("perimeter").alias("sides"), *((F.min if b.startswith("min") else F.max)(b).alias(b) for b in _BOX))
    met = members.join(borders.select("image_id", F.col("src").alias("region_id"), F.col("dst"), "length"), ["image_id", "region_id"])
    beyond = held.select("image_id", F.col("region_id").alias("dst"), F.col("owner").alias("other"), "since", "until")
    lengths = met.join(beyond, ["image_id", "dst"]).filter("since < step and step <= until").groupBy("image_id", "step", "source_id", "other").agg(F.sum("length").alias("border"))
    lengths = stored(lengths, "step-borders")
    inner = lengths.filter("other = source_id").select("image_id", "step", F.col("border").alias("inner"))
    sources = sums.join(inner, ["image_id", "step"], "left").select("image_id", "step", "source_id", "area", (F.col("sides") - F.coalesce("inner", F.lit(0))).alias("perimeter"), *_BOX)
    return lengths.filter("other <> source_id"), sources


def accepted_merges(regions: DataFrame, borders: DataFrame, trace: DataFrame, palette: DataFrame, distance: str = "delta_e_2000", **costs) -> DataFrame:
    """Every accepted merge with colours, bounds, measures and costs of its step.

    ``regions``, ``borders``: before the first step; ``trace(image_id, step, source_id, target_id)``. ``costs``: see :func:`~tessella.operators.merging.costed`.
    """
    neighbours, sources = step_neighbours(regions, borders, trace)
    sources = stored(sources, "step-sources")
    steps = trace.select("image_id", "step", "source_id", "target_id")
    border = neighbours.select("image_id", "step", F.col("other").alias("target_id"), "border")
    named = lambda df, side, end: df.select("image_id", "step", F.col("area").alias(f"{side}_area"), F.col("perimeter").alias(f"{side}_perimeter"), *(F.col(b).alias(f"{side}_{b}") for b in _BOX))  # noqa: E731, ARG005
    rows = steps.join(border, ["image_id", "step", "target_id"]).join(named(sources, "source", "source_id"), ["image_id", "step"])
    start = regions.select("image_id", F.col("region_id").alias("target_id"), *(F.col(c).alias(f"start_{c}") for c in ("area", "perimeter", *_BOX)))
    before = Window.partitionBy("image_id", "target_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    grown = rows.join(start, ["image_id", "target_id"])
    total = lambda first, added: F.col(first) + F.coalesce(F.sum(added).over(before), F.lit(0))
    grown = grown.withColumns({
        "target_area": total("start_area", F.col("source_area")), "target_perimeter": total("start_perimeter", F.col("source_perimeter") - 2 * F.col("border")),
        **{f"target_{b}": (F.least if b.startswith("min") else F.greatest)(F.col(f"start_{b}"), (F.min if b.startswith("min") else F.max)(f"source_{b}").over(before)) for b in _BOX},
    })
    colour = lambda side: regions.select("image_id", F.col("region_id").alias(f"{side}_id"), F.col("idx").alias(f"{side}_idx"))
    coloured = grown.join(colour("source"), ["image_id", "source_id"]).join(colour("target"), ["image_id", "target_id"])
    coloured = coloured.join(F.broadcast(palette_distances(palette, distance)), ["source_idx", "target_idx"])  # at most 256 x 256 rows
    measured = apply_steps(coloured.drop(*(f"start_{c}" for c in ("area", "perimeter", *_BOX))), DERIVED, [*MEASURES, "border_penalty", "geometry_penalty"])
    return costed(measured, **costs)


def accepted_contrast(regions: DataFrame, borders: DataFrame, trace: DataFrame, palette: DataFrame, distance: str = "delta_e_2000") -> DataFrame:
    """For every accepted merge the contrast of its source with all neighbours of that step, and the target's share of its border."""
    neighbours, sources = step_neighbours(regions, borders, trace)
    colour = lambda end, side: regions.select("image_id", F.col("region_id").alias(end), F.col("idx").alias(f"{side}_idx"))
    rows = neighbours.join(sources.select("image_id", "step", F.col("perimeter").alias("source_perimeter")), ["image_id", "step"])
    rows = rows.join(colour("source_id", "source"), ["image_id", "source_id"]).join(colour("other", "target"), ["image_id", "other"])
    rows = rows.join(F.broadcast(palette_distances(palette, distance)), ["source_idx", "target_idx"])  # at most 256 x 256 rows
    contrast = neighbour_contrast(rows)  # a source joins another once, so it names its step
    chosen = trace.select("image_id", "step", "source_id", "target_id").join(neighbours.select("image_id", "step", F.col("other").alias("target_id"), "border"), ["image_id", "step", "target_id"])
    return contrast.join(chosen, ["image_id", "source_id"]).withColumn("target_share", F.col("border") / F.col("total_border")).drop("border")
