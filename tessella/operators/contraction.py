"""Merging regions as a contraction of the region graph.

Spark finds what merging needs to know: measures, border lengths, which regions hold no disc, and the pixels of
those alone. The steps then run over graphs, never over images.

The mandatory merge touches only regions that hold no disc, in the order of a queue. What such a region does
depends on its own pixels and borders, and these change only through neighbours that hold no disc either. So
clusters of touching small regions take no notice of each other: each is contracted by itself, and many small
clusters share a task. A cluster above :data:`MOST_CLUSTER` is contracted in rounds of joins: a region moves once
no neighbour stands before it in the queue. Such regions touch none of their kind, so all move at once with the
result of the queue. A queue's rounds are as many as its longest chain of touching regions in ascending order.

The optional reduction always accepts the cheapest merge of an image, and a merge may make a cheaper one, so it has
no such parts: its task holds one image's region graph. Its size is that of regions and borders, not of pixels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.components import roots
from tessella.operators.folds import SHIFT, Costs, RegionGraph, check_paintable, final_owners, merge_undersized, reduce_regions
from tessella.operators.merging import palette_distances
from tessella.operators.regions import fitting_regions, merged_borders, region_measures, shared_borders
from tessella.tables import stored

#: Pixels and neighbours of the largest cluster that one task contracts.
MOST_CLUSTER = 8_000_000
#: Pixels and neighbours of the clusters that share a task.
BATCH = 1_000_000

_KEY = ["image_id", "region_id"]
_MEMBERS = [*_KEY, "x", "y", "idx"]
_MOVES = "image_id long, region_id long, final_id long"


def _small(members: DataFrame, diameter: int) -> DataFrame:
    """``(image_id, region_id, pixels)`` of the regions that hold no disc; pixels are packed as ``y << 32 | x``."""
    rest = members.join(fitting_regions(members, diameter).hint("merge"), _KEY, "left_anti")
    return rest.groupBy(*_KEY).agg(F.collect_list(F.shiftleft("y", SHIFT).bitwiseOR(F.col("x"))).alias("pixels"))


def _near(borders: DataFrame) -> DataFrame:
    return borders.groupBy("image_id", F.col("src").alias("region_id")).agg(F.collect_list(F.struct("dst", "length")).alias("near"))


def region_graph(members: DataFrame, diameter: int) -> DataFrame:
    """One row a region: ``idx``, ``area``, ``perimeter``, ``near`` (neighbours with border lengths, null: none) and, if it holds no disc, its ``pixels``."""
    table = region_measures(members).join(_near(shared_borders(members)).hint("merge"), _KEY, "left")
    return table.join(_small(members, diameter).hint("merge"), _KEY, "left")


def renamed(members: DataFrame, moves: DataFrame) -> DataFrame:
    """Members after ``moves(image_id, region_id, final_id, final_idx)``."""
    met = members.join(moves.hint("merge"), _KEY, "left")
    return met.select("image_id", F.coalesce("final_id", "region_id").alias("region_id"), "x", "y", F.coalesce("final_idx", "idx").alias("idx"))


def small_regions(members: DataFrame, diameter: int) -> DataFrame:
    """``(image_id, region_id, pixels, near, weight)`` of the regions that hold no disc; ``weight``: pixels and neighbours."""
    rows = _small(members, diameter).join(_near(shared_borders(members)).hint("merge"), _KEY, "left")
    return rows.withColumn("weight", F.size("pixels") + F.coalesce(F.size("near"), F.lit(0)))


def borders_of(rows: DataFrame) -> DataFrame:
    """``(image_id, src, dst, length)``: the borders that regions carry."""
    return rows.select("image_id", F.col("region_id").alias("src"), F.inline("near"))


def clustered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``cluster``, the least region of those that touch each other, and the cluster's ``total`` weight."""
    links = borders_of(rows).filter("src > dst").join(rows.select("image_id", F.col("region_id").alias("dst")).hint("merge"), ["image_id", "dst"], "left_semi")
    linked = roots(links.select("image_id", F.col("src").alias("node"), F.col("dst").alias("other")))
    found = rows.join(linked.withColumnRenamed("node", "region_id").hint("merge"), _KEY, "left").withColumn("cluster", F.coalesce("root", "region_id")).drop("root")
    found = stored(found, "small-clusters")
    return found.join(found.groupBy("image_id", "cluster").agg(F.sum("weight").alias("total")).hint("merge"), ["image_id", "cluster"])


def merge_moves(members: DataFrame, diameter: int, strict: bool = False, most_cluster: int = MOST_CLUSTER, batch: int = BATCH) -> DataFrame:
    """``(image_id, region_id, final_id)`` of the regions that the mandatory merge takes. ``strict``: a region left too small is an error.

    An image whose small regions fill no batch is one part without a look at its clusters.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids, image = part["region_id"].tolist(), int(part["image_id"].iloc[0])
        near = {r: {b["dst"]: b["length"] for b in near} if near is not None else {} for r, near in zip(ids, part["near"])}
        small = {r: np.asarray(p, np.int64) for r, p in zip(ids, part["pixels"])}
        final = final_owners(merge_undersized(near, small, diameter))
        if strict:
            check_paintable(small)
        return pd.DataFrame([(image, r, t) for r, t in final.items()], columns=["image_id", "region_id", "final_id"])

    rows = stored(small_regions(members, diameter), "small-regions")
    images = rows.groupBy("image_id").agg(F.sum("weight").alias("image_weight"))
    wide = images.filter(F.col("image_weight") > batch).select("image_id")
    if not wide.head(1):
        return rows.groupBy("image_id").applyInPandas(run, _MOVES)
    clusters = clustered(rows.join(wide.hint("merge"), "image_id", "left_semi"))
    within, beyond = clusters.filter(F.col("total") <= most_cluster), clusters.filter(F.col("total") > most_cluster)
    parts = within.groupBy("image_id").agg(F.ceil(F.sum("weight") / max(batch, 1)).alias("parts"))
    dealt = within.join(parts.hint("merge"), "image_id").withColumn("part", F.pmod(F.xxhash64("cluster"), "parts"))
    whole = rows.join(wide.hint("merge"), "image_id", "left_anti").withColumn("part", F.lit(0).cast("long"))
    columns = [*_KEY, "pixels", "near", "part"]
    moves = dealt.select(*columns).unionByName(whole.select(*columns)).groupBy("image_id", "part").applyInPandas(run, _MOVES)
    if beyond.head(1):
        moves = moves.unionByName(contracted_in_rounds(beyond, diameter, strict))
    return moves


def contracted_in_rounds(small: DataFrame, diameter: int, strict: bool = False) -> DataFrame:
    """The moves of whole clusters ``small(image_id, region_id, pixels, near)`` by rounds of joins.

    A place in the queue is ``(turn, place)``: at first every region's turn is 1 and its place its id. A region
    that grows stands again in the turn after that of the last one that joined it, at that one's place.
    """
    points = stored(small.select(*_KEY, F.explode("pixels").alias("p")).select(*_KEY, F.col("p").bitwiseAND((1 << SHIFT) - 1).alias("x"), F.shiftright("p", SHIFT).alias("y")), "round-points")
    waiting = stored(small.select(*_KEY, F.struct(F.lit(1).cast("long").alias("turn"), F.col("region_id").alias("place")).alias("at")), "round-waiting")
    owners = waiting.select(*_KEY, F.col("region_id").alias("owner"))
    edges = borders_of(small)
    while True:
        own, other = (waiting.select("image_id", F.col("region_id").alias(end), F.col("at").alias(f"{end}_at")) for end in ("src", "dst"))
        known = edges.join(own.hint("merge"), ["image_id", "src"]).join(other.hint("merge"), ["image_id", "dst"], "left")
        here = Window.partitionBy("image_id", "src")
        first = known.withColumns({
            "blocked": F.max(F.coalesce(F.col("dst_at") < F.col("src_at"), F.lit(False))).over(here),
            "rank": F.row_number().over(here.orderBy(F.desc("length"), "dst")),
        })
        moves = stored(first.filter("rank = 1 and not blocked").select("image_id", F.col("src").alias("region_id"), F.col("dst").alias("final_id"), F.struct((F.col("src_at.turn") + 1).alias("turn"), F.col("src_at.place").alias("place")).alias("again")), "round-moves")
        if not moves.head(1):
            break
        step = moves.select("image_id", F.col("region_id").alias("owner"), "final_id")
        owners = stored(owners.join(step.hint("merge"), ["image_id", "owner"], "left").select(*_KEY, F.coalesce("final_id", "owner").alias("owner")), "round-owners")
        grown = moves.groupBy("image_id", F.col("final_id").alias("region_id")).agg(F.max("again").alias("again"))
        left = waiting.join(moves.hint("merge"), _KEY, "left_anti").join(grown.hint("merge"), _KEY, "left")
        held = owners.join(left.filter("again is not null").select("image_id", F.col("region_id").alias("owner")).hint("merge"), ["image_id", "owner"], "left_semi")
        fit = fitting_regions(points.join(held.hint("merge"), _KEY).select("image_id", F.col("owner").alias("region_id"), "x", "y"), diameter)
        waiting = stored(left.join(fit.hint("merge"), _KEY, "left_anti").select(*_KEY, F.greatest("at", "again").alias("at")), "round-waiting")
        edges = merged_borders(edges, moves.select(*_KEY, "final_id")).join(waiting.select("image_id", F.col("region_id").alias("src")).hint("merge"), ["image_id", "src"], "left_semi")
        edges = stored(edges, "round-edges")
    if strict:
        check_paintable([r["region_id"] for r in waiting.limit(10).collect()])
    return owners.filter("owner <> region_id").select(*_KEY, F.col("owner").alias("final_id"))


def merged_regions(pixels: DataFrame, diameter: int, strict: bool = False, most_cluster: int = MOST_CLUSTER, batch: int = BATCH) -> DataFrame:
    """Region members after the mandatory merge. ``strict``: a region left too small is an error."""
    members = stored(pixels.select(*_MEMBERS), "contraction-members")
    moves = merge_moves(members, diameter, strict, most_cluster, batch)
    colours = members.groupBy("image_id", F.col("region_id").alias("final_id")).agg(F.first("idx").alias("final_idx"))
    return renamed(members, moves.join(colours.hint("merge"), ["image_id", "final_id"]))


def stage_loss(pixels: DataFrame, diameter: int) -> DataFrame:
    """``(image_id, detected, merged, lost, loss)``: regions as detected, after the mandatory merge, and the share of them that it takes."""
    count = lambda df, name: df.groupBy("image_id").agg(F.count_distinct("region_id").alias(name))
    counts = count(pixels, "detected").join(count(merged_regions(pixels, diameter), "merged").hint("merge"), "image_id")
    return counts.withColumn("lost", F.col("detected") - F.col("merged")).withColumn("loss", F.col("lost") / F.col("detected"))


def distance_table(palette: DataFrame, distance: str) -> dict[tuple[int, int], float]:
    return {(r["source_idx"], r["target_idx"]): r["de"] for r in palette_distances(palette, distance).collect()}  # 256 x 256 at most


def reduced_regions(pixels: DataFrame, palette: DataFrame, diameter: int, most_regions: int = 350, most_cost: float = 0.300, distance: str = "delta_e_2000", strict: bool = False, **weighting) -> DataFrame:
    """Region members after the optional reduction. ``strict``: a region left too small is an error; ``weighting``: see :class:`~tessella.operators.folds.Costs`."""
    costs = Costs(distance_table(palette, distance), **weighting)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        graph, image = RegionGraph(part), int(part["image_id"].iloc[0])
        steps = reduce_regions(graph, costs, diameter, most_regions, most_cost)
        if strict:
            check_paintable(graph.small)
        return pd.DataFrame([(image, r, t, graph.colour[t]) for r, t in final_owners({s[0]: s[1] for s in steps}).items()], columns=["image_id", "region_id", "final_id", "final_idx"])

    members = stored(pixels.select(*_MEMBERS), "contraction-members")
    return renamed(members, region_graph(members, diameter).groupBy("image_id").applyInPandas(run, f"{_MOVES}, final_idx long"))


def merge_trace(pixels: DataFrame, palette: DataFrame, diameter: int, most_regions: int = 350, most_cost: float = 0.300, distance: str = "delta_e_2000") -> DataFrame:
    """The accepted merges in order: ``(image_id, step, source_id, target_id, cost, border)``."""
    costs = Costs(distance_table(palette, distance))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        steps = reduce_regions(RegionGraph(part), costs, diameter, most_regions, most_cost)
        return pd.DataFrame([(int(part["image_id"].iloc[0]), i + 1, *s) for i, s in enumerate(steps)], columns=["image_id", "step", "source_id", "target_id", "cost", "border"])

    members = stored(pixels.select(*_MEMBERS), "contraction-members")
    return region_graph(members, diameter).groupBy("image_id").applyInPandas(run, "image_id long, step long, source_id long, target_id long, cost double, border long")


def reduction_matrix(pixels: DataFrame, palette: DataFrame, diameter: int, fractions: list[float], bounds: list[float], distance: str = "delta_e_2000") -> DataFrame:
    """One reduction for every image, target fraction and cost bound; the grid is spread over the cluster, and each cell gets the graph, not the pixels."""
    costs = Costs(distance_table(palette, distance))
    grid = F.array(*(F.struct(F.lit(f).alias("fraction"), F.lit(b).alias("bound")) for f in fractions for b in bounds))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        graph, first = RegionGraph(part), part.iloc[0]
        before = len(graph.area)
        target = max(1, math.ceil(before * first["fraction"]))
        reduce_regions(graph, costs, diameter, target, first["bound"])
        after = len(graph.area)
        return pd.DataFrame([(int(first["image_id"]), first["fraction"], first["bound"], before, target, after, (before - after) / before, "target" if after <= target else "exhausted")], columns=["image_id", "fraction", "bound", "before", "target", "after", "reduction", "stopped_by"])

    members = stored(pixels.select(*_MEMBERS), "contraction-members")
    graph = stored(region_graph(members, diameter), "region-graph")
    runs = graph.withColumn("g", F.explode(grid)).select(*graph.columns, "g.*")
    return runs.groupBy("image_id", "fraction", "bound").applyInPandas(run, "image_id long, fraction double, bound double, before long, target long, after long, reduction double, stopped_by string")
