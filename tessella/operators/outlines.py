"""Outlines of regions: boundary edges, rings, corners, areas.

Edges are directed with the region on their right (y grows downwards), on grid corners. Every edge has
one edge after it, so rings are the cycles of a permutation; edges of whole regions are linked and
numbered at once by pointer jumping over arrays, in tasks that hold some regions each. Rings, chains and
outlines are relations from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.overlaps import invalid_outlines, twice_area
from tessella.operators.topology import simplified_rings


class OutlineError(ValueError):
    """A region has no outer ring, or more than one."""


# Per side of a pixel: neighbour's offset, then start and end of the edge relative to the pixel.
SIDES = [(0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0)]


def boundary_edges(members: DataFrame) -> DataFrame:
    """``(image_id, region_id, sx, sy, ex, ey, other)``: exposed sides, with the region beyond (null outside)."""
    sides = F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(("dx", "dy", "ax", "ay", "bx", "by"), s))) for s in SIDES))
    asked = members.select("image_id", "region_id", "x", "y", F.explode(sides).alias("s"))
    asked = asked.select("image_id", "region_id", *((F.col(c) + F.col(f"s.{o}")).alias(n) for n, c, o in (("nx", "x", "dx"), ("ny", "y", "dy"), ("sx", "x", "ax"), ("sy", "y", "ay"), ("ex", "x", "bx"), ("ey", "y", "by"))))
    owners = members.select("image_id", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("region_id").alias("other"))
    return asked.join(owners.hint("merge"), ["image_id", "nx", "ny"], "left").filter("other is null or other <> region_id").select("image_id", "region_id", "sx", "sy", "ex", "ey", "other")


def edge_after(region: np.ndarray, sx: np.ndarray, sy: np.ndarray, ex: np.ndarray, ey: np.ndarray) -> np.ndarray:
    """The edge that follows each one; all edges are in order of region and start. Two leave a corner that a region touches twice: the one that turns right."""
    names = np.stack([np.concatenate([region, region]), np.concatenate([sx, ex]), np.concatenate([sy, ey])], axis=1)
    _, corner = np.unique(names, axis=0, return_inverse=True)
    starts, ends = corner[: len(sx)], corner[len(sx) :]
    found = np.searchsorted(starts, ends)
    if (found >= len(starts)).any() or (starts[np.minimum(found, len(starts) - 1)] != ends).any():
        raise OutlineError("a boundary does not close")
    twice = np.minimum(found + 1, len(starts) - 1)
    right = (ex[twice] - sx[twice] == -(ey - sy)) & (ey[twice] - sy[twice] == ex - sx)
    return np.where((starts[twice] == ends) & right, twice, found)


def rings_of(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least edge of each edge's ring, and how many edges it comes after it. By pointer jumping."""
    n = len(after)
    least, jump = np.arange(n), after
    while True:
        met = np.minimum(least, least[jump])
        if np.array_equal(met, least) and np.array_equal(least[after], least):
            break
        least, jump = met, jump[jump]
    leads = least == np.arange(n)
    left, jump = np.where(leads, 0, 1), np.where(leads, np.arange(n), after)  # edges until the ring's least one
    while not leads[jump].all():
        left, jump = left + left[jump], jump[jump]
    size = np.bincount(least, minlength=n)[least]
    return least, np.where(leads, 0, size - left)


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the edges of whole regions; they come in order of image, region and start."""
    rest: pa.Table | None = None

    def traced(edges: pa.Table) -> pa.RecordBatch:
        image, region, sx, sy, ex, ey = (edges.column(c).to_numpy() for c in ("image_id", "region_id", "sx", "sy", "ex", "ey"))
        new = (np.diff(image, prepend=image[:1]) != 0) | (np.diff(region, prepend=region[:1]) != 0)
        number = np.cumsum(new)
        least, at = rings_of(edge_after(number, sx, sy, ex, ey))
        area = np.zeros(len(sx), np.int64)
        np.add.at(area, least, sx * ey - ex * sy)
        leads = np.flatnonzero(least == np.arange(len(sx)))
        outer = np.bincount(number[leads[area[leads] > 0]], minlength=number[-1] + 1)
        if (outer != 1).any() or (area[leads] == 0).any():
            raise OutlineError("a region needs exactly one outer ring and no empty one")
        holes = leads[area[leads] < 0]  # in order of region and least edge
        ring = np.zeros(len(sx), np.int64)
        ring[holes] = np.arange(len(holes)) - np.searchsorted(number[holes], number[holes]) + 1
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in (image, region, ring[least], at, sx, sy)), edges.column("other").combine_chunks()], ["image_id", "region_id", "ring", "at", "x", "y", "other"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if rest.num_rows < 200_000:
            continue
        image, region = (rest.column(c).to_numpy() for c in ("image_id", "region_id"))
        whole = int(np.flatnonzero((image == image[-1]) & (region == region[-1]))[0])  # the last region may go on
        if whole:
            yield traced(rest.slice(0, whole))
            rest = rest.slice(whole)
    if rest is not None and rest.num_rows:
        yield traced(rest)


def ring_points(members: DataFrame) -> DataFrame:
    """``(image_id, region_id, ring, at, x, y, other)``: the corners of all rings in order from the least one on.

    Ring 0 is the outer one, holes follow in order of their least corners; ``other`` lies beyond the edge that leaves the corner.
    """
    edges = boundary_edges(members)
    dealt = edges.repartition("image_id", "region_id").sortWithinPartitions("image_id", "region_id", "sx", "sy", "ex", "ey")
    return dealt.mapInArrow(_trace, "image_id long, region_id long, ring long, at long, x long, y long, other long")


def without_straight(ring: Column) -> Column:
    """A ring's corners without those between two edges of one direction."""

    def turns(p: Column, i: Column) -> Column:
        a, b = F.get(ring, F.pmod(i - 1 + F.size(ring), F.size(ring))), F.get(ring, F.pmod(i + 1, F.size(ring)))
        return (p["x"] - a["x"]) * (b["y"] - p["y"]) != (p["y"] - a["y"]) * (b["x"] - p["x"])

    return F.filter(ring, turns)


def whole_outlines(rings: DataFrame, straight: bool) -> DataFrame:
    """Outlines from ``rings(image_id, region_id, ring, points)``; not ``straight``: corners only."""
    own = rings if straight else rings.withColumn("points", without_straight(F.col("points")))
    parts = own.groupBy("image_id", "region_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("rings"))
    return parts.select("image_id", "region_id", F.get("rings", F.lit(0)).alias("points"), F.slice("rings", 2, F.size("rings")).alias("hole_rings"))


def trace_outlines(members: DataFrame, tolerance: float | None = None, raw: bool = False) -> DataFrame:
    """``(image_id, region_id, points, hole_rings)``: every grid corner (``raw``), corners only, or simplified within ``tolerance``."""
    corners = ring_points(members)
    if tolerance is not None:
        return whole_outlines(simplified_rings(corners, tolerance, whole_outlines), False)
    points = F.transform(F.array_sort(F.collect_list(F.struct("at", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return whole_outlines(corners.groupBy("image_id", "region_id", "ring").agg(points.alias("points")), raw)


def outline_set_stats(outlines: DataFrame) -> DataFrame:
    vertices = F.size("points") + F.aggregate("hole_rings", F.lit(0), lambda a, h: a + F.size(h))
    holes = F.size("hole_rings")
    return outlines.groupBy("image_id").agg(F.count("*").alias("outlines"), F.sum(holes).alias("holes"), F.sum(vertices).alias("vertices"), F.max(vertices).cast("long").alias("most_vertices"), F.max(holes).cast("long").alias("most_holes"), F.sum(F.size("points")).alias("outer_vertices"))


def outline_areas(outlines: DataFrame) -> DataFrame:
    """Area inside the outer ring without the holes."""
    total = F.expr(f"{twice_area('points')} + aggregate(transform(hole_rings, h -> {twice_area('h')}), cast(0 as bigint), (a, v) -> a + v)")
    return outlines.select("image_id", "region_id", (total / 2).alias("area"))


def point_reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of outline points that simplification removed, in per cent."""
    count = lambda df, name: outline_set_stats(df).select("image_id", F.col("vertices").alias(name))
    return count(before, "before").join(count(after, "after").hint("merge"), "image_id").withColumn("reduction", F.coalesce(F.try_divide((F.col("before") - F.col("after")) * 100.0, F.col("before")), F.lit(0.0)))


def validate_outlines(outlines: DataFrame) -> DataFrame:
    """``(image_id, region_id)`` of outlines with an invalid ring, or with area in common with another of their image."""
    return invalid_outlines(outlines)
