"""Regions of a quantized raster: detection, borders, perimeters, paintability.

Regions and components are found in tiles of bounded size, with arrays inside, and joined across tiles as
links between their parts, so an image is spread over tasks. All else is windows, joins on region ids and
aggregations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.components import roots
from tessella.tables import stored

#: Pixels of the largest image that a fold may hold in one task; tiles are far smaller.
MOST_PIXELS = 50_000_000


class ImageTooLargeError(ValueError):
    """An image has more pixels than one task may hold."""


def grid_of(x: np.ndarray, y: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values on their bounding grid from (0, 0); -1 where there is no pixel."""
    height, width = int(y.max()) + 1, int(x.max()) + 1
    if height * width > MOST_PIXELS:
        raise ImageTooLargeError(f"{width} x {height} pixels; at most {MOST_PIXELS} are handled")
    grid = np.full((height, width), -1, np.int64)
    grid[y, x] = values
    return grid


def join_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the component of each of ``n`` nodes under links ``a``-``b``, by hooking and pointer jumping."""
    parent = np.arange(n)
    while len(a):
        pa, pb = parent[a], parent[b]
        apart = pa != pb
        if not apart.any():
            break
        a, b, pa, pb = a[apart], b[apart], pa[apart], pb[apart]
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
    return parent


def label_grid(grid: np.ndarray) -> np.ndarray:
    """Region ids from 1 in scan order of each 4-connected region of equal values; 0 where there is no pixel.

    Pixels of a row are first joined to runs, so links only join runs of neighbouring rows.
    """
    start = np.ones(grid.shape, bool)
    start[:, 1:] = grid[:, 1:] != grid[:, :-1]
    runs = (np.cumsum(start) - 1).reshape(grid.shape)
    alike = (grid[1:] == grid[:-1]) & (grid[1:] >= 0)
    links = np.unique(np.stack([runs[1:][alike], runs[:-1][alike]], axis=1), axis=0)
    roots = join_labels(int(runs[-1, -1]) + 1, links[:, 0], links[:, 1])[runs]
    roots[grid < 0] = -1
    known = np.unique(roots[roots >= 0])
    return np.where(roots >= 0, np.searchsorted(known, roots) + 1, 0)


#: Side of a tile that one task labels.
TILE = 256


#: Bits of x in a scan position.
SCAN = 31


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows(image_id, root, ...)`` with ``name`` for ``root``: the numbers of an image's roots, from 1, in their order."""
    order = Window.partitionBy("image_id").orderBy("root")
    numbers = rows.select("image_id", "root").distinct().withColumn(name, F.row_number().over(order).cast("long"))
    return rows.join(numbers.hint("merge"), ["image_id", "root"]).drop("root")


def tile_labels(quantized: DataFrame, tile: int = TILE) -> DataFrame:
    """``(image_id, pos, x, y, idx, local)``: pixels with the first one, in scan order, of their region's part within a tile."""

    def label(pixels: pd.DataFrame) -> pd.DataFrame:
        x, y = pixels["x"].to_numpy(), pixels["y"].to_numpy()
        u, v = x - x.min(), y - y.min()
        ids = label_grid(grid_of(u, v, pixels["idx"].to_numpy()))[v, u]
        scan = y << SCAN | x
        first = np.full(int(ids.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, ids, scan)
        return pixels.assign(local=first[ids])[["image_id", "pos", "x", "y", "idx", "local"]]

    dealt = quantized.select("image_id", "pos", "x", "y", "idx", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"))
    return dealt.groupBy("image_id", "tx", "ty").applyInPandas(label, "image_id long, pos long, x long, y long, idx long, local long")


def tile_links(labelled: DataFrame, tile: int = TILE) -> DataFrame:
    """``(image_id, node, other)``: parts of regions that meet across the edge of two tiles; only pixels on such edges are read."""
    found = None
    for moving, fixed in (("x", "y"), ("y", "x")):
        edge = labelled.filter(F.pmod(F.col(moving), F.lit(tile)).isin(0, tile - 1)).select("image_id", "x", "y", "idx", "local")
        near = Window.partitionBy("image_id", fixed).orderBy(moving)
        at = F.lag(F.struct("idx", "local", moving)).over(near)
        met = edge.withColumn("before", at).filter((F.col("before")[moving] == F.col(moving) - 1) & (F.pmod(F.col(moving), F.lit(tile)) == 0) & (F.col("before.idx") == F.col("idx")))
        links = met.select("image_id", F.col("local").alias("node"), F.col("before.local").alias("other"))
        found = links if found is None else found.unionByName(links)
    return found.distinct()


def detect_regions(quantized: DataFrame, tile: int = TILE) -> DataFrame:
    """``(image_id, region_id, pos, x, y, idx)``: the 4-connected region of every pixel, numbered by its first pixel in scan order.

    Tiles are labelled by themselves, and the parts that meet across their edges are joined as components.
    """
    labelled = stored(tile_labels(quantized, tile), "tile-labels")
    linked = roots(tile_links(labelled, tile))
    parts = labelled.join(linked.withColumnRenamed("node", "local").hint("merge"), ["image_id", "local"], "left")
    rooted = parts.select("image_id", F.coalesce("root", "local").alias("root"), "pos", "x", "y", "idx")
    return numbered(rooted, "region_id").select("image_id", "region_id", "pos", "x", "y", "idx")


def _moved(column: str, offset: int, orientation: str) -> Column:
    fixed, moving = ("y", "x") if orientation == "horizontal" else ("x", "y")
    return F.first(column).over(Window.partitionBy("image_id", fixed).orderBy(moving).rangeBetween(offset, offset))


def shared_borders(pixels: DataFrame) -> DataFrame:
    """``(image_id, src, dst, length)`` in both directions, of disjoint regions."""
    near = pixels.select("image_id", "x", "y", "region_id", _moved("region_id", 1, "horizontal").alias("right"), _moved("region_id", 1, "vertical").alias("down"))
    sides = near.select("image_id", "region_id", F.explode(F.array("right", "down")).alias("other")).filter("other <> region_id")
    both = sides.select("image_id", F.explode(F.array(F.struct(F.col("region_id").alias("src"), F.col("other").alias("dst")), F.struct(F.col("other").alias("src"), F.col("region_id").alias("dst")))).alias("e"))
    return both.groupBy("image_id", "e.src", "e.dst").agg(F.count("*").alias("length"))


OFFSETS_4 = [(1, 0), (-1, 0), (0, 1), (0, -1)]


def overlapping_borders(members: DataFrame) -> DataFrame:
    """Border lengths of regions that may share pixels: ordered pairs of adjacent pixels, one in each region."""
    offsets = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in OFFSETS_4))
    sent = members.select("image_id", F.col("region_id").alias("src"), "x", "y", F.explode(offsets).alias("o")).select("image_id", "src", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    met = sent.join(members.select("image_id", F.col("region_id").alias("dst"), "x", "y"), ["image_id", "x", "y"]).filter("src <> dst")
    return met.groupBy("image_id", "src", "dst").agg(F.count("*").alias("length"))


def overlapping_images(members: DataFrame) -> DataFrame:
    """``(image_id, overlapping)``: whether some pixel has two owners."""
    owners = members.groupBy("image_id", "x", "y").agg((F.count_distinct("region_id") > 1).alias("shared"))
    return owners.groupBy("image_id").agg(F.max("shared").alias("overlapping"))


def neighbours(regions: DataFrame, borders: DataFrame) -> DataFrame:
    """``(image_id, region_id, neighbours)`` sorted; empty for a region that stands alone."""
    found = borders.groupBy("image_id", F.col("src").alias("region_id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))
    return regions.select("image_id", "region_id").join(found.hint("merge"), ["image_id", "region_id"], "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<long>")))


def merged_borders(borders: DataFrame, mapping: DataFrame) -> DataFrame:
    """Borders after regions ``mapping(image_id, region_id, final_id)`` were joined: parallel borders add up, inner ones vanish."""
    out = borders
    for end in ("src", "dst"):
        named = mapping.select("image_id", F.col("region_id").alias(end), "final_id")
        out = out.join(named.hint("merge"), ["image_id", end], "left").withColumn(end, F.coalesce("final_id", end)).drop("final_id")
    return out.filter("src <> dst").groupBy("image_id", "src", "dst").agg(F.sum("length").alias("length"))


def region_table(pixels: DataFrame) -> DataFrame:
    """``(image_id, region_id, idx, area, perimeter, min_x, min_y, max_x, max_y, first_pos)``; perimeter counts exposed sides."""
    sides = [F.coalesce((_moved("region_id", k, o) == F.col("region_id")).cast("long"), F.lit(0)) for o in ("horizontal", "vertical") for k in (1, -1)]
    exposed = pixels.withColumn("exposed", 4 - sum(sides[1:], sides[0]))
    return exposed.groupBy("image_id", "region_id").agg(F.min("idx").alias("idx"), F.count("*").alias("area"), F.sum("exposed").alias("perimeter"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), F.min("pos").alias("first_pos"))


def region_measures(pixels: DataFrame) -> DataFrame:
    """``(image_id, region_id, idx, area, perimeter)`` of disjoint regions: a pixel has four sides, of which one to the right or below is lost twice."""
    inner = sum(F.coalesce((_moved("region_id", 1, o) == F.col("region_id")).cast("long"), F.lit(0)) for o in ("horizontal", "vertical"))
    met = pixels.select("image_id", "region_id", "x", "y", "idx").withColumn("inner", inner)
    return met.groupBy("image_id", "region_id").agg(F.first("idx").alias("idx"), F.count("*").alias("area"), (4 * F.count("*") - 2 * F.sum("inner")).alias("perimeter"))


def region_set_stats(regions: DataFrame) -> DataFrame:
    box = (F.col("max_x") - F.col("min_x") + 1) * (F.col("max_y") - F.col("min_y") + 1)
    return regions.groupBy("image_id").agg(F.count("*").alias("regions"), F.sum("area").alias("pixels"), F.max("area").alias("largest"), F.sum(box).alias("box_area"), F.max(box).alias("largest_box"))


def disc_rows(diameter: int) -> list[tuple[int, int]]:
    """The disc as rows: (dy, how far the row reaches left and right)."""
    r = diameter / 2
    return [(dy, min(int(r), math.isqrt(int((r * r - dy * dy) * 4)) // 2)) for dy in range(-int(r), int(r) + 1)]


def disc_offsets(diameter: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy, reach in disc_rows(diameter) for dx in range(-reach, reach + 1)]


def fitting_regions(pixels: DataFrame, diameter: int) -> DataFrame:
    """``(image_id, region_id)`` of the regions that hold a disc of this diameter.

    A centre needs the rows of the disc around it: each pixel says of which centres it is the middle of
    a row that is long enough, and centres with all rows are counted. Centres also keep half a diameter
    from the region's bounding box.
    """
    if diameter <= 0:
        return pixels.select("image_id", "region_id").limit(0)
    r, rows = diameter / 2, disc_rows(diameter)
    line = Window.partitionBy("image_id", "region_id", "y")
    runs = pixels.select("image_id", "region_id", "x", "y").withColumn("run", F.col("x") - F.row_number().over(line.orderBy("x")))
    run = Window.partitionBy("image_id", "region_id", "y", "run")
    reach = runs.withColumn("reach", F.least(F.col("x") - F.min("x").over(run), F.max("x").over(run) - F.col("x")))
    needed = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(k).alias("need")) for dy, k in rows))
    votes = reach.withColumn("d", F.explode(needed)).filter("reach >= d.need").groupBy("image_id", "region_id", "x", (F.col("y") - F.col("d.dy")).alias("cy")).agg(F.count("*").alias("rows")).filter(F.col("rows") == len(rows))
    boxes = pixels.groupBy("image_id", "region_id").agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))))
    inside = [(F.col(c) >= F.ceil(F.col(f"lo_{v}") + r)) & (F.col(c) <= F.floor(F.col(f"hi_{v}") - r)) for c, v in (("x", "x"), ("cy", "y"))]
    return votes.join(boxes.hint("merge"), ["image_id", "region_id"]).filter(inside[0] & inside[1]).select("image_id", "region_id").distinct()


def paintability(pixels: DataFrame, diameter: int) -> DataFrame:
    """``(image_id, region_id, mergeable)`` of the regions too small for the disc; mergeable: it has a neighbour."""
    small = pixels.select("image_id", "region_id").distinct().join(fitting_regions(pixels, diameter).hint("merge"), ["image_id", "region_id"], "left_anti")
    touching = shared_borders(pixels).select("image_id", F.col("src").alias("region_id"), F.lit(True).alias("touches")).distinct()
    return small.join(touching.hint("merge"), ["image_id", "region_id"], "left").select("image_id", "region_id", F.coalesce("touches", F.lit(False)).alias("mergeable"))


def merge_targets(undersized: DataFrame, borders: DataFrame) -> DataFrame:
    """The neighbour that each undersized region would join first: longest border, then least id."""
    window = Window.partitionBy("image_id", "src").orderBy(F.desc("length"), "dst")
    ranked = borders.join(undersized.select("image_id", F.col("region_id").alias("src")).hint("merge"), ["image_id", "src"], "left_semi").withColumn("r", F.row_number().over(window))
    return ranked.filter("r = 1").select("image_id", F.col("src").alias("region_id"), F.col("dst").alias("target_id"), "length")


def components_by_points(edges: DataFrame, tile: int = TILE) -> DataFrame:
    """``edges(image_id, orientation, x, y, x1, y1, x2, y2, ...)`` with ``component``: edges that share grid points, numbered in scan order.

    Edges that start in a tile are joined by themselves, then their parts through the points where several meet.
    """

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        scan = ((rows["y"].to_numpy() << SCAN | rows["x"].to_numpy()) << 1) | (rows["orientation"] == "vertical").to_numpy()
        rows = rows.iloc[np.argsort(scan, kind="stable")]
        points = np.concatenate([rows[f"y{e}"].to_numpy() << SCAN | rows[f"x{e}"].to_numpy() for e in (1, 2)])
        _, numbers = np.unique(points, return_inverse=True)
        n = len(rows)
        parents = join_labels(n + int(numbers.max()) + 1, np.tile(np.arange(n), 2), numbers + n)[:n]
        return rows.assign(local=np.sort(scan)[parents])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema.fields)
    tiled = edges.groupBy("image_id", F.floor(F.col("x") / tile), F.floor(F.col("y") / tile)).applyInPandas(label, f"{names}, local long")
    labelled = stored(tiled, "edge-parts")
    ends = labelled.select("image_id", "local", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).distinct()
    shared = ends.withColumn("least", F.min("local").over(Window.partitionBy("image_id", "p")))  # four edges meet at a point at most
    linked = roots(shared.filter("local > least").select("image_id", F.col("local").alias("node"), F.col("least").alias("other")))
    parts = labelled.join(linked.withColumnRenamed("node", "local"), ["image_id", "local"], "left")
    return numbered(parts.withColumn("root", F.coalesce("root", "local")), "component").select(*edges.columns, "component")


def boundary_components(labelled: DataFrame) -> DataFrame:
    """One row a component of collapsed boundary edges, ranked by edges, mean rescue cost and mean distance."""
    dominant = Window.partitionBy("image_id", "component").orderBy(F.desc("n"), "idx")
    colours = labelled.groupBy("image_id", "component", "idx").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(dominant)).filter("r = 1").select("image_id", "component", F.col("idx").alias("dominant_idx"))
    stats = labelled.groupBy("image_id", "component").agg(F.count("*").alias("edges"), F.min("x1").alias("min_x"), F.min("y1").alias("min_y"), F.max("x2").alias("max_x"), F.max("y2").alias("max_y"), F.min("source_de").alias("min_de"), F.max("source_de").alias("max_de"), F.avg("source_de").alias("mean_de"), F.min("rescue_cost").alias("min_cost"), F.avg("rescue_cost").alias("mean_cost"), F.count_if(F.col("rescue_cost").isNull()).alias("unavailable"))
    order = Window.partitionBy("image_id").orderBy(F.desc("edges"), F.asc_nulls_last(F.round("mean_cost", 6)), F.desc(F.round("mean_de", 6)), "min_y", "min_x", "max_y", "max_x", "dominant_idx", "component")
    return stats.join(colours, ["image_id", "component"]).withColumn("rank", F.row_number().over(order).cast("long"))
