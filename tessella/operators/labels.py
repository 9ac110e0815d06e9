"""Labels: one number a region, at the pixel farthest from the region's boundary.

Pixels stay rows: windows along rows and columns tell boundary pixels and distances within a column, the
distances of a row are met in tasks that hold some rows each, and an aggregation takes each region's best pixel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_boundary(members: DataFrame) -> DataFrame:
    """``members`` with ``inner``: whether all eight neighbours are of the region; the others are its boundary."""
    along = lambda fixed, moving: Window.partitionBy("image_id", "region_id", fixed).orderBy(moving)
    next_to = lambda column, k, window, value: F.coalesce((F.lag(column, k).over(window) == F.col(column) - k) & (F.lag(value, k).over(window) if value else F.lit(True)), F.lit(False))
    row, column = along("y", "x"), along("x", "y")
    rows = members.withColumn("between", next_to("x", 1, row, None) & next_to("x", -1, row, None))
    return rows.withColumn("inner", F.col("between") & next_to("y", 1, column, "between") & next_to("y", -1, column, "between")).drop("between")


def region_geometry(members: DataFrame) -> DataFrame:
    """``(image_id, region_id, pixels, boundary_pixels, min_x, ..., sum_x, sum_y)``; a boundary pixel lacks one of eight neighbours."""
    met = with_boundary(members.select("image_id", "region_id", "x", "y"))
    return met.groupBy("image_id", "region_id").agg(F.count("*").alias("pixels"), F.count_if(~F.col("inner")).alias("boundary_pixels"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


def row_minima(heights: np.ndarray) -> np.ndarray:
    """``min over v of (x - v)^2 + heights[v]`` for every x of rows laid end to end, each of them between two zeros.

    Step k looks k places to both sides, and only where the minimum so far is above k squared; a zero
    stops it before a row's end.
    """
    least, k = heights.copy(), 0
    far = np.flatnonzero(least > 1)
    while len(far):
        k += 1
        least[far] = np.minimum(least[far], np.minimum(heights[far - k], heights[far + k]) + k * k)
        far = far[least[far] > (k + 1) ** 2]
    return least


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Squared distances from those within columns; pixels come in order of region, row and x."""
    rest: pa.Table | None = None

    def done(rows: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in ("image_id", "region_id", "x", "y")), pa.array(row_minima(rows.column("down2").to_numpy()))], ["image_id", "region_id", "x", "y", "squared_distance"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if rest.num_rows < 100_000:
            continue
        # what must stay together begins and ends with a boundary pixel, as a run does
        zero = rest.column("down2").to_numpy() == 0
        ends = np.flatnonzero(zero[:-1] & zero[1:])
        if len(ends):
            whole = int(ends[-1]) + 1
            yield done(rest.slice(0, whole))
            rest = rest.slice(whole)
    if rest is not None and rest.num_rows:
        yield done(rest)


def squared_distances(members: DataFrame) -> DataFrame:
    """``(image_id, region_id, x, y, squared_distance)``: exact distance of each pixel to its region's nearest boundary pixel.

    The straight way to it runs within the region: along the row within a run, then along a column.
    """
    up = Window.partitionBy("image_id", "region_id", "x").orderBy("y")
    edge = F.when(~F.col("inner"), F.col("y"))
    above = F.last(edge, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(edge, ignorenulls=True).over(up.rowsBetween(0, Window.unboundedFollowing))
    near = F.least(F.col("y") - above, below - F.col("y"))
    columns = with_boundary(members.select("image_id", "region_id", "x", "y")).select("image_id", "region_id", "x", "y", (near * near).cast("long").alias("down2"))
    rows = columns.repartition("image_id", "region_id", "y").sortWithinPartitions("image_id", "region_id", "y", "x")
    return rows.mapInArrow(_distances, "image_id long, region_id long, x long, y long, squared_distance long")


def best_pixels(members: DataFrame) -> DataFrame:
    """``(image_id, region_id, idx, x, y, squared_distance)``: the pixel farthest from the boundary, then nearest the centroid, then first by y and x."""
    sums = members.groupBy("image_id", "region_id").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.first("idx").alias("idx"))
    found = squared_distances(members).join(sums.hint("merge"), ["image_id", "region_id"])
    dx, dy = ((F.col("n") * F.col(c) - F.col(f"s{c}")).cast("decimal(18,0)") for c in "xy")
    rank = F.struct(-F.col("squared_distance"), (dx * dx + dy * dy), F.col("y"), F.col("x"))  # whole numbers, so ties are exact
    return found.groupBy("image_id", "region_id").agg(F.min_by(F.struct("x", "y", "squared_distance", "idx"), rank).alias("best")).select("image_id", "region_id", "best.idx", "best.x", "best.y", "best.squared_distance")


def place_labels(members: DataFrame, palette: DataFrame) -> DataFrame:
    """``(image_id, region_id, text, x, y, squared_distance)``; the text is the number of the region's palette colour."""
    named = palette.select("idx", F.col("number").cast("string").alias("text"))  # at most 256 rows
    return best_pixels(members).join(F.broadcast(named), "idx").select("image_id", "region_id", "text", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "squared_distance")
