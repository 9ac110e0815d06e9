"""Borders as a table of their own: chains that neighbours share, simplified once.

A ring is cut where the region beyond changes. Each chain has one canonical form, whichever side it is
met from, and is one row of ``chains``; rings refer to chains by their name, with the direction in which they
run. Simplification works on rows of ``chains``; rings are put together again by joins. A ring with one
neighbour all around is a closed chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.overlaps import invalid_outlines, twice_area
from tessella.tables import stored

#: Shares of the tolerance that a chain takes in turn while a region on it is invalid.
FALLBACKS = (1.0, 0.5, 0.25, 0.125, 0.0)


def ring_chains(corners: DataFrame) -> DataFrame:
    """``(image_id, region_id, ring, chain, closed, points)``: runs of a ring's edges with one region beyond, ends included.

    ``corners``: see :func:`tessella.operators.outlines.ring_points`. Chains are numbered from the first cut on.
    """
    ring = ["image_id", "region_id", "ring"]
    order = Window.partitionBy(*ring).orderBy("at")
    whole = Window.partitionBy(*ring)
    last = F.max_by(F.struct("other"), "at").over(whole)["other"]
    before = F.when(F.col("at") == 0, last).otherwise(F.lag("other").over(order))
    cut = corners.withColumn("cut", (~F.col("other").eqNullSafe(before)).cast("int"))
    counted = cut.withColumns({"upto": F.sum("cut").over(order), "cuts": F.sum("cut").over(whole), "n": F.count("*").over(whole)})
    # corners before the first cut end the last chain
    chain = F.when(F.col("cuts") == 0, 0).otherwise(F.pmod(F.col("upto") - 1, F.col("cuts")))
    place = F.when(F.col("upto") == 0, F.col("at") + F.col("n")).otherwise(F.col("at"))
    point = F.struct("x", "y")
    follows = F.when(F.col("at") == F.col("n") - 1, F.min_by(point, "at").over(whole)).otherwise(F.lead(point).over(order))
    rows = counted.select(*ring, chain.alias("chain"), (F.col("cuts") == 0).alias("closed"), place.alias("place"), point.alias("p"), follows.alias("then"))
    parts = rows.groupBy(*ring, "chain", "closed").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "p"))), lambda r: r["p"]).alias("ps"), F.max_by("then", "place").alias("end"))
    return parts.select(*ring, "chain", "closed", F.when(F.col("closed"), F.col("ps")).otherwise(F.concat("ps", F.array("end"))).alias("points"))


def canonical(points: Column, closed: Column) -> Column:
    """A chain or its reverse, whichever is less; closed ones begin with their least point."""
    at = F.array_position(points, F.array_min(points)).cast("int")
    turned = F.concat(F.slice(points, at, F.size(points)), F.slice(points, 1, at - 1))
    back = F.concat(F.slice(turned, 1, 1), F.reverse(F.slice(turned, 2, F.size(turned))))
    return F.when(closed, F.least(turned, back)).otherwise(F.least(points, F.reverse(points)))


def chain_table(rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``chains(image_id, name, closed, points, regions)`` in canonical form, and ``refs`` to them with ``forward``.

    Of closed chains ``forward`` tells nothing: their turn is that of the ring's area.
    """
    named = rings.withColumn("own", canonical(F.col("points"), F.col("closed")))
    named = named.withColumn("name", F.sha2(F.concat(F.col("closed").cast("string"), F.to_json("own")), 256))
    signed = F.expr(twice_area("points")) > 0
    refs = named.select("image_id", "region_id", "ring", "chain", "closed", "name", "own", (F.col("own") == F.col("points")).alias("forward"), F.when(F.col("closed"), signed).alias("positive"))
    refs = stored(refs, "chain-refs")
    chains = refs.groupBy("image_id", "name", "closed").agg(F.first("own").alias("points"), F.collect_set("region_id").alias("regions"))  # two regions at most
    return chains, refs.drop("own")


def chain_stats(corners: DataFrame) -> DataFrame:
    """``(image_id, chains, closed_chains, refs, closed_refs, nodes)``: distinct chains, references to them, and the corners where chains end."""
    rings = ring_chains(corners)
    chains, refs = chain_table(rings)
    ends = chains.filter("not closed").select("image_id", F.explode(F.array(F.col("points")[0], F.element_at("points", -1))).alias("p")).distinct()
    counts = chains.groupBy("image_id").agg(F.count("*").alias("chains"), F.count_if("closed").alias("closed_chains"))
    counts = counts.join(refs.groupBy("image_id").agg(F.count("*").alias("refs"), F.count_if("closed").alias("closed_refs")).hint("merge"), "image_id")
    return counts.join(ends.groupBy("image_id").agg(F.count("*").alias("nodes")).hint("merge"), "image_id", "left").fillna(0, ["nodes"])


def _away(x: np.ndarray, y: np.ndarray, a: int, b: int) -> np.ndarray:
    """Squared distance of the points between places a and b to the segment from a to b."""
    px, py, dx, dy = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a], x[b] - x[a], y[b] - y[a]
    length = dx * dx + dy * dy
    t = np.clip((px * dx + py * dy) / length, 0.0, 1.0) if length else 0.0
    return (px - t * dx) ** 2 + (py - t * dy) ** 2


def kept_of_chain(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: whether each point stays. The first farthest one splits a part if it is farther than the tolerance."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    parts = [(0, len(x) - 1)]
    while parts:
        a, b = parts.pop()
        if b - a < 2:
            continue
        away = _away(x, y, a, b)
        at = int(away.argmax())
        if away[at] > tolerance * tolerance:
            keep[a + 1 + at] = True
            parts += [(a, a + 1 + at), (a + 1 + at, b)]
    return keep


def kept_of_ring(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed chain as two between its first point and the farthest one; three points at least stay."""
    n = len(x)
    if n <= 3 or tolerance <= 0:
        return np.ones(n, bool)
    far = int(((x[1:] - x[0]) ** 2 + (y[1:] - y[0]) ** 2).argmax()) + 1
    keep = np.zeros(n, bool)
    keep[: far + 1] = kept_of_chain(x[: far + 1], y[: far + 1], tolerance)
    back = np.append(np.arange(far, n), 0)
    keep[back[:-1]] |= kept_of_chain(x[back], y[back], tolerance)[:-1]
    px, py = x[keep], y[keep]
    if len(px) < 3 or not (px * np.roll(py, -1) - np.roll(px, -1) * py).sum():
        ends = np.array([0, far])
        away = np.full(n, -1.0)
        away[1:far] = _away(x, y, 0, far)
        if far < n - 1:
            turned = np.append(np.arange(far, n), 0)
            away[far + 1 :] = _away(x[turned][::-1], y[turned][::-1], 0, len(turned) - 1)[::-1]
        keep[:] = False
        keep[[*ends, int(away.argmax())]] = True
    return keep


def simplified_chains(chains: DataFrame, tolerance: float) -> DataFrame:
    """``chains(image_id, name, level, closed, points)`` with fewer points, by the share of the tolerance of their level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("points")
            flat = points.flatten()
            x, y = (pc.struct_field(flat, i).to_numpy().astype(np.float64) for i in (0, 1))
            sizes = pc.list_value_length(points).to_numpy()
            ends = np.cumsum(sizes)
            keep = np.ones(len(x), bool)
            for end, size, level, closed in zip(ends.tolist(), sizes.tolist(), batch.column("level").to_pylist(), batch.column("closed").to_pylist()):
                share, part = tolerance * FALLBACKS[level], slice(end - size, end)
                if closed:
                    keep[part] = kept_of_ring(x[part], y[part], share)
                elif share > 0:
                    keep[part] = kept_of_chain(x[part], y[part], share)
            left = np.add.reduceat(keep, ends - sizes) if len(ends) else ends
            offsets = pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32))
            short = pa.ListArray.from_arrays(offsets, flat.filter(pa.array(keep)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("image_id", "name", "level", "closed")), short], ["image_id", "name", "level", "closed", "points"])

    return chains.select("image_id", "name", "level", "closed", "points").mapInArrow(run, "image_id long, name string, level int, closed boolean, points array<struct<x:long,y:long>>")


def joined_rings(refs: DataFrame, simplified: DataFrame) -> DataFrame:
    """``(image_id, region_id, ring, points)``: rings put together from their chains, each in its direction and without its end."""
    met = refs.join(simplified.select("image_id", "name", "points").hint("merge"), ["image_id", "name"])
    turned = F.when(F.col("forward"), F.col("points")).otherwise(F.reverse("points"))
    same = (F.expr(twice_area("points")) > 0) == F.col("positive")
    part = F.when(F.col("closed"), F.when(same, F.col("points")).otherwise(F.reverse("points"))).otherwise(F.slice(turned, 1, F.size("points") - 1))
    parts = met.select("image_id", "region_id", "ring", "chain", part.alias("part"))
    return parts.groupBy("image_id", "region_id", "ring").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chain", "part"))), lambda p: p["part"])).alias("points"))


def simplified_rings(corners: DataFrame, tolerance: float, outlines: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """Rings whose chains are simplified within ``tolerance``, so that neighbours keep one border.

    Chains of regions that come out invalid take the next share of the tolerance until all is valid. A round
    looks only at what changed: its chains, the rings on them, and pairs of outlines with such a region.
    ``outlines`` makes outlines of rings.
    """
    chains, refs = chain_table(ring_chains(corners))
    chains = stored(chains.withColumn("level", F.lit(0)), "chains")
    rings = stored(joined_rings(refs, simplified_chains(chains, tolerance)), "rings")
    asked = None
    while True:
        whole = outlines(rings, True)
        if asked is not None:
            whole = whole.join(asked.withColumn("changed", F.lit(True)).hint("merge"), ["image_id", "region_id"], "left")
        bad = invalid_outlines(whole, None if asked is None else F.coalesce("changed", F.lit(False)))
        users = chains.filter(F.col("level") < len(FALLBACKS) - 1).select("image_id", "name", F.explode("regions").alias("region_id"))
        lower = stored(users.join(bad.hint("merge"), ["image_id", "region_id"], "left_semi").select("image_id", "name").distinct(), "chains-lower")
        if not lower.head(1):
            return rings
        lowered = chains.join(lower.withColumn("lower", F.lit(1)).hint("merge"), ["image_id", "name"], "left")
        chains = stored(lowered.withColumn("level", (F.col("level") + F.coalesce("lower", F.lit(0))).cast("int")).drop("lower"), "chains")
        asked = stored(chains.join(lower.hint("merge"), ["image_id", "name"], "left_semi").select("image_id", F.explode("regions").alias("region_id")).distinct(), "regions-changed")
        used = refs.join(asked.hint("merge"), ["image_id", "region_id"], "left_semi")
        needed = chains.join(used.select("image_id", "name").distinct().hint("merge"), ["image_id", "name"], "left_semi")
        fresh = joined_rings(used, simplified_chains(needed, tolerance))
        rings = stored(rings.join(asked.hint("merge"), ["image_id", "region_id"], "left_anti").unionByName(fresh), "rings")
