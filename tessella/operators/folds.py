"""Steps whose result depends on the order of earlier steps: merging, reduction, greedy grouping.

Merging works on region graphs, whose measures, borders and too small regions Spark finds and deals
(:mod:`tessella.operators.contraction`). Greedy components are a grouped map over single images, whose size is bounded.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Collection, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.color import colour_distance
from tessella.operators.merging import COLOUR_SCALE, COMPACTNESS, ENCLOSURE, WEIGHTS, check_weights
from tessella.operators.regions import disc_rows, fitting_regions, shared_borders

SHIFT = 32
STEPS = (1, -1, 1 << SHIFT, -(1 << SHIFT))


class PaintabilityError(ValueError):
    """Some region stays too small to paint and has no neighbour to join."""


def disc_fits(pixels: Iterable[int], diameter: int) -> bool:
    """Whether the packed pixels hold a disc of this diameter."""
    packed = pixels if isinstance(pixels, np.ndarray) else np.fromiter(pixels, np.int64)
    rows = disc_rows(diameter) if diameter > 0 else []
    if not rows or len(packed) < sum(2 * k + 1 for _, k in rows):
        return False
    x, y = packed & ((1 << SHIFT) - 1), packed >> SHIFT
    x0, y0, r = int(x.min()), int(y.min()), diameter / 2
    grid = np.zeros((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), bool)
    grid[y - y0, x - x0] = True
    lo_x, hi_x, lo_y, hi_y = math.ceil(r), math.floor(grid.shape[1] - 1 - r), math.ceil(r), math.floor(grid.shape[0] - 1 - r)
    if lo_x > hi_x or lo_y > hi_y:
        return False
    total = np.concatenate([np.zeros((grid.shape[0], 1), np.int64), np.cumsum(grid, axis=1)], axis=1)
    fits = np.ones((hi_y - lo_y + 1, hi_x - lo_x + 1), bool)
    for dy, k in rows:
        part = total[lo_y + dy : hi_y + dy + 1]
        fits &= part[:, lo_x + k + 1 : hi_x + k + 2] - part[:, lo_x - k : hi_x - k + 1] == 2 * k + 1
    return bool(fits.any())


class RegionGraph:
    """The regions of one image by their measures and border lengths; of those that hold no disc also the pixels.

    ``rows``: see :func:`tessella.operators.contraction.region_graph`.
    """

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("region_id")
        ids = rows["region_id"].tolist()
        self.colour, self.area, self.perimeter = (dict(zip(ids, rows[c].tolist())) for c in ("idx", "area", "perimeter"))
        self.borders = {r: {b["dst"]: b["length"] for b in near} if near is not None else {} for r, near in zip(ids, rows["near"])}
        self.small = {r: np.asarray(p, np.int64) for r, p in zip(ids, rows["pixels"]) if p is not None}

    def merge(self, source: int, target: int) -> None:
        """``source`` becomes part of ``target``, which keeps its id and colour."""
        self.perimeter[target] += self.perimeter.pop(source) - 2 * self.borders[source][target]
        self.area[target] += self.area.pop(source)
        join_borders(self.borders, source, target)
        del self.colour[source]
        part, rest = self.small.pop(source, None), self.small.pop(target, None)
        if part is not None and rest is not None:
            self.small[target] = np.concatenate([rest, part])


def join_borders(borders: dict[int, dict[int, int]], source: int, target: int) -> None:
    """Borders once ``source`` is part of ``target``; regions that are no key of ``borders`` are known as neighbours only."""
    for other, length in borders.pop(source).items():
        near = borders.get(other)
        if near is not None:
            del near[source]
        if other == target:
            continue
        if near is not None:
            near[target] = near.get(target, 0) + length
        if target in borders:
            borders[target][other] = borders[target].get(other, 0) + length


def merge_undersized(borders: dict[int, dict[int, int]], small: dict[int, np.ndarray], diameter: int) -> dict[int, int]:
    """Merges the regions of ``small``, which hold no disc, into the neighbour of longest border (then least id), first come first served; source -> target in order.

    ``borders``: of the regions in ``small``; both are left as they are after the merges, ``small`` with what still holds no disc.
    """
    generation = dict.fromkeys(sorted(small), 0)
    queue = deque(generation.items())
    into: dict[int, int] = {}
    while queue:
        region, made = queue.popleft()
        if region not in small or generation[region] != made:
            continue
        if made and disc_fits(small[region], diameter):
            del small[region]
        elif borders[region]:
            target = min(borders[region].items(), key=lambda b: (-b[1], b[0]))[0]
            join_borders(borders, region, target)
            into[region] = target
            part = small.pop(region)
            if target in small:
                small[target] = np.concatenate([small[target], part])
                generation[target] += 1
                queue.append((target, generation[target]))
    return into


def final_owners(into: dict[int, int]) -> dict[int, int]:
    """The region that each merged one ends in."""
    final: dict[int, int] = {}
    for source in reversed(into):  # what a target joins later is known already
        final[source] = final.get(into[source], into[source])
    return final


class Costs:
    """Cost of a directed merge in a region graph; the scalar form of :func:`tessella.operators.merging.cost_steps`."""

    def __init__(self, distances: dict[tuple[int, int], float], weights: tuple[float, ...] = WEIGHTS["production"], enclosure: float = ENCLOSURE, compactness: float = COMPACTNESS):
        self.distances, self.weights, self.enclosure, self.compactness = distances, check_weights(weights), enclosure, compactness

    def __call__(self, m: RegionGraph, source: int, target: int) -> float:
        de, border = self.distances[m.colour[source], m.colour[target]], m.borders[source][target]
        sa, ta, sp, tp = m.area[source], m.area[target], m.perimeter[source], m.perimeter[target]
        color, area, enclosed = de / (de + COLOUR_SCALE), sa / (sa + ta), border / sp
        before = tp * tp / ta
        worse = max(0.0, (sp + tp - 2 * border) ** 2 / (sa + ta) - before)
        geometry = worse / (before + worse) if worse else 0.0
        c, a, b, g = self.weights
        cost = c * color + a * area + b * (1 - enclosed) + g * geometry
        protect = color * (1 - area)
        cost += self.enclosure * enclosed * protect * (1 - cost)
        return cost + self.compactness * (1 - min(1.0, 4 * math.pi * sa / (sp * sp))) * protect * (1 - cost)


def reduce_regions(graph: RegionGraph, costs: Costs, diameter: int, most_regions: int, most_cost: float) -> list[tuple[int, int, float, int]]:
    """Accepts the cheapest merges (by cost, source, target) of at most ``most_cost`` until ``most_regions`` are left.

    A merge that would leave no disc is passed over; only where both regions hold none do pixels tell. Returns
    the accepted steps: source, target, cost and border length.
    """
    heap: list[tuple[float, int, int, int]] = []
    version = dict.fromkeys(graph.area, 0)

    def add(source: int, target: int) -> None:
        cost = round(costs(graph, source, target), 12)
        if cost <= most_cost:
            heapq.heappush(heap, (cost, source, target, version[source] + version[target]))

    for source, near in graph.borders.items():
        for target in near:
            add(source, target)
    steps = []
    while len(graph.area) > most_regions and heap:
        cost, source, target, made = heapq.heappop(heap)
        if source not in graph.area or target not in graph.area or version[source] + version[target] != made:
            continue
        if source in graph.small and target in graph.small and not disc_fits(np.concatenate([graph.small[source], graph.small[target]]), diameter):
            continue
        steps.append((source, target, cost, graph.borders[source][target]))
        graph.merge(source, target)
        graph.small.pop(target, None)
        version[target] += 1
        for other in graph.borders[target]:
            add(other, target)
            add(target, other)
    return steps


def check_paintable(small: Collection[int]) -> None:
    """:class:`PaintabilityError` if some region holds no disc."""
    if small:
        raise PaintabilityError(f"regions too small to paint: {sorted(small)[:10]}")


def _greedy_components(part: pd.DataFrame, threshold: float) -> list[list[int]]:
    """Packed members of each component, seed first; ``part`` is in scan order."""
    packed = (part["y"].to_numpy() << SHIFT | part["x"].to_numpy()).tolist()
    free, out, most = dict(zip(packed, part[["l", "a", "b"]].itertuples(index=False, name=None))), [], threshold * threshold
    for seed in packed:
        if seed not in free:
            continue
        l0, a0, b0 = free.pop(seed)
        members = [seed]
        for p in members:  # grows while it is read; a colour is compared only when the flood reaches its pixel
            for step in STEPS:
                q = p + step
                colour = free.get(q)
                if colour is not None and (colour[0] - l0) ** 2 + (colour[1] - a0) ** 2 + (colour[2] - b0) ** 2 <= most:
                    del free[q]
                    members.append(q)
        out.append(members)
    return out


def local_components(pixels: DataFrame, threshold: float) -> DataFrame:
    """``pixels(image_id, x, y, rgb, l, a, b)`` with ``region_id`` and ``seed_rgb``: greedy source components.

    Seeds are taken in scan order; a component is all that is reached from its seed over pixels within
    the threshold of the seed's colour (plain Lab distance), so it is no equivalence of colours.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["y", "x"])
        colour = dict(zip((part["y"].to_numpy() << SHIFT | part["x"].to_numpy()).tolist(), part["rgb"].tolist()))
        rows = [(int(part["image_id"].iloc[0]), k + 1, p & ((1 << SHIFT) - 1), p >> SHIFT, int(colour[members[0]])) for k, members in enumerate(_greedy_components(part, threshold)) for p in members]
        return pd.DataFrame(rows, columns=["image_id", "region_id", "x", "y", "seed_rgb"])

    return pixels.select("image_id", "x", "y", "rgb", "l", "a", "b").groupBy("image_id").applyInPandas(run, "image_id long, region_id long, x long, y long, seed_rgb long")


def local_component_table(members: DataFrame, diameter: int) -> DataFrame:
    """One row a component: seed colour, pixels, bounding box, and whether it holds a disc."""
    table = members.groupBy("image_id", "region_id").agg(F.first("seed_rgb").alias("seed_rgb"), F.count("*").alias("pixels"), *(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))))
    fits = fitting_regions(members, diameter).withColumn("paintable", F.lit(True))
    return table.join(fits, ["image_id", "region_id"], "left").withColumn("paintable", F.coalesce("paintable", F.lit(False)))


def unpaintable_components(members: DataFrame, diameter: int, distance: str = "delta_e_2000") -> DataFrame:
    """Components without a disc, ranked by size, each with the neighbour of longest border (then nearest colour, colour, number); none is null."""
    table = local_component_table(members, diameter)
    other = table.select("image_id", F.col("region_id").alias("dst"), F.col("seed_rgb").alias("other_rgb"))
    near = shared_borders(members).join(other, ["image_id", "dst"]).withColumnRenamed("src", "region_id")
    small = table.filter(~F.col("paintable")).drop("paintable")
    pairs = colour_distance(small.select("image_id", "region_id", "seed_rgb").join(near, ["image_id", "region_id"]), "seed_rgb", "other_rgb", "de", distance)
    best = Window.partitionBy("image_id", "region_id").orderBy(F.desc("length"), F.round("de", 9), "other_rgb", "dst")
    chosen = pairs.withColumn("r", F.row_number().over(best)).filter("r = 1").select("image_id", "region_id", F.col("dst").alias("neighbour"), "length", "de")
    order = Window.partitionBy("image_id").orderBy(F.desc("pixels"), "min_y", "min_x", "seed_rgb", "region_id")
    return small.join(chosen, ["image_id", "region_id"], "left").withColumn("rank", F.row_number().over(order).cast("long"))


def local_component_summary(components: DataFrame) -> DataFrame:
    paintable = F.col("paintable")
    return components.groupBy("image_id").agg(F.count("*").alias("components"), F.count_if(paintable).alias("paintable"), F.count_if(~paintable).alias("unpaintable"), F.coalesce(F.sum(F.when(paintable, F.col("pixels"))), F.lit(0)).alias("paintable_pixels"), F.coalesce(F.sum(F.when(~paintable, F.col("pixels"))), F.lit(0)).alias("unpaintable_pixels"))
