"""Merging with whole pixel sets, one image at a time: the slow double of the folds over region graphs."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np

from tessella.operators.folds import SHIFT, STEPS, Costs, disc_fits


class Mosaic:
    """The regions of one image: pixels, colours, border lengths, perimeters."""

    def __init__(self, region: np.ndarray, x: np.ndarray, y: np.ndarray, idx: np.ndarray):
        packed = y << SHIFT | x
        order = np.lexsort((packed, region))
        cuts = np.flatnonzero(np.diff(region[order], prepend=-1))
        self.pixels = {int(region[order[a]]): set(packed[order[a:b]].tolist()) for a, b in zip(cuts, [*cuts[1:], len(order)])}
        self.colour = {int(region[order[a]]): int(idx[order[a]]) for a in cuts}
        owner = dict(zip(packed.tolist(), region.tolist()))
        self.borders: dict[int, dict[int, int]] = {r: {} for r in self.pixels}
        self.perimeter = dict.fromkeys(self.pixels, 0)
        for p, r in owner.items():
            for step in STEPS:
                other = owner.get(p + step)
                if other != r:
                    self.perimeter[r] += 1
                    if other is not None:
                        self.borders[r][other] = self.borders[r].get(other, 0) + 1

    def merge(self, source: int, target: int) -> None:
        """``source`` becomes part of ``target``, which keeps its id and colour."""
        shared = self.borders[source].get(target, 0)
        self.perimeter[target] += self.perimeter.pop(source) - 2 * shared
        self.pixels[target] |= self.pixels.pop(source)
        for other, length in self.borders.pop(source).items():
            del self.borders[other][source]
            if other != target:
                self.borders[other][target] = self.borders[other].get(target, 0) + length
                self.borders[target][other] = self.borders[target].get(other, 0) + length
        del self.colour[source]

    @property
    def area(self) -> dict[int, int]:
        return {r: len(p) for r, p in self.pixels.items()}


def merge_undersized(mosaic: Mosaic, diameter: int) -> dict[int, int]:
    """Merges regions that hold no disc into the neighbour of longest border (then least id), first come first served; source -> target in order."""
    known: dict[int, bool] = {}
    generation = dict.fromkeys(sorted(mosaic.pixels), 0)
    queue = deque((r, 0) for r in generation)
    into: dict[int, int] = {}
    while queue:
        region, made = queue.popleft()
        if region not in mosaic.pixels or generation[region] != made:
            continue
        if region not in known:
            known[region] = disc_fits(mosaic.pixels[region], diameter)
        if known[region] or not mosaic.borders[region]:
            continue
        target = min(mosaic.borders[region].items(), key=lambda b: (-b[1], b[0]))[0]
        mosaic.merge(region, target)
        into[region] = target
        if not known.get(target):
            known.pop(target, None)
            generation[target] += 1
            queue.append((target, generation[target]))
    return into


def reduce_regions(mosaic: Mosaic, costs: Costs, diameter: int, most_regions: int, most_cost: float) -> list[tuple[int, int, float, int]]:
    """Accepts the cheapest merges (by cost, source, target) of at most ``most_cost`` until ``most_regions`` are left.

    A merge that would leave no disc is passed over. Returns the accepted steps: source, target, cost
    and border length.
    """
    heap: list[tuple[float, int, int, int]] = []
    version = dict.fromkeys(mosaic.pixels, 0)
    fits: dict[int, bool] = {}

    def add(source: int, target: int) -> None:
        cost = round(costs(mosaic, source, target), 12)
        if cost <= most_cost:
            heapq.heappush(heap, (cost, source, target, version[source] + version[target]))

    for source, near in mosaic.borders.items():
        for target in near:
            add(source, target)
    steps = []
    while len(mosaic.pixels) > most_regions and heap:
        cost, source, target, made = heapq.heappop(heap)
        if source not in mosaic.pixels or target not in mosaic.pixels or version[source] + version[target] != made:
            continue
        if target not in fits:
            fits[target] = disc_fits(mosaic.pixels[target], diameter)
        if not fits[target] and not disc_fits(mosaic.pixels[source] | mosaic.pixels[target], diameter):
            continue
        steps.append((source, target, cost, mosaic.borders[source][target]))
        mosaic.merge(source, target)
        fits[target] = True
        version[target] += 1
        for other in mosaic.borders[target]:
            add(other, target)
            add(target, other)
    return steps
