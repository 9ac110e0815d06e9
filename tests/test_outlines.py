"""Outlines, chains and overlaps as relations against their slow doubles."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import outline_double as double
import pytest

from tessella.operators import outlines, overlaps, topology

SCHEMA = "image_id long, region_id long, points array<struct<x:long,y:long>>, hole_rings array<array<struct<x:long,y:long>>>"


def label(grid):
    """4-connected regions from 1 in scan order, by flooding."""
    ids, n = np.zeros(grid.shape, int), 0
    for start in np.ndindex(grid.shape):
        if ids[start]:
            continue
        n, todo = n + 1, [start]
        ids[start] = n
        while todo:
            y, x = todo.pop()
            for v, u in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
                if 0 <= v < grid.shape[0] and 0 <= u < grid.shape[1] and not ids[v, u] and grid[v, u] == grid[y, x]:
                    ids[v, u] = n
                    todo.append((v, u))
    return ids


def members(spark, grids):
    rows = [(i, int(r), int(x), int(y)) for i, g in enumerate(grids) for (y, x), r in np.ndenumerate(g)]
    return spark.createDataFrame(rows, "image_id long, region_id long, x long, y long")


def traced(grid):
    """Rings of each region with the region beyond each edge, one edge after the other."""
    edges = defaultdict(dict)
    for (y, x), r in np.ndenumerate(grid):
        for dx, dy, ax, ay, bx, by in outlines.SIDES:
            v, u = y + dy, x + dx
            other = int(grid[v, u]) if 0 <= v < grid.shape[0] and 0 <= u < grid.shape[1] else None
            if other != r:
                edges[int(r)][(x + ax, y + ay), (x + bx, y + by)] = other
    found = {}
    for r, beyond in edges.items():
        outer, holes = double.classify_rings(double.trace_rings(list(beyond)))
        found[r] = [(ring, [beyond[ring[i], ring[(i + 1) % len(ring)]] for i in range(len(ring))]) for ring in (outer, *holes)]
    return found


def grids():
    rng = np.random.default_rng(3)
    smooth = np.add.outer(np.sin(np.arange(30) / 4), np.cos(np.arange(36) / 5))
    return [label(rng.integers(0, 2, (12, 14))), label(rng.integers(0, 3, (9, 9))), label((smooth * 3).round().astype(int)), label(np.zeros((3, 4), int)), label(np.kron(rng.integers(0, 3, (6, 6)), np.ones((4, 4), int)))]


def as_lists(row):
    ring = lambda points: [(p["x"], p["y"]) for p in points]
    return [ring(row["points"]), *map(ring, row["hole_rings"])]


@pytest.mark.parametrize("tolerance", [None, 0.0, 0.8, 1.5, 4.0])
def test_outlines_equal_double(spark, tolerance):
    own = grids()
    found = {(r["image_id"], r["region_id"]): as_lists(r) for r in outlines.trace_outlines(members(spark, own), tolerance).collect()}
    want = {}
    for i, grid in enumerate(own):
        rings = traced(grid)
        done = {r: [ring for ring, _ in parts] for r, parts in rings.items()} if tolerance is None else double.simplify_together(rings, tolerance)
        want |= {(i, r): [double.drop_straight(ring) for ring in parts] for r, parts in done.items()}
    assert found == want


def test_edges_of_regions_that_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    own = grids()[:2]
    found = {(r["image_id"], r["region_id"]): as_lists(r) for r in outlines.trace_outlines(members(spark, own), raw=True).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {(i, r): [ring for ring, _ in parts] for i, g in enumerate(own) for r, parts in traced(g).items()}


def test_chains_equal_double(spark):
    own = grids()
    found = {r["image_id"]: r for r in topology.chain_stats(outlines.ring_points(members(spark, own))).collect()}
    for i, grid in enumerate(own):
        names, refs, nodes = set(), 0, set()
        for parts in traced(grid).values():
            for ring, others in parts:
                chains = double.boundary_chains(ring, others)
                closed = len(chains) == 1 and chains[0] is ring
                names |= {(closed, *(double.canonical_ring if closed else double.canonical_chain)(c)) for c in chains}
                nodes |= set() if closed else {p for c in chains for p in (c[0], c[-1])}
                refs += len(chains)
        r = found[i]
        assert (r["chains"], r["closed_chains"], r["refs"], r["nodes"]) == (len(names), sum(n[0] for n in names), refs, len(nodes))


def polygons(rng, n, side):
    out = []
    for _ in range(n):
        x, y = rng.randint(-side, side), rng.randint(-side, side)
        kind = rng.random()
        if kind < 0.4:  # a box, now and then with a hole
            w, h = rng.randint(1, 8), rng.randint(1, 8)
            rings = [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]
            if w > 2 and h > 2 and rng.random() < 0.6:
                rings.append([(x + 1, y + 1), (x + 1, y + h - 1), (x + w - 1, y + h - 1), (x + w - 1, y + 1)])
        elif kind < 0.5 and out:
            rings = [list(reversed(r)) for r in rng.choice(out)]  # the same sides
        else:
            rings = [[(x + rng.randint(0, 9), y + rng.randint(0, 9)) for _ in range(rng.randint(3, 6))]]
        out.append(rings)
    return out


@pytest.mark.parametrize(("seed", "n", "side", "cell"), [(1, 40, 25, 16), (2, 40, 8, 4), (3, 60, 40, 3)])
def test_overlaps_equal_double(spark, seed, n, side, cell):
    rng = random.Random(seed)
    images = [polygons(rng, n, side) for _ in range(2)]
    points = lambda ring: [{"x": x, "y": y} for x, y in ring]
    table = spark.createDataFrame([(i, r, points(p[0]), [points(h) for h in p[1:]]) for i, own in enumerate(images) for r, p in enumerate(own)], SCHEMA)
    want = {(i, a, b) for i, own in enumerate(images) for a in range(n) for b in range(a + 1, n) if double.areas_overlap(own[a], own[b])}
    assert {tuple(r) for r in overlaps.overlapping_pairs(table, cell=cell).collect()} == want
    asked = {tuple(r) for r in overlaps.overlapping_pairs(table, table["region_id"] % 5 == 0, cell).collect()}
    assert asked == {p for p in want if p[1] % 5 == 0 or p[2] % 5 == 0}
    improper = {(i, r) for i, own in enumerate(images) for r, p in enumerate(own) if not all(map(double.ring_is_valid, p))}
    assert {tuple(r) for r in overlaps.improper_outlines(table, cell).collect()} == improper
    assert {tuple(r) for r in overlaps.invalid_outlines(table, cell=cell).collect()} == improper | {(i, r) for i, *pair in want for r in pair}
