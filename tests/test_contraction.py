"""Merging over region graphs against whole pixel sets."""

from __future__ import annotations

import random

import fold_double
import numpy as np
import pytest

from tessella.operators import contraction, folds
from tessella.operators import regions as R

PALETTE = [0x102030, 0x203040, 0x303030, 0xA0A0A0, 0xD02010]


def images(seed, n=6):
    """Noise, blocks of several sizes, and one colour."""
    rng = np.random.default_rng(seed)
    grids = [rng.integers(0, 5, (9, 11))]
    for k in range(n - 2):
        block = np.kron(rng.integers(0, 4, (4, 4)), np.ones((3 + k % 2, 4), int))
        grids.append(np.where(rng.random(block.shape) < 0.2 + 0.1 * (k % 3), rng.integers(0, 5, block.shape), block))
    return [*grids, np.zeros((2, 3), int)]


def members_of(spark, grids):
    rows = [(i, int(ids[y, x]), x, y, int(g[y, x])) for i, g in enumerate(grids) for ids in [R.label_grid(g)] for y in range(g.shape[0]) for x in range(g.shape[1])]
    return spark.createDataFrame(rows, "image_id long, region_id long, x long, y long, idx long")


def mosaic_of(grid):
    y, x = np.mgrid[: grid.shape[0], : grid.shape[1]]
    return fold_double.Mosaic(R.label_grid(grid).ravel(), x.ravel(), y.ravel(), grid.ravel())


def members_of_mosaic(i, m):
    return {(i, r, p & ((1 << folds.SHIFT) - 1), p >> folds.SHIFT, m.colour[r]) for r, pixels in m.pixels.items() for p in pixels}


@pytest.mark.parametrize(("most_cluster", "batch", "diameter"), [(contraction.MOST_CLUSTER, contraction.BATCH, 3), (contraction.MOST_CLUSTER, 5, 2), (40, 20, 3)])
def test_mandatory_merge_equals_whole_mosaic(spark, most_cluster, batch, diameter):
    grids = images(4) if most_cluster > 40 else images(4)[1:3]
    want = set()
    for i, g in enumerate(grids):
        m = mosaic_of(g)
        fold_double.merge_undersized(m, diameter)
        want |= members_of_mosaic(i, m)
    found = contraction.merged_regions(members_of(spark, grids), diameter, False, most_cluster, batch).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_all_clusters_in_rounds(spark):
    rng = np.random.default_rng(2)
    grids = [rng.integers(0, 3, (5, 6)), np.array([[0, 1, 0, 1, 2, 2, 2], [1, 0, 1, 0, 2, 2, 2], [3, 3, 3, 1, 2, 2, 2]])]
    want = set()
    for i, g in enumerate(grids):
        m = mosaic_of(g)
        fold_double.merge_undersized(m, 2)
        want |= members_of_mosaic(i, m)
    assert {tuple(r) for r in contraction.merged_regions(members_of(spark, grids), 2, False, 0, 0).collect()} == want


def test_reduction_equals_whole_mosaic(spark):
    grids = images(9)
    palette = spark.createDataFrame([(i, i + 1, f"c{i}", c) for i, c in enumerate(PALETTE)], "idx long, number long, name string, rgb long")
    costs = folds.Costs(contraction.distance_table(palette, "delta_e_2000"))
    members = members_of(spark, grids).cache()
    want, steps = set(), set()
    for i, g in enumerate(grids):
        m = mosaic_of(g)
        steps |= {(i, k + 1, *s) for k, s in enumerate(fold_double.reduce_regions(m, costs, 3, 4, 0.7))}
        want |= members_of_mosaic(i, m)
    assert len(steps) > 30
    assert {tuple(r) for r in contraction.merge_trace(members, palette, 3, 4, 0.7).collect()} == steps
    assert {tuple(r) for r in contraction.reduced_regions(members, palette, 3, 4, 0.7).collect()} == want
    for r in contraction.reduction_matrix(members, palette, 3, [0.2, 0.6], [0.3, 0.7]).collect():
        m = mosaic_of(grids[r["image_id"]])
        fold_double.reduce_regions(m, costs, 3, r["target"], r["bound"])
        assert r["after"] == len(m.pixels)


def test_queue_order_on_many_graphs():
    r = random.Random(6)
    for k in range(150):
        grid = np.array([[r.randrange(2 + k % 3) for _ in range(w)] for w in [r.randint(1, 9)] for _ in range(r.randint(1, 9))])
        d, m = r.randint(1, 4), mosaic_of(grid)
        small = {n: np.array(sorted(p)) for n, p in m.pixels.items() if not folds.disc_fits(p, d)}
        borders = {n: dict(m.borders[n]) for n in small}
        into = folds.merge_undersized(borders, small, d)
        assert into == fold_double.merge_undersized(m, d) and set(small) == {n for n, p in m.pixels.items() if not folds.disc_fits(p, d)}
        assert all(borders[n] == m.borders[n] for n in small)
        for start in into:
            end = start
            while end in into:
                end = into[end]
            assert folds.final_owners(into)[start] == end


def test_regions_left_too_small(spark):
    alone = spark.createDataFrame([(1, 1, 0, 0, 0), (1, 1, 1, 0, 0)], "image_id long, region_id long, x long, y long, idx long")
    assert contraction.merged_regions(alone, 3).count() == 2
    with pytest.raises(Exception, match="too small to paint"):
        contraction.merged_regions(alone, 3, strict=True).collect()
    with pytest.raises(folds.PaintabilityError):
        contraction.merged_regions(alone, 3, True, 0, 0)
    assert contraction.merged_regions(alone.limit(0), 3).count() == 0
