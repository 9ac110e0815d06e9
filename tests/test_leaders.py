"""Leader clusters, union measures and resampling against one step after the other."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tessella.functions.color import with_lab
from tessella.operators import leaders, merging
from tessella.sources import resampling


@pytest.mark.parametrize(("distance", "threshold"), [("delta_e_76", 6.0), ("delta_e_76", 0.0), ("delta_e_2000", 4.0)])
def test_leaders_equal_sequential(spark, distance, threshold):
    from tessella.functions.color import with_distance

    r = random.Random(11)
    rows = []
    for image in range(3):
        base = [r.randrange(1 << 24) for _ in range(5)]
        colours = {(b + r.choice([0, 1, 256, 65536, 515, 4 * 257]) * r.randrange(6)) & 0xFFFFFF for b in base for _ in range(25)}
        rows += [(image, c, p) for p, c in enumerate(r.sample(sorted(colours), len(colours)))]
    table = with_lab(spark.createDataFrame(rows, "image_id long, rgb long, first_pos long"))
    lab = {(x["image_id"], x["rgb"]): (x["l"], x["a"], x["b"]) for x in table.collect()}
    both = with_distance(table.selectExpr("image_id", "rgb as one", "l as l1", "a as a1", "b as b1").join(table.selectExpr("image_id", "rgb as two", "l as l2", "a as a2", "b as b2"), "image_id"), distance)
    de = {(x["image_id"], x["one"], x["two"]): x["de"] for x in both.collect()}
    if distance == "delta_e_76":
        de = {(i, a, b): math.dist(lab[i, a], lab[i, b]) for i, a, b in de}
    want, led = {}, {}
    for image, c, _ in sorted(rows, key=lambda x: (x[0], x[2])):
        near = [x for x in led.setdefault(image, []) if de[image, c, x] <= threshold]
        want[image, c] = near[0] if near else c
        if not near:
            led[image].append(c)
    found = {(x["image_id"], x["rgb"]): x["leader"] for x in leaders.leader_clusters(table, threshold, distance).collect()}
    assert found == want and (threshold == 0 or len(set(want.items())) > len({(i, v) for (i, _), v in want.items()}))


def test_union_measures_equal_brute_force(spark):
    r = random.Random(2)
    regions = [{(x, y) for x in range(a, a + r.randint(1, 6)) for y in range(b, b + r.randint(1, 6)) if r.random() < 0.9} or {(0, 0)} for a, b in [(r.randrange(9), r.randrange(9)) for _ in range(12)]]
    members = spark.createDataFrame([(1, i, x, y) for i, own in enumerate(regions) for x, y in own], "image_id long, region_id long, x long, y long")
    pairs = spark.createDataFrame([(1, a, b) for a in range(12) for b in range(12) if a != b], "image_id long, src long, dst long")
    found = merging.union_measures(members, pairs).collect()
    assert len(found) == 132
    for f in found:
        both = regions[f["src"]] | regions[f["dst"]]
        sides = sum((x + dx, y + dy) not in both for x, y in both for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        assert (f["union_area"], f["union_perimeter"]) == (len(both), sides)


def weights(n, m):
    out = np.zeros((m, n))
    scale = n / m
    wide = max(scale, 1.0)
    for i in range(m):
        centre = (i + 0.5) * scale
        for k in range(max(0, math.floor(centre - 3 * wide + 0.5)), min(n, math.floor(centre + 3 * wide + 0.5))):
            t = (k + 0.5 - centre) / wide
            out[i, k] = np.sinc(t) * np.sinc(t / 3) if abs(t) < 3 else 0
    return out / out.sum(axis=1, keepdims=True)


def test_resampling_equals_matrix_products(spark):
    r = np.random.default_rng(5)
    shapes = [((9, 13), (4, 5)), ((6, 6), (6, 6)), ((5, 4), (11, 3)), ((1, 7), (1, 2))]
    rows, sizes, want = [], [], {}
    for i, ((h, w), (mh, mw)) in enumerate(shapes):
        image = r.integers(0, 256, (h, w, 3))
        rows += [(i, x, y, int(image[y, x] @ [65536, 256, 1])) for y in range(h) for x in range(w)]
        sizes.append((i, w, h, mw, mh))
        small = image if (h, w) == (mh, mw) else np.clip(np.floor(np.einsum("ah,bw,hwc->abc", weights(h, mh), weights(w, mw), image) + 0.5), 0, 255).astype(int)
        want |= {(i, y * mw + x, x, y): int(small[y, x] @ [65536, 256, 1]) for y in range(mh) for x in range(mw)}
    found = resampling.resample(spark.createDataFrame(rows, "image_id long, x long, y long, rgb long"), spark.createDataFrame(sizes, "image_id long, width long, height long, process_width long, process_height long")).collect()
    assert {(f["image_id"], f["pos"], f["x"], f["y"]): f["rgb"] for f in found} == want
