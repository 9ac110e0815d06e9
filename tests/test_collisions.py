"""Neighbours at several offsets: results against brute force, and what the plans shuffle."""

from __future__ import annotations

import random
import re

import pytest

from tessella.functions.color import colour_distance
from tessella.operators import collisions as C

OFFSETS = [2, 4, 8]
SCHEMA = "image_id long, pos long, x long, y long, rgb long, idx long, de double"


def raster():
    """Rows (image_id, pos, x, y, rgb, idx, de): gaps, rows that come twice, null positions and null colours among them."""
    r = random.Random(5)
    colours = [0x101010, 0x131313, 0x404040, 0x464646, 0xA02020]
    rows = [(i, y * 20 + x, x, y, r.choice(colours), r.randrange(2), 0.5) for i in (3, None) for y in range(12) for x in range(20) if r.random() < 0.9]
    rows = [(*a[:4], None if r.random() < 0.03 else a[4], None if r.random() < 0.03 else a[5], a[6]) for a in rows]
    return rows + r.sample(rows, 60) + [(7, None, None, 4, 0x101010, 1, 0.5), (7, None, 4, None, 0x404040, 1, 0.5), (9, 0, 0, 0, 0x101010, 1, 0.5)]


def distances(spark, rows):
    colours = sorted({a[4] for a in rows if a[4] is not None})
    pairs = spark.createDataFrame([(a, b) for a in colours for b in colours], "first long, second long")
    return {(f["first"], f["second"]): f["de"] for f in colour_distance(pairs, "first", "second", "de").collect()}


def at(rows, image, x, y):
    """The pixel of a place; all rows of a place are alike."""
    return next((a for a in rows if (a[0], a[2], a[3]) == (image, x, y)), None)


def alike(one, other):
    """Of one palette colour, by different sources."""
    return other is not None and None not in (one[4], one[5], other[4], other[5]) and one[5] == other[5] and one[4] != other[4]


def steps(a, k):
    return () if None in (a[2], a[3]) else (("horizontal", k, 0), ("vertical", 0, k))


def test_center_surround_equals_brute_force(spark):
    rows = raster()
    de, want = distances(spark, rows), []
    for c in rows:
        for k in OFFSETS:
            for o, dx, dy in steps(c, k):
                a, b = at(rows, c[0], c[2] - dx, c[3] - dy), at(rows, c[0], c[2] + dx, c[3] + dy)
                if alike(c, a) and alike(c, b) and de[a[4], b[4]] <= 5 < min(de[c[4], a[4]], de[c[4], b[4]]):
                    want.append((c[0], k, o, c[2], c[3], c[4], a[4], b[4], c[5]))
    found = C.center_surround(spark.createDataFrame(rows, SCHEMA), OFFSETS)
    assert found.columns == ["image_id", "offset_px", "orientation", "x", "y", "center_rgb", "first_rgb", "second_rgb", "idx", "background_de", "first_de", "second_de"]
    assert len(want) > 20 and sorted((tuple(f)[:9] for f in found.collect()), key=repr) == sorted(want, key=repr)
    assert all(f["background_de"] == de[f["first_rgb"], f["second_rgb"]] and f["first_de"] == de[f["center_rgb"], f["first_rgb"]] and f["second_de"] == de[f["center_rgb"], f["second_rgb"]] for f in found.collect())
    assert C.center_surround(spark.createDataFrame([], SCHEMA), OFFSETS).count() == 0


def test_offset_pairs_equal_brute_force(spark):
    rows = raster()
    de, want = distances(spark, rows), []
    for a in rows:
        for k in OFFSETS:
            for o, dx, dy in steps(a, k):
                b = at(rows, a[0], a[2] + dx, a[3] + dy)
                if alike(a, b) and de[a[4], b[4]] > 5:
                    want.append((a[0], k, o, a[2], a[3], a[4], b[4], a[5], de[a[4], b[4]]))
    table = spark.createDataFrame(rows, SCHEMA)
    found = C.offset_pairs(table, OFFSETS)
    assert found.columns == ["image_id", "offset_px", "orientation", "x", "y", "rgb", "other_rgb", "idx", "de"]
    assert len(want) > 200 and sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    of_image = {k: [w[8] for w in want if w[:2] == (3, k)] for k in OFFSETS}
    summary = {(s["image_id"], s["offset_px"]): s for s in C.offset_summary(found, OFFSETS, table).collect()}
    for k, values in of_image.items():
        s = summary[3, k]
        assert (s["pairs"], s["min_de"], s["max_de"]) == (len(values), min(values), max(values)) and s["mean_de"] == pytest.approx(sum(values) / len(values))
        assert tuple(summary[9, k])[2:] == (0, None, None, None)
    assert C.offset_pairs(spark.createDataFrame([], SCHEMA), OFFSETS).count() == 0


def test_pixels_without_a_place_meet_each_other(spark):
    """Null positions on one line are one place: its first row is the neighbour of all, at every offset."""
    rows = [(8, None, None, 1, 0x101010, 1, 0.5), (8, None, None, 1, 0x404040, 1, 0.5), (8, 5, 5, 1, 0x404040, 1, 0.5)]
    found = C.offset_pairs(spark.createDataFrame(rows, SCHEMA), OFFSETS).collect()
    assert sorted((f["offset_px"], f["orientation"], f["x"], f["y"]) for f in found) == [(k, "horizontal", None, 1) for k in OFFSETS]


@pytest.mark.parametrize("operator", [C.center_surround, C.offset_pairs])
def test_pixels_are_sorted_once_a_direction(spark, operator):
    """All offsets come from one window a direction, so from one shuffle and one sort."""
    rows = spark.range(100).selectExpr("0L as image_id", "id as pos", "id % 10 as x", "id div 10 as y", "id % 7 as rgb", "id % 3 as idx", "0e0 as de")
    plan = operator(rows, OFFSETS)._jdf.queryExecution().executedPlan().toString()
    assert {n: len(re.findall(rf"[-+] {n}", plan)) for n in ("Window", "Sort", "Exchange")} == {"Window": 2, "Sort": 2, "Exchange": 2}


def test_later_distances_are_of_kept_rows(spark):
    """A row that one distance rules out meets no other: a filter stands between the distances."""
    rows = spark.createDataFrame(raster(), SCHEMA)
    plan = C.center_surround(rows, OFFSETS)._jdf.queryExecution().optimizedPlan().toString()
    order = re.findall(r"Filter .*\bde#\d+ (<=|>) 5\.0|Generate inline.*\[(de)#", plan)
    assert [a or b for a, b in order] == ["<=", "de", ">", "de", ">", "de"]


@pytest.mark.parametrize("operator", [C.adjacent_pairs, lambda q: C.offset_pairs(q, OFFSETS), lambda q: C.center_surround(q, OFFSETS)])
def test_no_column_is_shuffled_twice(spark, operator):
    """What goes into the first shuffles is the pixel's own columns, with no struct that repeats them."""
    rows = spark.range(100).selectExpr("0L as image_id", "id as pos", "id % 10 as x", "id div 10 as y", "id % 7 as rgb", "id % 3 as idx", "0e0 as de")
    plan = operator(rows)._jdf.queryExecution().executedPlan().toString()
    below = re.findall(r"Exchange .*\n.*(Project|Window) \[(.*)", plan)
    assert any(kind == "Project" for kind, _ in below) and not any("struct(" in columns for kind, columns in below if kind == "Project")


def test_a_neighbour_without_colours_is_still_there(spark):
    """Null is a pixel that is missing, not one whose colours are."""
    rows = [(1, 0, 0, 0, 5, 1, 0.5), (1, 1, 1, 0, None, None, 0.5), (1, 3, 3, 0, 5, 1, 0.5)]
    found = C.adjacent_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(f["x"], f["orientation"], tuple(f["n"])) for f in found] == [(0, "horizontal", (None, None))]


def test_summary_quantizes_once(spark):
    """The list of images comes from the stored raster: nothing of the result reads the events or joins colours again."""
    from tessella.plans.catalog import QUERIES

    read = QUERIES["offset_collapsed_summary"](spark, "/root/testdata/sf0.001").inputFiles()
    assert read and all("/quantized-" in path for path in read)


def test_sums_of_images_are_not_broadcast(spark):
    """Three rows an image grow with the images, however small they are here."""
    rows = spark.range(100).selectExpr("id div 50 as image_id", "id as pos", "id % 10 as x", "id div 10 as y", "id % 7 as rgb", "id % 3 as idx", "0e0 as de")
    plan = C.offset_summary(C.offset_pairs(rows, OFFSETS), OFFSETS, rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_hot_place_is_dealt_by_direction(spark):
    """A place that comes many times: its pairs along the row and those along the column come from different tasks."""
    from pyspark.sql import functions as F

    rows = [(1, 0, 8, 8, 0x101010, 1, 0.5)] * 300 + [(1, 0, 8 + k * h, 8 + k * (1 - h), 0x404040, 1, 0.5) for k in OFFSETS for h in (0, 1)]
    found = C.offset_pairs(spark.createDataFrame(rows, SCHEMA), OFFSETS).filter("x = 8 and y = 8")
    tasks = {o: {f["task"] for f in found.withColumn("task", F.spark_partition_id()).collect() if f["orientation"] == o} for o in C.LINES}
    assert found.count() == 1800 and all(len(t) == 1 for t in tasks.values()) and not tasks["horizontal"] & tasks["vertical"]
