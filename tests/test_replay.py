"""Replayed merges against a mosaic that is really merged; legend pages."""

from __future__ import annotations

import fold_double
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import contraction, folds, regions, replay
from tessella.sources import legend, sinks


def test_replay_equals_merged_mosaic(spark):
    rng = np.random.default_rng(8)
    grids = [rng.integers(0, 4, (9, 11)), np.kron(rng.integers(0, 3, (6, 6)), np.ones((2, 2), int))]
    rows = [(i, y * g.shape[1] + x, x, y, int(g[y, x])) for i, g in enumerate(grids) for y in range(g.shape[0]) for x in range(g.shape[1])]
    rows = [tuple(int(v) for v in r) for r in rows]
    px = regions.detect_regions(spark.createDataFrame(rows, "image_id long, pos long, x long, y long, idx long")).cache()
    palette = spark.createDataFrame([(i, i + 1, f"c{i}", c) for i, c in enumerate([0x102030, 0x203040, 0x303030, 0xA0A0A0])], "idx long, number long, name string, rgb long")
    trace = contraction.merge_trace(px, palette, 1, 3, 0.9).cache()
    table, borders = regions.region_table(px), regions.shared_borders(px)
    found = {(r["image_id"], r["step"]): r for r in replay.accepted_merges(table, borders, trace, palette).collect()}
    contrast = {(r["image_id"], r["step"]): r for r in replay.accepted_contrast(table, borders, trace, palette).collect()}
    steps = trace.orderBy("image_id", "step").collect()
    assert len(steps) == len(found) == len(contrast) > 20
    de = contraction.distance_table(palette, "delta_e_2000")
    mosaics = {i: fold_double.Mosaic(*(px.filter(F.col("image_id") == i).toPandas()[c].to_numpy() for c in ("region_id", "x", "y", "idx"))) for i in range(len(grids))}
    for s in steps:
        m, f, c = mosaics[s["image_id"]], found[s["image_id"], s["step"]], contrast[s["image_id"], s["step"]]
        source, target = s["source_id"], s["target_id"]
        for side, r in (("source", source), ("target", target)):
            xs, ys = [p & ((1 << folds.SHIFT) - 1) for p in m.pixels[r]], [p >> folds.SHIFT for p in m.pixels[r]]
            assert (f[f"{side}_area"], f[f"{side}_perimeter"], f[f"{side}_idx"]) == (len(xs), m.perimeter[r], m.colour[r])
            assert [f[f"{side}_{b}"] for b in ("min_x", "min_y", "max_x", "max_y")] == [min(xs), min(ys), max(xs), max(ys)]
        assert f["border"] == m.borders[source][target] == s["border"] and f["cost"] == pytest.approx(s["cost"], abs=1e-9)
        near = {o: (n, de[m.colour[source], m.colour[o]]) for o, n in m.borders[source].items()}
        total = sum(n for n, _ in near.values())
        assert (c["neighbours"], c["total_border"], c["target_id"]) == (len(near), total, target)
        assert c["target_share"] == pytest.approx(near[target][0] / total) and c["coverage"] == pytest.approx(total / m.perimeter[source])
        assert c["weighted_de"] == pytest.approx(sum(n * d for n, d in near.values()) / total) and c["max_de"] == pytest.approx(max(d for _, d in near.values()))
        m.merge(source, target)


def test_legend_pages(spark):
    names = ["Plain", "Very long name that takes two lines", "(Odd) \\ name", "x"]
    palette = spark.createDataFrame([(i, i + 1, names[i % 4], 0xFFFFFF if i % 2 else 0x101010) for i in range(70)], "idx long, number long, name string, rgb long")
    lines = {(r["idx"], r["line"]): r["text"] for r in legend.legend_names(palette).collect()}
    assert lines[0, 0] == "Plain" and f"{lines[1, 0]} {lines[1, 1]}" == names[1] and (0, 1) not in lines
    pages = legend.legend_pages(palette, "Set", 3)
    assert len(pages) == 2 and b"(Set) Tj" in pages[0] and b"(Version 3) Tj" in pages[0] and b"Version" not in pages[1]
    assert pages[0].count(b" re f") == 68 and pages[1].count(b" re f") == 2 and b"(\\(Odd\\) \\\\ name) Tj" in pages[0]
    assert pages[0].count(b"1 1 1 rg") == 34 and sinks.pdf_document(pages, (210.0, 297.0)).count(b"/Type /Page ") == 2
    with pytest.raises(legend.LegendError):
        legend.legend_pages(palette.withColumn("name", F.lit("far too long a name for any two lines of a column")), "Set", 1)
    with pytest.raises(legend.LegendError):
        legend.legend_pages(palette, "Set", 1, legend.LegendStyle(columns=5))
