"""Generation by configured values, decode gate and orientation."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pytest
from test_config import GOOD

from tessella import config
from tessella.operators import contraction, folds
from tessella.plans import pipeline
from tessella.sources import images, synthetic


def test_configured_pdf(spark):
    px = synthetic.raster(spark, "gradient", 24, 16).unionByName(synthetic.raster(spark, "gradient", 12, 20).selectExpr("image_id + 1 as image_id", "pos", "x", "y", "rgb"))
    palette = synthetic.benchmark_palette(spark, 8)
    values = config.resolve(GOOD | {"minimum_region_size_mm": 20.0, "line_color": "#FF0000", "outline_simplification_enabled": True, "max_regions": 3, "maximum_merge_cost": 1.0})
    document, placed = pipeline.generate_configured(px, palette, values)
    sizes = {r["image_id"]: (r["diameter"], r["width"]) for r in placed.collect()}
    assert [w for _, w in sizes.values()] == [24, 12] or len(sizes) == 2
    assert all(d == -(-20 // s) or d >= 1 for d, s in ((r["diameter"], r["scale"]) for r in placed.collect()))
    counts = {r["image_id"]: r["count"] for r in document.outlines.groupBy("image_id").count().collect()}
    assert len(counts) == 2 and all(n <= 8 for n in counts.values())
    pdfs = [bytes(r["pdf"]) for r in pipeline.configured_pdf(px, palette, values, "Set", 2).collect()]
    assert len(pdfs) == 2 and all(p.count(b"/Type /Page ") == 2 and b"1 0 0 RG" in p and b"(Version 2) Tj" in p for p in pdfs)


def test_configured_options():
    values = config.resolve(GOOD | {"region_complexity_reduction_enabled": False, "merge_cost_enclosure_strength": 0.25})
    found = pipeline.options_of(values, 4)
    assert (found.reduce, found.strict, found.tolerance, found.enclosure, found.diameter, found.distance) == (False, True, None, 0.25, 4, "delta_e_2000")
    assert pipeline.options_of(values | {"outline_simplification_enabled": True}, 4).tolerance == 1.0


def test_gates_stop_unpaintable_regions(spark):
    px = synthetic.raster(spark, "flat", 3, 3)
    with pytest.raises(Exception, match="too small to paint"):
        pipeline.generate(px, synthetic.benchmark_palette(spark, 4), pipeline.Options(diameter=5, strict=True)).members.count()
    with pytest.raises(folds.PaintabilityError):
        folds.check_paintable({1})


def test_stage_loss(spark):
    rows = [(0, 1 if x < 8 else 2, x, y, int(x >= 8)) for x in range(16) for y in range(8) if (x, y) != (3, 3)] + [(0, 3, 3, 3, 2)]
    found = contraction.stage_loss(spark.createDataFrame(rows, "image_id long, region_id long, x long, y long, idx long"), 3).first()
    assert (found["detected"], found["merged"], found["lost"]) == (3, 2, 1) and found["loss"] == pytest.approx(1 / 3)


def png(width, height, body):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_only_accepted_files_are_decoded(spark, tmp_path, monkeypatch):
    row = b"\0" + bytes([255, 0, 0] * 4)
    files = {"a [1].png": png(4, 3, row * 3), "bomb.png": png(60_000, 60_000, bytes(10)), "wide.png": png(4, 3, row * 3)[:40] + b"broken"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    given, decode = [], images.decode_files
    monkeypatch.setattr(images, "decode_files", lambda spark, paths: given.extend(paths) or decode(spark, paths))
    assert {(r["x"], r["y"], r["rgb"]) for r in images.load_images(spark, str(tmp_path), most_pixels=1000).collect()} == {(x, y, 0xFF0000) for x in range(4) for y in range(3)}
    refused = {r["path"].rsplit("/", 1)[1]: r["refusal"] for r in images.refused_images(spark, str(tmp_path), decode=True, most_pixels=1000).collect()}
    assert refused == {"bomb.png": "width", "wide.png": "body"}
    assert {p.rsplit("/", 1)[1] for p in given} == {"a [1].png", "wide.png"} and not any("bomb" in f for f in decode(spark, given).inputFiles())


def exif(orientation, order):
    e = {"II": "<", "MM": ">"}[order]
    tiff = order.encode() + struct.pack(f"{e}HI", 42, 8) + struct.pack(f"{e}H", 2) + struct.pack(f"{e}HHII", 0x0100, 3, 1, 7) + struct.pack(f"{e}HHIHH", 0x0112, 3, 1, orientation, 0) + bytes(4)
    body = b"Exif\0\0" + tiff
    return b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body


@pytest.mark.parametrize("order", ["II", "MM"])
def test_exif_orientation(order):
    for o in range(1, 9):
        assert images.exif_orientation(b"\xff\xd8\xff\xe0\x00\x04ab" + exif(o, order) + b"\xff\xd9") == o
    assert images.exif_orientation(b"\xff\xd8" + exif(9, order)) == 1 and images.exif_orientation(b"\xff\xd8\xff\xda") == 1 and images.exif_orientation(b"") == 1


def test_all_orientations(spark):
    grid = np.arange(6).reshape(2, 3)
    turned = {1: grid, 2: grid[:, ::-1], 3: grid[::-1, ::-1], 4: grid[::-1], 5: grid.T, 6: np.rot90(grid, -1), 7: grid[::-1, ::-1].T, 8: np.rot90(grid)}
    rows = [(o, x, y, int(grid[y, x]), 3, 2, o) for o in turned for y in range(2) for x in range(3)]
    found = images.oriented(spark.createDataFrame(rows, "image_id long, x long, y long, rgb long, width long, height long, orientation long")).collect()
    for o, want in turned.items():
        assert {(f["pos"], f["x"], f["y"], f["rgb"]) for f in found if f["image_id"] == o} == {(y * want.shape[1] + x, x, y, int(v)) for (y, x), v in np.ndenumerate(want)}
