"""Palette documents, images and the whole generation on small inputs."""

from __future__ import annotations

import copy
import json

import pytest

from tessella.plans.pipeline import Options, generate
from tessella.sources import images, palettes, sinks, synthetic

GOOD = {"metadata": {"id": "set", "manufacturer": "maker", "display_name": "Set", "version": 1}, "colors": [{"number": 1, "name": "one", "rgb": {"red": 1, "green": 2, "blue": 3}}, {"number": 5, "name": "two", "rgb": {"red": 255, "green": 0, "blue": 0}}]}


def changed(change):
    out = copy.deepcopy(GOOD)
    change(out)
    return json.dumps(out)


BAD = {
    "extra key": changed(lambda d: d.update(more=1)),
    "missing key": changed(lambda d: d["metadata"].pop("manufacturer")),
    "repeated number": changed(lambda d: d["colors"][1].update(number=1)),
    "channel": changed(lambda d: d["colors"][0]["rgb"].update(red=256)),
    "boolean": changed(lambda d: d["colors"][0].update(number=True)),
    "text": changed(lambda d: d["colors"][0].update(name="日")),
    "empty": changed(lambda d: d.update(colors=[])),
    "identity": changed(lambda d: d["metadata"].update(id="other")),
    "no object": "[1, 2]",
}


def test_catalogue_keeps_only_good_documents(spark, tmp_path):
    (tmp_path / "set-v1.json").write_text(json.dumps(GOOD))
    (tmp_path / "set-v01.json").write_text(json.dumps(GOOD))
    documents = palettes.read_documents(spark, str(tmp_path))
    assert [r["palette_id"] for r in palettes.catalogue(documents).collect()] == ["set"]
    rows = palettes.load_palette(spark, str(tmp_path), "set", 1).orderBy("idx").collect()
    assert [(r["idx"], r["number"], r["rgb"]) for r in rows] == [(0, 1, 0x010203), (1, 5, 0xFF0000)]
    with pytest.raises(palettes.PaletteNotFoundError):
        palettes.load_palette(spark, str(tmp_path), "set", 2)


@pytest.mark.parametrize("case", sorted(BAD))
def test_bad_documents_are_named(spark, tmp_path, case):
    (tmp_path / "set-v1.json").write_text(BAD[case], encoding="utf-8")
    documents = palettes.read_documents(spark, str(tmp_path))
    assert palettes.palette_problems(documents).first()["problems"], case
    assert palettes.catalogue(documents).count() == 0


def test_bmp_round_trip(spark, tmp_path):
    px = synthetic.raster(spark, "gradient", 13, 7)
    (tmp_path / "one.bmp").write_bytes(bytes(images.to_bmp(px).first()["bmp"]))
    (tmp_path / "two.png").write_bytes(b"BM not a png")
    back = images.load_images(spark, str(tmp_path))
    assert {(r["x"], r["y"], r["rgb"]) for r in back.collect()} == {(r["x"], r["y"], r["rgb"]) for r in px.collect()}
    header = images.image_headers(spark, str(tmp_path / "one.bmp")).first()
    assert (header["format"], header["width"]) == ("bmp", 13)


@pytest.mark.parametrize("kind", ["flat", "gradient", "noise", "checkerboard", "comb"])
def test_generation_completes(spark, kind):
    document = generate(synthetic.raster(spark, kind, 24, 16), synthetic.benchmark_palette(spark, 8), Options(tolerance=1.0))
    assert document.members.count() == 24 * 16
    assert document.labels.count() == document.outlines.count() > 0


def test_pdf_has_its_objects():
    data = sinks.pdf_document([b"q Q"], (210.0, 297.0))
    assert data.startswith(b"%PDF-1.4") and data.endswith(b"%%EOF\n") and b"/Count 1" in data


def test_options_are_checked():
    with pytest.raises(ValueError):
        Options(diameter=0)


def test_refusals_come_from_headers(spark, tmp_path):
    bmp = bytes(images.to_bmp(synthetic.raster(spark, "gradient", 13, 7)).first()["bmp"])
    frame = b"\xff\xc2\x00\x11\x08" + (300).to_bytes(2, "big") + (400).to_bytes(2, "big") + b"\x03" + bytes(9)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc4\x00\x03x" + frame
    assert images.jpeg_size(jpeg) == (400, 300) and images.jpeg_size(b"\xff\xd8\xff\xe0") == (None, None)
    files = {"good.bmp": bmp, "large.jpg": jpeg, "named.png": bmp, "text.bmp": b"hello", "web.webp": b"RIFF\0\0\0\0WEBPVP8 ", "cut.jpg": b"\xff\xd8\xff\xe0\x00"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = {r["path"].rsplit("/", 1)[1]: r["refusal"] for r in images.refused_images(spark, str(tmp_path), most_width=399).collect()}
    assert found == {"large.jpg": "width", "named.png": "name", "text.bmp": "format", "web.webp": "format", "cut.jpg": "header"}
    assert images.load_images(spark, str(tmp_path), most_width=399).count() == 13 * 7
