"""Colour differences against published pairs (Sharma, Wu and Dalal 2005)."""

from __future__ import annotations

import pytest

from tessella.functions.color import DISTANCES, colour_distance, with_distance, with_lab

# Lab pairs and their CIEDE2000 difference, from the published data set.
PAIRS = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
    (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615),
    (50.0, 2.8361, -74.0200, 50.0, 0.0, -82.7485, 3.4412),
    (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0000),
    (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669),
    (50.0, -1.0, 2.0, 50.0, 0.0, 0.0, 2.3669),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0009, 7.1792),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0011, 7.2195),
    (50.0, -0.001, 2.49, 50.0, 0.0009, -2.49, 4.8045),
    (50.0, -0.001, 2.49, 50.0, 0.0011, -2.49, 4.7461),
    (50.0, 2.5, 0.0, 50.0, 0.0, -2.5, 4.3065),
    (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
    (50.0, 2.5, 0.0, 61.0, -5.0, 29.0, 22.8977),
    (50.0, 2.5, 0.0, 56.0, -27.0, -3.0, 31.9030),
    (50.0, 2.5, 0.0, 50.0, 3.1736, 0.5854, 1.0000),
    (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
    (22.7233, 20.0904, -46.6940, 23.0331, 14.9730, -42.5619, 2.0373),
    (90.8027, -2.0831, 1.4410, 91.1528, -1.6435, 0.0447, 1.4441),
    (2.0776, 0.0795, -1.1350, 0.9033, -0.0636, -0.5514, 0.9082),
]
LAB = "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double"


def test_published_differences(spark):
    for r in with_distance(spark.createDataFrame(PAIRS, LAB)).collect():
        assert r["de"] == pytest.approx(r["want"], abs=1e-4)


def test_symmetry_and_identity(spark):
    turned = [(l2, a2, b2, l1, a1, b1, w) for l1, a1, b1, l2, a2, b2, w in PAIRS]
    for r in with_distance(spark.createDataFrame(turned, LAB)).collect():
        assert r["de"] == pytest.approx(r["want"], abs=1e-4)
    same = spark.createDataFrame([(0x336699, 0x336699), (0, 0)], "x long, y long")
    for name in DISTANCES:
        assert [r["de"] for r in colour_distance(same, "x", "y", "de", name).collect()] == [0.0, 0.0]


def test_lab_of_black_white_and_red(spark):
    found = {r["rgb"]: (r["l"], r["a"], r["b"]) for r in with_lab(spark.createDataFrame([(0,), (0xFFFFFF,), (0xFF0000,)], "rgb long")).collect()}
    assert found[0] == pytest.approx((0, 0, 0), abs=1e-9)
    assert found[0xFFFFFF] == pytest.approx((100, 0, 0), abs=0.02)
    assert found[0xFF0000] == pytest.approx((53.24, 80.09, 67.20), abs=0.02)


@pytest.mark.parametrize("most", [200_000, 0])
def test_matches_are_joined_alike(spark, monkeypatch, most):
    """A third of all pixels have one colour; few matches are broadcast, many only for hot colours."""
    from tessella.operators import quantize

    monkeypatch.setattr(quantize, "BROADCAST_COLOURS", most)
    palette = spark.createDataFrame([(0, 1, "a", 0), (1, 2, "b", 0x8080FF), (2, 3, "c", 0xFFFFFF)], "idx long, number long, name string, rgb long")
    pixels = spark.range(6000).selectExpr("id as pos", "if(id % 3 = 0, 16777215L, id * 257 % 16777216) as rgb")
    found = quantize.quantize(pixels, palette)
    nearest = {r["rgb"]: r["idx"] for r in quantize.nearest_colours(pixels, palette).collect()}
    rows = found.collect()
    assert len(rows) == 6000 and all(r["idx"] == nearest[r["rgb"]] for r in rows)


def test_distances_are_small_enough_to_be_compiled(spark, capsys):
    """The JVM interprets methods of more than 8000 bytes of bytecode: rows with a distance must not meet one."""
    import re

    rows = spark.range(4).selectExpr("id", "if(id % 2 = 1, null, 3368601 + id) as x", "if(id >= 2, null, 1122867L) as y")
    for name in DISTANCES:
        found = colour_distance(colour_distance(rows, "x", "y", "there", name), "y", "x", "back", name)
        capsys.readouterr()
        found.explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) <= 8000
        assert found.columns == ["id", "x", "y", "there", "back"]
        values = {r["id"]: (r["there"], r["back"]) for r in found.collect()}
        assert values[0][0] > 0 and values[0][0] == pytest.approx(values[0][1], abs=1e-9)
        unknown = 0.0 if name == "delta_e_2000" else None
        assert all(values[i] == (unknown, unknown) for i in (1, 2, 3))
