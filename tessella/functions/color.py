"""Colour: sRGB to CIE XYZ and Lab, and two colour differences, as column formulas.

Sources: IEC 61966-2-1 (sRGB), CIE 15 (Lab), Sharma, Wu and Dalal 2005 (CIEDE2000).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.steps import Steps, apply_steps

# The sRGB to XYZ matrix for D65, rows X, Y, Z, and the D65 white point.
MATRIX = (("0.4124564e0", "0.3575761e0", "0.1804375e0"), ("0.2126729e0", "0.7151522e0", "0.0721750e0"), ("0.0193339e0", "0.1191920e0", "0.9503041e0"))
WHITE = ("0.95047e0", "1.0e0", "1.08883e0")
#: (6/29)^3 and 3 (6/29)^2, by which Lab switches from a cube root to a line.
EDGE, SLOPE = "pow(6e0 / 29e0, 3e0)", "(3e0 * pow(6e0 / 29e0, 2e0))"


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("long"), 16).bitwiseOR(F.shiftleft(g.cast("long"), 8)).bitwiseOR(b.cast("long"))


def unpack_rgb(rgb: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(rgb, s).bitwiseAND(255) for s in (16, 8, 0))


def _linear(channel: str) -> str:
    return f"CASE WHEN {channel} / 255e0 <= 0.04045e0 THEN {channel} / 255e0 / 12.92e0 ELSE pow(({channel} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END"


def _f(value: str) -> str:
    return f"CASE WHEN {value} > {EDGE} THEN pow({value}, 1e0 / 3e0) ELSE {value} / {SLOPE} + 4e0 / 29e0 END"


def lab_steps(rgb: str = "rgb", suffix: str = "") -> Steps:
    """From the packed column ``rgb`` to ``l``, ``a``, ``b``; ``x``, ``y``, ``z`` and linear channels on the way."""
    s = suffix
    return [
        {f"red{s}": f"CAST({rgb} AS BIGINT) >> 16", f"green{s}": f"(CAST({rgb} AS BIGINT) >> 8) & 255", f"blue{s}": f"CAST({rgb} AS BIGINT) & 255"},
        {f"lin_{c}{s}": _linear(f"{c}{s}") for c in ("red", "green", "blue")},
        {f"xyz_{axis}{s}": " + ".join(f"{w} * lin_{c}{s}" for w, c in zip(row, ("red", "green", "blue"))) for axis, row in zip("xyz", MATRIX)},
        {f"f_{axis}{s}": _f(f"(xyz_{axis}{s} / {white})") for axis, white in zip("xyz", WHITE)},
        {f"l{s}": f"116e0 * f_y{s} - 16e0", f"a{s}": f"500e0 * (f_x{s} - f_y{s})", f"b{s}": f"200e0 * (f_y{s} - f_z{s})"},
    ]


def with_lab(df: DataFrame, rgb: str = "rgb", suffix: str = "") -> DataFrame:
    """Adds ``l``, ``a``, ``b`` (each with ``suffix``)."""
    return apply_steps(df, lab_steps(rgb, suffix), [f"l{suffix}", f"a{suffix}", f"b{suffix}"])


#: Squared Euclidean distance ranks like the distance itself; lightness difference bounds it from below.
DELTA_E_76: Steps = [{"rank_76": "(l1 - l2) * (l1 - l2) + (a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2)"}, {"de": "sqrt(rank_76)", "bound_76": "abs(l1 - l2)"}]

_SEVENTH = "6103515625e0"  # 25^7
_HUE = "CASE WHEN ap{i} = 0e0 AND b{i} = 0e0 THEN 0e0 WHEN atan2(b{i}, ap{i}) < 0e0 THEN degrees(atan2(b{i}, ap{i})) + 360e0 ELSE degrees(atan2(b{i}, ap{i})) END"
DELTA_E_2000: Steps = [
    {"cm": "(sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2e0"},
    {"gg": f"0.5e0 * (1e0 - sqrt(pow(cm, 7e0) / (pow(cm, 7e0) + {_SEVENTH})))"},
    {"ap1": "(1e0 + gg) * a1", "ap2": "(1e0 + gg) * a2"},
    {"cp1": "sqrt(ap1 * ap1 + b1 * b1)", "cp2": "sqrt(ap2 * ap2 + b2 * b2)", "h1": _HUE.format(i=1), "h2": _HUE.format(i=2)},
    {
        "dh": "CASE WHEN cp1 * cp2 = 0e0 THEN 0e0 WHEN abs(h2 - h1) <= 180e0 THEN h2 - h1 WHEN h2 - h1 > 180e0 THEN h2 - h1 - 360e0 ELSE h2 - h1 + 360e0 END",
        "hm": "CASE WHEN cp1 * cp2 = 0e0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180e0 THEN (h1 + h2) / 2e0 WHEN h1 + h2 < 360e0 THEN (h1 + h2 + 360e0) / 2e0 ELSE (h1 + h2 - 360e0) / 2e0 END",
        "lm": "(l1 + l2) / 2e0",
        "cpm": "(cp1 + cp2) / 2e0",
    },
    {
        "tt": "1e0 - 0.17e0 * cos(radians(hm - 30e0)) + 0.24e0 * cos(radians(2e0 * hm)) + 0.32e0 * cos(radians(3e0 * hm + 6e0)) - 0.2e0 * cos(radians(4e0 * hm - 63e0))",
        "rc": f"2e0 * sqrt(pow(cpm, 7e0) / (pow(cpm, 7e0) + {_SEVENTH}))",
        "turn": "30e0 * exp(-pow((hm - 275e0) / 25e0, 2e0))",
        "sl": "1e0 + 0.015e0 * pow(lm - 50e0, 2e0) / sqrt(20e0 + pow(lm - 50e0, 2e0))",
        "sc": "1e0 + 0.045e0 * cpm",
    },
    {"tl": "(l2 - l1) / sl", "tc": "(cp2 - cp1) / sc", "th": "2e0 * sqrt(cp1 * cp2) * sin(radians(dh) / 2e0) / (1e0 + 0.015e0 * cpm * tt)", "rt": "-sin(radians(2e0 * turn)) * rc"},
    {"de": "sqrt(greatest(0e0, tl * tl + tc * tc + th * th + rt * tc * th))"},
]
#: The distances by name; each gives ``de`` from ``l1 a1 b1 l2 a2 b2``.
DISTANCES: dict[str, Steps] = {"delta_e_76": DELTA_E_76, "delta_e_2000": DELTA_E_2000}


def with_distance(df: DataFrame, distance: str = "delta_e_2000", out: str = "de") -> DataFrame:
    """Adds the distance of (l1, a1, b1) and (l2, a2, b2)."""
    found = apply_steps(df, DISTANCES[distance], ["de"])
    return found if out == "de" else found.withColumnRenamed("de", out)


def colour_distance(df: DataFrame, first: str, second: str, out: str, distance: str = "delta_e_2000") -> DataFrame:
    """Adds ``out``, the distance of two packed colour columns; where either is null, null (0 by ``delta_e_2000``).

    Each colour's Lab and the distance are steps of their own: as one run of steps the generated method exceeds the
    8000 bytes of bytecode up to which the JVM compiles a method, and every row would be interpreted.
    """
    names = df.columns
    labs = with_lab(with_lab(df, first, "1"), second, "2")
    return with_distance(labs, distance).select(*names, F.col("de").alias(out))
