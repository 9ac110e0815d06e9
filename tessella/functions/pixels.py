"""Packed pixel positions: ``y`` in the upper, ``x`` in the lower 32 bits of a long."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_pixel(x: Column, y: Column) -> Column:
    return F.shiftleft(y.cast("long"), 32).bitwiseOR(x.cast("long"))


def unpack_pixel(packed: Column) -> tuple[Column, Column]:
    """(x, y)."""
    return packed.bitwiseAND((1 << 32) - 1), F.shiftright(packed, 32)
