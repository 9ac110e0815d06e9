"""Integer vectors from float columns, checked and scaled by DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column, limit: float) -> Column:
    """Whether a vector is there, has components, and all of them are there, finite and below ``limit`` in magnitude."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def floored(vector: Column, scale: int) -> Column:
    """Every component ``x`` as ``floor(scale * x)``, computed in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
