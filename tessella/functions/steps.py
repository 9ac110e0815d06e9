"""Formulas as named SQL expressions, built up step by step.

The expressions keep to what Spark and standard SQL engines read alike (doubles are written with an
exponent), so one formula serves the DataFrame operators and the SQL that checks the plumbing around
them; the formulas themselves are tested against published values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Steps = list[dict[str, str]]


def apply_steps(df: DataFrame, steps: Steps, keep: list[str]) -> DataFrame:
    """``df`` with the columns of every step, of which only ``keep`` stay.

    The results pass through a one-element generator: a filter on them is not pushed below it, where
    each name would be replaced by its whole formula, again and again.
    """
    names = df.columns
    for step in steps:
        df = df.withColumns({name: F.expr(text) for name, text in step.items()})
    new = [k for k in keep if k not in names]
    return df.select(*names, F.inline(F.array(F.struct(*new))))


def steps_sql(source: str, steps: Steps, keep: list[str]) -> str:
    """The same as a SELECT over the table or subquery ``source``."""
    out = f"SELECT *  FROM {source}"
    for step in steps:
        out = f"SELECT *, {', '.join(f'{text} AS {name}' for name, text in step.items())} FROM ({out})"
    return f"SELECT {', '.join(keep)} FROM ({out})"
