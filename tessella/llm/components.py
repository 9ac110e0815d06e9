"""Connected components of a link table by alternating large-star and small-star steps.

Kiveris et al., "Connected components in MapReduce and beyond" (2014). Every step is a shuffle
join and an aggregation; links and labels stay in Spark.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import join_skewed, materialize, temporary_tables

#: Far above the logarithmic number of rounds that any input needs; a guard against a defect only.
MAX_ROUNDS = 60


def _neighbours(links: DataFrame, large: bool) -> DataFrame:
    """``(a, b)``: every link once from its larger end, or (large) from both ends."""
    both = links.select("a", "b")
    return both.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else both


def _least(both: DataFrame, name: str) -> DataFrame:
    """``(a, m, n)``: every node's least neighbour (or itself), and the number of its neighbours."""
    return materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), f"{name}-least")


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; component is the least node reachable.

    Self-links and repeated links are allowed; nodes without a link to another node don't appear.
    Links that are stars already (those of components found before) cost one look.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    links = materialize(ordered, "links")
    for _ in range(MAX_ROUNDS):
        with temporary_tables(links.sparkSession):
            both = _neighbours(links, True)
            least = _least(both, "large")
            # every link is there once, so these are stars when no node with a smaller neighbour has another one
            total, most, unsettled = least.agg(F.sum("n"), F.max("n"), F.max(F.expr("m < a AND n > 1"))).first()
            if not unsettled:
                break
            # a link leaves its larger end only: there are no more of them than before, so they need not be made distinct here
            larger = join_skewed(both, least, "a", "n", sizes=(total, most)).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            links = materialize(larger.filter("a > b"), "large")
            least = _least(links, "small")
            smaller = join_skewed(links, least, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
            links = materialize(smaller.filter("a > b").distinct(), "small", keep=True)
    else:
        raise RuntimeError("components did not settle")
    # links are stars now: (node, least node); the centres themselves are added
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def tile_links(near: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(i, j)`` that join all nodes joined by the boolean tile ``near``, one a node at most.

    ``own``: rows and columns are the same nodes; else columns are numbered behind the rows. Every
    node takes the least label among its partners, with pointer jumping, until nothing changes.
    """
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    tile = near[np.ix_(rows, columns)]
    numbers = rows if own else np.concatenate([rows, columns + len(near)])
    n, m = len(rows), 0 if own else len(rows)
    label, none = np.arange(len(numbers)), len(numbers)
    while len(numbers):
        before = label.copy()
        label[:n] = np.minimum(label[:n], np.where(tile, label[None, m:], none).min(axis=1))
        label[m:] = np.minimum(label[m:], np.where(tile, label[:n, None], none).min(axis=0))
        label = label[label]
        if np.array_equal(before, label):
            break
    moved = np.flatnonzero(label != np.arange(len(label)))
    return numbers[moved], numbers[label[moved]]


def block_pairs(packed: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Every pair of blocks of one key, and every block with itself (the ``other_`` columns are null).

    ``packed``: one row a block, with ``keys``, ``blocks`` (blocks of the key), ``block`` and
    ``payload``. Each block is sent once to each of its partners and meets it under a key of its own,
    so the blocks of a hot key are dealt evenly, and only whole blocks, never single rows, are paired.
    """
    base = [*keys, "block", *payload]
    own = packed.select(*payload, *(F.lit(None).cast(packed.schema[c].dataType).alias(f"other_{c}") for c in payload))
    sent = packed.filter("blocks > 1").select(*base, F.explode(F.sequence(F.lit(0).cast("int"), F.col("blocks").cast("int") - 1)).alias("partner"))
    low = sent.filter("block < partner").select(*keys, F.col("block").alias("lo"), F.col("partner").alias("hi"), *payload)
    high = sent.filter("block > partner").select(*keys, F.col("partner").alias("lo"), F.col("block").alias("hi"), *(F.col(c).alias(f"other_{c}") for c in payload))
    return own.unionByName(low.join(high, [*keys, "lo", "hi"]).select(*own.columns))
