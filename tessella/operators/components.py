"""Components of links between nodes of images, by large and small stars (Kiveris et al., 2014).

A large star links every greater neighbour of a node to its least one, a small star every lesser one; both
keep what is connected and end in stars around the least nodes, in rounds that grow with the logarithm of a
component. Every round is a join and an aggregation over stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.tables import stored

#: Far above what any input needs.
MOST_ROUNDS = 60

_NODE = ["image_id", "node"]


def _round(links: DataFrame, large: bool) -> DataFrame:
    """``links(image_id, node, other)``, node above other, after one star operation."""
    turned = links.select("image_id", F.col("other").alias("node"), F.col("node").alias("other"))
    sides = links.unionByName(turned) if large else links
    least = sides.groupBy(*_NODE).agg(F.least(F.min("other"), F.first("node")).alias("least"))
    met = sides.join(least.hint("merge"), _NODE)
    far = met.filter("other > node") if large else met.filter("other <> least")
    new = far.select("image_id", F.col("other").alias("node"), F.col("least").alias("other"))
    if not large:
        new = new.unionByName(least.select(*_NODE, F.col("least").alias("other")))
    return new.filter("node > other").distinct()


def roots(links: DataFrame) -> DataFrame:
    """``(image_id, node, root)``: the least node that each node of ``links(image_id, node, other)`` is connected with; roots themselves have no row."""
    tidy = links.select("image_id", F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).filter("node > other").distinct()
    now = stored(tidy, "links")
    for _ in range(MOST_ROUNDS):
        # stars: every node has one lesser neighbour, which has none
        centres = now.select("image_id", F.col("other").alias("node")).distinct()
        if not now.groupBy(*_NODE).count().filter("count > 1").head(1) and not now.join(centres.hint("merge"), _NODE, "left_semi").head(1):
            return now.select(*_NODE, F.col("other").alias("root"))
        now = stored(_round(_round(now, True), False), "links")
    raise RuntimeError("components did not settle")
