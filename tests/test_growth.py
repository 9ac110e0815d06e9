"""Tables that grow with the input are never broadcast, whatever size Spark takes them for."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import DataFrameWriter

from tessella.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["region_neighbours", "invalid_outlines", "overlapping_outlines", "leader_clusters", "leader_clusters_2000", "merge_candidates", "combined_protection", "first_merge_targets", "metric_distributions", "region_labels", "paintability", "touching_candidates", "ranked_candidates", "strategy_cohorts", "fragile_details", "neighbour_contrast", "protected_ranking", "vector_pages", "outline_reduction"])
def test_no_growing_table_is_broadcast(spark, monkeypatch, name):
    """Here every table is below Spark's bound. Whatever grows has an image_id, but for colours; palettes and counted matches may be broadcast."""
    plans = []
    written = DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        plans.append((path, self._df._jdf.queryExecution().executedPlan().toString()))
        return written(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    found = QUERIES[name](spark, SF_DIR)
    plans.append(("last", found._jdf.queryExecution().executedPlan().toString()))
    bad = [(path, line.strip(" +-:*")) for path, plan in plans for line in plan.splitlines() if re.search(r"BroadcastHashJoin|BroadcastNestedLoopJoin", line) and ("image_id" in line or "/colour-matches-" in path)]
    assert bad == []
    assert any("SortMergeJoin" in plan for _, plan in plans)
