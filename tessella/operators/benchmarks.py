"""Summaries of measured runs: durations, pairs, break-even workloads, worker counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duration_summary(runs: DataFrame) -> DataFrame:
    """``runs(stage, seconds)``: repetitions, least, median, mean, greatest."""
    return runs.groupBy("stage").agg(F.count("*").alias("runs"), F.min("seconds").alias("least"), F.median("seconds").alias("median"), F.avg("seconds").alias("mean"), F.max("seconds").alias("greatest"))


def paired_summary(runs: DataFrame) -> DataFrame:
    """``runs(stage, before, after)``: medians, their difference, ratio and overhead share (null where the first is zero)."""
    m = runs.groupBy("stage").agg(F.median("before").alias("before"), F.median("after").alias("after"))
    return m.withColumns({"delta": F.col("after") - F.col("before"), "ratio": F.try_divide("after", "before"), "overhead": F.try_divide(F.col("after") - F.col("before"), F.col("before"))})


def calibration_points(runs: DataFrame) -> DataFrame:
    """``runs(unique_colours, palette_colours, workers, seconds)``: workload and best speed-up over one worker; 0 without parallel runs, infinite on zero time."""
    one = F.max(F.when(F.col("workers") == 1, F.col("seconds")))
    best = F.min(F.when(F.col("workers") > 1, F.col("seconds")))
    found = runs.groupBy("unique_colours", "palette_colours").agg(one.alias("one"), best.alias("best"))
    speed = F.when(F.col("best").isNull(), 0.0).when(F.col("best") == 0, F.lit(float("inf"))).otherwise(F.col("one") / F.nullif("best", F.lit(0.0)))
    return found.select((F.col("unique_colours") * F.col("palette_colours")).alias("workload"), speed.alias("speedup"))


def break_even(points: DataFrame, least_speedup: float) -> DataFrame:
    """The least workload such that it and every larger one reaches the speed-up; null if none does."""
    rest = points.groupBy("workload").agg(F.min("speedup").alias("speedup"))  # one row a measured workload
    upward = Window.orderBy("workload").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return rest.withColumn("low", F.min("speedup").over(upward)).agg(F.min(F.when(F.col("low") >= least_speedup, F.col("workload"))).alias("workload"))


def worker_gains(runs: DataFrame) -> DataFrame:
    """``runs(point, workers, seconds)`` with ``gain``: how much faster than the best smaller worker count (null for the least)."""
    before = Window.partitionBy("point").orderBy("workers").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("gain", F.try_divide(F.min("seconds").over(before), F.col("seconds")))


def recommended_workers(runs: DataFrame, least_gain: float, least_streak: int) -> DataFrame:
    """The highest worker count with the gain at ``least_streak`` consecutive points or more; 1 if none has."""
    gains = worker_gains(runs).withColumn("good", F.coalesce(F.col("gain") >= least_gain, F.lit(False)))
    line = Window.partitionBy("workers").orderBy("point")
    island = F.row_number().over(line) - F.row_number().over(Window.partitionBy("workers", "good").orderBy("point"))
    streaks = gains.withColumn("island", island).filter("good").groupBy("workers", "island").agg(F.count("*").alias("streak"))
    return streaks.filter(F.col("streak") >= least_streak).agg(F.coalesce(F.max("workers"), F.lit(1)).alias("workers"))


def worker_counts(limits: DataFrame) -> DataFrame:
    """``limits(cpus, units, most)`` with ``counts``: powers of two up to the least of the three, and that number."""
    top = F.least("cpus", "units", "most")
    powers = F.transform(F.sequence(F.lit(0), F.floor(F.log2(top.cast("double"))).cast("int")), lambda i: F.pow(F.lit(2.0), i).cast("long"))
    return limits.withColumn("counts", F.array_sort(F.array_union(powers, F.array(top.cast("long")))))


def validation_breakdown(calls: DataFrame) -> DataFrame:
    """``calls(kind, seconds)``: seconds and share of each kind of check."""
    return calls.groupBy("kind").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("calls")).withColumn("share", F.coalesce(F.try_divide(F.col("seconds"), F.sum("seconds").over(Window.partitionBy())), F.lit(0.0)))
