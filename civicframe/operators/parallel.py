"""Spreading CPU-heavy row work over all task slots."""

from __future__ import annotations

from pyspark.sql import DataFrame


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-repartition on ``keys`` when the input has fewer partitions than
    the session's default parallelism.

    Per-row work such as long regular-expression chains or polygon tests
    costs far more than moving the row once, but only when a scan yields
    too few splits (one large file, one row group). A big input read in
    many splits is left alone: no extra shuffle. Hash partitioning (not
    round-robin) keeps the placement deterministic if a task is re-run.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    # A few partitions per slot: row costs are uneven (text lengths run from
    # one word to tens of thousands), so finer pieces balance the slots.
    target = slots * 4
    return df.repartition(target, *keys) if keys else df.repartition(target)
