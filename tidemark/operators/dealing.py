"""Rows that are few and small, but take long each: one task would get them all by their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tasks a core.
TASKS = 2


def deal(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` over a number of partitions that follows the cluster's cores, which adaptive execution doesn't join again."""
    return rows.repartition(max(1, TASKS * rows.sparkSession.sparkContext.defaultParallelism), *keys)
