"""Additive evaluation totals for incremental jobs.

The library's metrics and moments are sums of sums. ``fold`` writes the sums of each micro-batch
under its batch id, so a replayed batch overwrites itself and the merge stays exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landtally.operators.metrics import merge_sums, regression_metrics, regression_sums


def fold(path: str, keys: list[str], pred: str, target: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores per-batch sufficient sums."""
    def write(batch: DataFrame, batch_id: int) -> None:
        regression_sums(batch, keys, pred, target).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Metrics over every batch so far."""
    return regression_metrics(merge_sums(spark.read.parquet(path).drop("batch"), keys))
