"""Stages that write their result and are skipped where it is already complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.sources.readers import exists

Stage = tuple[str, str, Callable[[SparkSession], DataFrame]]


def complete(spark: SparkSession, path: str) -> bool:
    """Has a writer finished here? An interrupted one leaves no marker, and its stage runs again."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def run_stages(spark: SparkSession, stages: list[Stage], again: bool = False) -> list[str]:
    """Runs (name, path, query) in order, leaving out the complete ones unless `again`; the names of those that ran."""
    ran = []
    for name, path, query in stages:
        if again or not complete(spark, path):
            query(spark).write.mode("overwrite").parquet(path)
            ran.append(name)
    return ran
