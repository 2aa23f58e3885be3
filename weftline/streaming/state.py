"""Ordered run logs: the adaptive coefficient, the divergence stop, window means; in batch and as streams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.schemas import STEP_LOG


def controller_trace(log: DataFrame, run: str, step: str, kl: str, beta: float, target: float, rate: float = 0.05, low: float = 1e-4, high: float = 2.0) -> DataFrame:
    """(run, step, beta) after each step of a run: a fold over the ordered steps as they stream by, only the last coefficient held.
    A missing divergence counts as one on target."""
    if target <= 0:
        raise ValueError("target must be positive")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, b = object(), beta
        for batch in batches:
            out = []
            for r, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if r != last:
                    last, b = r, beta
                e = 0.0 if x is None else min(1.0, max(-1.0, x / target - 1.0))
                b = min(max(b * math.exp(rate * e), low), high)
                out.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], [run, step, "beta"])

    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    d = log.select(run, step, F.col(kl).cast("double")).repartition(run).sortWithinPartitions(run, step)
    return d.mapInArrow(fold, f"{run} {kinds[run]}, {step} {kinds[step]}, beta double")


def violations(log: DataFrame, run: str, step: str, kl: str, stop: float, patience: int) -> DataFrame:
    """Adds `streak`, the consecutive steps above `stop` so far, and `stops`, where the patience is used up for the first time."""
    w = W.partitionBy(run).orderBy(step)
    d = log.withColumn("_v", F.coalesce((F.col(kl) > stop).cast("int"), F.lit(0))).withColumn("_g", F.sum(1 - F.col("_v")).over(w))
    d = d.withColumn("streak", F.sum("_v").over(W.partitionBy(run, "_g").orderBy(step)))
    first = F.min(F.when(F.col("streak") >= patience, F.col(step))).over(W.partitionBy(run))
    return d.withColumn("stops", F.coalesce(F.col(step) == first, F.lit(False))).drop("_v", "_g")


def first_last_means(log: DataFrame, run: str, step: str, values: list[str], window: int = 500) -> DataFrame:
    """Means over the first and the last steps of each run."""
    w = W.partitionBy(run)
    d = log.withColumns({"_i": F.row_number().over(w.orderBy(step)), "_n": F.count("*").over(w)})
    cols = []
    for v in values:
        cols += [F.avg(F.when(F.col("_i") <= window, F.col(v))).alias(f"{v}_first"), F.avg(F.when(F.col("_i") > F.col("_n") - window, F.col(v))).alias(f"{v}_last")]
    return d.groupBy(run).agg(F.count("*").alias("steps"), *cols)


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(STEP_LOG).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def controller_stream(log: DataFrame, run: str, beta: float, target: float, patience: int, stop: float, rate: float = 0.05, low: float = 1e-4, high: float = 2.0) -> DataFrame:
    """(run, global_step, beta, streak, stopped) per step of a stream of steps (run, global_step, kl), state kept per run.

    Steps of a micro-batch are taken in their order; a step not later than the last one seen is a repeat and skipped.
    """
    if target <= 0:
        raise ValueError("target must be positive")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        b, streak, stopped, last = state.get if state.exists else (beta, 0, False, -1)
        rows = pd.concat(list(batches)).sort_values("global_step")
        out = []
        for s, kl in zip(rows["global_step"], rows["kl"]):
            if s <= last:
                continue
            e = min(1.0, max(-1.0, kl / target - 1.0))
            b = min(high, max(low, b * math.exp(rate * e)))
            streak = streak + 1 if kl > stop else 0
            stopped = stopped or streak >= patience
            last = int(s)
            out.append((key[0], last, b, streak, stopped))
        state.update((float(b), int(streak), bool(stopped), int(last)))
        yield pd.DataFrame(out, columns=[run, "global_step", "beta", "streak", "stopped"])

    kind = log.schema[run].dataType.simpleString()
    return log.groupBy(run).applyInPandasWithState(fold, f"{run} {kind}, global_step long, beta double, streak long, stopped boolean", "beta double, streak long, stopped boolean, last long", "append", "NoTimeout")
