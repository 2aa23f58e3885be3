"""Writers: Parquet by codec, JSON lines, JSON arrays, summaries with upsert."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.relational import upsert


def write_parquet(df: DataFrame, path: str, codec: str = "snappy", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", codec).parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_prediction_array(df: DataFrame, path: str) -> None:
    """Predictions (image_id, caption) as one JSON array in one file, by image. The rows stream through the task that writes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            lines = [x for x in b.column(0).to_pylist() if x is not None]
            if lines:
                out = [("[" if first and i == 0 else ",") + x for i, x in enumerate(lines)]
                first = False
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], ["value"])

    # A last row of its own, so that an empty table has a task that writes an empty array.
    end = df.sparkSession.range(0, 1, 1, 1).select(F.lit(None).alias("image_id"), F.lit(None).alias("caption"), F.lit(True).alias("end"))
    rows = df.select("image_id", "caption", F.lit(False).alias("end")).unionByName(end).repartition(1).sortWithinPartitions("end", "image_id", "caption")
    rows.select(F.when(~F.col("end"), F.to_json(F.struct("image_id", "caption"), {"ignoreNullFields": "false"})).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row table as pretty JSON."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_two(df: DataFrame, first: tuple[list[str], str], second: tuple[list[str], str]) -> None:
    """Two projections of one result, computed once."""
    df.persist()
    try:
        for columns, path in (first, second):
            write_parquet(df.select(*columns), path)
    finally:
        df.unpersist()


def merge_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, value): new scores over old ones."""
    return upsert(old, new, "name", "value")
