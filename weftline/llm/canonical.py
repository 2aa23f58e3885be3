"""Duplicates hidden by formatting differences (problem 5).

Byte-identical raw rows collapse first, with counts; only the distinct survivors are parsed and canonicalised; these are
grouped again on their whole canonical text, summing the counts. Both groupings combine map-side, so a record holding a
third of all rows costs each map task one row. Images are keyed by SHA-256 so that no image bytes are shuffled; texts are
compared in full.

Cases: rows whose image is NULL, whose conversation is NULL, blank, unparsable or without turns are no records and are
left out. A NULL or absent `content` or `role` counts as an empty one. Empty input gives empty output; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.schemas import TURNS
from weftline.session import cut, skew_join

TURN_END, ROLE_END = "\x1e", "\x1f"


def fold(c: Column) -> Column:
    """Letter case and everything but letters and digits removed. Upper-casing first folds such letters as the sharp s; the
    removal stands between the two, as the optimizer would drop the inner one of two case functions."""
    return F.lower(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", ""))


def canonical_text(conversations: Column) -> Column:
    """Canonical form of a JSON array of turns, NULL where there is no turn."""
    turns = F.from_json(conversations, TURNS)
    text = F.array_join(F.transform(turns, lambda t: F.concat(fold(t["role"]), F.lit(ROLE_END), fold(t["content"]))), TURN_END)
    return F.when(F.size(turns) > 0, text)


def _raw(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("image_bytes").isNotNull() & F.col("conversations").isNotNull()).select("row_id", F.sha2("image_bytes", 256).alias("img"), "conversations")


def canonical_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(survivors, records): survivors have `img, conversations, n, rep, keep_id, copies`; one row per distinct raw row."""
    raw = _raw(rows).groupBy("img", "conversations").agg(F.count("*").alias("n"), F.min("row_id").alias("rep"))
    survivors = cut(raw.withColumn("canon", canonical_text("conversations")).where(F.col("canon").isNotNull())
                    .select("rep", "n", "img", "canon"))
    records = survivors.groupBy("img", "canon").agg(F.sum("n").alias("copies"), F.min("rep").alias("keep_id"), F.count("*").alias("variants"))
    return survivors, records


def dedup_records(rows: DataFrame) -> DataFrame:
    """One row per record: `keep_id`, the smallest row id, and `copies`, how many rows held it."""
    _, records = canonical_groups(rows)
    return records.select("keep_id", "copies")


def duplicate_rows(rows: DataFrame) -> DataFrame:
    """(keep_id, row_id) for every row that is not the kept one of its record."""
    survivors, records = canonical_groups(rows)
    # A record of one spelling needs no join back: its survivors already know their record.
    key = F.sha2(F.concat_ws(TURN_END, "img", "canon"), 256)
    many = records.where("copies > 1").select(key.alias("key"), "keep_id", "variants")
    # `rep` alone identifies a distinct raw row.
    joined = cut(skew_join(survivors.select("rep", "n", key.alias("key")), many, "key", "variants").select("rep", "n", "keep_id"))
    first = joined.where("rep <> keep_id").select("keep_id", F.col("rep").alias("row_id"))
    # Raw rows that occur more than once: every further row, found by its full raw digest.
    repeated = joined.where("n > 1")
    digests = rows.where(F.col("image_bytes").isNotNull() & F.col("conversations").isNotNull()).select(
        "row_id", F.sha2(F.concat_ws(TURN_END, F.sha2("image_bytes", 256), "conversations"), 256).alias("digest"))
    heads = digests.join(repeated.withColumnRenamed("rep", "row_id"), "row_id").select("digest", "keep_id", "n", F.col("row_id").alias("rep"))
    others = skew_join(digests, cut(heads), "digest", "n").where("row_id <> rep").select("keep_id", "row_id")
    return first.unionByName(others)
