"""Joins, samples, unions and order-aware selections of dataset construction. Draws are keyed by a hash of seed and id, so that
they are the same on every cluster; first and last always refer to an explicit order, never to file order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.session import cut


#: Items of a pool of negatives at most.
POOL = 10_000


def draw_key(seed: int, *ids: str) -> Column:
    """Pseudo-random order of rows: a hash of the seed and the ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def first_per_key(df: DataFrame, key: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by `order`, which must be total. Combines map-side: no window over hot keys."""
    value = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    pick = (F.max_by if last else F.min_by)(value["_row"], F.struct(*[value[f"_o{i}"] for i in range(len(order))]))
    return df.groupBy(*key).agg(pick.alias("_row")).select("_row.*")


def sample_rows(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """n rows without replacement; fewer if there are fewer."""
    return df.withColumn("_k", draw_key(seed, *ids)).orderBy("_k", *ids).limit(n).drop("_k")


def balanced_sample(df: DataFrame, label: str, n: int, seed: int, *ids: str) -> DataFrame:
    """Up to n rows per class. The n-th smallest draw key of a class bounds its rows; a rank settles the rest."""
    w = W.partitionBy(label).orderBy(draw_key(seed, *ids), *ids)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def exact_split(df: DataFrame, holdout: int, seed: int, *ids: str) -> DataFrame:
    """Adds `part`: eval for exactly `holdout` rows, train for the rest."""
    held = sample_rows(df.select(*ids), holdout, seed, *ids).withColumn("part", F.lit("eval"))
    return df.join(held, list(ids), "left").withColumn("part", F.coalesce("part", F.lit("train")))


def mix(parts: list[tuple[DataFrame, int]], seed: int, *ids: str) -> DataFrame:
    """Union of samples of given sizes (0: all rows), in drawn order."""
    picked = [sample_rows(d, n, seed, *ids) if n else d for d, n in parts]
    return reduce(lambda a, b: a.unionByName(b), picked).orderBy(draw_key(seed + 1, *ids), *ids)


def union_all(parts: list[DataFrame], widen: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=widen), parts)


def top_k(df: DataFrame, key: str, k: int, first: Column) -> DataFrame:
    """The k most frequent values, ties by first occurrence."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(first).alias("_f")).orderBy(F.desc("n"), "_f", key).limit(k).drop("_f")


def cooccurrence(pairs: DataFrame, group: str, item: str) -> DataFrame:
    """(item, other, n): for every occurrence of an item, the other distinct items of its group. Groups are sets of categories."""
    distinct = pairs.select(group, item).distinct()
    return pairs.select(group, item).join(distinct.withColumnRenamed(item, "other"), group).where(F.col(item) != F.col("other")).groupBy(item, "other").agg(F.count("*").alias("n"))


def negatives(pairs: DataFrame, group: str, item: str, k: int, seed: int, pool: DataFrame) -> DataFrame:
    """Up to k items of a small `pool` (column item) absent from each group. The pool, of at most POOL items, is broadcast; a larger
    one raises an error, as each group is compared with all of it: draw from it first."""
    groups = pairs.select(group).distinct()
    pool = cut(pool.select(item).distinct())
    if pool.count() > POOL:
        raise ValueError(f"a pool of more than {POOL} items")
    absent = groups.join(F.broadcast(pool)).join(pairs.select(group, item).distinct(), [group, item], "left_anti")
    w = W.partitionBy(group).orderBy(draw_key(seed, group, item), item)
    return absent.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def adversarial_negatives(pairs: DataFrame, group: str, item: str, k: int, seed: int) -> DataFrame:
    """Up to k absent items that occur together with items of the group elsewhere."""
    both = cooccurrence(pairs, group, item).select(F.col(item).alias("_i"), F.col("other").alias(item))
    have = pairs.select(group, item).distinct()
    near = have.withColumnRenamed(item, "_i").join(both, "_i").select(group, item).distinct().join(have, [group, item], "left_anti")
    w = W.partitionBy(group).orderBy(draw_key(seed, group, item), item)
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def ranked_answers(votes: DataFrame, key: str, answer: str, position: str) -> DataFrame:
    """(key, answer, n, rank): answers of each key by frequency, ties by first position."""
    c = votes.groupBy(key, answer).agg(F.count("*").alias("n"), F.min(position).alias("_p"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "_p", answer))).drop("_p")


def next_cyclic(df: DataFrame, order: str, value: str, out: str, *partition: str) -> DataFrame:
    """The value of the next row, the first row following the last.

    No window over whole keys, one of which may hold most rows: key and order are cut into ranges (`_block`), rows are ranked
    inside their range, and the last row of a range takes the head of the key's next range, found among the heads alone.
    """
    rows = cut(df.repartitionByRange(*partition, order).withColumn("_block", F.spark_partition_id()))
    w = W.partitionBy("_block", *partition).orderBy(order)
    rows = rows.withColumns({"_no": F.row_number().over(w), "_next": F.lead(value).over(w), "_last": F.lead(F.lit(True)).over(w).isNull()})
    heads = W.partitionBy(*partition).orderBy("_block")
    whole = heads.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = rows.where("_no = 1").select(F.col("_block").alias("_b"), *[F.col(p).alias(f"_p{i}") for i, p in enumerate(partition)], F.lead(value).over(heads).alias("_head"), F.first(value).over(whole).alias("_first"))
    on = [F.col("_block") == F.col("_b"), *[F.col(p).eqNullSafe(F.col(f"_p{i}")) for i, p in enumerate(partition)]]
    following = F.coalesce(F.when(F.col("_last"), F.col("_head")).otherwise(F.col("_next")), F.col("_first"))
    return rows.join(ends, on).select(*df.columns, following.alias(out))


def global_rank(df: DataFrame, out: str, *order: str) -> DataFrame:
    """Adds the position of each row in the total order, from 0: rows are ranked inside ranges, the sizes of the ranges, one row
    each, are summed up."""
    rows = cut(df.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()))
    sizes = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(W.partitionBy("_block").orderBy(*order)) - 1
    return rows.withColumn("_own", rank).join(F.broadcast(sizes.select("_block", before.alias("_from"))), "_block").withColumn(out, F.col("_own") + F.col("_from")).drop("_own", "_from", "_block")


def running_total(df: DataFrame, value: str, out: str, order: str) -> DataFrame:
    """Adds the sum of `value` over all rows before in the order of the distinct values `order`, range by range."""
    rows = cut(df.repartitionByRange(order).withColumn("_block", F.spark_partition_id()))
    sums = rows.groupBy("_block").agg(F.sum(value).alias("_n"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = F.coalesce(F.sum("_n").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", inside).join(F.broadcast(sums.select("_block", start.alias("_from"))), "_block").withColumn(out, F.col("_own") + F.col("_from")).drop("_own", "_from", "_block")


def upsert(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """New values replace old ones, other keys stay."""
    o, n = old.select(key, F.col(value).alias("_o")), new.select(key, F.col(value).alias("_n"))
    return o.join(n, key, "full_outer").select(key, F.coalesce("_n", "_o").alias(value))
