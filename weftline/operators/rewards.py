"""Rewards from reference texts, group-relative advantages, preference margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.numbers import clamp
from weftline.functions.text import ngrams
from weftline.operators.metrics import alignment_metrics

# Weights of the reward's components.
WEIGHTS = {"unigram_f1": 0.30, "rouge_l": 0.30, "meteor_exact": 0.30, "length_score": 0.10, "repetition_penalty": 0.20}


def _bag_overlap(a: Column, b: Column) -> Column:
    """Tokens common to two bags, with repetition."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))))


def unigram_f1(pred: Column, ref: Column) -> Column:
    n = _bag_overlap(pred, ref)
    return F.when(n > 0, 2.0 * n / (F.size(pred) + F.size(ref))).otherwise(0.0)


def length_score(pred: Column, refs: Column) -> Column:
    """Shorter over longer of the prediction and the reference closest in length, the first of several."""
    d = F.transform(refs, lambda r: F.abs(F.size(r) - F.size(pred)))
    n = F.element_at(F.transform(refs, lambda r: F.size(r)), F.array_position(d, F.array_min(d)).cast("int"))
    return F.least(F.size(pred), n) / F.greatest(F.size(pred), n, F.lit(1))


def repetition(tokens: Column) -> Column:
    """Share of repeated pairs of neighbours."""
    g = ngrams(tokens, 2)
    return F.when(F.size(tokens) < 2, 0.0).otherwise(1.0 - F.size(F.array_distinct(g)) / F.greatest(F.size(g), F.lit(1)))


def reference_reward(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, reward, components) of (id, pred, refs); -1 without a prediction or a reference."""
    w = {**WEIGHTS, **(weights or {})}
    d = df.withColumn("refs", F.filter("refs", lambda r: F.size(r) > 0)).join(alignment_metrics(df), "id")
    usable = (F.size("pred") > 0) & (F.size("refs") > 0)
    parts = {
        "unigram_f1": F.array_max(F.transform("refs", lambda r: unigram_f1(F.col("pred"), r))),
        "rouge_l": F.col("rouge_l"),
        "meteor_exact": F.col("meteor_exact"),
        "length_score": F.when(usable, length_score(F.col("pred"), F.col("refs"))),
        "repetition_penalty": repetition(F.col("pred")),
    }
    d = d.select("id", *[F.when(usable, c).otherwise(0.0).alias(n) for n, c in parts.items()], usable.alias("_usable"))
    total = sum(((-1 if n == "repetition_penalty" else 1) * w[n] * F.col(n) for n in parts), F.lit(0.0))
    return d.select("id", F.when(F.col("_usable"), clamp(total)).otherwise(-1.0).alias("reward"), *parts)


def shaped(base: Column, cider: Column, judge: Column, cider_weight: float, judge_weight: float) -> Column:
    """Adds weighted CIDEr and judge terms to a reward that is already bounded, and bounds the sum."""
    return clamp(base + cider_weight * cider / 10.0 + judge_weight * judge)


def advantages(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Group-relative advantage; groups are the few answers drawn for one prompt."""
    w = W.partitionBy(group)
    return df.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + 1e-4))


def label_by_judge(df: DataFrame, a: str, b: str, score_a: str, score_b: str, gap: float) -> DataFrame:
    """Preference pairs from two scored answers whose scores differ by at least `gap`; ties go to the first."""
    first = F.col(score_a) >= F.col(score_b)
    return df.where(F.abs(F.col(score_a) - F.col(score_b)) >= gap).withColumns({"chosen": F.when(first, F.col(a)).otherwise(F.col(b)), "rejected": F.when(first, F.col(b)).otherwise(F.col(a))})


def margin_report(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row: mean margins, win rates, the gain and the share that improved."""
    b, a = F.col(before), F.col(after)
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return df.agg(F.count("*").alias("pairs"), F.coalesce(F.avg(b), F.lit(0.0)).alias("margin_before"), F.coalesce(F.avg(a), F.lit(0.0)).alias("margin_after"), rate(b > 0).alias("win_before"), rate(a > 0).alias("win_after"), F.coalesce(F.avg(a - b), F.lit(0.0)).alias("gain"), rate(a > b).alias("improved"))
