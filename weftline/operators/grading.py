"""Grading of answers, classification and calibration statistics, rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.relational import running_total


def leave_one_out_consensus(matches: Column, answers: Column) -> Column:
    """Mean over the annotators of min(1, matches among the others / 3), from the number of matches among all."""
    m, n = matches.cast("double"), answers.cast("double")
    return F.when(n > 0, (m * F.least(F.lit(1.0), (m - 1) / 3.0) + (n - m) * F.least(F.lit(1.0), m / 3.0)) / F.greatest(n, F.lit(1.0))).otherwise(0.0)


def three_of_ten(matches: Column) -> Column:
    return F.least(F.lit(1.0), matches / 3.0)


def binary_summary(df: DataFrame, predicted: Column, label: Column, *by: str) -> DataFrame:
    """Accuracy, precision, recall, F1, share of yes and of unknown; an unknown prediction misses a yes."""
    p, y = F.coalesce(predicted, F.lit("unknown")), label
    d = df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(p == y).alias("correct"), F.count_if((p == "yes") & (y == "yes")).alias("tp"), F.count_if((p == "yes") & (y == "no")).alias("fp"),
        F.count_if((p != "yes") & (y == "yes")).alias("fn"), F.count_if(p == "yes").alias("yes"), F.count_if(~p.isin("yes", "no")).alias("unknown"))
    one = F.lit(1)
    d = d.withColumns({"accuracy": F.col("correct") / F.greatest("total", one), "precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one), "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)})
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))
    return d.select(*by, "total", "accuracy", "precision", "recall", f1.alias("f1"), (F.col("yes") / F.greatest("total", one)).alias("yes_ratio"), (F.col("unknown") / F.greatest("total", one)).alias("unknown_ratio"))


def calibration_bins(df: DataFrame, label: Column, confidence: Column, bins: int = 10) -> DataFrame:
    return df.select(label.cast("double").alias("y"), confidence.alias("c"), F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("c").alias("c"))


def expected_calibration_error(df: DataFrame, label: Column, confidence: Column, bins: int = 10) -> DataFrame:
    b = calibration_bins(df, label, confidence, bins)
    return b.agg(F.coalesce(F.sum(F.abs(F.col("y") - F.col("c"))) / F.greatest(F.sum("n"), F.lit(1)), F.lit(0.0)).alias("ece"))


def rank_table(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the average rank of equal values, from the counts of distinct values summed up range by range."""
    c = running_total(df.groupBy(value).agg(F.count("*").alias("_n")), "_n", "_b", value)
    return df.hint("merge").join(c.select(value, (F.col("_b") + (F.col("_n") + 1) / 2.0).alias(out)), value)


def area_under_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: `auc`, the share of ordered pairs (half for ties), and `descending_statistic`, its complement as a rank sum over
    descending scores gives it; 0.5 each if a class is empty."""
    r = rank_table(df.select(F.col(label).cast("long").alias("y"), F.col(score).alias("s")), "s", "r")
    d = r.agg(F.sum(F.when(F.col("y") == 1, F.col("r"))).alias("rs"), F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    auc = (F.col("rs") - F.col("p") * (F.col("p") + 1) / 2.0) / F.greatest(F.col("p") * F.col("n"), F.lit(1))
    return d.select(F.when((F.col("p") == 0) | (F.col("n") == 0), 0.5).otherwise(auc).alias("auc")).withColumn("descending_statistic", 1 - F.col("auc"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks; NULL for constants."""
    d = rank_table(rank_table(df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL"), "a", "ra"), "b", "rb")
    m = d.agg(F.count("*").alias("n"), F.avg("ra").alias("ma"), F.avg("rb").alias("mb"), F.avg(F.col("ra") * F.col("rb")).alias("mab"), F.avg(F.col("ra") * F.col("ra")).alias("maa"), F.avg(F.col("rb") * F.col("rb")).alias("mbb"))
    va, vb = F.col("maa") - F.col("ma") * F.col("ma"), F.col("mbb") - F.col("mb") * F.col("mb")
    return m.select("n", F.when((va > 0) & (vb > 0), (F.col("mab") - F.col("ma") * F.col("mb")) / F.sqrt(va * vb)).alias("spearman"))


def order_statistic(df: DataFrame, value: str, q: list[float], *by: str) -> DataFrame:
    """Values at position floor(q * n) of the sorted values, by counts of distinct values; no interpolation."""
    c = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by).orderBy(value)
    c = c.withColumn("_to", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(W.partitionBy(*by)))
    at = [F.floor(F.lit(x) * F.col("_all")) for x in q]
    return c.groupBy(*by).agg(F.max("_all").alias("n"), *[F.min(F.when(F.col("_to") > p, F.col(value))).alias(f"q{round(x * 100)}") for x, p in zip(q, at)])
