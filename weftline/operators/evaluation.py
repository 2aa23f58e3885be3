"""Evaluation over prediction tables: logs of several runs joined, choices graded, conditions compared, scores correlated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import numbers as N
from weftline.operators import grading as G
from weftline.operators import metrics as M
from weftline.operators import relational as R
from weftline.operators import rewards as RW
from weftline.session import cut

LETTERS = ("A", "B", "C", "D")


def require_rows(df: DataFrame, least: int, what: str = "rows") -> DataFrame:
    """The table, or an error if it has fewer rows; reads no more of it than that."""
    n = df.limit(least).count()
    if n < least:
        raise ValueError(f"{n} {what}, at least {least} needed")
    return df


# --- Choices --------------------------------------------------------------------------------------------------------------


def valid_options(options: dict[str, Column]) -> Column:
    """[(letter, text)] of the options present; a missing one is NULL, empty or the text nan."""
    every = F.array(*[F.struct(F.lit(k).alias("letter"), v.cast("string").alias("text")) for k, v in options.items()])
    return F.filter(every, lambda o: o["text"].isNotNull() & (o["text"] != "") & (o["text"] != "nan"))


def choice_prompt(question: Column, options: Column, instruction: str = "Answer with the option letter only.") -> Column:
    lines = F.transform(options, lambda o: F.concat(o["letter"], F.lit(". "), o["text"]))
    return F.array_join(F.concat(F.array(question, F.lit("Options:")), lines, F.array(F.lit(instruction))), "\n")


def choice_correct(predicted: Column, answer: Column, options: Column) -> Column:
    """Right and among the options given; an unread prediction is wrong."""
    return F.coalesce((predicted == answer) & F.exists(options, lambda o: o["letter"] == answer), F.lit(False))


def choice_correct_gold(predicted: Column, gold: Column) -> Column:
    """Right where there is a gold answer at all."""
    return F.coalesce((gold != "") & (predicted == gold), F.lit(False))


def accuracy_by_levels(graded: DataFrame, correct: str, *levels: str) -> DataFrame:
    """(level, key, total, accuracy) of each level by itself, in one pass; a missing key is unknown."""
    keys = F.array(*[F.struct(F.lit(x).alias("level"), F.coalesce(F.nullif(F.col(x), F.lit("")), F.lit("unknown")).alias("key")) for x in levels])
    d = graded.select(F.explode(keys).alias("k"), F.col(correct).alias("c")).groupBy("k.level", "k.key").agg(F.count("*").alias("total"), F.count_if("c").alias("right"))
    return d.select("level", "key", "total", (F.col("right") / F.col("total")).alias("accuracy")).orderBy("level", F.desc("total"), "key")


# --- Joins of logs ----------------------------------------------------------------------------------------------------------


def common_ids(predictions: DataFrame, references: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables restricted to the ids that the other one has."""
    return predictions.join(references.select(key), key, "left_semi"), references.join(predictions.select(key), key, "left_semi")


def joined_runs(runs: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of several runs side by side, inner on `key`; other columns get the name of their run."""
    named = [d.select(key, *[F.col(c).alias(f"{c}_{name}") for c in d.columns if c != key]) for name, d in runs.items()]
    return reduce(lambda a, b: a.join(b, key), named)


def first_common(left: DataFrame, right: DataFrame, key: str, n: int, order: str, name: tuple[str, str] = ("left", "right")) -> DataFrame:
    """The first n rows of both runs, in the order of the left one."""
    return joined_runs({name[0]: left, name[1]: right}, key).orderBy(f"{order}_{name[0]}", key).limit(n)


def combined_summaries(parts: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """(model, a column per metric) from several summaries of (name, value); a metric that a model lacks is NULL."""
    rows = R.union_all([d.select(F.lit(model).alias("model"), "name", "value") for model, d in parts.items()])
    return rows.groupBy("model").pivot("name", names).agg(F.first("value"))


# --- Scores -------------------------------------------------------------------------------------------------------------------


def with_overall(df: DataFrame, predicted: Column, label: Column, by: str) -> DataFrame:
    """The summary of each setting, and one of all rows under the name `overall`."""
    own = F.explode(F.array(F.coalesce(F.col(by), F.lit("unknown")), F.lit("overall")))
    d = df.select(predicted.alias("_p"), label.alias("_y"), own.alias(by))
    return G.binary_summary(d, F.col("_p"), F.col("_y"), by)


def calibration_report(df: DataFrame, label: Column, confidence: Column) -> DataFrame:
    """One row: calibration error, mean confidence, share of positive labels."""
    b = G.calibration_bins(df, label, confidence)
    n = F.greatest(F.sum("n"), F.lit(1))
    return b.agg(F.coalesce(F.sum(F.abs(F.col("y") - F.col("c"))) / n, F.lit(0.0)).alias("ece"), F.coalesce(F.sum("c") / n, F.lit(0.0)).alias("mean_confidence"), F.coalesce(F.sum("y") / n, F.lit(0.0)).alias("base_rate"))


def pairwise_report(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: wins of either side, ties, the share that b wins and the mean scores."""
    n = F.greatest(F.count("*"), F.lit(1))
    return df.agg(F.count("*").alias("samples"), F.count_if(F.col(a) > F.col(b)).alias("wins_a"), F.count_if(F.col(b) > F.col(a)).alias("wins_b"), F.count_if(F.col(a) == F.col(b)).alias("ties"),
                  F.round(F.count_if(F.col(b) > F.col(a)) / n, 4).alias("win_rate_b"), F.round(F.avg(a), 4).alias("mean_a"), F.round(F.avg(b), 4).alias("mean_b"))


def component_means(df: DataFrame, group: str, components: str) -> DataFrame:
    """(group, component, mean) of a map column."""
    return df.select(group, F.explode(components).alias("component", "x")).groupBy(group, "component").agg(F.avg("x").alias("mean"))


def pair_confidence(yes: Column, no: Column) -> tuple[Column, Column]:
    """(answer, confidence) from the probabilities of two answers; equal ones are a yes."""
    return F.when(yes >= no, "yes").otherwise("no"), F.greatest(yes, no) / F.greatest(yes + no, F.lit(1e-9))


def extended_reward(base: Column, cider: Column, judge: Column, w_cider: float, w_judge: float) -> Column:
    """A clamped base reward with shares of the scaled metric and of the judge's score, clamped again."""
    return RW.shaped(base, cider, N.judge_rescaled(judge), w_cider, w_judge)


def rank_correlations(df: DataFrame, score: str, metrics: list[str]) -> DataFrame:
    """(metric, n, spearman) of a score with each metric."""
    parts = [G.spearman(df, score, m).select(F.lit(m).alias("metric"), "n", "spearman") for m in metrics]
    return R.union_all(parts)


# --- Conditions ---------------------------------------------------------------------------------------------------------------


def control_conditions(samples: DataFrame, order: str, image: str) -> DataFrame:
    """(order, condition, image): each sample with its own image, with none (black), and with that of the next sample, cyclically."""
    d = R.next_cyclic(samples.select(order, image), order, image, "_next")
    none = F.lit(None).cast(samples.schema[image].dataType)
    kinds = [F.struct(F.lit(name).alias("condition"), x.alias(image)) for name, x in (("correct", F.col(image)), ("black", none), ("shuffled", F.col("_next")))]
    return d.select(order, F.inline(F.array(*kinds)))


def condition_report(conditions: dict[str, DataFrame]) -> DataFrame:
    """(condition, change_rate, mean_distance, cider_drop, bleu4_drop) of each condition against `correct`.

    A condition is a table of (id, pred, refs), the tokens predicted and the reference tokens. Each score is a job of its own that
    leaves one row: as one plan, every metric of every condition would be more than a driver holds.
    """
    tables = {name: cut(d.select("id", "pred", "refs")) for name, d in conditions.items()}
    scores = {name: cut(M.cider(d).agg(F.avg("cider").alias("cider"))).crossJoin(cut(M.corpus_bleu(d).select("bleu4"))) for name, d in tables.items()}
    best = scores["correct"].select(F.col("cider").alias("_c"), F.col("bleu4").alias("_b"))
    out = []
    for name, d in tables.items():
        if name == "correct":
            continue
        both = tables["correct"].select("id", F.col("pred").alias("a")).join(d.select("id", F.col("pred").alias("b")), "id")
        change = cut(both.agg(F.avg((F.col("a") != F.col("b")).cast("double")).alias("change_rate"), F.avg(M.jaccard_distance(F.array_distinct("a"), F.array_distinct("b"))).alias("mean_distance")))
        drop = scores[name].crossJoin(best).select((F.col("_c") - F.col("cider")).alias("cider_drop"), (F.col("_b") - F.col("bleu4")).alias("bleu4_drop"))
        out.append(change.crossJoin(drop).select(F.lit(name).alias("condition"), "*"))
    return R.union_all(out)


def strata_peek(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first row of each of n equal strata of the ordered table: positions floor(i * rows / n)."""
    total = df.count()
    at = sorted({i * total // n for i in range(n)})
    return R.global_rank(df, "_rank", *order).where(F.col("_rank").isin(at)).drop("_rank") if total else df


def coerced_score(values: Column, key: str = "f") -> Column:
    """A map of scores as one number: the entry `f`, else the mean of all."""
    v = F.map_values(values)
    return F.coalesce(F.try_element_at(values, F.lit(key)), F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(v), F.lit(1)))


def chart_tables(summaries: DataFrame, base: str) -> DataFrame:
    """(chart, model, name, value) from summaries (position, model, name, value): every value (overview), its gain over the model
    before (chain) and its ratio to the model `base` (ratios); one row a model and metric, so windows over metrics are small."""
    w = W.partitionBy("name").orderBy("position")
    first = summaries.where(F.col("model") == base).select("name", F.col("value").alias("_base"))
    d = summaries.withColumn("_before", F.lag("value").over(w)).join(first, "name", "left")
    parts = {"overview": F.col("value"), "chain": F.col("value") - F.col("_before"), "ratios": F.col("value") / F.nullif(F.col("_base"), F.lit(0.0))}
    rows = F.array(*[F.struct(F.lit(k).alias("chart"), v.alias("value")) for k, v in parts.items()])
    return d.select("model", "name", F.explode(rows).alias("c")).where("c.value IS NOT NULL").select("c.chart", "model", "name", "c.value")
