"""Evaluation reports and builders by hand-computed cases, nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import evaluation as E
from weftline.operators import relational as R
from weftline.plans import builders as B


def test_choices(spark):
    d = spark.createDataFrame([(1, "q", "x", "y", None, "nan", "A", "A"), (2, "q", "x", "y", "z", "w", "C", "C"), (3, "q", "x", "y", None, None, "C", "C"), (4, "q", "x", "", None, None, "A", None)], "i int, q string, A string, B string, C string, D string, gold string, got string")
    o = E.valid_options({k: F.col(k) for k in E.LETTERS})
    got = {r["i"]: r for r in d.select("i", E.choice_prompt(F.col("q"), o).alias("p"), E.choice_correct(F.col("got"), F.col("gold"), o).alias("c"), E.choice_correct_gold(F.col("got"), F.col("gold")).alias("g")).collect()}
    assert got[1]["p"] == "q\nOptions:\nA. x\nB. y\nAnswer with the option letter only." and got[4]["p"].count("\n") == 3
    assert [got[i]["c"] for i in (1, 2, 3, 4)] == [True, True, False, False] and [got[i]["g"] for i in (1, 2, 3, 4)] == [True, True, True, False]


def test_levels_and_overall(spark):
    d = spark.createDataFrame([("a", "x", True), ("a", None, False), (None, "x", True)], "c string, l string, ok boolean")
    got = {(r["level"], r["key"]): (r["total"], r["accuracy"]) for r in E.accuracy_by_levels(d, "ok", "c", "l").collect()}
    assert got == {("c", "a"): (2, 0.5), ("c", "unknown"): (1, 1.0), ("l", "x"): (2, 1.0), ("l", "unknown"): (1, 0.0)}
    b = spark.createDataFrame([("s", "yes", "yes"), ("s", "no", "yes"), ("t", "yes", "no"), ("t", "no", "no")], "s string, p string, y string")
    o = {r["s"]: r for r in E.with_overall(b, F.col("p"), F.col("y"), "s").collect()}
    assert set(o) == {"s", "t", "overall"} and (o["overall"]["accuracy"], o["overall"]["precision"], o["overall"]["recall"]) == (0.5, 0.5, 0.5) and o["t"]["precision"] == 0
    assert E.accuracy_by_levels(d.where("false"), "ok", "c").count() == 0


def test_joins_of_runs(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, text string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (9, "v")], "id int, text string")
    p, r = E.common_ids(a, b, "id")
    assert {x["id"] for x in p.collect()} == {x["id"] for x in r.collect()} == {2, 3}
    assert [tuple(x) for x in E.first_common(a, b, "id", 1, "id".replace("id", "text")).collect()] == [(3, None, "w")]
    assert E.joined_runs({"a": a, "b": b, "c": a}, "id").columns == ["id", "text_a", "text_b", "text_c"]
    s = E.combined_summaries({"m": spark.createDataFrame([("bleu", 1.0)], "name string, value double"), "n": spark.createDataFrame([("cider", 2.0)], "name string, value double")}, ["bleu", "cider"])
    assert {tuple(x) for x in s.collect()} == {("m", 1.0, None), ("n", None, 2.0)}


def test_scores(spark):
    d = spark.createDataFrame([(3.0, 4.0), (4.0, 4.0), (5.0, 1.0), (1.0, 2.0)], "a double, b double")
    r = E.pairwise_report(d, "a", "b").first()
    assert (r["wins_a"], r["wins_b"], r["ties"], r["win_rate_b"], r["mean_a"]) == (1, 2, 1, 0.5, 3.25)
    answer, c = E.pair_confidence(F.lit(0.2), F.lit(0.2))
    assert tuple(spark.range(1).select(answer, c).first()) == ("yes", 0.5)
    x = spark.range(1).select(E.extended_reward(F.lit(0.9), F.lit(10.0), F.lit(5.0), 0.2, 0.3).alias("x"), E.coerced_score(F.create_map(F.lit("f"), F.lit(3.0), F.lit("p"), F.lit(1.0))).alias("f"), E.coerced_score(F.create_map(F.lit("a"), F.lit(3.0), F.lit("p"), F.lit(1.0))).alias("m")).first()
    assert tuple(x) == (1.0, 3.0, 2.0)
    e = E.calibration_report(spark.createDataFrame([(1, 0.9), (0, 0.1)], "y int, c double"), F.col("y"), F.col("c")).first()
    assert e["ece"] == pytest.approx(0.1) and e["mean_confidence"] == 0.5 and e["base_rate"] == 0.5
    assert tuple(E.calibration_report(spark.createDataFrame([], "y int, c double"), F.col("y"), F.col("c")).first()) == (0.0, 0.0, 0.0)


def test_conditions(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "i int, image string")
    got = {(r["i"], r["condition"]): r["image"] for r in E.control_conditions(s, "i", "image").collect()}
    assert [got[i, "shuffled"] for i in (1, 2, 3)] == ["b", "c", "a"] and got[2, "correct"] == "b" and got[1, "black"] is None
    right = spark.createDataFrame([(i, f"a {w} dog runs on grass".split(), [f"a {w} dog runs on grass".split()]) for i, w in ((1, "big"), (2, "red"), (3, "old"))], "id int, pred array<string>, refs array<array<string>>")
    dark = right.withColumn("pred", F.array(F.lit("dark")))
    r = E.condition_report({"correct": right, "black": dark, "same": right}).collect()
    by = {x["condition"]: x for x in r}
    assert by["same"]["change_rate"] == 0 and by["same"]["cider_drop"] == 0 and by["black"]["change_rate"] == 1 and by["black"]["mean_distance"] == 1 and by["black"]["bleu4_drop"] == pytest.approx(1)


def test_condition_report_is_no_single_plan(spark):
    right = spark.createDataFrame([(i, f"a {w} dog runs".split(), [f"a {w} dog runs on".split()]) for i, w in ((1, "big"), (2, "red"))], "id int, pred array<string>, refs array<array<string>>")
    r = E.condition_report({"correct": right, **{f"c{i}": right.withColumn("pred", F.col("refs")[0]) for i in range(3)}})
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    # Only rows of finished scores are put together: no n-grams, joins of tables or rankings are left to the last plan.
    assert "Generate" not in plan and "Aggregate" not in plan
    assert {x["condition"]: x["change_rate"] for x in r.collect()} == {"c0": 1.0, "c1": 1.0, "c2": 1.0}


def test_peek_guard_and_ranks(spark):
    d = spark.range(17).repartition(5)
    assert [r[0] for r in E.strata_peek(d, 5, "id").orderBy("id").collect()] == [0, 3, 6, 10, 13]
    assert E.strata_peek(d.where("false"), 5, "id").count() == 0
    with pytest.raises(ValueError):
        E.require_rows(d, 18)
    assert E.require_rows(d, 17) is d
    assert {(r["id"], r["k"]) for r in R.global_rank(d, "k", "id").collect()} == {(i, i) for i in range(17)}
    plan = R.global_rank(d, "k", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 3
    with pytest.raises(ValueError):
        R.negatives(spark.createDataFrame([(1, 1)], "g int, x int"), "g", "x", 1, 1, spark.range(10_001).select(F.col("id").cast("int").alias("x")))


def test_builders(spark):
    boxes = spark.createDataFrame([(1, "cat", "left"), (1, "dog", "top"), (1, "dog", "left"), (2, "cat", "top")], "image_id int, category string, position string")
    pool = spark.createDataFrame([("cat",), ("dog",), ("bus",)], "category string")
    got = {(r["image_id"], r["question"].split("?")[0], r["answer"]) for r in B.spatial_questions(boxes, pool, 2, 1).collect()}
    assert got == {(1, "Where is the cat in the image", "left"), (1, "How many cats are in the image", "1"), (1, "How many dogs are in the image", "2"), (1, "Is there a bus in the image", "no")}
    q = spark.createDataFrame([(1, 7, "what?"), (2, 7, "where?")], "question_id int, image_id int, question string")
    v = spark.createDataFrame([(1, 0, "cat"), (1, 1, "cat"), (1, 2, "dog"), (2, 0, "here")], "question_id int, pos int, answer string")
    talks, pairs = B.knowledge_rows(q, v, 0, 1, " Short.")
    assert {tuple(r) for r in pairs.collect()} == {(1, 7, "what? Short.", "cat", "dog"), (2, 7, "where? Short.", "here", "unknown")} and talks.count() == 2
    sweep = B.ratio_sweep(spark.range(50), spark.range(100, 150), {"a": (10, 5), "b": (20, 0)}, 3, "id")
    assert {(r["variant"], r["count"]) for r in sweep.groupBy("variant").count().collect()} == {("a", 15), ("b", 20)}
    assert B.capped_rows({"x": spark.range(9), "y": spark.range(2)}, 4, "id").count() == 6
