import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import grading as G
from weftline.operators import metrics as M
from weftline.operators import rewards as R


def pairs(spark, rows):
    return spark.createDataFrame([(i, p.split(), [r.split() for r in rs]) for i, (p, rs) in enumerate(rows)], "id long, pred array<string>, refs array<array<string>>")


def brute_lcs(a, b):
    best = 0
    for n in range(len(a), 0, -1):
        for c in itertools.combinations(range(len(a)), n):
            it = iter(b)
            if all(a[i] in it for i in c):
                return n
    return best


def test_lcs_against_brute_force():
    r = random.Random(5)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 8))] for _ in range(2))
        assert M.lcs(a, b) == brute_lcs(a, b)


def test_meteor_bounds_and_order():
    same = "a b c d e".split()
    assert M.meteor_exact_score(same, [same]) == pytest.approx(1 - 0.5 / 125)
    assert M.meteor_exact_score("e d c b a".split(), [same]) < M.meteor_exact_score(same, [same])
    assert M.meteor_exact_score([], [same]) == 0 and M.meteor_exact_score(same, []) == 0


def test_bundle_prefers_equal_texts(spark):
    good = M.caption_metrics(pairs(spark, [("a dog runs in the park", ["a dog runs in the park"]), ("two cats sit on a mat", ["two cats sit on a mat"])])).first()
    bad = M.caption_metrics(pairs(spark, [("x y z", ["a dog runs in the park"]), ("q", ["two cats sit on a mat"])])).first()
    for c in ("bleu4", "rouge_l", "cider", "meteor_exact"):
        assert good[c] > bad[c]
    assert good["bleu4"] == pytest.approx(1.0) and bad["empty_rate"] == 0


def test_bleu_by_hand(spark):
    b = M.corpus_bleu(pairs(spark, [("the the cat", ["the cat sat"])])).first()
    assert b["bleu1"] == pytest.approx(2 / 3) and b["bleu2"] == pytest.approx(math.sqrt(2 / 3 * 1 / 2)) and b["bleu3"] == 0


def test_cider_of_one_document_is_zero(spark):
    assert M.cider(pairs(spark, [("a b", ["a b"])])).first()["cider"] == 0


def test_empty_corpus(spark):
    row = M.caption_metrics(pairs(spark, []).where("false")).first()
    assert row["bleu1"] == 0 and row["cider"] == 0


def test_rewards(spark):
    d = pairs(spark, [("a dog in the park", ["a dog in the park"]), ("x y", ["a dog in the park"]), ("", ["a dog"]), ("a", [""])])
    r = {x["id"]: x for x in R.reference_reward(d).collect()}
    assert r[0]["reward"] > 0.99 > r[1]["reward"] and r[2]["reward"] == -1 and r[3]["reward"] == -1 and r[2]["rouge_l"] == 0
    length_only = {k: 0.0 for k in R.WEIGHTS} | {"length_score": 1.0}
    assert {x["id"]: x["reward"] for x in R.reference_reward(d, length_only).collect()}[1] == pytest.approx(0.4)
    f = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "b"])], ["p", "r"]).select(R.unigram_f1(F.col("p"), F.col("r")).alias("x"), R.repetition(F.array(*[F.lit(x) for x in "abab"])).alias("y")).first()
    assert f["x"] == pytest.approx(2 / 3) and f["y"] == pytest.approx(1 / 3)


def test_binary_summary(spark):
    d = spark.createDataFrame([("yes", "yes"), ("yes", "no"), ("no", "yes"), ("no", "no")], ["p", "y"])
    s = G.binary_summary(d, F.col("p"), F.col("y")).first()
    assert s["accuracy"] == s["precision"] == s["recall"] == 0.5
    d = spark.createDataFrame([(None, "yes")], "p string, y string")
    assert G.binary_summary(d, F.col("p"), F.col("y")).first()["unknown_ratio"] == 1


def test_consensus_closed_form(spark):
    for m, n in ((6, 10), (4, 10), (0, 3), (1, 1)):
        votes = [1] * m + [0] * (n - m)
        want = sum(min(1, (sum(votes) - v) / 3) for v in votes) / n
        got = spark.range(1).select(G.leave_one_out_consensus(F.lit(m), F.lit(n)).alias("x")).first()["x"]
        assert got == pytest.approx(want)


def test_auc_and_ties(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.5), (0, 0.5)], ["y", "s"])
    assert G.area_under_curve(d, "y", "s").first()["auc"] == pytest.approx((1 + 1 + 1 + 0.5) / 4)
    assert G.area_under_curve(d.where("y = 1"), "y", "s").first()["auc"] == 0.5


def test_spearman_of_constant_is_null(spark):
    assert G.spearman(spark.createDataFrame([(1, 2), (1, 3)], ["a", "b"]), "a", "b").first()["spearman"] is None


def test_order_statistic(spark):
    d = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], ["v"])
    assert G.order_statistic(d, "v", [0.5, 0.9]).first()["q50"] == 3
