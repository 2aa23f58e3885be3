import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import numbers as N
from weftline.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.mixed_tokens(F.col("t")), t="A dog 在公园") == ["a", "dog", "在", "公", "园"]
    assert one(spark, T.mixed_tokens(F.lit(None).cast("string"))) == []
    assert one(spark, T.word_count(F.col("t")), t="  one two\nthree ") == 3


@pytest.mark.parametrize("text, want", [("the Two cats!", "2 cats"), ("An, a", ""), ("ten-one", "10 1")])
def test_normaliser_b(spark, text, want):
    assert one(spark, T.normalise_b(F.col("t")), t=text) == want


def test_normaliser_a(spark):
    assert one(spark, T.normalise_a(F.col("t")), t="The étion, dé_ja! a") == "étion dé_ja"


@pytest.mark.parametrize("text, prefix, pattern", [("Yes.", "yes", "yes"), ("yeah", None, "yes"), ("north", "no", "no"), ("maybe", None, None), (" you", None, "yes")])
def test_yes_no(spark, text, prefix, pattern):
    assert one(spark, T.yes_no_prefix(F.col("t")), t=text) == prefix
    assert one(spark, T.yes_no_pattern(F.col("t")), t=text) == pattern


@pytest.mark.parametrize("text, want", [("B", "B"), ("the answer: c", "c"), ("Answer-D", "D"), ("none", None)])
def test_choice_letter(spark, text, want):
    assert one(spark, T.choice_letter(F.col("t")), t=text) == want


def test_judge_score(spark):
    assert one(spark, T.judge_score(F.col("t")), t="about 4.5 of 5") == 4.5
    assert one(spark, T.judge_score(F.col("t")), t="no number") == 3.0


def test_ngrams_and_shingles(spark):
    t = F.split(F.col("t"), " ")
    assert one(spark, T.ngrams(t, 2), t="a b c") == ["a b", "b c"]
    assert one(spark, T.ngrams(t, 4), t="a b c") == []
    assert one(spark, T.shingles(t, 5), t="a b") == ["a b"]


def test_language_bucket(spark):
    assert one(spark, T.language_bucket(F.col("t")), t="hello") == "en"
    assert one(spark, T.language_bucket(F.col("t")), t="你好吗") == "zh"
    assert one(spark, T.language_bucket(F.col("t")), t="") == "en"


def test_controller(spark):
    step = lambda kl: one(spark, N.controller_step(F.lit(0.1), F.lit(kl), 0.05))
    assert step(0.2) > 0.1 > step(0.0)
    assert step(0.05) == pytest.approx(0.1)
    with pytest.raises(ValueError):
        N.controller_step(F.lit(0.1), F.lit(0.1), 0.0)


def test_policy_terms(spark):
    assert one(spark, N.kl_estimate(F.lit(0.0), F.lit(0.0))) == 0
    assert one(spark, N.clipped_objective(F.lit(1.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(1.2)
    assert one(spark, N.preference_loss(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))) == pytest.approx(math.log(2))
    assert one(spark, N.cosine_rate(F.lit(0), F.lit(10), 1.0)) == pytest.approx(1.0)
    assert one(spark, N.position_of(F.lit(310.0), F.lit(230.0), F.lit(20.0), F.lit(20.0))) == "center"
