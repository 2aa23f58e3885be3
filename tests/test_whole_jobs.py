"""Whole jobs: no group, kind of text or part of a text is left out."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftline.functions import text as T
from weftline.operators import relational as R

DATA = "/root/testdata/sf0.001"


def test_cyclic_lead_of_a_hot_group(spark):
    rows = [(i, 417 if i % 3 else None, None if i == 7 else i) for i in range(400)] + [(1000 + i, i, i) for i in range(20)]
    got = R.next_cyclic(spark.createDataFrame(rows, "o long, k long, v long"), "o", "v", "n", "k")
    have = {r["o"]: r["n"] for r in got.collect()}
    want = {}
    for k in {r[1] for r in rows}:
        own = sorted(r for r in rows if r[1] == k)
        for at, (o, _, _) in enumerate(own):
            v = own[at + 1][2] if at + 1 < len(own) else None
            want[o] = own[0][2] if v is None else v
    assert have == want
    # No window over the hot group as one.
    assert "windowspecdefinition(_block" in got._jdf.queryExecution().optimizedPlan().toString()
    whole = R.next_cyclic(spark.range(50).repartition(5), "id", "id", "n").collect()
    assert {r["id"]: r["n"] for r in whole} == {i: (i + 1) % 50 for i in range(50)}


def test_cyclic_lead_over_every_image(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("image_id IS NOT NULL")
    got = entry.queries()["cyclic_lead"](spark, DATA)
    assert got.count() == docs.count()
    assert got.select("image_id", "next_id").exceptAll(docs.select("image_id", "doc_id")).count() == 0


ANSWERS = ["答案是A", "答案：B。", "选 C", "Désolé, fermé", "für d’eau", "L'île B", "É A", "Ü_A A_", "answer\u00a0:\u3000c", "Answer -d", "ANSWER b", "(D)", "A", "", None, "Beide: a, b", "x\u00a0A\u00a0y", "½A", "评分：４.５分"]


def test_choice_letter_in_any_script(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(ANSWERS)], "i int, t string")
    got = {r["i"]: (r["a"], r["b"]) for r in d.select("i", T.choice_letter(F.col("t")).alias("a"), T.choice_letter_any_case(F.col("t")).alias("b")).collect()}
    for i, t in enumerate(ANSWERS):
        t = t or ""
        m = re.search(r"\b([ABCD])\b", t) or re.search(r"answer\s*[:\-]?\s*([ABCD])", t, re.I)
        n = re.search(r"\b([A-Da-d])\b", t)
        assert got[i] == (m and m[1], n[1].upper() if n else ""), t


@pytest.mark.parametrize("name", ["choice_letter", "preference_quality"])
def test_pairs_of_any_script_against_sql(spark, name, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, t, u) for i, (t, u) in enumerate(zip(["two words", "no\u00a0break", "宽\u3000格", "one", None, "yes", "a b\u200b"] * 3, ANSWERS))]
    spark.createDataFrame(rows, "pair_id long, chosen string, rejected string").coalesce(1).write.parquet(str(tmp_path / "preference_pairs.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW preference_pairs AS SELECT * FROM read_parquet('{tmp_path}/preference_pairs.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=str)
    assert got.count() == (len(rows) if name == "choice_letter" else len([1 for _, c, r in rows if len((c or "").split()) > 1 and (r or "").split()]))


def test_near_duplicates_at_the_threshold(spark, tmp_path):
    rows = []
    for n in range(40):
        words = [f"w{n}x{i}" for i in range(104)]
        two, three = ([f"z{n}{w}" if i in at else w for i, w in enumerate(words)] for at in ((30, 70), (20, 50, 80)))
        # 90 of 110 shingles in common, then with texts of their own 85 of 115.
        rows += [(4 * n, " ".join(words)), (4 * n + 1, " ".join(two).upper()), *((4 * n + i, " ".join(f"v{w}" for w in t)) for i, t in ((2, words), (3, three)))]
    rows += [(900, "one two"), (901, "One, two!"), (902, "one"), (903, None), (904, " ? ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["id"]: r["component"] for r in entry.queries()["near_dup_clusters"](spark, str(tmp_path)).collect()}
    assert got == {i + j: i for i in range(0, 160, 4) for j in (0, 1)} | {900: 900, 901: 900}
    p = entry.queries()["near_dup_profile"](spark, str(tmp_path)).first()
    assert (p["texts"], p["clusters"], p["clustered"], p["near_duplicates"]) == (163, 41, 82, 41)
