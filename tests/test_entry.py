"""Every registered query runs on the smallest tables; those with SQL agree with it."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SAMPLE = ["profile_language_mix", "first_turn_extract", "answer_normalise_b", "consensus_answer", "existence_negatives_popular", "corpus_bleu", "cider", "ece", "rank_statistic", "spearman", "kl_controller", "kl_safety_stop", "top_k_nucleus", "dependency_report"]


def test_names():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)


def test_entry(spark):
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    got = entry.queries()[name](spark, DATA)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.count() >= 0
        return
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(got.columns)

    def plain(v):
        return round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=str)
    have = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()), key=str)
    assert have == want
