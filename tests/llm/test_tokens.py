import random

import pytest

from weftline.llm import mixing, packing
from weftline.llm.tokens import encoding, measured


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], "doc_id long, text string, source string, tokens int")


def test_measured(spark):
    got = {r["doc_id"]: r["tokens"] for r in measured(docs(spark, [(1, "hello world", "a"), (2, None, "a"), (3, " \n", "a"), (4, "你好", None)])).collect()}
    assert got == {1: len(encoding("byte_bpe_50k.tiktoken").encode_ordinary("hello world")), 4: len(encoding("byte_bpe_50k.tiktoken").encode_ordinary("你好"))}


@pytest.mark.parametrize("capacities", [[10], [4, 10], [3, 7, 10]])
def test_plan_holds_everything(capacities):
    r = random.Random(1)
    for _ in range(40):
        h = {s: r.randint(1, 9) for s in r.sample(range(1, max(capacities) + 1), r.randint(1, max(capacities)))}
        plan = packing.plan(dict(h), capacities)
        got = {}
        for p in plan:
            assert p.used <= p.capacity and p.capacity in capacities and not any(p.used <= c < p.capacity for c in capacities)
            for s, k in p.items:
                got[s] = got.get(s, 0) + k * p.bins
        assert got == h
        # Never worse than the bound of first fit decreasing.
        if len(capacities) == 1:
            least = -(-sum(s * n for s, n in h.items()) // capacities[0])
            assert sum(p.bins for p in plan) <= 11 / 9 * max(least, sum(n for s, n in h.items() if 2 * s > capacities[0])) + 4


def test_pack(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["dog", "cat", "house", "tree"]) for _ in range(r.choice([1, 5, 5, 5, 17, 70]))), "a") for i in range(300)] + [(900, None, "a"), (901, "  ", "a"), (5, "again", "b")]
    d = docs(spark, rows)
    specs = spark.createDataFrame([(1, 16), (2, 40), (3, None), (4, 0)], "spec_id int, capacity_tokens int")
    a = packing.pack(d, specs).toPandas()
    sizes = {x["doc_id"]: 0 for x in d.collect()}
    for x in measured(d).collect():
        sizes[x["doc_id"]] += x["tokens"]
    assert set(a.packing) == {"spec 1", "spec 2", "joint"}
    for name, g in a.groupby("packing"):
        assert dict(g.groupby("doc_id").tokens.sum()) == {k: v for k, v in sizes.items() if v}
        bins = g.groupby("bin_id").agg(t=("tokens", "sum"), c=("capacity_tokens", "first"), k=("capacity_tokens", "nunique"))
        assert (bins.t <= bins.c).all() and (bins.k == 1).all()
        top = {"spec 1": 16, "spec 2": 40, "joint": 40}[name]
        split = g[g.doc_id != 5].groupby("doc_id").size()
        assert all(sizes[i] > top for i in split[split > 1].index)
    u = packing.unused(packing.pack(d, specs)).toPandas()
    assert (u.unused >= 0).all() and u[u.packing == "joint"].unused.sum() <= u[u.packing == "spec 2"].unused.sum()
    assert packing.pack(d.where("false"), specs).count() == 0 and packing.pack(d, specs.where("false")).count() == 0


def test_mix(spark):
    r = random.Random(3)
    rows = []
    for s, n in (("big-one", 600), ("Small", 30), ("mid", 200), ("unnamed", 50)):
        rows += [(len(rows) + k, " ".join(r.choice(["dog", "cat", "house"]) + str(r.randint(0, 9999)) for _ in range(r.randint(3, 40))), s) for k in range(n)]
    rows += [(9000, rows[0][1], "mid"), (9001, None, "mid"), (9002, "x", None)]
    t = spark.createDataFrame([("BIG_ONE", 0.5, 1), ("small", 0.2, 3), ("mid", 0.25, 2), ("missing", 0.05, 2), ("never", 0.0, 2)], "source string, target_share double, max_repeats int")
    d = docs(spark, rows)
    drawn = mixing.draw(d, t).toPandas()
    cap = {"big_one": 1, "small": 3, "mid": 2}
    assert set(drawn.source) == set(cap) and all(c <= cap[s] for s, c in zip(drawn.source, drawn.copies)) and 9000 not in set(drawn.doc_id)
    share = {x["source"]: x["share_reached"] for x in mixing.shares(d, t).collect()}
    for s, want in (("big_one", 0.5), ("small", 0.2), ("mid", 0.25)):
        assert share[s] == pytest.approx(want / 0.95, abs=0.01)
    assert share["missing"] == 0
    # Every source within one of its texts of its target.
    size = {s: max(x["tokens"] for x in drawn.to_dict("records") if x["source"] == s) for s in cap}
    total = (drawn.tokens * drawn.copies).sum()
    assert all(abs(share[s] - want / 0.95) * total <= size[s] for s, want in (("big_one", 0.5), ("small", 0.2), ("mid", 0.25)))
    plan = mixing.draw(d, t)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan  # counted once, before
    assert mixing.draw(d.where("false"), t).count() == 0 and mixing.draw(d, t.where("false")).count() == 0


def test_too_many_targets_raise(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError):
        mixing.draw(docs(spark, [(1, "x", "a")]), t)
    monkeypatch.setattr(packing, "MOST_CAPACITY", 8)
    with pytest.raises(ValueError):
        packing.packings(spark.createDataFrame([(1, 9)], "spec_id int, capacity_tokens int"))
