import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import conversations as C
from weftline.operators import relational as R
from weftline.operators.components import connected_components
from weftline.streaming import state as S


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 9), (5, 5), (3, None), (20, 10), (30, 20), (40, 30), (50, 40)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 10, 20: 10, 30: 10, 40: 10, 50: 10}
    assert connected_components(e.where("false")).count() == 0


def test_upsert_and_samples(spark):
    o, n = spark.createDataFrame([("a", 1.0), ("b", 2.0)], ["name", "value"]), spark.createDataFrame([("b", 3.0), ("c", 4.0)], ["name", "value"])
    assert {tuple(r) for r in R.upsert(o, n, "name", "value").collect()} == {("a", 1.0), ("b", 3.0), ("c", 4.0)}
    d = spark.range(100)
    assert R.sample_rows(d, 10, 1, "id").collect() == R.sample_rows(d.repartition(7), 10, 1, "id").collect()
    s = R.exact_split(d, 30, 2, "id").groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in s} == {"eval": 30, "train": 70}


def test_first_and_last(spark):
    d = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, None)], "k int, o int, v string")
    assert {tuple(r) for r in R.first_per_key(d, ["k"], [F.col("o")], last=True).collect()} == {(1, 2, "y"), (2, 1, None)}


def test_negatives(spark):
    p = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c")], ["g", "i"])
    pool = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], ["i"])
    got = {tuple(r) for r in R.negatives(p, "g", "i", 9, 1, pool).collect()}
    assert got == {(1, "c"), (1, "d"), (2, "b"), (2, "d")}
    assert {tuple(r) for r in R.adversarial_negatives(p, "g", "i", 9, 1).collect()} == {(1, "c"), (2, "b")}


def turns(spark, *items):
    t = json.dumps([dict(zip(("role", "content"), x)) if isinstance(x, tuple) else x for x in items])
    return spark.createDataFrame([(t,)], ["c"]).select(C.turns(F.col("c")).alias("t"))


def test_turns(spark):
    t = turns(spark, ("system", "s"), ("user", "<image>\nq"), ("assistant", "a long enough answer"), ("user", "r"), ("assistant", "b"))
    h, last = C.history_and_last(F.col("t"))
    row = t.select(C.first_content(F.col("t"), "user").alias("u"), F.size(h).alias("h"), last.alias("l"), C.valid_for_reward(F.col("t")).alias("ok")).first()
    assert (row["u"], row["h"], row["l"], row["ok"]) == ("<image>\nq", 4, "b", True)
    bad = turns(spark, ("user", "<image>"), {"role": "assistant", "content": "a long enough answer", "tools": [1]})
    assert not bad.select(C.valid_for_reward(F.col("t")).alias("ok")).first()["ok"]
    assert spark.createDataFrame([("x",), (None,), ("",)], ["c"]).select(C.turns(F.col("c")).alias("t")).where("t is not null and size(t) > 0").count() == 0


def test_label_spans(spark):
    d = spark.createDataFrame([([1, 9, 8, 5, 6, 7, 2, 9, 8, 4, 7],)], "t array<int>")
    assert d.select(C.answer_labels(F.col("t"), [9, 8], [7], 100).alias("x")).first()["x"] == [-100, -100, -100, 5, 6, 7, -100, -100, -100, 4, 7]
    assert d.select(C.answer_labels(F.col("t"), [9, 8], [7], 5).alias("x")).first()["x"] == [-100, -100, -100, 5, 6] + [-100] * 6
    assert d.select(C.mask_after_end(F.col("t"), 9).alias("x")).first()["x"] == [1, 1] + [0] * 9
    assert [tuple(r) for r in d.select(C.marker_runs(F.array(*[F.lit(x) for x in (3, 3, 1, 3)]), 3).alias("x")).first()["x"]] == [(0, 2), (3, 1)]


def test_batch_controller_and_stop(spark):
    log = spark.createDataFrame([("r", i, kl) for i, kl in enumerate([0.1, 0.2, 0.3, 0.0, 0.9])], "run string, s int, kl double")
    b = [r["beta"] for r in S.controller_trace(log, "run", "s", "kl", 0.1, 0.05).orderBy("s").collect()]
    assert b[0] == pytest.approx(0.1 * 2.718281828 ** 0.05) and b[3] < b[2]
    v = {r["s"]: (r["streak"], r["stops"]) for r in S.violations(log, "run", "s", "kl", 0.15, 2).collect()}
    assert v == {0: (0, False), 1: (1, False), 2: (2, True), 3: (0, False), 4: (1, False)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [("r", i, kl) for i, kl in enumerate([0.1, 0.2, 0.3, 0.0, 0.9])]
    src = tmp_path / "in"
    log = spark.createDataFrame(rows, "run string, global_step long, kl double")
    log.coalesce(1).write.json(str(src))
    stream = spark.readStream.schema("run string, global_step long, kl double").json(str(src))
    out = S.controller_stream(stream, "run", 0.1, 0.05, 2, 0.15)
    q = out.writeStream.format("memory").queryName("betas").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["global_step"]: r["beta"] for r in spark.table("betas").collect()}
    want = {r["global_step"]: r["beta"] for r in S.controller_trace(log, "run", "global_step", "kl", 0.1, 0.05).collect()}
    assert got == pytest.approx(want)


def test_readers(spark, tmp_path):
    from weftline.sources import readers, writers

    (tmp_path / "a.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "000000000007.jpg"}], "annotations": [{"image_id": 1, "caption": "x"}]}))
    images, notes = readers.read_captions(spark, str(tmp_path / "a.json"))
    assert images.count() == notes.count() == 1
    (tmp_path / "q.json").write_text(json.dumps({"annotations": [{"question_id": 1, "answer_type": "other", "answers": [{"answer": "a"}, "b"]}]}))
    assert readers.read_annotations(spark, str(tmp_path / "q.json")).first()["answers"] == ["a", "b"]
    (tmp_path / "log.txt").write_text("noise\n{\"x\": 1}\n\ntime 1.0 h\ntime 3.5 h\n")
    assert readers.read_json_lines(spark, str(tmp_path / "log.txt"), "x int").count() == 1
    assert readers.last_match(spark, str(tmp_path / "log.txt"), r"time [0-9.]+ h") == "time 3.5 h"
    with pytest.raises(ValueError):
        readers.last_match(spark, str(tmp_path / "log.txt"), "never")
    (tmp_path / "c.tsv").write_text("index\tquestion\tA\tB\tanswer\n1\tq\tx\tnan\t b\n")
    row = readers.read_choices(spark, str(tmp_path / "c.tsv")).first()
    assert row["answer"] == "B" and row["B"] is None
    (tmp_path / "f.json").write_text(json.dumps({"data": [{"file_name": "i", "sentences": ["u", {"caption": "v"}]}, {"image": "j", "caption": "w"}]}))
    got = {r["image"]: r["references"] for r in readers.read_flexible_captions(spark, str(tmp_path / "f.json")).collect()}
    assert got == {"i": ["u", "v"], "j": ["w"]}
    d = spark.createDataFrame([(1, "a"), (2, "b")], ["image_id", "caption"])
    writers.write_prediction_array(d, str(tmp_path / "p"))
    assert {tuple(r) for r in readers.read_predictions(spark, str(tmp_path / "p")).collect()} == {(1, "a"), (2, "b")}
    assert readers.tolerant_json(spark, str(tmp_path / "none.json")) == {}


def test_signatures_and_clusters(spark):
    import numpy as np

    from weftline.operators import dedup as D

    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base.upper() + "!"), (3, base.replace("w59", "z")), (4, "something else entirely here now ok"), (5, None), (6, " ?"), (7, "short")]
    sigs = D.signatures(spark.createDataFrame(rows, "i long, t string"), "i", F.col("t"))
    got = {r["id"]: r["sig"] for r in sigs.collect()}
    assert set(got) == {1, 2, 3, 4, 7} and got[1] == got[2] and len(got[4]) == 64
    a, b = zip(*D.permutations(64))
    h = D.base_hash("short")
    assert got[7] == [int(x) for x in (np.array(a) * h + np.array(b)) % D.PRIME]
    comps = {r["id"]: r["component"] for r in D.clusters(sigs).collect()}
    assert comps[1] == comps[2] == 1 and 4 not in comps
    assert D.cluster_profile(sigs).first()["texts"] == 5
    assert 0 <= D.sampled_rate(sigs, 10, 2, 1).first()["rate"] <= 1


def test_experiment():
    from weftline.plans.builders import VARIABLES, Experiment

    ok = {k: {} for k in ("pretrain", "sft", "grpo", "evaluation")}
    for name in VARIABLES:
        section, key = name.split(".")
        ok[section][key] = 64 if key == "batch_size" else True if key == "adaptive_beta" else 0.1
    ok["evaluation"]["conditions"] = ["correct", "black", "shuffled"]
    env = Experiment.of(ok).environment({"HOME": "/x"})
    assert env["GRPO_ADAPTIVE_BETA"] == "1" and env["SFT_BATCH_SIZE"] == "64" and env["PIPELINE_SEED"] == "42" and env["EVAL_CONDITIONS"] == "correct black shuffled" and env["HOME"] == "/x"
    assert len(env) == 18 and Experiment.of({**ok, "seed": 7}).environment()["PIPELINE_SEED"] == "7"
    less = {k: v for k, v in ok["sft"].items() if k != "epochs"}
    for bad in ({**ok, "grpo": {**ok["grpo"], "target_kl": 0}}, {**ok, "evaluation": {**ok["evaluation"], "conditions": ["blue"]}}, {**ok, "evaluation": {**ok["evaluation"], "samples": 0}}, {**ok, "sft": less}, {"sft": {}}, {**ok, "evaluation": {"samples": 1}}):
        with pytest.raises(ValueError):
            Experiment.of(bad)
