"""Listings, archives, Arrow folders, arrays, resumable stages and the command line."""

import io
import json
import os
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from weftline import __main__ as cli
from weftline.operators import conversations as C
from weftline.plans.stages import run_stages
from weftline.sources import readers, writers


def test_listings(spark, tmp_path):
    for d in ("b", "a", "c"):
        (tmp_path / d).mkdir()
    for d in ("b", "a"):
        (tmp_path / d / "predictions.json").write_text("[]")
    assert [os.path.basename(x) for x in readers.result_directories(spark, str(tmp_path), "predictions.json")] == ["a", "b"]
    assert readers.existing(spark, [str(tmp_path / "a"), str(tmp_path / "z")]) == [str(tmp_path / "a")]
    listing = spark.createDataFrame([("/x/COCO_val2014_000000000007.jpg",), ("/x/000000000007.jpg",), ("/x/000000000009.jpg",)], "path string")
    got = readers.probe_images(spark.createDataFrame([(7,), (9,), (11,)], "image_id long"), listing, ["COCO_val2014_{}.jpg", "{}.jpg"])
    assert {tuple(r) for r in got.collect()} == {(7, "/x/COCO_val2014_000000000007.jpg"), (9, "/x/000000000009.jpg")}


def test_archives_and_arrow(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "i.zip", "w") as z:
        z.writestr("val/000000000042.jpg", b"x")
        z.writestr("readme.txt", b"x")
    assert [(r["image_id"], r["member"]) for r in readers.zip_index(spark, str(tmp_path)).collect()] == [(42, "val/000000000042.jpg")]
    t = pa.table({"i": [1, 2], "s": ["a", None]})
    for name, kind in (("data-0.arrow", pa.ipc.new_stream), ("data-1.arrow", pa.ipc.new_file)):
        buffer = io.BytesIO()
        with kind(buffer, t.schema) as w:
            w.write_table(t)
        (tmp_path / name).write_bytes(buffer.getvalue())
    assert sorted(map(tuple, readers.read_arrow_directory(spark, str(tmp_path), "i long, s string").collect()), key=str) == [(1, "a"), (1, "a"), (2, None), (2, None)]


def test_prediction_array(spark, tmp_path):
    for n, d in (("full", spark.range(300).repartition(7).select(F.col("id").alias("image_id"), F.concat(F.lit("c"), "id").alias("caption"))), ("none", spark.createDataFrame([], "image_id long, caption string"))):
        writers.write_prediction_array(d, str(tmp_path / n))
        text = "".join(open(tmp_path / n / f).read() for f in sorted(os.listdir(tmp_path / n)) if f.startswith("part"))
        assert json.loads(text) == ([{"image_id": i, "caption": f"c{i}"} for i in range(300)] if n == "full" else [])


def test_stages(spark, tmp_path):
    stages = [("one", str(tmp_path / "1"), lambda s: s.range(3)), ("two", str(tmp_path / "2"), lambda s: s.read.parquet(str(tmp_path / "1")).where("id > 0"))]
    assert run_stages(spark, stages) == ["one", "two"] and run_stages(spark, stages) == []
    os.remove(tmp_path / "2" / "_SUCCESS")
    assert run_stages(spark, stages) == ["two"] and spark.read.parquet(str(tmp_path / "2")).count() == 2


def test_tools_and_images(spark):
    rows = [(1, '[{"role":"system","content":"x","functions":"[f]"},{"role":"user","content":"q"}]'), (2, '[{"role":"user","content":"q"}]'), (3, None)]
    got = {r["i"]: r["f"] for r in spark.createDataFrame(rows, "i int, c string").select("i", C.lifted_functions(C.turns(F.col("c"))).alias("f")).collect()}
    assert got == {1: "[f]", 2: None, 3: None}
    d = spark.createDataFrame([(b"a", [b"b", b"c"]), (None, [])], "one binary, many array<binary>")
    r = d.select(C.as_list(F.col("one"), False), C.as_list(F.col("many"), True), C.first_image(F.col("one"), False), C.first_image(F.col("many"), True)).collect()
    assert [bytes(x) for x in r[0][0]] == [b"a"] and len(r[0][1]) == 2 and bytes(r[0][3]) == b"b" and r[1][0] is None and r[1][3] is None


def test_command_line(spark, tmp_path):
    spark.createDataFrame([(1, "yes it is"), (2, "dog")], "pair_id long, chosen string").coalesce(1).write.parquet(str(tmp_path / "preference_pairs.parquet"))
    q = cli.registry()["class_totals"](spark, str(tmp_path)).first()
    assert tuple(q) == (1, 0, 1) and "near_dup_profile" in cli.registry()
