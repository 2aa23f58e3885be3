"""Readers: nested JSON documents into flat tables, JSON lines, TSV, logs, file listings, configurations."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import image_id_of


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path on any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist, on whatever store; for unions of optional inputs."""
    return [p for p in paths if exists(spark, p)]


def result_directories(spark: SparkSession, root: str, name: str) -> list[str]:
    """Folders below `root` that hold a file `name`, sorted."""
    fs, p = _hadoop(spark, f"{root.rstrip('/')}/*/{name}")
    return sorted(x.getPath().getParent().toString() for x in fs.globStatus(p) or [])


def read_arrow_directory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A data set saved as Arrow files (streams or files) in a folder, read file by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                data = pa.py_buffer(content.as_py())
                opened = pa.ipc.open_file(data) if data.to_pybytes()[:6] == b"ARROW1" else pa.ipc.open_stream(data)
                yield from opened.read_all().to_batches()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.arrow").load(path)
    return files.select("content").mapInArrow(run, schema)


def zip_index(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, archive, member) of the images inside zip archives, by the twelve digits of their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1)):
                names = zipfile.ZipFile(io.BytesIO(content.as_py())).namelist()
                yield pa.RecordBatch.from_pydict({"archive": [archive] * len(names), "member": names}, pa.schema([("archive", pa.string()), ("member", pa.string())]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInArrow(run, "archive string, member string")
    found = files.where(F.col("member").rlike(r"\d{12}\.jpg$")).withColumn("image_id", image_id_of(F.col("member")))
    return found.groupBy("image_id").agg(F.min(F.struct("archive", "member")).alias("f")).select("image_id", "f.*")


def probe_images(ids: DataFrame, listing: DataFrame, patterns: list[str]) -> DataFrame:
    """(image_id, path): for each id the file of `listing` (path) named by the first pattern that fits, such as
    `COCO_val2014_{}.jpg` or `{}.jpg`, the braces standing for twelve digits. Ids without a file have no row."""
    names = F.array(*[F.concat(F.lit(p.split("{}")[0]), F.lpad(F.col("image_id").cast("string"), 12, "0"), F.lit(p.split("{}")[1])) for p in patterns])
    wanted = ids.select("image_id").distinct().select("image_id", F.posexplode(names).alias("order", "name"))
    files = listing.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    return wanted.join(files, "name").groupBy("image_id").agg(F.min(F.struct("order", "path")).alias("f")).select("image_id", "f.path")


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_captions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of a caption document."""
    d = _document(spark, path, "images array<struct<id:long,file_name:string>>, annotations array<struct<image_id:long,caption:string>>")
    return d.select(F.inline("images")), d.select(F.posexplode("annotations").alias("ordinal", "a")).select("ordinal", "a.*")


def read_instances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(categories, annotations) of an instance document."""
    d = _document(spark, path, "categories array<struct<id:long,name:string>>, annotations array<struct<image_id:long,category_id:long,bbox:array<double>>>")
    return d.select(F.inline("categories")), d.select(F.posexplode("annotations").alias("ordinal", "a")).select("ordinal", "a.*")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    d = _document(spark, path, "questions array<struct<question_id:long,image_id:long,question:string>>")
    return d.select(F.posexplode("questions").alias("ordinal", "q")).select("ordinal", "q.*")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations; answers may be structs or plain strings."""
    d = _document(spark, path, "annotations array<struct<question_id:long,answer_type:string,answers:array<string>>>")
    a = d.select(F.posexplode("annotations").alias("ordinal", "a")).select("ordinal", "a.*")
    return a.withColumn("answers", F.transform("answers", lambda x: F.coalesce(F.get_json_object(x, "$.answer"), x)))


def read_text_vqa(spark: SparkSession, path: str) -> DataFrame:
    """Questions about text in images; rows whose image name holds no id or that have no answers are dropped."""
    d = _document(spark, path, "data array<struct<question_id:long,image:string,question:string,answers:array<string>>>").select(F.inline("data"))
    return d.withColumn("image_id", image_id_of(F.col("image"))).where("image_id IS NOT NULL AND size(answers) > 0")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Lines that begin with a brace; others (blank ones, log text) are skipped."""
    return spark.read.text(path).where(F.trim("value").startswith("{")).select(F.from_json("value", schema).alias("r")).select("r.*")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """image_id to caption of a JSON array; the last of several wins."""
    d = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<image_id:long,caption:string>>")).alias("i", "r"))
    return d.groupBy("r.image_id").agg(F.max_by("r.caption", "i").alias("caption"))


def read_choices(spark: SparkSession, path: str) -> DataFrame:
    """Multiple-choice questions as tab-separated text with a header; answers are trimmed and upper-cased, empty options NULL."""
    d = spark.read.csv(path, sep="\t", header=True, quote="")
    for c in ("A", "B", "C", "D"):
        if c in d.columns:
            d = d.withColumn(c, F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("nan")))
    return d.withColumn("answer", F.upper(F.trim("answer")))


def read_flexible_captions(spark: SparkSession, path: str) -> DataFrame:
    """(image, references) of an annotation file: a list, or the first list under annotations, data or images; captions under
    caption, captions, sentence or sentences, as text, list of text or list of objects."""
    raw = spark.read.text(path, wholetext=True)
    lists = [F.from_json("value", "array<string>")] + [F.from_json(F.get_json_object("value", f"$.{k}"), "array<string>") for k in ("annotations", "data", "images")]
    whole = F.when(F.trim("value").startswith("["), lists[0]).otherwise(F.coalesce(*lists[1:]))
    r = raw.select(F.posexplode(whole).alias("ordinal", "r"))
    caption = F.coalesce(*[F.get_json_object("r", f"$.{k}") for k in ("caption", "captions", "sentence", "sentences")])
    refs = F.when(caption.startswith("["), F.transform(F.from_json(caption, "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.caption"), x))).otherwise(F.array(caption))
    image = F.coalesce(*[F.get_json_object("r", f"$.{k}") for k in ("image", "image_id", "file_name", "filename")])
    return r.select("ordinal", image.alias("image"), F.filter(refs, lambda x: x.isNotNull() & (F.trim(x) != "")).alias("references"))


def last_match(spark: SparkSession, path: str, pattern: str) -> str:
    """The last match of a pattern in a log; an error if there is none."""
    row = spark.read.text(path, wholetext=True).select(F.regexp_extract_all("value", F.lit(pattern), F.lit(0)).alias("m")).first()
    if row is None or not row["m"]:
        raise ValueError(f"no match of {pattern!r} in {path}")
    return row["m"][-1]


def read_config(spark: SparkSession, path: str) -> dict:
    row = spark.read.json(path, multiLine=True).first()
    return row.asDict(recursive=True) if row else {}


def tolerant_json(spark: SparkSession, path: str) -> dict:
    """A JSON object, empty on any failure."""
    try:
        row = spark.read.option("mode", "FAILFAST").json(path, multiLine=True).first()
        return row.asDict(recursive=True) if row else {}
    except Exception:  # noqa: BLE001
        return {}


def image_index(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, path) of the images below a folder, by the twelve digits of their names; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,png}").load(path).select("path")
    return f.withColumn("image_id", image_id_of(F.element_at(F.split("path", "/"), -1))).where("image_id IS NOT NULL").groupBy("image_id").agg(F.min("path").alias("path"))
