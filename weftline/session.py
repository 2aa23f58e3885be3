"""Session defaults and the two physical helpers every operator shares: cutting lineage and spreading small scans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the engine's defaults; on a cluster the caller's own session is used instead."""
    b = SparkSession.builder.master(master).appName("weftline").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**DEFAULTS, "spark.driver.memory": "8g", **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's own, else `spark.checkpoint.dir`, else, for a local master only, a local one."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf = sc.getConf().get("spark.checkpoint.dir")
    if not conf and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="weftline-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and drop its lineage. Survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that has fewer partitions than the cluster has cores, ahead of CPU-heavy Arrow work.

    Inputs of many splits, the case at scale, pass through without a shuffle. Only a scan is asked for its partitions, as a plan
    with a shuffle would run to tell; such a plan passes through too.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if any(x in plan for x in ("Exchange", "Aggregate", "Join", "Sort", "Window")):
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def skew_join(rows: DataFrame, groups: DataFrame, key: str, size_col: str, hot: int = 256, how: str = "inner") -> DataFrame:
    """Join many `rows` to one `groups` row per key when single keys may hold a third of all rows.

    The `hot` largest groups, a fixed number whatever the input, are broadcast; every other key then holds at most
    1/hot of the rows and takes an ordinary shuffle join. Exact: each row meets its group on one of the two ways.
    """
    top = cut(groups.orderBy(F.desc(size_col), F.asc(key)).limit(hot))
    near = rows.join(F.broadcast(top), key, "inner")
    rest = rows.join(F.broadcast(top.select(key)), key, "left_anti")
    far = rest.join(groups.join(F.broadcast(top.select(key)), key, "left_anti"), key, how)
    return near.unionByName(far)
