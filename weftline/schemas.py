"""Explicit schemas of the logical tables."""

from pyspark.sql import types as T

#: A conversation turn; `tools` and `functions` stay raw JSON text, as only their presence matters.
TURN = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("tools", T.StringType()),
    T.StructField("functions", T.StringType()),
])
TURNS = T.ArrayType(TURN)
STEP_LOG = T.StructType([
    T.StructField("epoch", T.IntegerType()),
    T.StructField("epoch_step", T.LongType()),
    T.StructField("global_step", T.LongType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("reward_mean", T.DoubleType()),
    T.StructField("reward_std", T.DoubleType()),
    T.StructField("kl", T.DoubleType()),
    T.StructField("beta", T.DoubleType()),
    T.StructField("clip_fraction", T.DoubleType()),
    T.StructField("reward_components", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("completion_tokens", T.DoubleType()),
    T.StructField("elapsed_seconds", T.DoubleType()),
    T.StructField("row_index", T.LongType()),
])
