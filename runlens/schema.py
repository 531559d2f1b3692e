"""The two relations of the engine, and what names its columns and codes have."""

from __future__ import annotations

from pyspark.sql import types as T

USER, TIMING = 1, 3
RUN_KEYS = ["projid", "tstamp", "filename"]
PREFIX, SUFFIX, LOOP, ITERATION = "delta::prefix", "delta::suffix", "delta::loop", "delta::iteration"

LOGS = T.StructType(
    [
        T.StructField("projid", T.StringType()),
        T.StructField("tstamp", T.TimestampNTZType()),
        T.StructField("filename", T.StringType()),
        T.StructField("ctx_id", T.LongType()),
        T.StructField("value_name", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("value_type", T.IntegerType()),
    ]
)
LOOPS = T.StructType(
    [
        T.StructField("ctx_id", T.LongType()),
        T.StructField("p_ctx_id", T.LongType()),
        T.StructField("l_name", T.StringType()),
        T.StructField("iteration", T.LongType()),
        T.StructField("l_value", T.StringType()),
    ]
)
STEP = T.StructType([T.StructField("name", T.StringType()), T.StructField("iteration", T.LongType()), T.StructField("value", T.StringType())])
#: A context resolved to its chain of loop steps, outermost first.
PATHS = T.StructType([T.StructField("ctx_id", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("path", T.ArrayType(STEP))])
