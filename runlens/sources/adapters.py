"""The synthetic tables as logs and loops.

Amounts are rendered as DECIMAL(18,2) text, so that every engine prints them alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import TIMING, USER


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _logs(df: DataFrame, keys: tuple, ctx: Column | None, values: dict[str, Column], kind: int = USER, packed: bool = False) -> DataFrame:
    """One row per input row and value: a single pass that explodes an array of pairs; or one per input row with that array as ``held``."""
    pairs = F.array(*(F.struct(F.lit(n).alias("value_name"), v.cast("string").alias("value")) for n, v in values.items()))
    projid, tstamp, filename = keys
    picked = df.select(
        projid.alias("projid"), tstamp.cast("timestamp_ntz").alias("tstamp"), filename.alias("filename"), (F.lit(None).cast("bigint") if ctx is None else ctx.cast("bigint")).alias("ctx_id"), (pairs if packed else F.explode(pairs)).alias("held")
    )
    own = ["held"] if packed else ["held.value_name", "held.value"]
    return picked.select("projid", "tstamp", "filename", "ctx_id", *own, F.lit(kind).alias("value_type"))


def _loops(df: DataFrame, ctx: Column, parent: Column | None, name: str, number: Column, value: Column | None) -> DataFrame:
    """One row per input row: readers of large tables' loops keep one a context themselves, in one shuffle."""
    return df.select(
        ctx.cast("bigint").alias("ctx_id"),
        (F.lit(None) if parent is None else parent).cast("bigint").alias("p_ctx_id"),
        F.lit(name).alias("l_name"),
        number.cast("bigint").alias("iteration"),
        (F.lit(None) if value is None else value).cast("string").alias("l_value"),
    )


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def orders(spark: SparkSession, sf_dir: str, names: tuple[str, ...] | None = None, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Orders as rounds of a loop, lines as rounds of a loop nested in it; a run is a day and priority.

    A reader of some ``names`` alone says so: a filter on the exploded names doesn't reach the join and the scans below.
    With ``packed``, the values of an order or line stay one row, as the pivot takes them.
    """
    o, l = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    keys = (F.lit("tpch"), F.col("o_orderdate"), F.col("o_orderpriority"))
    order_ctx, line_ctx = F.col("o_orderkey") * 8, F.col("l_orderkey") * 8 + F.col("l_linenumber")
    lines = l.join(o.select("o_orderkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    logged = [
        (o, order_ctx, {"totalprice": money(F.col("o_totalprice")), "shared": money(F.col("o_totalprice"))}),
        (lines, line_ctx, {"quantity": money(F.col("l_quantity")), "extendedprice": money(F.col("l_extendedprice")), "tax": money(F.col("l_tax")), "shared": money(F.col("l_tax"))}),
    ]
    if names is not None:
        logged = [(df, ctx, own) for df, ctx, values in logged if (own := {n: v for n, v in values.items() if n in names})] or [(o.where(F.lit(False)), *logged[0][1:])]
    logs = union(*(_logs(df, keys, ctx, values, packed=packed) for df, ctx, values in logged))
    loops = union(_loops(o, order_ctx, None, "order", F.col("o_orderkey"), None), _loops(l, line_ctx, F.col("l_orderkey") * 8, "line", F.col("l_linenumber"), None))
    return logs, loops


def events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events: top-level values of runs by day and event type, and a loop over users."""
    e = _read(spark, sf_dir, "events")
    keys = (F.lit("events"), F.date_trunc("day", F.col("ts")), F.col("event_type"))
    user = F.col("user_id") * 2 + 1
    logs = union(
        _logs(e, keys, None, {"value": money(F.col("value")), "props": F.col("props")}),
        _logs(e, keys, user, {"seen": F.col("event_id")}),
    )
    return logs, _loops(e, user, None, "user", F.col("user_id"), None).distinct()


def conversations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations and their turns as nested loops, each with number and value.

    A conversation takes as many ids as the longest one needs, so that none meets another's.
    """
    c = _read(spark, sf_dir, "conversations")
    keys = (F.lit("chat"), F.lit("2024-01-01 00:00:00"), F.lit("chat.py"))
    width = (c.agg(F.max("turn")).first()[0] or 0) + 2
    top, turn = F.col("conv_id") * width, F.col("conv_id") * width + F.col("turn") + 1
    logs = _logs(c, keys, turn, {"role": F.col("role"), "text": F.col("text")})
    return logs, union(_loops(c, top, None, "conversation", F.col("conv_id"), None), _loops(c, turn, top, "turn", F.col("turn"), F.concat(F.lit("t"), F.col("turn")))).distinct()


def documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents and their labels: names logged for some rounds only."""
    d, l = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    keys = (F.lit("docs"), F.lit("2024-01-01 00:00:00"), F.col("source"))
    labelled = l.join(d.select("doc_id", "source"), "doc_id")
    logs = union(
        _logs(d, keys, F.col("doc_id"), {"lang": F.col("lang"), "n_chars": F.col("n_chars")}),
        _logs(labelled, keys, F.col("doc_id"), {"quality": F.col("quality"), "toxic": F.col("toxic")}),
    )
    return logs, _loops(d, F.col("doc_id"), None, "document", F.col("doc_id"), None).distinct()


def trainings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as training runs with timings: orders are epochs, lines are steps of an epoch.

    The run's file is the market segment and its stamp the customer's number in seconds;
    every customer with an order logs a learning rate, timings and an epoch loop.
    """
    o, l, c = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "customer")
    stamp = F.timestamp_seconds(F.col("o_custkey")).cast("timestamp_ntz")
    full = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    keys = (F.lit("train"), stamp, F.col("c_mktsegment"))
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    ranked = full.select("o_custkey", "c_mktsegment", "o_orderkey", at.alias("at"))
    epoch, step = F.col("o_orderkey") * 8, F.col("o_orderkey") * 8 + F.col("l_linenumber")
    lines = l.join(ranked, F.col("l_orderkey") == F.col("o_orderkey"))
    runs = full.groupBy("o_custkey", "c_mktsegment").agg(F.max("c_acctbal").alias("bal"), F.count("*").alias("n"))
    logs = union(
        _logs(runs, keys, None, {"lr": money(F.col("bal"))}),
        _logs(runs, keys, None, {"delta::prefix": F.col("n") * F.lit(0.5), "delta::suffix": F.col("n") * F.lit(0.25), "delta::loop": F.col("n") * F.lit(100.0)}, TIMING),
        _logs(ranked, keys, epoch, {"delta::loop": F.col("o_orderkey") * F.lit(0.5)}, TIMING),
        _logs(lines, keys, step, {"loss": money(F.col("l_tax"))}),
    )
    return logs, union(_loops(ranked, epoch, None, "epoch", F.col("at"), None), _loops(lines, step, epoch, "step", F.col("l_linenumber"), None))

