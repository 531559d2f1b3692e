"""Picking runs: the latest, the best, those that lack a value, first and last parts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, column: str = "tstamp") -> DataFrame:
    """Rows with the greatest time stamp; ties stay.  The one-row maximum is broadcast."""
    newest = df.agg(F.max(column).alias("_newest"))
    return df.join(F.broadcast(newest), F.col(column) == F.col("_newest"), "left_semi")


def missing_any(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows without a value for at least one name; names the frame lacks are added as nulls."""
    full = with_missing(df, names)
    return full.where(reduce(or_, (F.col(f"`{n}`").isNull() for n in names), F.lit(False)))


def with_missing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("*", *(F.lit(None).cast("string").alias(n) for n in names if n not in df.columns))


def best(df: DataFrame, measure: str, k: int = 1, smallest: bool = False, ties: list[str] | None = None) -> DataFrame:
    """The k rows of greatest (or smallest) numeric measure; text that is no number is left out."""
    number = F.col(f"`{measure}`").cast("string").try_cast("double")
    order = [F.asc("_n") if smallest else F.desc("_n"), *(F.col(f"`{c}`") for c in (ties or []))]
    return df.withColumn("_n", number).where(F.col("_n").isNotNull()).orderBy(*order).limit(k).drop("_n")


def first_and_last(df: DataFrame, keys: list[str], order: list[str], count: int = 10) -> DataFrame:
    """Of each group: the first rows of its first half and the last rows of its second."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    half = F.floor(F.col("_n") / 2)
    first = (F.col("_at") < half) & (F.col("_at") < count)
    last = (F.col("_at") >= half) & (F.col("_at") >= F.col("_n") - count)
    return numbered.where(first | last).withColumn("part", F.when(first, "first").otherwise("last")).drop("_at", "_n")


def pick_iterations(df: DataFrame, keys: list[str], order: list[str], picks: list[str] | None = None) -> DataFrame:
    """Rows of each group at the given 0-based places; without picks, the last row only.

    Picks that aren't digits are ignored.  The last row comes from an aggregate with
    map-side combination, not from a window.
    """
    if picks is None:
        columns = df.columns
        last = df.groupBy(*keys).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in columns)), F.struct(*order)).alias("_last"))
        return last.select(*(F.col(f"_last.`{c}`").alias(c) for c in columns))
    places = [int(p) for p in picks if str(p).isdigit()]
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_at", at).where(F.col("_at").isin(places)).drop("_at")


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the smallest."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best_n = counts.groupBy(*keys).agg(F.max("_n").alias("_top"))
    held = counts.join(best_n, keys).where(F.col("_n") == F.col("_top"))
    return held.groupBy(*keys).agg(F.min(value).alias(value), F.max("_top").alias("votes"))


def non_decreasing(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Whether the value never falls along the order, per group."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    steps = df.withColumn("_before", before)
    return steps.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("_before") <= F.col(value), F.lit(True))).alias("monotonic"))
