"""Joins that aren't by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, low: Column, high: Column, point: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows of which the right one's point lies in the left one's interval, ends included.

    Nested loops would compare all pairs.  Here an interval is put into bins of the least power
    of two that is no shorter than it, so into two at most, and a point into one bin for
    each such length that occurs (under 64, which one aggregate finds); bins and lengths
    are an equi-join's keys, and the comparison itself its residual condition.  Rows whose
    bounds or point are null, and intervals that end before they begin, match nothing.
    Bounds and points are whole numbers, such as microseconds; ``keys`` are columns of both sides that
    have to be equal, and come once in the result.
    """
    length = F.greatest(high - low, F.lit(1))
    # bits of the length less one: the least power of two that isn't below it
    level = F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1))).cast("int")
    intervals = left.where(low <= high).withColumns({"_low": low, "_high": high, "_level": level})
    bins = F.array_distinct(F.array(*(F.call_function("shiftright", F.col(c), F.col("_level")) for c in ("_low", "_high"))))
    intervals = intervals.withColumn("_bin", F.explode(bins))
    levels = sorted(r[0] for r in left.where(low <= high).select(level.alias("_level")).distinct().collect())
    points = right.withColumn("_point", point).where(F.col("_point").isNotNull()).withColumn("_at_level", F.explode(F.array(*(F.lit(v) for v in levels)).cast("array<int>")))
    points = points.withColumn("_at_bin", F.call_function("shiftright", F.col("_point"), F.col("_at_level"))).withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = (F.col("_level") == F.col("_at_level")) & (F.col("_bin") == F.col("_at_bin")) & F.col("_point").between(F.col("_low"), F.col("_high"))
    for k in keys:
        same &= F.col(k) == F.col(f"_right_{k}")
    return intervals.join(points, same).drop("_low", "_high", "_level", "_bin", "_point", "_at_level", "_at_bin", *(f"_right_{k}" for k in keys))
