"""Whole-column type inference for text columns: number, then date, else text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = r"^\s*$"
_INTEGER = r"^\s*[+-]?\d{1,18}\s*$"
_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|Inf|INF|infinity|Infinity)\s*$"
_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"


def _blank(c: Column) -> Column:
    return c.isNull() | c.rlike(_BLANK)


def _number(c: Column) -> Column:
    """The text as DOUBLE, null where it isn't a plain number in range."""
    value = F.regexp_replace(F.trim(c), "(?i)^([+-]?)inf(inity)?$", "$1Infinity").try_cast("double")
    wide = (F.abs(value) == float("inf")) & ~c.rlike("(?i)inf")
    return F.when(c.rlike(_NUMBER) & ~wide, value)


def inferred_types(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """bigint, double, timestamp_ntz or string for each text column, by one aggregate.

    Null and blank text does not stand against a number; a column with neither
    numbers nor dates stays text.  Dates are ISO dates with or without a time.
    """
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    if not text:
        return {}
    checks = []
    for k, name in enumerate(text):
        c = F.col(f"`{name}`")
        checks += [
            F.bool_and(_blank(c) | _number(c).isNotNull()).alias(f"n{k}"),
            F.bool_and(F.coalesce(c.rlike(_INTEGER), F.lit(False))).alias(f"i{k}"),
            F.bool_and(c.isNull() | (c.rlike(_DATE) & c.try_cast("timestamp_ntz").isNotNull())).alias(f"d{k}"),
            F.count(c).alias(f"c{k}"),
        ]
    row = df.agg(*checks).first()
    out = {}
    for k, name in enumerate(text):
        if not row[f"c{k}"]:
            out[name] = "string"
        elif row[f"i{k}"]:
            out[name] = "bigint"
        elif row[f"n{k}"]:
            out[name] = "double"
        else:
            out[name] = "timestamp_ntz" if row[f"d{k}"] else "string"
    return out


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The frame with each text column cast to its inferred type."""
    cast = {}
    for name, kind in inferred_types(df, columns).items():
        c = F.col(f"`{name}`")
        if kind == "double":
            cast[name] = _number(c)
        elif kind != "string":
            cast[name] = F.trim(c).try_cast(kind)
    return df.select(*(cast[c].alias(c) if c in cast else F.col(f"`{c}`") for c in df.columns))
