"""Expressions with the lenient semantics that text-typed embedded databases give.

Spark's own functions differ in the cases below; everything else is spelled alike.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import json_text


def cast_integer(c: Column) -> Column:
    """Leading integer of a text, the nearest one of 64 bits; 0 without one, null for null."""
    digits = F.regexp_extract(F.trim(c), r"^[+-]?\d+", 0)
    nearest = F.when(digits.startswith("-"), -(1 << 63)).when(digits != "", (1 << 63) - 1).otherwise(0)
    return F.when(c.isNotNull(), F.coalesce(digits.try_cast("bigint"), nearest))


def cast_real(c: Column) -> Column:
    return F.when(c.isNotNull(), F.coalesce(F.regexp_extract(F.trim(c), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0).try_cast("double"), F.lit(0.0)))


def divide_integers(a: Column, b: Column) -> Column:
    """Truncating division in 64 bits; by zero it is null."""
    return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0).cast("bigint")))


def greatest(*cs: Column) -> Column:
    """Null if any argument is."""
    return F.when(~reduce(or_, (c.isNull() for c in cs)), F.greatest(*cs))


def total(c: Column) -> Column:
    """Sum as DOUBLE; 0.0 over no rows, text that is no number counts as 0."""
    return F.coalesce(F.sum(F.coalesce(c.try_cast("double"), F.lit(0.0))), F.lit(0.0))


def trunc(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))


def glob_pattern(pattern: str) -> str:
    """A GLOB pattern (``*``, ``?`` and ``[...]``) as a regular expression for whole texts."""
    out = ""
    for piece in re.findall(r"\[\^?\]?[^\]]*\]|.", pattern, re.S):
        if len(piece) > 1:
            out += "[" + re.sub(r"([\\\[\]&])", r"\\\1", piece[1:-1]) + "]"
        else:
            out += {"*": ".*", "?": "."}.get(piece, re.escape(piece))
    return "(?s)^" + out + r"\z"


def glob(c: Column, pattern: str) -> Column:
    """GLOB, case-sensitive."""
    return c.rlike(glob_pattern(pattern))


def quote(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")))


#: What each conversion of a time format stands for; ``s`` is the time's text.
CONVERSIONS = {
    "%Y": "substr({s}, 1, 4)", "%m": "substr({s}, 6, 2)", "%d": "substr({s}, 9, 2)", "%H": "substr({s}, 12, 2)", "%M": "substr({s}, 15, 2)", "%S": "substr({s}, 18, 2)",
    "%f": "concat(substr({s}, 18, 2), '.', rpad(substr({s}, 21, 3), 3, '0'))", "%F": "substr({s}, 1, 10)", "%T": "substr({s}, 12, 8)", "%R": "substr({s}, 12, 5)",
    "%j": "lpad(dayofyear(t), 3, '0')", "%w": "dayofweek(t) - 1", "%u": "weekday(t) + 1", "%W": "lpad((dayofyear(t) + 6 - weekday(t)) DIV 7, 2, '0')",
    "%s": "CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', t) AS STRING)", "%J": "CAST(julianday(t) AS STRING)",
}


def _strftime() -> str:
    """A format with its conversions replaced one after the other; ``%%`` is a percent sign."""
    out = "replace(f, '%%', chr(1))"
    for name, body in CONVERSIONS.items():
        out = f"replace({out}, '{name}', {body.format(s='CAST(t AS STRING)')})"
    return f"replace({out}, chr(1), '%')"


#: Names for SQL text, as temporary functions whose bodies Spark inlines: (signature, result, body).
#: ``plans.dialect`` respells statements with them; Spark SQL may use them as they are.
SQL_FUNCTIONS = [
    (
        "cast_integer(x STRING)",
        "BIGINT",
        r"if(x IS NULL, NULL, coalesce(try_cast(regexp_extract(trim(x), r'^[+-]?\d+', 0) AS BIGINT), "
        r"CASE WHEN trim(x) RLIKE r'^-\d' THEN -9223372036854775807L - 1L WHEN trim(x) RLIKE r'^[+]?\d' THEN 9223372036854775807L ELSE 0L END))",
    ),
    ("cast_real(x STRING)", "DOUBLE", r"if(x IS NULL, NULL, coalesce(try_cast(regexp_extract(trim(x), r'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?', 0) AS DOUBLE), 0.0D))"),
    ("int_div(a BIGINT, b BIGINT)", "BIGINT", "if(b = 0, NULL, a DIV b)"),
    (
        "divide_text(a STRING, b STRING)",
        "DOUBLE",
        r"if(trim(a) RLIKE r'^[+-]?\d+$' AND trim(b) RLIKE r'^[+-]?\d+$', CAST(int_div(cast_integer(a), cast_integer(b)) AS DOUBLE), cast_real(a) / nullif(cast_real(b), 0.0D))",
    ),
    (
        "glob_pattern(p STRING)",
        "STRING",
        r"concat('(?s)^', array_join(transform(regexp_extract_all(p, r'(\[\^?\]?[^\]]*\]|(?s:.))', 1), c -> CASE WHEN length(c) > 1 THEN concat('[', regexp_replace(substr(c, 2, length(c) - 2), r'([\\\[\]&])', r'\\$1'), ']') "
        r"WHEN c = '*' THEN '.*' WHEN c = '?' THEN '.' WHEN c RLIKE r'^\w$' THEN c ELSE concat(r'\x{', hex(ascii(c)), '}') END), ''), r'\z')",
    ),
    ("glob(p STRING, x STRING)", "BOOLEAN", "x RLIKE glob_pattern(p)"),
    ("sql_quote(x STRING)", "STRING", """if(x IS NULL, 'NULL', concat("'", replace(x, "'", "''"), "'"))"""),
    ("json_extract(j STRING, p STRING)", "STRING", "get_json_object(j, p)"),
    ("json_valid(j STRING)", "INT", "if(j IS NULL, NULL, if(try_parse_json(j) IS NULL, 0, 1))"),
    (
        "json_type(j STRING)",
        "STRING",
        "CASE WHEN try_parse_json(j) IS NULL THEN NULL WHEN schema_of_variant(try_parse_json(j)) LIKE 'OBJECT%' THEN 'object' WHEN schema_of_variant(try_parse_json(j)) LIKE 'ARRAY%' THEN 'array' "
        "WHEN schema_of_variant(try_parse_json(j)) = 'STRING' THEN 'text' WHEN schema_of_variant(try_parse_json(j)) = 'BOOLEAN' THEN trim(j) WHEN schema_of_variant(try_parse_json(j)) = 'BIGINT' THEN 'integer' "
        "WHEN schema_of_variant(try_parse_json(j)) = 'VOID' THEN 'null' ELSE 'real' END",
    ),
    (
        "moment(x STRING)",
        "TIMESTAMP_NTZ",
        r"if(trim(x) RLIKE r'^[+-]?\d+(\.\d*)?$', timestampadd(MICROSECOND, CAST(round((CAST(trim(x) AS DOUBLE) - 2440587.5D) * 86400000) * 1000 AS BIGINT), TIMESTAMP_NTZ'1970-01-01 00:00:00'), try_cast(x AS TIMESTAMP_NTZ))",
    ),
    ("moment_of_seconds(x DOUBLE)", "TIMESTAMP_NTZ", "timestampadd(MICROSECOND, CAST(round(x * 1000000) AS BIGINT), TIMESTAMP_NTZ'1970-01-01 00:00:00')"),
    ("shift_months(t TIMESTAMP_NTZ, n INT)", "TIMESTAMP_NTZ", "timestampadd(DAY, day(t) - 1, timestampadd(MONTH, n, timestampadd(DAY, 1 - day(t), t)))"),
    (
        "start_of(unit STRING, t TIMESTAMP_NTZ)",
        "TIMESTAMP_NTZ",
        "make_timestamp_ntz(year(t), if(unit = 'year', 1, month(t)), if(unit = 'day', day(t), 1), 0, 0, 0)",
    ),
    ("next_weekday(t TIMESTAMP_NTZ, n INT)", "TIMESTAMP_NTZ", "timestampadd(DAY, pmod(n + 1 - dayofweek(t), 7), t)"),
    ("unixepoch(t TIMESTAMP_NTZ)", "BIGINT", "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', t)"),
    ("julianday(t TIMESTAMP_NTZ)", "DOUBLE", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', t) / 86400000000.0D + 2440587.5D"),
    ("strftime(f STRING, t TIMESTAMP_NTZ)", "STRING", _strftime()),
]


def register(spark: SparkSession) -> None:
    """Makes ``SQL_FUNCTIONS`` known to the session, once."""
    if spark.catalog.functionExists(SQL_FUNCTIONS[-1][0].partition("(")[0]) and spark.catalog.functionExists("cast_real"):
        return
    for signature, result, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")
    json_text.register(spark)
