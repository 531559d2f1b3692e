"""Read-only SQL over the two relations, with optional type inference of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import compat
from ..functions.inference import infer_types
from ..scratch import materialise
from .dialect import respell
from .readonly import check_read_only

def register_views(logs: DataFrame, loops: DataFrame) -> None:
    logs.createOrReplaceTempView("logs")
    loops.createOrReplaceTempView("loops")


def query(logs: DataFrame, loops: DataFrame, sql: str, typed: bool = True, lenient: bool = True) -> DataFrame:
    """Result of a query over the views ``logs`` and ``loops``; no rows give an empty frame.

    The statement is in the dialect that ``dialect`` respells, or, if not ``lenient``, Spark
    SQL as it is; both may use ``compat.SQL_FUNCTIONS``.  With ``typed`` the result is
    written once, and one more aggregate over it decides the type of every text column.
    """
    spark = logs.sparkSession
    register_views(logs, loops)
    compat.register(spark)
    statement = respell(spark, sql) if lenient else sql
    check_read_only(statement, spark)
    out = spark.sql(statement)
    return infer_types(materialise(out, "query")) if typed else out
