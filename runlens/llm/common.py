"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise, shared_dir

__all__ = ["ascii_lower", "input_bytes", "materialise", "rank", "row_key", "shared_dir", "table"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Space and the five control characters from tab to carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UNKNOWN_BYTES = 1 << 45
#: Rows without a doc_id count as one last document where documents are ranked by id.
LAST_ID = (1 << 63) - 1


def input_bytes(df: DataFrame, text: str = "text") -> int:
    """Size of the scanned files as the optimizer knows it; no job runs.

    Where it doesn't know (frames that don't come from files), the texts are measured.
    Used only to pick numbers of partitions, never to decide what is computed.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < UNKNOWN_BYTES:
        return size
    return (df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 2


def rank(doc_id: str = "doc_id") -> Column:
    """The id by which a row's document is ranked; never null."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("rank")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  Pure-ASCII values take the quick built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_LOWER))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Identity of a row: its id and a hash of its text.

    Repeated rows share a key and get the same result; rows that repeat an id
    with another text stay separate documents.
    """
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key")]
