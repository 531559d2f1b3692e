"""Run files: a JSON array of log records, each with its chain of nested contexts.

Contexts nest to any depth, which no fixed Spark schema describes, so a small Python
helper flattens records into rows that carry the chain as an array; both relations are
then plain DataFrame operations on these rows.

Run files are written with an indentation of two.  A line break can't lie in a JSON text,
so a line of that indentation with nothing but an opening brace is where a record begins, and
Spark's text reader splits files there, large ones into many tasks, each of which
holds a record at a time.  Files in another layout are still read, each as one piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "projid string, tstamp string, filename string, name string, value string, type int, chain array<struct<ctx_id: bigint, p_ctx_id: bigint, name: string, iteration: bigint, value: string>>"
_STEP = pa.struct([("ctx_id", pa.int64()), ("p_ctx_id", pa.int64()), ("name", pa.string()), ("iteration", pa.int64()), ("value", pa.string())])
_SCHEMA = pa.schema([("projid", pa.string()), ("tstamp", pa.string()), ("filename", pa.string()), ("name", pa.string()), ("value", pa.string()), ("type", pa.int32()), ("chain", pa.list_(_STEP))])


def record_row(record: dict) -> tuple:
    """One record as a row; values are rendered as Python text, contexts innermost first."""
    chain, ctx = [], record.get("ctx")
    while ctx is not None:
        above = ctx.get("p_ctx")
        number, value = ctx.get("iteration"), ctx.get("value")
        chain.append({"ctx_id": int(ctx["ctx_id"]), "p_ctx_id": None if above is None else int(above["ctx_id"]), "name": str(ctx["name"]), "iteration": None if number is None else int(number), "value": None if value is None else str(value)})
        ctx = above
    return record["projid"], record["tstamp"], record["filename"], record["name"], str(record["value"]), record["type"], chain


#: Where a record begins in a file written with an indentation of two.
SEPARATOR, _END = "\n  {\n", "\n  }"


def piece_records(piece: str) -> list[dict]:
    """The records of a piece: what stands before the first one, one record's lines, or a whole file in another layout."""
    text = piece.strip()
    if text in ("", "["):
        return []
    if text.startswith("["):
        return json.loads(text)
    body, ended, _ = piece.rpartition(_END)
    if not ended:
        raise ValueError(f"a record that breaks off: {piece[-80:]!r}")
    return [json.loads("{" + body + "}")]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("value").to_pylist():
            rows = [record_row(r) for r in piece_records(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def records_of(texts: DataFrame) -> DataFrame:
    """Records of the pieces of run files, or of whole ones, in ``value``."""
    return texts.select("value").mapInArrow(_parse, RECORDS)


def read_run_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return records_of(spark.read.option("lineSep", SEPARATOR).text(paths))


def logs_of(records: DataFrame) -> DataFrame:
    return records.select(
        "projid", F.col("tstamp").cast("timestamp_ntz").alias("tstamp"), "filename", F.get("chain", F.lit(0))["ctx_id"].alias("ctx_id"), F.col("name").alias("value_name"), "value", F.col("type").alias("value_type")
    )


def loops_of(records: DataFrame) -> DataFrame:
    """Every context once, although each record repeats its whole chain."""
    steps = records.select(F.explode("chain").alias("s"))
    return steps.select("s.ctx_id", "s.p_ctx_id", F.col("s.name").alias("l_name"), "s.iteration", F.col("s.value").alias("l_value")).dropDuplicates(["ctx_id"])


def paths_of(records: DataFrame) -> DataFrame:
    """(ctx_id, depth, path) of every context: what its record's chain holds from it outwards, turned round."""
    at = records.select("chain", F.posexplode("chain").alias("pos", "own"))
    outwards = F.slice("chain", F.col("pos") + 1, F.size("chain"))
    steps = F.transform(F.reverse(outwards), lambda s: F.struct(s["name"].alias("name"), s["iteration"].alias("iteration"), s["value"].alias("value")))
    return at.select("own.ctx_id", F.size(outwards).alias("depth"), steps.alias("path")).dropDuplicates(["ctx_id"])


def write_run_file(records: list[dict], path: str) -> None:
    """One run's records as its run file, on the machine that ran it."""
    with open(path, "w") as out:
        json.dump(records, out, indent=2)
