"""New run files into the store as they arrive.

Replays write under their run's old time stamp, however late, so no watermark is set.
A run is recognised by its project, stamp and file name: a file that arrives twice adds nothing the second
time, also when a micro-batch is run again after a failure.  What a batch is compared
with are the store's runs, a small sorted table, and of those only the batch's projects
and stamps; logs are read for replays alone, and then of the replayed runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RUN_KEYS
from ..scratch import materialise
from ..sources import runfiles
from ..sources.tables import Overtaken, Snapshot, Store, near, unseen

#: A row of a record, by which a replay's rows are known.
_ROW = [*RUN_KEYS, "_ctx", "name", "value", "type"]


def fresh_records(records: DataFrame, base: Snapshot, replays: bool = False) -> DataFrame:
    """The records of runs that the store doesn't have; with ``replays``, those whose row it doesn't have."""
    if not replays:
        return unseen(records, near(base.runs(), records))
    own = records.withColumn("_ctx", F.get("chain", F.lit(0))["ctx_id"]).dropDuplicates(_ROW)
    runs = records.select(*(F.col(c).alias(f"r_{c}") for c in RUN_KEYS)).distinct()
    held = near(base.logs(), records).join(runs, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in RUN_KEYS], "left_semi")
    held = held.select(*(F.col(c).alias(f"h_{n}") for c, n in zip([*RUN_KEYS, "ctx_id", "value_name", "value", "value_type"], _ROW))).distinct()
    return own.join(held, [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in _ROW], "left_anti").drop("_ctx")


def ingest(store: Store, texts: DataFrame, replays: bool = False, tries: int = 5) -> None:
    """Appends the runs of run files, in pieces or whole, that the store doesn't have, in one commit.

    With ``replays``, known stamps are let in and rows the store has already are left out.
    Where another writer was first, what is new is worked out again.
    """
    records = materialise(runfiles.records_of(texts).withColumn("tstamp", F.col("tstamp").cast("timestamp_ntz")), "records")
    for left in reversed(range(tries)):
        base = store.snapshot()
        fresh = materialise(fresh_records(records, base, replays), "records")
        if fresh.isEmpty():
            return
        loops, paths = runfiles.loops_of(fresh), runfiles.paths_of(fresh)
        if replays:  # a replay logs into contexts that may be there
            low, high = loops.agg(F.min("ctx_id"), F.max("ctx_id")).first()
            if low is not None:
                held = base.loops().where(F.col("ctx_id").between(low, high)).select("ctx_id")
                loops, paths = loops.join(held, "ctx_id", "left_anti"), paths.join(held, "ctx_id", "left_anti")
        try:
            store.append(runfiles.logs_of(fresh), loops, paths, new_contexts=True, base=base)
            return
        except Overtaken:
            if not left:
                raise


def watch(spark: SparkSession, store: Store, folder: str, checkpoint: str, replays: bool = False, trigger: dict | None = None):
    """A streaming query over the folder's run files; ``trigger`` as for ``DataStreamWriter.trigger``."""
    texts = spark.readStream.format("text").option("lineSep", runfiles.SEPARATOR).load(folder)
    writer = texts.writeStream.foreachBatch(lambda batch, _: ingest(store, batch, replays)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
