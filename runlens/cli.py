"""Command line: ``unpack``, ``query``, ``dataframe``, ``replay`` (costs), ``stat``."""

from __future__ import annotations

import argparse
import platform
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import discretize
from .plans import pivot, schedule, sql
from .sources.tables import Store
from .streaming.ingest import watch


def facts(spark: SparkSession) -> DataFrame:
    """Where this runs, as one row."""
    row = {"architecture": platform.machine(), "operating_system": platform.system(), "os_version": platform.version(), "python_version": platform.python_version(), "spark_version": spark.version}
    return spark.createDataFrame([tuple(row.values())], list(row))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="runlens")
    out.add_argument("--store", default="runlens-store", help="root folder of the tables")
    commands = out.add_subparsers(dest="command", required=True)
    p = commands.add_parser("unpack", help="ingest new run files")
    p.add_argument("folder")
    commands.add_parser("stat", help="facts about this machine")
    p = commands.add_parser("query", help="read-only SQL over logs and loops")
    p.add_argument("q")
    p = commands.add_parser("dataframe", help="pivot of logged names")
    p.add_argument("columns", nargs="?", type=lambda s: s.split(","), default=[])
    p = commands.add_parser("replay", help="cost and commands of replaying past runs")
    p.add_argument("names", type=lambda s: s.split(","))
    p.add_argument("where", nargs="?")
    p.add_argument("--logged", type=lambda s: s.split(","), default=[], help="logged names that the condition uses")
    p.add_argument("--level", type=int, default=1)
    p.add_argument("--after", action="store_true", help="the names over the scheduled runs, once these are replayed")
    p.add_argument("--mark", choices=("prefix", "suffix"), default="suffix")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("runlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "stat":
        out = facts(spark)
    else:
        store = Store(spark, args.store).create()
        if args.command == "unpack":
            watch(spark, store, args.folder, f"{args.store}/_ingest").awaitTermination()
            store.compact_if_scattered()
            return None
        held = store.snapshot()  # one version for all that follows
        logs, loops, paths = held.logs(), held.loops(), held.paths()
        if args.command == "query":
            out = sql.query(logs, loops, args.q)
        elif args.command == "dataframe":
            out = pivot.dataframe(logs, loops, *args.columns, paths=paths)
        else:
            costs = schedule.estimate(logs, loops, args.level, args.mark, paths=paths)
            costs = schedule.where_logged(costs, logs, loops, args.logged, args.where, paths) if args.where and args.logged else schedule.where(costs, args.where)
            if args.after:
                out = schedule.after_replay(costs, logs, loops, *args.names, paths=paths)
            else:
                costs = schedule.lacking(costs, logs, args.names)
                schedule.total_cost(costs).select("total", discretize(F.col("total")).alias("estimate")).show(truncate=False)
                out = schedule.replay_commands(costs, args.names, args.level)
    out.show(truncate=False)
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
