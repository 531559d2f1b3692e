"""The store: the two relations and what is derived from them, committed together.

Under the root lie folders of Parquet files, one a table and batch, and ``_versions`` with a
small manifest a version: which folders make up each table.  A write puts its batch into new
folders and then publishes the next version by one rename that refuses an existing
target; until then nobody sees the batch, and a writer that another one overtook is told so.
Readers keep the version they opened.  Old folders stay until ``vacuum``.

Tables: ``logs`` (by project, sorted by name), ``loops``, ``paths`` (every context's chain of
steps, so that pivots walk nothing), ``runs`` (one row a run, sorted, with Bloom filters:
what ingestion compares new runs with) and ``pending`` (contexts whose ancestors aren't there yet).

The rename has to be atomic and to refuse existing targets, as in HDFS; plain object
stores need a file system that gives this.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.paths import distinct_loops, walk
from ..schema import LOGS, LOOPS, PATHS, RUN_KEYS
from ..scratch import small_tasks, spread

RUNS = T.StructType([f for f in LOGS if f.name in RUN_KEYS])
TABLES = {"logs": LOGS, "loops": LOOPS, "paths": PATHS, "runs": RUNS, "pending": LOOPS}
#: From so many batches on, ``compact_if_scattered`` merges them.
SCATTERED = 32
#: A batch of so many bytes, in files of so many on average, has nothing to gain from compaction.
LARGE_BATCH, LARGE_FILE = 64 << 20, 2 << 20
#: Starts the names of batches whose contexts were compared with all that the store had; older stores' and vouched ones start with b.
CHECKED, VOUCHED = "batch=c", "batch=b"


class Overtaken(RuntimeError):
    """Another writer published a version first."""


@dataclass(frozen=True)
class Snapshot:
    """One version of all tables."""

    spark: SparkSession
    version: int
    folders: dict[str, tuple[str, ...]]

    def table(self, name: str) -> DataFrame:
        if not self.folders.get(name):
            return self.spark.createDataFrame([], TABLES[name])
        base = self.folders[name][0].rpartition("/")[0]
        return self.spark.read.schema(TABLES[name]).option("basePath", base).parquet(*self.folders[name]).select(*TABLES[name].names)

    def logs(self) -> DataFrame:
        return self.table("logs")

    def loops(self) -> DataFrame:
        return self.table("loops")

    def paths(self) -> DataFrame:
        return self.table("paths")

    def runs(self) -> DataFrame:
        return self.table("runs")


@dataclass
class Store:
    """Versions of the tables under ``root``."""

    spark: SparkSession
    root: str

    # files

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))

    def _files(self):
        path = self._path()
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        files, path = self._files(), self._path(*parts)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("_versions") if n.endswith(".json")]

    def _read(self, version: int) -> dict[str, tuple[str, ...]]:
        stream = self._files().open(self._path("_versions", f"{version:020d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return {t: tuple(f"{self.root.rstrip('/')}/{x}" for x in held) for t, held in json.loads(text).items()}

    def _publish(self, version: int, folders: dict[str, list[str]]) -> None:
        """Writes the manifest aside and renames it to its place."""
        files, jvm = self._files(), self.spark.sparkContext._jvm
        aside, place = self._path("_versions", f"_{uuid.uuid4().hex}"), self._path("_versions", f"{version:020d}.json")
        out = files.create(aside, True)
        try:
            out.write(bytearray(json.dumps(folders, indent=1).encode()))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(aside, place, none)
        except Exception as why:
            files.delete(aside, False)
            if files.exists(place):
                raise Overtaken(f"version {version} is there already") from why
            raise

    # versions

    def create(self) -> Store:
        """Publishes an empty first version where there is none."""
        if not self.versions():
            try:
                self._publish(1, {name: [] for name in TABLES})
            except Overtaken:  # created by another writer just now
                pass
        return self

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or an older one that is still there."""
        found = version or self.versions()[-1]
        return Snapshot(self.spark, found, self._read(found))

    def logs(self) -> DataFrame:
        return self.snapshot().logs()

    def loops(self) -> DataFrame:
        return self.snapshot().loops()

    def _write(self, name: str, df: DataFrame, batch: str) -> str:
        """One table's batch, laid out for its readers; the folder's name.

        Tasks are of few rows; loops and chains stay in the ones that they come from.
        """
        shaped = df.select(*(F.col(f.name).cast(f.dataType) for f in TABLES[name]))
        if name == "logs":
            # files by project, also for one large project: of what some tasks sent
            writer = shaped.hint("rebalance", "projid").sortWithinPartitions("projid", "value_name").write.partitionBy("projid")
        elif name == "runs":
            writer = shaped.hint("rebalance", *RUN_KEYS[:2]).sortWithinPartitions(*RUN_KEYS).write.option("parquet.bloom.filter.enabled#projid", "true").option("parquet.bloom.filter.enabled#filename", "true")
        else:
            writer = shaped.write
        with small_tasks(self.spark):
            writer.parquet(f"{self.root.rstrip('/')}/{name}/{batch}")
        return f"{name}/{batch}"

    def _held(self, folder: str) -> DataFrame:
        """What was just written to a folder, before any version names it."""
        name = folder.partition("/")[0]
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root.rstrip('/')}/{folder}")

    def _commit(self, base: Snapshot, added: dict[str, list[str]], replaced: tuple[str, ...]) -> Snapshot:
        """The version after ``base``: its tables with the added folders, or made of these alone where replaced."""
        cut = len(self.root.rstrip("/")) + 1
        self._publish(base.version + 1, {name: [*([] if name in replaced else [f[cut:] for f in base.folders.get(name, ())]), *added.get(name, [])] for name in TABLES})
        return self.snapshot(base.version + 1)

    def append(self, logs: DataFrame, loops: DataFrame, paths: DataFrame | None = None, new_contexts: bool = False, base: Snapshot | None = None) -> Snapshot:
        """Adds rows of logs and the contexts that aren't there yet, with their chains.

        Chains come from the batch, or start from those of contexts that are there; only
        contexts of the batch and pending ones are walked.  ``new_contexts`` vouches that none of
        them is in the store, and ``paths`` that these are all their chains.  Runs and chains are
        derived from the logs and loops as written, so that the given frames are read as rarely as can be.
        """
        base = base or self.snapshot()
        batch = f"{VOUCHED if new_contexts else CHECKED}{uuid.uuid4().hex}"
        added = {"logs": self._write("logs", logs, batch)}
        # a folder's name doesn't tell a missing project from an empty one
        kept = self._held(added["logs"])
        added["runs"] = self._write("runs", (kept if kept.where(F.col("projid").isNull()).isEmpty() else logs).select(*RUN_KEYS).distinct(), batch)
        shaped = loops.select(*(F.col(f.name).cast(f.dataType) for f in LOOPS))
        own = distinct_loops(shaped)
        if not new_contexts and base.folders.get("loops"):
            low, high = shaped.agg(F.min("ctx_id"), F.max("ctx_id")).first()
            held = base.loops().where(F.col("ctx_id").between(low, high)) if low is not None else base.loops().limit(0)
            own = own.join(held.select("ctx_id"), "ctx_id", "left_anti")
        added["loops"], replaced = self._write("loops", own, batch), ()
        if paths is not None:
            added["paths"] = self._write("paths", paths, batch)
        else:
            walked = self._held(added["loops"])
            if base.folders.get("pending") and not base.table("pending").isEmpty():
                walked = spread(distinct_loops(walked.unionByName(base.table("pending"))), "contexts")
            found, left = walk(walked, base.paths() if base.folders.get("paths") else None)
            added["paths"] = self._write("paths", found, batch)
            added["pending"] = self._write("pending", walked.join(found.select("ctx_id"), "ctx_id", "left_anti") if left else walked.limit(0), batch)
            replaced = ("pending",)
        return self._commit(base, {name: [folder] for name, folder in added.items()}, replaced)

    def _large(self, folder: str) -> bool:
        held = self._files().getContentSummary(self._path(folder))
        return held.getLength() >= max(LARGE_BATCH, LARGE_FILE * held.getFileCount())

    def compact(self) -> Snapshot:
        """Merges the batches of every table, without repeated contexts and runs; log rows all stay.

        Large batches in large files stay as they are, so that a store isn't written anew each time.
        Those of contexts do so only where all batches were compared with what was there before them: nothing is repeated then.
        """
        base, batch = self.snapshot(), f"{CHECKED}{uuid.uuid4().hex}"
        cut = len(self.root.rstrip("/")) + 1
        folders = {}
        for name in TABLES:
            found = [f[cut:] for f in base.folders.get(name, ())]
            checked = all(f.startswith(f"{name}/{CHECKED}") for f in found)
            stay = [f for f in found if name == "logs" or name in ("loops", "paths") and checked if self._large(f)]
            merged = [f for f in found if f not in stay]
            if merged:
                df = replace(base, folders={name: tuple(f"{self.root.rstrip('/')}/{f}" for f in merged)}).table(name)
                if name == "runs":
                    df = df.dropDuplicates(RUN_KEYS)
                elif name != "logs" and not (checked and name != "pending"):
                    df = df.repartition("ctx_id").dropDuplicates(["ctx_id"])
                stay.append(self._write(name, df, batch))
            folders[name] = stay
        return self._commit(base, folders, tuple(TABLES))

    def compact_if_scattered(self) -> None:
        if max(map(len, self.snapshot().folders.values()), default=0) >= SCATTERED:
            self.compact()

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the newest ``keep`` versions, and the folders that none of these names; how many folders went.

        Readers of older versions, and writers at work, lose their files: run it alone.
        """
        known = self.versions()
        held = {f for v in known[-keep:] for folders in self._read(v).values() for f in folders}
        files, gone = self._files(), 0
        for v in known[:-keep]:
            files.delete(self._path("_versions", f"{v:020d}.json"), False)
        for name in TABLES:
            for batch in self._names(name):
                if f"{self.root.rstrip('/')}/{name}/{batch}" not in held:
                    files.delete(self._path(name, batch), True)
                    gone += 1
        return gone


def distinct_logs(logs: DataFrame, where: str | None = None) -> DataFrame:
    return (logs if where is None else logs.where(F.expr(where))).distinct()


def known_stamps(logs: DataFrame) -> DataFrame:
    return logs.select("tstamp").distinct()


#: Up to so many projects are asked for by name.
FEW_PROJECTS = 100


def near(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """The known rows among which those of the incoming projects and stamps are, by filters that reach the scan."""
    low, high, blank = incoming.agg(F.min("tstamp"), F.max("tstamp"), F.count_if(F.col("tstamp").isNull())).first()
    projects = [r[0] for r in incoming.select("projid").distinct().limit(FEW_PROJECTS + 1).collect()]
    if low is not None and not blank:
        known = known.where(F.col("tstamp").between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")))
    if projects and len(projects) <= FEW_PROJECTS and None not in projects:
        known = known.where(F.col("projid").isin(projects))
    return known


def unseen(incoming: DataFrame, known: DataFrame, newer_only: bool = False) -> DataFrame:
    """Incoming rows of runs that ``known`` (logs, or a store's runs) doesn't have yet; a run is a project, stamp and file.

    With ``newer_only``, runs older than the newest known one stay out, too, as if the
    history were walked from the newest run and left at the first known one.
    """
    if not newer_only:
        held = known.select(*(F.col(c).alias(f"_{c}") for c in RUN_KEYS)).distinct()
        return incoming.join(held, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in RUN_KEYS], "left_anti")
    met = incoming.select("tstamp").distinct().join(known_stamps(known), "tstamp", "left_semi").agg(F.max("tstamp").alias("_met"))
    return incoming.join(F.broadcast(met), F.col("_met").isNull() | (F.col("tstamp") > F.col("_met")), "inner").drop("_met")
