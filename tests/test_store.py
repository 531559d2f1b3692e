"""The versioned store: commits that break off, snapshots, compaction, chains, ingestion plans."""

import pytest

from runlens.plans import pivot
from runlens.plans.paths import context_paths
from runlens.schema import LOGS, LOOPS
from runlens.sources import runfiles, tables
from runlens.sources.tables import Overtaken, Snapshot, Store
from runlens.streaming import ingest as streaming
from test_ingest import run


def frames(spark, k, parent=None):
    """A run with two rounds of a loop; the loop hangs below ``parent``."""
    import datetime

    stamp = datetime.datetime(2024, 1, 1, 0, 0, k)
    logs = [("p", stamp, "f.py", 10 * k + j, "loss", str(j), 1) for j in (1, 2)] + [("p", stamp, "f.py", None, "lr", "0.1", 1)]
    loops = [(10 * k + j, parent, "step" if parent else "epoch", j, None) for j in (1, 2)]
    return spark.createDataFrame(logs, LOGS), spark.createDataFrame(loops, LOOPS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_commit_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    """A failure at any of the writes: readers see the old version, and the write can be repeated."""
    store = Store(spark, str(tmp_path / "store")).create()
    store.append(*frames(spark, 1))
    steps = len(tables.TABLES) + 1  # one a table, and the manifest
    write, publish = Store._write, Store._publish
    for at in range(steps):
        before, left = (rows(store.logs()), rows(store.loops())), [at]

        def broken(real):
            def f(self, *args):
                if left[0] == 0:
                    left[0] = -1
                    raise OSError("gone")
                left[0] -= 1
                return real(self, *args)

            return f

        monkeypatch.setattr(Store, "_write", broken(write))
        monkeypatch.setattr(Store, "_publish", broken(publish))
        with pytest.raises(OSError):
            store.append(*frames(spark, 2 + at))
        monkeypatch.setattr(Store, "_write", write)
        monkeypatch.setattr(Store, "_publish", publish)
        assert (rows(store.logs()), rows(store.loops())) == before
        store.append(*frames(spark, 2 + at))
        assert store.logs().count() == len(before[0]) + 3 and store.loops().count() == len(before[1]) + 2
    assert store.snapshot().paths().count() == store.loops().count()


@pytest.mark.parametrize("broken_table", ["logs", "loops", "paths", "runs"])
def test_ingestion_that_breaks_off_is_completed(spark, tmp_path, monkeypatch, broken_table):
    folder = tmp_path / "runs"
    folder.mkdir()
    run("2024-01-01T00:00:00").commit(path=str(folder / "1.json"))
    store, write = Store(spark, str(tmp_path / "store")).create(), Store._write
    texts = spark.read.format("text").option("wholetext", "true").load(str(folder))

    def broken(self, name, *args):
        if name == broken_table:
            raise OSError("gone")
        return write(self, name, *args)

    monkeypatch.setattr(Store, "_write", broken)
    with pytest.raises(OSError):
        streaming.ingest(store, texts)
    monkeypatch.setattr(Store, "_write", write)
    assert store.logs().count() == 0
    for _ in range(2):
        streaming.ingest(store, texts)
    held = store.snapshot()
    assert pivot.dataframe(held.logs(), held.loops(), "lr", "loss", "acc", paths=held.paths()).count() == 4
    assert rows(held.paths()) == rows(context_paths(held.loops()))


def test_writer_that_was_overtaken(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create()
    base = store.snapshot()
    store.append(*frames(spark, 1), base=base)
    with pytest.raises(Overtaken):
        store.append(*frames(spark, 2), base=base)
    assert store.logs().count() == 3
    store.append(*frames(spark, 2))
    assert store.logs().count() == 6 and store.versions() == [1, 2, 3]


def test_two_ingestions_at_once(spark, tmp_path, monkeypatch):
    """Another writer brings one of the two runs in meanwhile."""
    folder = tmp_path / "runs"
    folder.mkdir()
    for k in (1, 2):
        run(f"2024-01-01T00:00:0{k}").commit(path=str(folder / f"{k}.json"))
    store, real = Store(spark, str(tmp_path / "store")).create(), streaming.fresh_records
    read = lambda name: spark.read.format("text").option("wholetext", "true").load(str(folder / name))

    def overtaken(*args):
        out = real(*args)
        monkeypatch.setattr(streaming, "fresh_records", real)
        streaming.ingest(store, read("1.json"))
        return out

    monkeypatch.setattr(streaming, "fresh_records", overtaken)
    streaming.ingest(store, read("*.json"))
    assert store.snapshot().version == 3
    assert store.logs().where("value_name = 'lr'").count() == 2 and store.loops().count() == 12


def test_snapshots_stay_as_they_are(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create()
    first = store.append(*frames(spark, 1))
    held = rows(first.logs())
    second = store.append(*frames(spark, 2))
    store.compact()
    assert rows(first.logs()) == held and second.logs().count() == 6 == store.logs().count()
    assert rows(store.snapshot(first.version).loops()) == rows(first.loops())
    assert max(len(f) for f in store.snapshot().folders.values()) == 1
    gone = store.vacuum()
    assert gone == 10 and store.logs().count() == 6 and store.versions() == [4]
    with pytest.raises(Exception):
        first.logs().collect()


def test_compaction_drops_repeated_contexts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create()
    logs, loops = frames(spark, 1)
    for _ in range(3):
        store.append(logs, loops, new_contexts=True)
    assert store.loops().count() == 6
    store.compact()
    assert store.loops().count() == 2 == store.snapshot().paths().count() and store.snapshot().runs().count() == 1 and store.logs().count() == 9
    store.append(logs, loops)  # without the promise, contexts that are there stay out
    assert store.loops().count() == 2


def test_chains_of_contexts_that_arrive_out_of_order(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create()
    leaf, middle, top = frames(spark, 3, parent=22), frames(spark, 2, parent=11), frames(spark, 1)
    store.append(*leaf)
    assert store.snapshot().paths().count() == 0 and store.snapshot().table("pending").count() == 2
    store.append(*middle)
    assert store.snapshot().table("pending").count() == 4
    store.append(*top)
    held = store.snapshot()
    assert held.table("pending").count() == 0 and rows(held.paths()) == rows(context_paths(held.loops())) and held.paths().count() == 6
    store.append(*frames(spark, 4, parent=31))  # below one that is there
    held = store.snapshot()
    assert rows(held.paths()) == rows(context_paths(held.loops())) and max(r["depth"] for r in held.paths().collect()) == 4


def test_paths_of_run_files_are_those_of_the_walk(spark, tmp_path):
    run("2024-01-01T00:00:00").commit(path=str(tmp_path / "1.json"))
    records = runfiles.read_run_files(spark, str(tmp_path))
    assert rows(runfiles.paths_of(records)) == rows(context_paths(runfiles.loops_of(records)))


def read_files(df):
    return {f.split("/store/")[1].split("/")[0] for f in df.inputFiles() if "/store/" in f}


def test_ingestion_reads_no_logs(spark, tmp_path):
    """Unseen runs come from the table of runs, by its projects and stamps; replays read the logs of their runs' projects."""
    store = Store(spark, str(tmp_path / "store")).create()
    for k in (1, 2, 3):
        store.append(*frames(spark, k))
    run("2024-01-01T00:00:02").commit(path=str(tmp_path / "1.json"))
    records = runfiles.read_run_files(spark, str(tmp_path / "1.json")).selectExpr("projid", "CAST(tstamp AS TIMESTAMP_NTZ) AS tstamp", "filename", "name", "value", "type", "chain")
    fresh = streaming.fresh_records(records, store.snapshot())
    assert read_files(fresh) == {"runs"}
    plan = fresh._jdf.queryExecution()
    assert "NestedLoop" not in plan.executedPlan().toString()
    filters = [line for line in plan.optimizedPlan().toString().split("\n") if "Filter" in line]
    assert any("tstamp" in f and ">=" in f and "projid" in f for f in filters)
    assert read_files(streaming.fresh_records(records, store.snapshot(), replays=True)) <= {"logs"}


def test_pivot_over_a_store_walks_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create()
    store.append(*frames(spark, 1))
    store.append(*frames(spark, 2, parent=11))
    held = store.snapshot()
    resolved = pivot.resolved(held.logs(), held.paths(), ["loss"])
    assert read_files(resolved) == {"logs", "paths"}
    assert rows(pivot.dataframe(held.logs(), held.loops(), "loss", "lr", paths=held.paths())) == rows(pivot.dataframe(held.logs(), held.loops(), "loss", "lr"))
    assert isinstance(held, Snapshot)


def test_append_reads_the_logs_once(spark, tmp_path):
    """Runs come from what was written, also where a project is missing or empty."""
    store, read = Store(spark, str(tmp_path / "store")).create(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    logs, loops = frames(spark, 1)
    store.append(logs.mapInArrow(counted, LOGS), loops)
    assert read.value == 3 and store.snapshot().runs().count() == 1
    odd = logs.selectExpr("CASE WHEN value = '1' THEN '' WHEN value = '2' THEN NULL ELSE 'p' END AS projid", "tstamp", "filename", "ctx_id", "value_name", "value", "value_type")
    store.append(odd, loops)
    assert sorted((r[0] for r in store.snapshot().runs().collect()), key=repr) == ["", "p", "p", None]
    assert store.loops().count() == 2 == store.snapshot().paths().count()


@pytest.mark.parametrize("vouched", [False, True])
def test_compaction_leaves_large_batches_unless_contexts_may_repeat(spark, tmp_path, monkeypatch, vouched):
    store = Store(spark, str(tmp_path / "store")).create()
    for k in (1, 2, 1):
        store.append(*frames(spark, k), new_contexts=vouched)
    before = store.snapshot()
    held = {name: rows(before.table(name).distinct()) for name in tables.TABLES}
    monkeypatch.setattr(tables, "LARGE_BATCH", 0)
    monkeypatch.setattr(tables, "LARGE_FILE", 0)
    after = store.compact()
    assert {name: rows(after.table(name).distinct()) for name in tables.TABLES} == held
    assert after.logs().count() == 9 and after.runs().count() == 2 and after.loops().count() == 4 == after.paths().count()
    assert after.folders["logs"] == before.folders["logs"] and (after.folders["loops"] == before.folders["loops"]) != vouched
    assert (len(after.folders["loops"]), len(after.folders["runs"])) == ((1 if vouched else 3), 1)
