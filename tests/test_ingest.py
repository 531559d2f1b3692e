"""Recorder, run files, store, streaming and command line, end to end."""

import json

import pytest

from runlens import cli
from runlens.plans import pivot
from runlens.recorder import Recorder, settings_of
from runlens.sources import checkpoints, runfiles
from runlens.sources.tables import Store
from runlens.streaming.ingest import ingest, watch


def run(stamp, epochs=2, **more):
    r = Recorder("proj", "train.py", tstamp=stamp, **more)
    r.arg("lr", 0.1)
    with r.checkpointing(model={}):
        for e in r.loop("epoch", range(epochs)):
            for s in r.loop("step", ["a", "b"]):
                r.log("loss", e + len(s))
            r.log("acc", {"top": [e, None, True]})
    return r


def test_record_ingest_pivot(spark, tmp_path):
    folder = tmp_path / "runs"
    folder.mkdir()
    run("2024-01-01T00:00:00").commit(path=str(folder / "1.json"))
    store = Store(spark, str(tmp_path / "store")).create()
    for _ in range(2):  # a second pass over the same files adds nothing
        watch(spark, store, str(folder), str(tmp_path / "check")).awaitTermination()
    (folder / "copy.json").write_text((folder / "1.json").read_text())
    watch(spark, store, str(folder), str(tmp_path / "check")).awaitTermination()
    out = pivot.dataframe(store.logs(), store.loops(), "lr", "loss", "acc")
    assert sorted((r["epoch"], r["step_value"], r["lr"], r["loss"], r["acc"]) for r in out.collect()) == [
        (e, s, "0.1", str(e), "{'top': [%d, None, True]}" % (e - 1)) for e in (1, 2) for s in ("a", "b")
    ]
    assert store.loops().count() == store.loops().distinct().count() == 6


def test_runs_of_one_second_are_told_apart(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create()
    stamp, folder = "2024-01-01T00:00:00", tmp_path / "runs"
    folder.mkdir()
    for k, (project, file) in enumerate([("proj", "train.py"), ("proj", "eval.py"), ("other", "train.py")]):
        r = Recorder(project, file, tstamp=stamp)
        r.log("acc", k)
        r.commit(path=str(folder / f"{k}.json"))
        watch(spark, store, str(folder), str(tmp_path / "check")).awaitTermination()
    assert sorted((r["projid"], r["filename"], r["value"]) for r in store.logs().where("value_name = 'acc'").collect()) == [("other", "train.py", "2"), ("proj", "eval.py", "1"), ("proj", "train.py", "0")]


def test_late_replay_rows_join_their_run(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create()
    first = run("2024-01-01T00:00:00")
    first.commit(store=store)
    again = Recorder("proj", "train.py", settings=settings_of([{"ctx": None, "type": 1, "name": "lr", "value": 0.1}]), replay={"VARS": ["grad"], "epoch": ["0", "1"]}, tstamp="2024-01-01T00:00:00")
    for e in again.loop("epoch", range(2)):
        again.log("grad", e * 10)
        again.log("loss", "not wanted")
    again.commit(store=store)
    out = pivot.dataframe(store.logs(), store.loops(), "grad", "acc")
    assert sorted((r["epoch"], r["grad"], r["acc"] is not None) for r in out.collect()) == [(1, "0", True), (2, "10", True)]
    store.compact()
    assert store.loops().count() == 8


def test_recorder_closes_loops_on_break_and_slices_replays():
    r = Recorder("p", "f.py")
    for e in r.loop("epoch", range(5)):
        break
    r.log("after", 1)
    assert r.records[-1]["ctx"] is None
    assert list(Recorder("p", "f", replay={"VARS": []}, tstamp="t").loop("x", "abc")) == ["c"]
    assert list(Recorder("p", "f", replay={"VARS": [], "x": ["0", "2", "z", "9"]}, tstamp="t").loop("x", "abc")) == ["a", "c"]
    assert list(Recorder("p", "f", replay={"VARS": []}, tstamp="t").loop("x", "")) == []
    with pytest.raises(KeyError):
        Recorder("p", "f").arg("missing")
    assert Recorder("p", "f", settings={"n": "3"}).arg("n", 1) == 3


def test_run_file_values(spark, tmp_path):
    ctx = {"ctx_id": 5, "p_ctx": {"ctx_id": -(1 << 63), "p_ctx": None, "name": "o", "iteration": 1, "value": None}, "name": "i", "iteration": None, "value": "v"}
    values = ["s", 1, 1.5, True, None, [1, "a"], {"k": 1}]
    records = [{"projid": "p", "tstamp": "2024-01-01T00:00:00", "filename": "f", "ctx": ctx, "name": "n", "value": v, "type": 1} for v in values]
    (tmp_path / "r.json").write_text(json.dumps(records))
    (tmp_path / "empty.json").write_text("[]")
    found = runfiles.read_run_files(spark, str(tmp_path))
    assert [r["value"] for r in runfiles.logs_of(found).collect()] == ["s", "1", "1.5", "True", "None", "[1, 'a']", "{'k': 1}"]
    assert sorted((r["ctx_id"], r["p_ctx_id"]) for r in runfiles.loops_of(found).collect()) == [(-(1 << 63), None), (5, -(1 << 63))]


def test_checkpoint_catalogue(spark, tmp_path):
    at = tmp_path / "obj" / "proj" / "2024-01-01T00:00:00"
    at.mkdir(parents=True)
    (at / "my%5Fmodel_epoch_1_step_0%2E5.npy").write_bytes(b"x")
    row = checkpoints.catalogue(spark, str(tmp_path / "obj")).drop("content").first()
    assert (row["projid"], row["object"], row["kind"]) == ("proj", "my_model", "array")
    assert [(s["name"], s["value"]) for s in row["steps"]] == [("epoch", "1"), ("step", "0.5")]


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "runs"
    folder.mkdir()
    run("2024-01-01T00:00:00").commit(path=str(folder / "1.json"))
    base = ["--store", str(tmp_path / "store")]
    cli.main([*base, "unpack", str(folder)], spark)
    assert cli.main([*base, "dataframe", "lr,loss"], spark).count() == 4
    assert cli.main([*base, "query", "SELECT count(*) AS n FROM logs"], spark).first()["n"] > 0
    assert cli.main([*base, "replay", "grad", "num_epochs = 2"], spark).count() == 1
    after = cli.main([*base, "replay", "lr,acc", "num_epochs = 2", "--after"], spark)
    assert after.count() == 2 and {"epoch", "lr", "acc"} <= set(after.columns)
    assert cli.main(["stat"], spark).count() == 1
    capsys.readouterr()
