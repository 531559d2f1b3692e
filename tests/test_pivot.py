"""Hand-made relations for each rule of the pivot."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from runlens.functions.inference import infer_types, inferred_types
from runlens.plans import paths, pivot, schedule, sql
from runlens.schema import LOGS, LOOPS, TIMING, USER

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def frames(spark, logs, loops=()):
    rows = [("p", r.get("t", T1), "f.py", r.get("ctx"), r["name"], r["value"], r.get("type", USER)) for r in logs]
    return spark.createDataFrame(rows, LOGS), spark.createDataFrame(list(loops), LOOPS)


def log(name, value, ctx=None, **more):
    return {"name": name, "value": value, "ctx": ctx, **more}


LOOPS_2 = [(1, None, "epoch", 1, None), (2, None, "epoch", 2, None), (11, 1, "step", 1, "a"), (12, 1, "step", 2, "b"), (21, 2, "step", 1, "a")]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_paths_two_levels_dangling_and_cycles(spark):
    loops = [*LOOPS_2, (31, 99, "step", 1, None), (41, 42, "x", 1, None), (42, 41, "x", 1, None), (11, 1, "step", 1, "a")]
    _, l = frames(spark, [], loops)
    for build in (paths.context_paths, paths.context_paths_sql):
        found = {r["ctx_id"]: [s["name"] for s in r["path"]] for r in build(l).collect()}
        assert found == {1: ["epoch"], 2: ["epoch"], 11: ["epoch", "step"], 12: ["epoch", "step"], 21: ["epoch", "step"]}


def test_recursive_paths_of_more_rows_than_the_session_allows(spark):
    _, l = frames(spark, [], LOOPS_2)
    spark.conf.set(paths.ROW_LIMIT, "3")
    try:
        assert sorted(r["ctx_id"] for r in paths.context_paths_sql(l).collect()) == [1, 2, 11, 12, 21]
        assert spark.conf.get(paths.ROW_LIMIT) == "3"
    finally:
        spark.conf.unset(paths.ROW_LIMIT)


def test_run_level_value_spreads_over_iterations(spark):
    logs, loops = frames(spark, [log("lr", "0.1"), log("loss", "3", 11), log("loss", "2", 12), log("loss", "1", 21)], LOOPS_2)
    out = pivot.dataframe(logs, loops, "lr", "loss")
    assert out.columns == ["projid", "tstamp", "filename", "epoch", "step", "step_value", "lr", "loss"]
    assert rows(out, "epoch", "step", "step_value", "lr", "loss") == [(1, 1, "a", "0.1", "3"), (1, 2, "b", "0.1", "2"), (2, 1, "a", "0.1", "1")]


def test_repeated_logs_pair_up_fused_or_not(spark):
    logs, loops = frames(spark, [log("a", "1", 1), log("a", "2", 1), log("b", "x", 1), log("b", "y", 1), log("a", "3", 2), log("b", None, 1)], LOOPS_2)
    want = [(1, a, b) for a in ("1", "2") for b in ("x", "y", None)] + [(2, "3", None)]
    for fuse in (True, False):
        out = pivot.dataframe(logs, loops, "a", "b", fuse=fuse)
        assert rows(out, "epoch", "a", "b") == sorted(want, key=repr)


def test_fold_order_is_kept_when_shapes_differ(spark):
    """A run-level name between two loop names must not be fused around."""
    logs, loops = frames(spark, [log("x", "1", 11), log("acc", "9"), log("acc", "8", t=T2), log("y", "5", 12), log("y", "6", 21, t=T2)], LOOPS_2)
    fused, joined = (pivot.dataframe(logs, loops, "x", "acc", "y", fuse=f) for f in (True, False))
    assert fused.columns == joined.columns
    assert rows(fused, *fused.columns) == rows(joined, *fused.columns)


def test_names_in_any_order_give_the_same_rows(spark):
    logs, loops = frames(spark, [log("a", "1", 11), log("b", "2", 11), log("c", "3", 12), log("b", "4", 12)], LOOPS_2)
    one, two = pivot.dataframe(logs, loops, "a", "b", "c"), pivot.dataframe(logs, loops, "c", "a", "b")
    assert one.columns[-3:] == ["a", "b", "c"] and two.columns[-3:] == ["c", "a", "b"]
    assert rows(one, *one.columns) == rows(two, *one.columns)


def test_deepest_rows_stay(spark):
    logs, loops = frames(spark, [log("v", "top"), log("v", "mid", 1), log("v", "deep", 11), log("v", "lost", 99)], LOOPS_2)
    assert rows(pivot.dataframe(logs, loops, "v"), "epoch", "step", "v") == [(1, 1, "deep")]


def test_unknown_contexts_only_give_no_rows(spark):
    logs, loops = frames(spark, [log("v", "1", 99)], LOOPS_2)
    assert pivot.dataframe(logs, loops, "v").collect() == []


def test_column_drops(spark):
    loops = [(1, None, "named", None, "a"), (2, None, "named", 2, "b")]
    logs, l = frames(spark, [log("v", "1", 1), log("v", "2", 2)], loops)
    assert pivot.dataframe(logs, l, "v").columns == ["named_value", "projid", "tstamp", "filename", "v"]
    logs, l = frames(spark, [log("v", "1", 1)], [(1, None, "bare", None, None)])
    with pytest.raises(ValueError, match="neither"):
        pivot.dataframe(logs, l, "v")


def test_loops_of_different_names_on_a_level_keep_their_columns(spark):
    loops = [(1, None, "train", 1, None), (2, None, "test", 1, None)]
    logs, l = frames(spark, [log("v", "1", 1), log("v", "2", 2)], loops)
    assert rows(pivot.dataframe(logs, l, "v"), "train", "test", "v") == [(1, None, "1"), (None, 1, "2")]


def test_ids_that_differ_by_one_stay_apart(spark):
    big = 1 << 62
    logs, l = frames(spark, [log("v", "1", big), log("v", "2", big + 1)], [(big, None, "e", 1, None), (big + 1, None, "e", 2, None)])
    assert rows(pivot.dataframe(logs, l, "v"), "e", "v") == [(1, "1"), (2, "2")]


def test_record_and_replay_meet_on_loop_columns(spark):
    loops = [(1, None, "epoch", 1, None), (7, None, "epoch", 1, None)]
    logs, l = frames(spark, [log("loss", "3", 1), log("grad", "5", 7)], loops)
    assert rows(pivot.dataframe(logs, l, "loss", "grad"), "epoch", "loss", "grad") == [(1, "3", "5")]


def test_clashing_names_and_nested_same_loops_are_refused(spark):
    logs, l = frames(spark, [log("epoch", "3", 1), log("tstamp", "x")], LOOPS_2)
    for name in ("epoch", "tstamp"):
        with pytest.raises(ValueError, match="key or loop"):
            pivot.dataframe(logs, l, name)
    logs, l = frames(spark, [log("v", "3", 2)], [(1, None, "e", 1, None), (2, 1, "e", 1, None)])
    with pytest.raises(ValueError, match="same name"):
        pivot.dataframe(logs, l, "v")


def test_quotes_in_names_and_repeated_names(spark):
    logs, l = frames(spark, [log("it's \"v\"", "1")])
    assert pivot.dataframe(logs, l, "it's \"v\"", "it's \"v\"").columns == ["projid", "tstamp", "filename", "it's \"v\""]


def test_star_takes_text_maximum_and_user_rows(spark):
    logs, l = frames(spark, [log("acc", "9"), log("acc", "10"), log("delta::prefix", "1", type=TIMING), log("loss", "1", 1)], LOOPS_2)
    out = pivot.dataframe(logs, l)
    assert rows(out, *out.columns) == [("p", T1, "f.py", "9")]
    empty, l = frames(spark, [])
    assert pivot.dataframe(empty, l).columns == ["projid", "tstamp", "filename"]


def test_star_plan_has_one_shuffle(spark, capsys):
    logs, _ = frames(spark, [log("acc", "9")])
    pivot.star(logs, ["acc", "loss"]).explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def test_inference(spark):
    data = [("1", "1.5", "2024-01-01", "True", None, " 7 ", "nan", "1e400", "inf"), ("2", "", "2024-01-02 03:04:05", "x", None, "8", "1", "1", "2")]
    df = spark.createDataFrame(data, ",".join(f"{c} string" for c in "abcdefghi").replace(",", ", "))
    kinds = inferred_types(df)
    assert kinds == {"a": "bigint", "b": "double", "c": "timestamp_ntz", "d": "string", "e": "string", "f": "bigint", "g": "string", "h": "string", "i": "double"}
    assert infer_types(df).collect()[0]["i"] == float("inf")


def test_query_is_read_only(spark):
    logs, l = frames(spark, [log("acc", "9")])
    assert sql.query(logs, l, "SELECT value FROM logs").collect()[0]["value"] == 9
    assert sql.query(logs, l, "SELECT value FROM logs WHERE false").collect() == []
    for bad in ("DROP VIEW logs", "CREATE TABLE x AS SELECT 1", "SET a=b", "INSERT INTO logs SELECT * FROM logs"):
        with pytest.raises(ValueError, match="command"):
            sql.query(logs, l, bad)


def test_published_costs(spark):
    """Two runs with known timings: 5 epochs and 3 epochs."""
    loops, entries = [], []
    for t, n, pre, suf, marginal in ((T1, 5, "0.4068293860000267", "0.5810907259983651", 0.644463), (T2, 3, "0.35641806300009193", "0.5474109189999581", 0.436843)):
        base = 100 * n
        entries += [log("hidden", "500", t=t), log("delta::prefix", pre, t=t, type=TIMING), log("delta::suffix", suf, t=t, type=TIMING), log("delta::loop", str(10.0 + marginal), t=t, type=TIMING)]
        for k in range(n):
            loops.append((base + k, None, "epoch", k + 1, None))
            entries.append(log("delta::loop", str(10.0 / n), base + k, t=t, type=TIMING))
    logs, l = frames(spark, entries, loops)
    found = sorted(round(r["composite"], 4) for r in schedule.estimate(logs, l, 1).collect())
    assert found == [4.3407, 6.6324]
    commands = [r["command"] for r in schedule.replay_commands(schedule.estimate(logs, l, 2), ["grad"], 2).collect()]
    assert "python f.py --replay grad epoch=0,1,2, step=1" in commands


def test_costs_without_loops_or_checkpoints_are_empty(spark):
    logs, l = frames(spark, [log("lr", "1")])
    for level in (0, 1, 2):
        out = schedule.estimate(logs, l, level)
        assert out.collect() == [] and "composite" in out.columns
    with pytest.raises(ValueError):
        schedule.estimate(logs, l, 3)


def test_fused_later_equals_joined(spark):
    """Names of one shape behind a shallower one, each missing in some rounds."""
    import itertools
    import random

    rng = random.Random(5)
    loops = [(k, None, "epoch", k, None) for k in range(1, 5)] + [(10 * k + j, k, "step", j, None) for k in range(1, 5) for j in range(1, 4)]
    logs = []
    for run, (k, j) in itertools.product(range(2), itertools.product(range(1, 5), range(4))):
        for name in ("loss", "grad", "norm") if j else ("acc", "lr"):
            for _ in range(rng.choice((0, 1, 1, 2))):
                logs.append(("p", f"2024-01-01 00:00:0{run}", "f.py", 10 * k + j if j else k, name, rng.choice((None, "1", "2")), 1))
    frames = spark.createDataFrame(logs, "projid string, tstamp string, filename string, ctx_id long, value_name string, value string, value_type int").withColumn("tstamp", F.col("tstamp").cast("timestamp_ntz")), spark.createDataFrame(loops, "ctx_id long, p_ctx_id long, l_name string, iteration long, l_value string")
    for names in (("acc", "loss", "grad", "norm"), ("loss", "grad", "acc", "lr", "norm"), ("lr", "acc", "norm", "loss")):
        fused, joined = (sorted(map(repr, pivot.dataframe(*frames, *names, fuse=f).collect())) for f in (True, False))
        assert fused == joined and fused


def test_run_level_names_join_without_a_full_join(spark):
    """A run of very many rounds is no key of a full outer join; the rows are those of one."""
    import datetime

    stamp = lambda k: datetime.datetime(2024, 1, 1, 0, 0, k)
    rows = [("p", stamp(r), "f", r * 100 + e, "loss", str(e), 1) for r in (1, 2, 3) for e in range(1, 5)]
    rows += [("p", stamp(r), "f", None, "lr", v, 1) for r in (2, 3, 4) for v in ("0.1", "0.2")[: r % 2 + 1]] + [(None, None, "f", None, "lr", "0.5", 1), (None, None, "f", 101, "loss", "9", 1)]
    loops = spark.createDataFrame([(r * 100 + e, None, "epoch", e, None) for r in (1, 2, 3) for e in range(1, 5)], LOOPS)
    logs = spark.createDataFrame(rows, LOGS)
    for names in (("loss", "lr"), ("lr", "loss")):
        found = pivot.dataframe(logs, loops, *names)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FullOuter" not in plan and "NestedLoop" not in plan
        alone = [pivot.dataframe(logs, loops, n) for n in names]
        full = pivot.natural_full_join(*alone)
        shown = lambda df: sorted((tuple(r[c] for c in ("epoch", "projid", "tstamp", "filename", "loss", "lr")) for r in df.collect()), key=repr)
        assert shown(found) == shown(full)
        assert found.columns == [c for c in full.columns if c not in names] + list(names)
