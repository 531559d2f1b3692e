"""What a task holds at once: partitions of a shuffle, not splits of the input."""

import pytest
from pyspark.sql import functions as F

from runlens import queries, scratch
from runlens.plans import paths, pivot
from runlens.schema import LOOPS
from runlens.sources import adapters


def below_exchange(df) -> str:
    """The plan beneath its last exchange."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.rindex("Exchange") :]


def test_contexts_are_dealt_out_before_they_are_sorted(spark):
    found = paths.distinct_loops(spark.range(10).selectExpr("id % 3 AS ctx_id", "CAST(NULL AS BIGINT) AS p_ctx_id", "'x' AS l_name", "id AS iteration", "CAST(NULL AS STRING) AS l_value"))
    assert sorted(r["ctx_id"] for r in found.collect()) == [0, 1, 2]
    assert "Aggregate" not in below_exchange(found) and "Sort" not in below_exchange(found)


def test_rows_are_dealt_out_before_they_are_grouped(spark):
    keys = [(None, "p", "f.py", "a", None, 0), (None, "p", "f.py", "a", None, 0), (None, "q", "f.py", "b", None, 0)]
    rows = spark.createDataFrame(keys, "tstamp timestamp_ntz, projid string, filename string, value string, path array<struct<name:string,iteration:bigint,value:string>>, depth int").selectExpr("*", "'n' AS value_name")
    shape = pivot.Shape(0, (), rows=3)
    single, fused = pivot._single(rows, "n", shape), pivot._fused(rows, ["n", "m"], shape)
    assert sorted(r["n"] for r in single.collect()) == sorted(r["n"] for r in fused.collect()) == ["a", "b"]
    assert "Aggregate" not in below_exchange(single) and "Aggregate" not in below_exchange(fused)
    assert pivot._dealt(rows, [rows.projid], pivot.TASK_ROWS * 3).rdd.getNumPartitions() == 3
    assert pivot._dealt(rows, [rows.projid], 1 << 40).rdd.getNumPartitions() == pivot.MOST_TASKS


def test_written_steps_have_small_partitions_and_leave_the_session_as_it_was(spark, monkeypatch):
    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    before, seen = [spark.conf.get(n, None) for n in names], []
    plain = scratch.materialise
    monkeypatch.setattr(scratch, "materialise", lambda df, name: (seen.extend(spark.conf.get(n) for n in names), plain(df, name))[1])
    assert scratch.spread(spark.range(5).repartition("id"), "five").count() == 5
    assert seen == [scratch.TASK_BYTES, str(scratch.PARTITIONS)]
    assert [spark.conf.get(n, None) for n in names] == before


@pytest.mark.parametrize("known", [False, True])
def test_walk_ends_once_all_contexts_are_reached(spark, monkeypatch, known):
    joins, plain = [], paths.spread
    monkeypatch.setattr(paths, "spread", lambda df, name: (joins.append(name), plain(df, name))[1])
    loops = spark.createDataFrame([(1, None, "a", 1, None), (2, 1, "b", 1, None), (3, 2, "c", 1, None)], LOOPS)
    if known:
        top = paths.context_paths(loops.where("ctx_id = 1"))
        joins.clear()
        found = paths.context_paths(loops.where("ctx_id > 1"), top)
    else:
        found = paths.context_paths(loops)
    assert {r["ctx_id"]: r["depth"] for r in found.collect()} == ({2: 2, 3: 3} if known else {1: 1, 2: 2, 3: 3})
    assert joins == ["contexts", "paths", "paths"]


def test_named_orders_read_what_the_names_need(spark, sf_dir):
    some = adapters.orders(spark, sf_dir, names=("totalprice",))[0]
    every = adapters.orders(spark, sf_dir)[0].where("value_name = 'totalprice'")
    assert some.count() == every.count() > 0 and some.exceptAll(every).isEmpty()
    assert not any("lineitem" in f for f in some.inputFiles())
    assert adapters.orders(spark, sf_dir, names=("absent",))[0].isEmpty()
    assert sorted(r[0] for r in adapters.orders(spark, sf_dir, names=("shared", "tax"))[0].select("value_name").distinct().collect()) == ["shared", "tax"]


def test_ingested_orders_read_no_lines(spark, sf_dir):
    logs, known = queries._ingested(spark, sf_dir)
    assert not any("lineitem" in f for df in (logs, known) for f in df.inputFiles())
    assert logs.count() > known.count() > 0


def test_shapes_take_one_pass_over_the_rows(spark):
    schema = "value_name string, depth int, path array<struct<name:string,iteration:bigint,value:string>>"
    given = [("a", 2, [("x", 1, None), ("y", 1, "u")]), ("a", 2, [("x", 2, None), ("z", None, "v")]), ("a", 1, [("x", None, None)]), ("b", 0, None), ("c", 1, [("x", 1, None)])]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    found = pivot.shapes(spark.createDataFrame(given, schema).mapInArrow(counted, schema), ["a", "b", "c", "none"])
    assert read.value == len(given)
    assert found["a"] == pivot.Shape(2, (("x", "x", "iteration"), ("y", "y", "iteration"), ("y_value", "y", "value"), ("z_value", "z", "value")), frozenset({"x"}))
    assert found["b"] == found["none"] == pivot.Shape(0, ()) and found["c"] == pivot.Shape(1, (("x", "x", "iteration"),), frozenset({"x"}))
    assert [found[n].rows for n in ("a", "b", "c", "none")] == [2, 1, 1, 0]


#: Small tables treated as large ones: no broadcast, and no least size of a shuffled partition.
LIKE_LARGE = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def largest_task(written) -> int:
    """Rows of the largest file of a written step: a task writes one."""
    return max(r["count"] for r in written.groupBy(F.input_file_name()).count().collect())


def test_rows_outside_of_loops_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_BYTES", "1k")
    ids = spark.range(4000).withColumn("ctx_id", F.when(F.col("id") < 100, F.col("id")))
    keys = ["'p' AS projid", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS tstamp", "'f.py' AS filename"]
    logs = ids.selectExpr(*keys, "ctx_id", "'a' AS value_name", "CAST(id AS STRING) AS value", "1 AS value_type")
    known = spark.range(50).selectExpr("id AS ctx_id", "1 AS depth", "array(named_struct('name', 'x', 'iteration', id, 'value', CAST(NULL AS STRING))) AS path")
    with scratch.settings(spark, LIKE_LARGE):
        rows = scratch.spread(pivot.resolved(logs, known, ["a"]), "pivot")
    # contexts 50 to 99 are unknown
    assert {r["depth"]: r["count"] for r in rows.groupBy("depth").count().collect()} == {0: 3900, 1: 50}
    assert {r["value"] for r in rows.where("depth = 1").collect()} == {str(r["path"][0]["iteration"]) for r in rows.where("depth = 1").collect()} == {str(k) for k in range(50)}
    assert largest_task(rows) < 3950 / 8


@pytest.mark.parametrize("query", ["ctx_paths", "schedule_dims", "pivot_dup_logs_joined", "cost_level1"])
def test_no_task_takes_a_large_share_of_a_step(spark, sf_dir, monkeypatch, query):
    monkeypatch.setattr(scratch, "TASK_BYTES", "1k")
    monkeypatch.setattr(scratch, "PARTITIONS", 32)
    monkeypatch.setattr(pivot, "TASK_ROWS", 500)
    written, plain = [], scratch.materialise
    monkeypatch.setattr(scratch, "materialise", lambda df, name: (written.append((name, plain(df, name))), written[-1][1])[1])
    dealt, deal = [], pivot._dealt
    monkeypatch.setattr(pivot, "_dealt", lambda *given: (dealt.append((deal(*given), given[2])), dealt[-1][0])[1])
    with scratch.settings(spark, LIKE_LARGE):
        queries.QUERIES[query](spark, sf_dir)
    assert [name for name, _ in written][:2] == ["contexts", "paths"]
    for name, rows in written:
        assert largest_task(rows) < rows.count() / 8, name
    assert bool(dealt) == (query != "ctx_paths")
    for frame, rows in dealt:
        assert not rows or frame.rdd.getNumPartitions() == min(pivot.MOST_TASKS, -(-rows // 500))
