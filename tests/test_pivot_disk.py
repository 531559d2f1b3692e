"""What a pivot writes and shuffles: a row a round, not a row a value or a combination of values."""

import itertools
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from runlens import queries, scratch
from runlens.plans import pivot
from runlens.schema import LOGS, LOOPS, RUN_KEYS
from runlens.scratch import settings
from runlens.sources import adapters


def shown(df, columns):
    return sorted(map(repr, df.select(*(F.col(f"`{c}`") for c in columns)).collect()))


def test_neighbouring_values_of_a_round_are_one_row(spark):
    key = lambda ctx, run="p": (run, None, "f.py", ctx)
    given = [(*key(1), "a", "1"), (*key(1), "b", None), (*key(1), "a", "1"), (*key(2), "a", "2"), (*key(None), "b", "3"), (*key(None), "a", "4"), (*key(None, None), "a", "5"), (*key(1), "a", "6")]
    given += [(*key(3), "a", str(n % 5)) for n in range(pivot.MOST_PACKED + 1)] + [(*key(4), "other", "x"), (*key(4), "b", "7")]
    logs = spark.createDataFrame([(*r, 1) for r in given], LOGS).coalesce(1)
    rows = [(*(r[c] for c in ("projid", "tstamp", "filename", "ctx_id")), [tuple(h) for h in r["held"]]) for r in pivot.packed(logs, ["a", "b", "c"]).collect()]
    want = [(*key(1), [("a", "1"), ("b", None), ("a", "1")]), (*key(2), [("a", "2")]), (*key(None), [("b", "3"), ("a", "4")]), (*key(None, None), [("a", "5")]), (*key(1), [("a", "6")])]
    assert rows == [*want, *((*key(3), [("a", str(n % 5))]) for n in range(pivot.MOST_PACKED + 1)), (*key(4), [("b", "7")])]
    assert pivot.packed(logs, ["none", "of", "these"]).collect() == []
    # few names are not passed through Arrow: their rows stay apart
    assert sorted(r["held"][0]["value"] for r in pivot.packed(logs, ["a"]).where("ctx_id = 1").collect()) == ["1", "1", "6"]


def test_values_that_a_source_packs_are_those_of_its_rows(spark, sf_dir, monkeypatch):
    names = ("totalprice", "quantity", "tax", "shared")
    long, loops = adapters.orders(spark, sf_dir, names=names)
    packed = adapters.orders(spark, sf_dir, packed=True)[0]
    assert set(packed.columns) ^ set(long.columns) == {"held", "value_name", "value"}
    asked = pivot.packed(packed, list(names))
    assert asked.count() == packed.count() and asked.where("exists(held, h -> h.value_name = 'extendedprice')").isEmpty()
    values = asked.select(*RUN_KEYS, "ctx_id", F.inline("held"))
    assert values.exceptAll(long.select(values.columns)).isEmpty() and values.count() == long.count()
    kept = pivot.packed(packed, ["totalprice"])
    assert 0 < kept.count() < packed.count()
    one, two = (pivot.dataframe(logs, loops, *names) for logs in (packed, long))
    assert one.columns == two.columns and shown(one, one.columns) == shown(two, one.columns)


def test_five_names_are_written_by_rounds_and_joined_before_they_pair_up(spark, sf_dir, monkeypatch):
    written, plain = {}, scratch.materialise
    monkeypatch.setattr(scratch, "materialise", lambda df, name: written.setdefault(name, plain(df, name)))
    monkeypatch.setattr(pivot, "KEYS_PER_TASK", 0)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        found = queries.QUERIES["pivot_five_names"](spark, sf_dir)
        plan = found._jdf.queryExecution().executedPlan().toString()
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    assert 0 < written["pivot"].count() <= table("orders") + table("lineitem")
    # both sides are shuffled once, for their groups and for the join, and no more after it
    assert plan.count("Exchange") == 2 and plan.count("FullOuter") == 1
    assert plan[: plan.index("FullOuter")].count("Generate explode(") == 4


@pytest.mark.parametrize("keys_per_task", [0, 1 << 40])
def test_names_of_two_depths_equal_joined_ones_with_missing_keys(spark, monkeypatch, keys_per_task):
    """Both ways of dealing rows; keys, values and names are missing here and there, and values repeat apart from each other."""
    monkeypatch.setattr(pivot, "KEYS_PER_TASK", keys_per_task)
    monkeypatch.setattr(pivot, "TASK_ROWS", 20)
    rng = random.Random(11)
    loops = [(k, None, "epoch", k if k < 4 else None, f"e{k}") for k in range(1, 6)] + [(10 * k + j, k, "step", j, None) for k in range(1, 6) for j in range(1, 4)]
    rows = []
    for run, (k, j) in itertools.product(("p", None), itertools.product(range(1, 6), range(4))):
        for _ in range(rng.choice((1, 2))):
            for name in ("loss", "grad", "norm") if j else ("acc", "lr", "grad"):
                rows += [(run, None, "f.py", 10 * k + j if j else k, name, rng.choice((None, "1", "2")), 1)] * rng.choice((0, 1, 2))
    rng.shuffle(rows)
    frames = spark.createDataFrame(rows, LOGS), spark.createDataFrame(loops, LOOPS)
    for names in (("acc", "loss", "grad", "norm"), ("loss", "grad", "acc", "lr", "norm"), ("acc", "lr", "loss", "grad")):
        found = pivot.dataframe(*frames, *names)
        alone = [pivot.dataframe(*frames, n) for n in names]
        full = alone[0]
        for part in alone[1:]:
            full = pivot.natural_full_join(full, part)
        assert shown(found, full.columns) == shown(full, full.columns)


def test_what_a_step_shuffled_is_gone_once_it_is_written(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f.name for d in dirs for f in Path(d).rglob("shuffle_*")}
    before = files()
    rows = scratch.spread(spark.range(1000).repartition(7, "id"), "shuffled")
    end = time.time() + 20
    while (left := files() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and rows.count() == 1000


def test_steps_are_written_in_small_files_and_the_session_stays_as_it_was(spark):
    before = spark.conf.get(scratch.CODEC), spark.conf.get(scratch.CLEANUP, None)
    rows = scratch.spread(spark.range(1000), "small")
    assert rows.count() == 1000 and all(f.endswith(".zstd.parquet") for f in rows.inputFiles())
    assert before == (spark.conf.get(scratch.CODEC), spark.conf.get(scratch.CLEANUP, None))
