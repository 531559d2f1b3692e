"""Version logs, run files in pieces, and range joins."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from runlens.operators.joins import range_join
from runlens.sources import runfiles, versions
from test_ingest import run


def test_version_log(spark, tmp_path):
    commits = [
        ("c3", "2024-03-03T10:00:00+02:00", "RUN::auto::2024-03-03T09:59:00\n"), ("c2", "2024-03-03T09:30:00+00:00", "Fix: a line\n\nwith RUN::a::b and RUN::c::d"), ("c1", "2024-03-03T09:00:00+00:00", "RUN::auto::2024-03-02T08:00:00"),
        ("c0", "2024-01-01T00:00:00+00:00", "begin\nRUN::only two"), ("b9", "2023-12-31T00:00:00Z", "RUN::x::no stamp"), ("b8", "2023-12-30T00:00:00Z", ""),
    ]
    (tmp_path / "history").write_text("".join(f"{a}\x1f{b}\x1f{c}\x1e\n" for a, b, c in commits))
    found = versions.newest_first(versions.read_versions(spark, str(tmp_path / "history"), "RUN")).collect()
    assert [r["vid"] for r in found] == ["c1", "c3", "b9"]  # 09:00 and 08:00 in one zone
    assert found[1]["tstamp"] == datetime.datetime(2024, 3, 3, 9, 59) and found[1]["authored"] == "2024-03-03T10:00:00" and found[2]["tstamp"] is None
    (tmp_path / "empty").write_text("")
    assert versions.read_versions(spark, str(tmp_path / "empty"), "RUN").collect() == []


def test_run_files_are_read_in_pieces(spark, tmp_path):
    """A file of many records is split among tasks, and gives the records that reading it whole gives."""
    r = run("2024-01-01T00:00:00", epochs=3)
    tricky = ['{\n  {\n', "\n  }", "[", "}\n]", "é ", [{"a": {"b": []}}], {"k": "\n  {\n"}]
    records = [dict(x, value=tricky[k % len(tricky)], name=f"n{k}") for k, x in enumerate(r.records * 300)]
    runfiles.write_run_file(records, str(tmp_path / "big.json"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        found = runfiles.read_run_files(spark, str(tmp_path / "big.json"))
        pieces = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert len(pieces) > 3 and max(p["count"] for p in pieces) < len(records) / 2
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    show = lambda row: (row[0], row[1], row[2], row[3], row[4], row[5], [tuple(s.values() if isinstance(s, dict) else s) for s in row[6]])
    assert sorted(map(show, rows), key=repr) == sorted(map(show, (runfiles.record_row(x) for x in records)), key=repr)


def test_run_files_in_other_layouts(spark, tmp_path):
    records = run("2024-01-01T00:00:00").records
    for k, layout in enumerate([{}, {"indent": 4}, {"indent": 1}, {"separators": (",", ":")}]):
        (tmp_path / f"{k}.json").write_text(json.dumps(records, **layout))
    (tmp_path / "none.json").write_text("[]")
    runfiles.write_run_file([], str(tmp_path / "empty.json"))
    assert runfiles.read_run_files(spark, str(tmp_path)).count() == 4 * len(records)
    broken = tmp_path / "broken.json"
    runfiles.write_run_file(records, str(broken))
    broken.write_text(broken.read_text()[:-40])
    with pytest.raises(Exception, match="breaks off"):
        runfiles.read_run_files(spark, str(broken)).collect()


@pytest.mark.parametrize("keys", [(), ("g",)])
def test_range_join(spark, keys):
    rng = random.Random(8)
    bounds = [(k, rng.choice([0, 1, None]), a, rng.choice([None, a - 3, a, a + 1, a + rng.randrange(2000), a + 10**9])) for k in range(150) for a in [rng.randrange(-3000, 3000)]]
    points = [(k, rng.choice([0, 1, None]), rng.choice([None, rng.randrange(-3500, 3500)])) for k in range(300)] + [(k, 0, 7) for k in range(900, 950)]
    left = spark.createDataFrame(bounds, "id long, g int, a long, b long").repartition(3)
    right = spark.createDataFrame(points, "no long, g int, p long").repartition(3)
    joined = range_join(left, right if keys else right.withColumnRenamed("g", "h"), F.col("a"), F.col("b"), F.col("p"), keys)
    want = sorted((i, n) for i, g, a, b in bounds for n, h, p in points if b is not None and p is not None and a <= p <= b and (not keys or g is not None and g == h))
    assert sorted((r["id"], r["no"]) for r in joined.collect()) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert range_join(left.limit(0), right.withColumnRenamed("g", "h"), F.col("a"), F.col("b"), F.col("p")).collect() == []
