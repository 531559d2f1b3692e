"""Every registered core query against its SQL on the smallest tables."""

import pytest
from support import canonical, oracle_rows

from runlens import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    rows = found.collect()
    columns, expected = oracle_rows(sf_dir, queries.ORACLE_SQL[name])
    assert canonical(found.columns, rows) == canonical(columns, expected)


def test_entry_point(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["order", "projid", "tstamp", "filename", "line", "totalprice", "quantity"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_point_without_optional_part(monkeypatch):
    """The optional subpackage may be absent; nothing else may fail silently."""
    import importlib

    import __spark_entry__ as entry

    def gone(name, package=None):
        raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(importlib, "import_module", gone)
    assert set(entry.queries()) == set(queries.QUERIES)

    def broken(name, package=None):
        raise ModuleNotFoundError("No module named 'numpy'", name="numpy")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def test_conversations_of_any_length(spark, tmp_path):
    """Turns of a long conversation don't take the next one's contexts."""
    rows = [(c, t, "user", f"c{c}t{t}") for c, n in ((1, 3000), (2, 5), (3, 1)) for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    import __spark_entry__ as entry

    found = entry.queries()["pivot_conversation"](spark, str(tmp_path)).select("conversation", "turn", "role", "text").collect()
    assert sorted(map(tuple, found)) == sorted(rows)
    files = entry.queries()["checkpoint_catalogue"](spark, str(tmp_path)).select("file").collect()
    assert sorted(r["file"] for r in files) == sorted(f"model_conversation_{c}_turn_t{t}.pkl" for c, t, _, _ in rows)
