"""Statements in the lenient dialect against an embedded database that has it natively."""

import json
import math
import random
import sqlite3

import pytest

from runlens.functions import compat, json_text
from runlens.plans import sql
from runlens.plans.dialect import respell

LOGS = "projid string, filename string, ctx_id long, value_name string, value string, value_type int"
LOOPS = "ctx_id long, p_ctx_id long, l_name string, iteration long, l_value string"


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(2)
    values = ["9", "10", "abc", "12x", "-3.5e2x", "0", "", None, "  7", "1e3", "[x]", "a*c", "Ähre", "it's", "99999999999999999999", '{"k": [1, 2.50, {"m": null}], "s": "t", "b": true}', "[]", "3.25"]
    logs = [("p", rng.choice(["a.py", "b.py", "C.py"]), rng.choice([None, *range(1, 9)]), rng.choice(["v", "w"]), rng.choice(values), 1) for _ in range(80)]
    loops = [(k, None if k < 4 else k - 3, "epoch" if k < 4 else "step", k * 3, None if k % 2 else f"t{k}") for k in range(1, 9)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE logs (projid TEXT, filename TEXT, ctx_id INTEGER, value_name TEXT, value TEXT, value_type INTEGER)")
    con.execute("CREATE TABLE loops (ctx_id INTEGER, p_ctx_id INTEGER, l_name TEXT, iteration INTEGER, l_value TEXT)")
    con.executemany("INSERT INTO logs VALUES (?,?,?,?,?,?)", logs)
    con.executemany("INSERT INTO loops VALUES (?,?,?,?,?)", loops)
    return spark.createDataFrame(logs, LOGS), spark.createDataFrame(loops, LOOPS), con


def shown(rows):
    def show(v):
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, float) and math.isfinite(v):
            return f"{v:.6f}"
        return repr(v)

    return sorted(tuple(map(show, r)) for r in rows)


STATEMENTS = [
    "SELECT value FROM logs WHERE value > 10",
    "SELECT value FROM logs WHERE 10 >= value AND value <> 9",
    "SELECT value FROM logs WHERE value BETWEEN 1 AND 3 OR value NOT BETWEEN 0 AND 9",
    "SELECT value FROM logs WHERE value IN (9, 10, 0) OR value NOT IN (9, 12)",
    "SELECT value FROM logs WHERE CAST(value AS REAL) > 8.5",
    "SELECT value, CAST(value AS INTEGER), CAST(value AS REAL), CAST(ctx_id AS TEXT) || 'x' FROM logs",
    "SELECT 7 / 2, -7 / 2, 7.0 / 2, 1 / 0, 1.5 / 0, 9223372036854775807 / 3, 7 / 2 / 2.0, 2 * 7 / 4 - 1, (1 + 2) / 2",
    "SELECT ctx_id / 2, ctx_id / 2 * 2, (ctx_id + 1) / (ctx_id - 1), count(*) FROM logs GROUP BY ctx_id",
    "SELECT l.ctx_id, p.iteration / 2 FROM logs l JOIN loops p ON l.ctx_id = p.ctx_id AND p.iteration / 2 > 3",
    "SELECT max(ctx_id, 3), min(ctx_id, 3, 5), max(value, 'b') FROM logs",
    "SELECT value FROM logs WHERE value GLOB '[0-9]*' OR value GLOB '*[*]*' OR value GLOB '?' OR value GLOB '[^a-z]x]'",
    "SELECT value, value NOT GLOB '*x', filename LIKE 'c%', filename NOT LIKE '%PY' FROM logs",
    "SELECT value FROM logs WHERE value GLOB substr(filename, 1, 1) || '*'",
    "SELECT value IS 'abc', value IS NOT '9', value IS NULL, value NOTNULL, ctx_id ISNULL, ctx_id IS NOT NULL FROM logs",
    "SELECT filename, total(value), total(ctx_id) FROM logs GROUP BY filename",
    "SELECT total(value) FROM logs WHERE 0 = 1",
    "SELECT total(ctx_id) FILTER (WHERE value_name = 'v') AS t, count(*) FROM logs",
    "SELECT filename, ctx_id, total(ctx_id) OVER (PARTITION BY filename) AS t FROM logs",
    "SELECT group_concat(DISTINCT value_name) IN ('v,w', 'w,v') AS d FROM logs",
    "SELECT filename, value, max(iteration) FROM (SELECT filename, value || value_name || projid AS value, logs.ctx_id * 1000 + length(value) AS iteration FROM logs WHERE value IN ('9', '10', 'abc') AND ctx_id = 5) GROUP BY filename",
    "SELECT p.l_name, p.l_value AS which, min(p.iteration) AS low FROM loops p GROUP BY p.l_name ORDER BY 1 LIMIT 5",
    "SELECT l_name, max(iteration) AS m FROM loops GROUP BY l_name HAVING max(iteration) / 2 > 4 UNION SELECT value_name, count(*) / 2 FROM logs GROUP BY value_name",
    "SELECT CASE WHEN value = 9 THEN 'nine' WHEN value IS 'abc' THEN 'it''s' ELSE iif(ctx_id IS NOT 2, 'x', 'y') END FROM logs",
    "SELECT quote(value), ifnull(value, '-'), nullif(value, '9'), \"value\", [filename], unicode(value_name) FROM logs WHERE value <> ''",
    "WITH s AS (SELECT ctx_id / 2 AS h FROM logs) SELECT h, count(*) FROM s WHERE h < 3 GROUP BY h",
    "SELECT value FROM logs WHERE EXISTS (SELECT 1 FROM loops WHERE loops.ctx_id = logs.ctx_id AND loops.iteration > 7) -- why\n AND /* not */ value_type = 1",
    "SELECT value FROM logs WHERE ctx_id IN (SELECT ctx_id FROM loops WHERE iteration / 3 >= 2)",
    "SELECT date('2023-01-31', '+1 month'), date('2024-01-31', '+1 month'), date('2024-03-31', '-1 month'), date('2024-02-29', '+1 year'), date('2024-02-29', '-4 years')",
    "SELECT datetime('2024-05-15T13:45:10', 'start of month', '-1 day'), datetime('2024-05-15 13:45', 'start of year', '+36 hours'), datetime('2024-05-15', '-90 minutes', '+1.5 seconds'), time('2024-05-15 01:02:03', '+12:30')",
    "SELECT date('2024-05-15', 'weekday 0'), date('2024-05-15', 'weekday 3'), date('2024-05-19', 'weekday 0'), date('2024-05-15', 'start of month', '+1 month', '-1 day', 'weekday 5')",
    "SELECT strftime('%Y-%m-%dT%H:%M:%S, year %Y %% %j %w %W %f', '2024-12-30 23:59:58.125'), strftime('%s', '2024-01-01') + 0, unixepoch('1969-12-31 23:59:59'), julianday('2024-02-29 06:00')",
    "SELECT datetime(1700000000, 'unixepoch'), date(2460000.5), date('nonsense'), date(NULL), datetime(1700000000, 'unixepoch', 'start of day', '+1 month')",
    "SELECT '{\"k\": [1, 2]}' -> '$.k' AS a, '{\"k\": \"x\"}' ->> 'k' AS b, json_extract('{\"k\": {\"m\": 5}}', '$.k.m') || '' AS c",
    "SELECT e.key || '', e.type, e.atom IS NULL, e.fullkey, e.path FROM logs, json_each(logs.value) AS e WHERE logs.value LIKE '{%'",
    "SELECT t.key || '', t.type, t.value || '', t.fullkey, t.path FROM logs JOIN json_tree(logs.value) t WHERE logs.value LIKE '{%'",
    "SELECT json_set('{\"a\":1}', '$.a', 2, '$.b', 'x', '$.c', NULL), json_set('{\"a\":[1,2]}', '$.a[1]', 9, '$.a[#]', 10, '$.a[#-1]', 11), json_set('{\"a\":1.50}', '$.x.y[0].z', 1.5)",
    "SELECT json_insert('{\"a\":1}', '$.a', 2, '$.b', json('[1, {\"q\": 2}]')), json_replace('{\"a\":1}', '$.a', 'é', '$.b', 2), json_replace('[1,2]', '$[5]', 0)",
    "SELECT json_remove('{\"a\":1,\"b\":[1,2,3]}', '$.a', '$.b[1]', '$.zz'), json_remove('[1]', '$'), json_patch('{\"a\":{\"x\":1,\"y\":2},\"b\":3}', '{\"a\":{\"y\":null,\"z\":[1]},\"b\":null}')",
    "SELECT ctx_id, value, sum(ctx_id) OVER (PARTITION BY filename ORDER BY ctx_id GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s, count(*) OVER (ORDER BY ctx_id DESC GROUPS 2 PRECEDING) AS n FROM logs WHERE ctx_id > 0",
    "SELECT value, max(ctx_id) OVER (ORDER BY value GROUPS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING EXCLUDE NO OTHERS) FROM logs l",
    "SELECT ctx_id, sum(ctx_id) OVER (PARTITION BY filename ORDER BY ctx_id RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS a, count(value) OVER (ORDER BY ctx_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS b FROM logs WHERE ctx_id IS NOT NULL",
    "SELECT ctx_id, avg(ctx_id) OVER (ORDER BY ctx_id GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS a, count(*) OVER (ORDER BY ctx_id GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS b, sum(ctx_id) OVER (ORDER BY ctx_id GROUPS BETWEEN 2 PRECEDING AND 1 PRECEDING EXCLUDE GROUP) AS c FROM (SELECT * FROM logs WHERE ctx_id < 6) AS s",
    "SELECT iteration, sum(iteration) OVER (ORDER BY ctx_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS s, avg(iteration) OVER (ORDER BY ctx_id ROWS BETWEEN CURRENT ROW AND CURRENT ROW EXCLUDE CURRENT ROW) AS none FROM loops",
]


@pytest.mark.parametrize("statement", STATEMENTS)
def test_as_in_an_embedded_database(both, statement):
    logs, loops, con = both
    if "->" in statement and sqlite3.sqlite_version_info < (3, 38) or "unixepoch(" in statement and sqlite3.sqlite_version_info < (3, 38):
        pytest.skip("the library at hand is too old")
    found = sql.query(logs, loops, statement, typed=False)
    assert shown(map(tuple, found.collect())) == shown(con.execute(statement).fetchall())


def test_group_concat(both):
    logs, loops, con = both
    for each in ("group_concat(value)", "group_concat(value, ' - ')", "group_concat(ctx_id, '')"):
        statement = f"SELECT filename, {each} AS g FROM logs GROUP BY filename"
        cut = " - " if "-" in each else "" if "''" in each else ","
        sets = [{r[0]: sorted(r[1].split(cut) if cut else r[1]) for r in rows} for rows in (sql.query(logs, loops, statement, typed=False).collect(), con.execute(statement).fetchall())]
        assert sets[0] == sets[1]
    ordered = "SELECT group_concat(value, '|' ORDER BY value DESC) AS g FROM logs WHERE value IN ('9', '10')"
    n = con.execute("SELECT count(*) FILTER (WHERE value = '9'), count(*) FILTER (WHERE value = '10') FROM logs").fetchone()
    assert sql.query(logs, loops, ordered, typed=False).first()["g"] == "|".join(["9"] * n[0] + ["10"] * n[1])


def test_predicates_stay_plain(spark, both):
    """What is respelled is ordinary SQL: joins keep their keys, filters reach the scan."""
    logs, loops, _ = both
    found = sql.query(logs, loops, "SELECT count(*) AS n FROM logs l JOIN loops p ON l.ctx_id = p.ctx_id WHERE p.iteration > 3", typed=False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan
    assert not [f.name for f in spark.catalog.listFunctions() if f.name.startswith("runlens_mark")]


BAD = [
    "INSERT OVERWRITE DIRECTORY '{}' USING parquet SELECT 1", "WITH s AS (SELECT 1 AS a) INSERT INTO t SELECT * FROM s", "FROM VALUES (8) AS v(a) INSERT INTO t SELECT a INSERT INTO t SELECT a + 1",
    "INSERT INTO t VALUES (1)", "DROP TABLE t", "CREATE TABLE u AS SELECT 1 AS a", "CREATE TEMPORARY VIEW v AS SELECT 1", "SET x.y=1", "DELETE FROM t WHERE a / 2 > 0", "CACHE TABLE logs", "BEGIN SELECT 1; END",
    "SELECT TRANSFORM(value) USING 'cat' AS (x) FROM logs", "SELECT reflect('java.lang.System', 'nanoTime')", "SELECT value FROM logs WHERE value IN (SELECT java_method('java.lang.System', 'lineSeparator'))", "WITH s AS (SELECT reflect('java.lang.System', 'nanoTime') AS a) SELECT * FROM s",
]


@pytest.mark.parametrize("lenient", [True, False])
@pytest.mark.parametrize("statement", BAD)
def test_only_reading_statements(spark, both, tmp_path, statement, lenient):
    logs, loops, _ = both
    spark.sql("CREATE TABLE IF NOT EXISTS t (a INT) USING parquet")
    try:
        with pytest.raises(Exception) as why:
            sql.query(logs, loops, statement.format(tmp_path / "out"), typed=False, lenient=lenient)
        assert isinstance(why.value, ValueError) or "ParseException" in type(why.value).__name__
        assert spark.table("t").count() == 0 and not (tmp_path / "out").exists()
    finally:
        spark.sql("DROP TABLE t")


def test_reading_statements_pass(both):
    logs, loops, _ = both
    for good in ("SELECT 1 AS a", "WITH s AS (SELECT 1 AS a) SELECT * FROM s", "VALUES (1)", "SELECT (SELECT max(ctx_id) FROM loops) AS m", "SELECT a FROM (SELECT 1 AS a UNION ALL SELECT 2) EXCEPT SELECT 2"):
        assert sql.query(logs, loops, good, typed=False).count() >= 1


def test_typed_results_are_computed_once(both):
    """Values of a statement that isn't deterministic keep their inferred type."""
    logs, loops, _ = both
    found = sql.query(logs, loops, "SELECT CAST(CAST(rand() * 1000000 AS BIGINT) AS STRING) AS x FROM logs")
    assert found.collect() == found.collect() and found.schema["x"].dataType.typeName() in ("long", "integer")


def test_statements_with_other_names(spark, both):
    logs, loops, _ = both
    compat.register(spark)
    assert respell(spark, "SELECT 1") == "SELECT 1"
    assert sql.query(logs, loops, "SELECT 'a\\b' AS x, 'say \"it''s\"' AS y", typed=False).first() == ("a\\b", 'say "it\'s"')
    with pytest.raises(ValueError):
        respell(spark, "SELECT (1))")
    for bad in ("SELECT min(a) OVER (ORDER BY a ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) FROM t", "SELECT sum(a) OVER (ORDER BY a ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) FROM t", "SELECT sum(a) OVER (ORDER BY a GROUPS 1 PRECEDING) FROM t JOIN u"):
        with pytest.raises(ValueError):
            respell(spark, bad)
    with pytest.raises(ValueError):
        respell(spark, "SELECT date('2024-01-01', '+1 fortnight')")


def test_json_edits_keep_numbers_and_reject_other_texts():
    assert json_text.edit("set", '{"a": 1.50, "b": 1e3}', ["$.c"], ["[2]"]) == '{"a":1.50,"b":1e3,"c":2}'
    assert json_text.edit("set", "no json", ["$.c"], ["[2]"]) is None and json_text.edit("set", None, [], []) is None
    with pytest.raises(ValueError):
        json_text.steps("a.b")
    deep = json.dumps({"k": {"q q": [0, {"z": 1}]}})
    assert json_text.edit("replace", deep, ['$.k."q q"[1].z'], ['["new"]']) == '{"k":{"q q":[0,{"z":"new"}]}}'
