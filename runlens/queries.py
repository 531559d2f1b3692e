"""Registered queries over the synthetic tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import compat, text
from .operators import joins, runs
from .plans import paths, pivot, schedule, sql
from .schema import RUN_KEYS
from .scratch import remove, shared_dir
from .sources import adapters, checkpoints, tables, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def _pivot(adapter: Callable, *names: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = {"names": names, "packed": True} if adapter is adapters.orders else {}
        return pivot.dataframe(*adapter(spark, sf_dir, **given), *names, **options)

    return run


def _money(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"


# Pivots

_ORDER = "o_orderkey AS \"order\", 'tpch' AS projid, o_orderdate AS tstamp, o_orderpriority AS filename"
_LINE = "CAST(l_linenumber AS BIGINT) AS line"


@_query(f"SELECT DISTINCT {_ORDER}, {_LINE}, {_money('o_totalprice')} AS totalprice, {_money('l_quantity')} AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def pivot_order_line(spark, sf_dir):
    return _pivot(adapters.orders, "totalprice", "quantity")(spark, sf_dir)


@_query(f"SELECT DISTINCT {_ORDER}, {_LINE}, {_money('l_quantity')} AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def pivot_single_name(spark, sf_dir):
    return _pivot(adapters.orders, "quantity")(spark, sf_dir)


_DUP = f"""
SELECT DISTINCT {_ORDER}, CAST(a.l_linenumber AS BIGINT) AS line, {_money('a.l_quantity')} AS quantity, {_money('b.l_tax')} AS tax
FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN lineitem b ON b.l_orderkey = o_orderkey AND b.l_linenumber = a.l_linenumber
"""


@_query(_DUP)
def pivot_dup_logs(spark, sf_dir):
    """Values logged repeatedly in one round pair up with every value of the other name (fused)."""
    return _pivot(adapters.orders, "quantity", "tax")(spark, sf_dir)


@_query(_DUP)
def pivot_dup_logs_joined(spark, sf_dir):
    """The same by full outer joins."""
    return _pivot(adapters.orders, "quantity", "tax", fuse=False)(spark, sf_dir)


@_query(f"SELECT DISTINCT {_ORDER}, {_LINE}, {_money('l_tax')} AS shared FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def pivot_mixed_depth(spark, sf_dir):
    """A name logged at both levels keeps its deepest rows."""
    return _pivot(adapters.orders, "shared")(spark, sf_dir)


@_query(
    f"""
SELECT DISTINCT {_ORDER}, CAST(a.l_linenumber AS BIGINT) AS line, {_money('o_totalprice')} AS totalprice, {_money('a.l_quantity')} AS quantity,
  {_money('b.l_extendedprice')} AS extendedprice, {_money('c.l_tax')} AS tax, {_money('d.l_tax')} AS shared
FROM orders LEFT JOIN lineitem a ON a.l_orderkey = o_orderkey LEFT JOIN lineitem b ON b.l_orderkey = o_orderkey AND b.l_linenumber = a.l_linenumber
LEFT JOIN lineitem c ON c.l_orderkey = o_orderkey AND c.l_linenumber = a.l_linenumber LEFT JOIN lineitem d ON d.l_orderkey = o_orderkey AND d.l_linenumber = a.l_linenumber
"""
)
def pivot_five_names(spark, sf_dir):
    return _pivot(adapters.orders, "totalprice", "quantity", "extendedprice", "tax", "shared")(spark, sf_dir)


@_query(f"SELECT DISTINCT {_ORDER}, {_LINE}, {_money('l_quantity')} AS quantity, CAST(NULL AS VARCHAR) AS absent FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def pivot_unknown_name(spark, sf_dir):
    """A name that nothing logged is an empty column."""
    return _pivot(adapters.orders, "quantity", "absent")(spark, sf_dir)


@_query(f"SELECT 'events' AS projid, date_trunc('day', ts)::TIMESTAMP AS tstamp, event_type AS filename, max(props) AS props, max({_money('value')}) AS \"value\" FROM events GROUP BY 2, 3")
def pivot_star_runs(spark, sf_dir):
    return _pivot(adapters.events)(spark, sf_dir)


@_query(
    """
SELECT d.doc_id AS document, 'docs' AS projid, TIMESTAMP '2024-01-01 00:00:00' AS tstamp, d.source AS filename, d.lang AS lang, CAST(l.quality AS VARCHAR) AS quality
FROM documents d LEFT JOIN labels l USING (doc_id)
"""
)
def pivot_feedback(spark, sf_dir):
    """Labels logged for some documents only."""
    return _pivot(adapters.documents, "lang", "quality")(spark, sf_dir)


_TURN = "c.conv_id AS conversation, c.turn AS turn, 't' || c.turn AS turn_value, 'chat' AS projid, TIMESTAMP '2024-01-01 00:00:00' AS tstamp, 'chat.py' AS filename"


@_query(f"SELECT DISTINCT {_TURN}, c.role AS role, c.text AS text FROM conversations c")
def pivot_conversation(spark, sf_dir):
    return _pivot(adapters.conversations, "role", "text")(spark, sf_dir)


@_query(
    f"""
SELECT * FROM (SELECT 'events' AS projid, date_trunc('day', ts)::TIMESTAMP AS tstamp, event_type AS filename, max(props) AS props,
  max({_money('value')})::DOUBLE AS "value" FROM events GROUP BY 2, 3)
"""
)
def pivot_typed(spark, sf_dir):
    return _pivot(adapters.events, typed=True)(spark, sf_dir)


# Picking runs


@_query(
    f"""
SELECT 'events' AS projid, date_trunc('day', ts)::TIMESTAMP AS tstamp, event_type AS filename, max(props) AS props, max({_money('value')}) AS "value"
FROM events WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events) GROUP BY 2, 3
"""
)
def latest_runs(spark, sf_dir):
    return runs.latest(pivot.star(adapters.events(spark, sf_dir)[0]))


@_query(
    """
SELECT d.doc_id AS document, 'docs' AS projid, TIMESTAMP '2024-01-01 00:00:00' AS tstamp, d.source AS filename, d.lang AS lang, CAST(NULL AS VARCHAR) AS quality, CAST(NULL AS VARCHAR) AS grade
FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)
"""
)
def missing_values(spark, sf_dir):
    """Documents without a quality; a name never logged counts as a null column."""
    full = _pivot(adapters.documents, "lang", "quality")(spark, sf_dir)
    return runs.with_missing(runs.missing_any(full, ["quality"]), ["grade"])


@_query(f"SELECT {_ORDER}, {_money('o_totalprice')} AS totalprice FROM orders ORDER BY CAST({_money('o_totalprice')} AS DOUBLE) DESC, o_orderkey LIMIT 10")
def best_run_topk(spark, sf_dir):
    return runs.best(_pivot(adapters.orders, "totalprice")(spark, sf_dir), "totalprice", 10, ties=["order"])


@_query(f"SELECT {_ORDER}, {_money('o_totalprice')} AS totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderdate, o_orderpriority ORDER BY o_orderkey DESC) = 1")
def slice_last(spark, sf_dir):
    return runs.pick_iterations(_pivot(adapters.orders, "totalprice")(spark, sf_dir), RUN_KEYS, ["order"])


@_query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 IN (0, 2)")
def slice_index(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return runs.pick_iterations(turns, ["conv_id"], ["turn"], ["0", "2", "x"]).select("conv_id", "turn", "role", "text")


@_query(
    """
SELECT user_id, event_id, CASE WHEN nth < h THEN 'first' ELSE 'last' END AS part FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth, count(*) OVER (PARTITION BY user_id) AS n, count(*) OVER (PARTITION BY user_id) // 2 AS h FROM events)
WHERE (nth < h AND nth < 3) OR (nth >= h AND nth >= n - 3)
"""
)
def first_and_last(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id")
    return runs.first_and_last(rows, ["user_id"], ["event_id"], 3)


@_query("SELECT user_id, event_type, n AS votes FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def majority_vote(spark, sf_dir):
    return runs.majority(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], "event_type")


@_query("SELECT user_id, bool_and(coalesce(before <= value, true)) AS monotonic FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id")
def monotonic(spark, sf_dir):
    return runs.non_decreasing(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], ["ts", "event_id"], "value")


# Costs

_RUNS = """
t AS (SELECT o_custkey, c_mktsegment, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS epoch FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT 'train' AS projid, make_timestamp(o_custkey * 1000000) AS tstamp, c_mktsegment AS filename, o_custkey, CAST(CAST(max(c_acctbal) AS DECIMAL(18,2)) AS VARCHAR) AS lr,
  CAST(count(*) AS DOUBLE) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_mktsegment),
e AS (SELECT o_custkey, max(epoch) AS num_epochs, sum(o_orderkey * CAST(0.5 AS DOUBLE)) AS nested FROM t GROUP BY o_custkey),
c AS (SELECT r.*, CAST(n * CAST(0.5 AS DOUBLE) AS VARCHAR) AS "delta::prefix", CAST(n * CAST(0.25 AS DOUBLE) AS VARCHAR) AS "delta::suffix", e.num_epochs, n * 100.0 - nested AS marginal, n * 100.0 AS coarse_loop FROM r JOIN e USING (o_custkey))
"""
_KEYS = "projid, tstamp, filename"


def _costs(spark, sf_dir, level, mark="suffix"):
    return schedule.estimate(*adapters.trainings(spark, sf_dir), level, mark)


@_query(f'WITH {_RUNS} SELECT {_KEYS}, lr, "delta::prefix", n * 0.5 AS composite FROM c')
def cost_level0_prefix(spark, sf_dir):
    return _costs(spark, sf_dir, 0, "prefix")


@_query(f'WITH {_RUNS} SELECT {_KEYS}, lr, "delta::prefix", "delta::suffix", n * 0.75 + 1 AS composite FROM c')
def cost_level0(spark, sf_dir):
    return _costs(spark, sf_dir, 0)


@_query(f'WITH {_RUNS} SELECT {_KEYS}, lr, num_epochs, marginal, "delta::prefix", "delta::suffix", num_epochs + marginal + n * 0.75 AS composite FROM c')
def cost_level1(spark, sf_dir):
    return _costs(spark, sf_dir, 1)


@_query(f'WITH {_RUNS} SELECT {_KEYS}, lr, coarse_loop, num_epochs, "delta::prefix", "delta::suffix", coarse_loop + n * 0.75 AS composite FROM c')
def cost_level2(spark, sf_dir):
    return _costs(spark, sf_dir, 2)


@_query(f'WITH {_RUNS} SELECT {_KEYS}, lr, coarse_loop, num_epochs, "delta::prefix", "delta::suffix", coarse_loop + n * 0.75 AS composite FROM c WHERE num_epochs > 10 AND CAST(lr AS DOUBLE) > 0')
def schedule_where(spark, sf_dir):
    return schedule.where(_costs(spark, sf_dir, 2), "num_epochs > 10 AND CAST(lr AS DOUBLE) > 0")


@_query(f"WITH {_RUNS} SELECT sum(coarse_loop + n * 0.75) AS total FROM c")
def schedule_total(spark, sf_dir):
    return schedule.total_cost(_costs(spark, sf_dir, 2))


@_query("SELECT 'tpch' AS projid, o_orderdate AS tstamp, max(o_orderpriority) AS filename FROM orders GROUP BY o_orderdate")
def schedule_dims(spark, sf_dir):
    return schedule.last_of_each_run(_pivot(adapters.orders, "totalprice")(spark, sf_dir))


@_query("SELECT 'tpch' AS projid, o_orderdate AS tstamp, max(o_orderpriority) AS filename, min_by('v' || o_orderkey, o_orderkey) AS vid FROM orders GROUP BY o_orderdate")
def schedule_versions(spark, sf_dir):
    """Version ids looked up by time stamp in an exported history; the first commit of a stamp wins."""
    return schedule.with_versions(_pivot(adapters.orders, "totalprice")(spark, sf_dir), _history(spark, sf_dir))


def _history(spark, sf_dir):
    """Orders as commits of runs, every fifth one with a commit between that belongs to none, written and read back."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.timestamp_seconds(F.lit(946684800) + F.col("o_orderkey"))
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    commit = lambda vid, message: F.concat_ws("\x1f", vid, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss+00:00"), message)
    own = commit(F.concat(F.lit("v"), "o_orderkey"), F.concat(F.lit("RUN::auto::"), stamp, F.lit("\n")))
    other = commit(F.concat(F.lit("x"), "o_orderkey"), F.concat(F.lit("Mend it\n\nRUN:: twice RUN::"), stamp))
    lines = o.select(F.explode(F.when(F.col("o_orderkey") % 5 == 0, F.array(own, other)).otherwise(F.array(own))).alias("value"))
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    lines.write.option("lineSep", "\x1e").text(path)
    return versions.read_versions(spark, path, "RUN")


@_query("SELECT 'v' || o_orderkey AS vid, o_orderdate AS tstamp, strftime(TIMESTAMP '2000-01-01' + to_seconds(o_orderkey), '%Y-%m-%dT%H:%M:%S') AS authored FROM orders ORDER BY o_orderkey DESC LIMIT 100")
def versions_newest(spark, sf_dir):
    """The hundred newest commits of runs."""
    return versions.newest_first(_history(spark, sf_dir)).limit(100).select("vid", "tstamp", "authored")


@_query(f"WITH {_RUNS} SELECT {_KEYS}, 'python ' || filename || ' --replay grad,acc epoch=' || array_to_string(range(0, num_epochs), ',') || ', step=1' AS command FROM c")
def replay_commands(spark, sf_dir):
    return schedule.replay_commands(_costs(spark, sf_dir, 2), ["grad", "acc"], 2)


_LOSS = f"SELECT r.o_custkey AS k, max(CAST({_money('l_tax')} AS DOUBLE)) AS most, count(*) AS n FROM r JOIN orders o ON o.o_custkey = r.o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r.o_custkey"


@_query(f'WITH {_RUNS}, x AS ({_LOSS}) SELECT {_KEYS}, lr, "delta::prefix", "delta::suffix", n * 0.75 + 1 AS composite FROM c WHERE o_custkey IN (SELECT k FROM x WHERE most > 0.07) AND n * 0.75 + 1 > 4')
def schedule_where_logged(spark, sf_dir):
    """A condition over a name logged in nested loops, and over the schedule."""
    logs, loops = adapters.trainings(spark, sf_dir)
    return schedule.where_logged(schedule.estimate(logs, loops, 0), logs, loops, ["loss"], "loss > 0.07 AND composite > 4")


@_query(f'WITH {_RUNS}, x AS ({_LOSS}) SELECT {_KEYS}, lr, "delta::prefix", "delta::suffix", n * 0.75 + 1 AS composite FROM c WHERE o_custkey NOT IN (SELECT k FROM x) OR o_custkey % 3 <> 0')
def schedule_lacking(spark, sf_dir):
    """Runs without a loss, or without a grade, which every third run has."""
    logs, loops = adapters.trainings(spark, sf_dir)
    graded = logs.where("value_name = 'lr' AND unix_timestamp(CAST(tstamp AS TIMESTAMP)) % 3 = 0").withColumn("value_name", F.lit("grade"))
    return schedule.lacking(schedule.estimate(logs, loops, 0), logs.unionByName(graded), ["loss", "grade"])


@_query(
    f"WITH {_RUNS} SELECT DISTINCT t.epoch AS epoch, CAST(l_linenumber AS BIGINT) AS step, {_KEYS}, {_money('l_tax')} AS loss, lr FROM c "
    "JOIN t USING (o_custkey) JOIN lineitem ON l_orderkey = t.o_orderkey WHERE n > 10"
)
def schedule_after_replay(spark, sf_dir):
    """The pivot over the runs that a condition picked."""
    logs, loops = adapters.trainings(spark, sf_dir)
    picked = schedule.where(schedule.estimate(logs, loops, 2), "num_epochs > 10")
    return schedule.after_replay(picked, logs, loops, "loss", "lr")


@_query(
    "SELECT o_orderkey, CASE WHEN o_totalprice / 300 < 10 THEN 'under 10 seconds' WHEN o_totalprice / 300 < 100 THEN 'under 2 minutes' WHEN o_totalprice / 300 < 1000 THEN 'up to 15 minutes' ELSE 'more than 15 minutes' END AS phrase FROM orders"
)
def discretize(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.discretize(F.col("o_totalprice") / 300).alias("phrase"))


# Relations


@_query("SELECT DISTINCT o_orderdate AS tstamp FROM orders")
def known_tstamps(spark, sf_dir):
    return tables.known_stamps(adapters.orders(spark, sf_dir)[0])


_HALF = "(SELECT date_trunc('year', max(o_orderdate)) FROM orders)"
_FRESH = f"SELECT 'tpch' AS projid, o_orderdate AS tstamp, o_orderpriority AS filename, o_orderkey * 8 AS ctx_id, 'totalprice' AS value_name, {_money('o_totalprice')} AS \"value\", 1 AS value_type FROM orders"


def _ingested(spark, sf_dir):
    logs = adapters.orders(spark, sf_dir, names=("totalprice",))[0]
    year = logs.agg(F.date_trunc("year", F.max("tstamp")).alias("_year"))
    # every third day before the last year is known
    known = logs.join(F.broadcast(year), F.col("tstamp") < F.col("_year")).where("dayofyear(tstamp) % 3 = 0").drop("_year")
    return logs, known


@_query(f"{_FRESH} WHERE NOT (o_orderdate < {_HALF} AND dayofyear(o_orderdate) % 3 = 0)")
def unpack_incremental(spark, sf_dir):
    """Runs that aren't known yet, gaps included."""
    return tables.unseen(*_ingested(spark, sf_dir))


@_query(f"{_FRESH} WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < {_HALF} AND dayofyear(o_orderdate) % 3 = 0)")
def unpack_newer(spark, sf_dir):
    """Only runs newer than the newest known one."""
    return tables.unseen(*_ingested(spark, sf_dir), newer_only=True)


# A store of several versions


def _stored(spark: SparkSession, *batches: tuple[DataFrame, DataFrame], **options) -> tables.Store:
    """A store in the shared folder, with one commit a batch."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    atexit.register(remove, spark, root)
    store = tables.Store(spark, root).create()
    for logs, loops in batches:
        store.append(logs, loops, **options)
    return store


def _by_year(spark, sf_dir):
    """Orders in two batches, cut at a year: the first has the loops of all orders, the second those of all lines."""
    logs, loops = adapters.orders(spark, sf_dir)
    early = F.col("tstamp") < F.lit("1996-01-01").cast("timestamp_ntz")
    return (logs.where(early), loops.where("l_name = 'order'")), (logs.where(~early), loops.where("l_name = 'line'"))


@_query(ORACLE_SQL["pivot_order_line"])
def store_pivot(spark, sf_dir):
    """The pivot over a store's newest version: chains come from the table kept at ingestion."""
    held = _stored(spark, *_by_year(spark, sf_dir)).snapshot()
    return pivot.dataframe(held.logs(), held.loops(), "totalprice", "quantity", paths=held.paths())


@_query(f"SELECT 'tpch' AS projid, o_orderdate AS tstamp, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY o_orderdate")
def store_snapshot(spark, sf_dir):
    """An older version stays as it was when its reader opened it."""
    store = _stored(spark, *_by_year(spark, sf_dir))
    first = store.snapshot(2)
    store.compact()
    return first.logs().where("value_name = 'totalprice'").groupBy("projid", "tstamp").agg(F.count("*").alias("n"))


@_query("SELECT o_orderkey * 8 AS ctx_id, CAST(NULL AS BIGINT) AS p_ctx_id, 'order' AS l_name, o_orderkey AS iteration, CAST(NULL AS VARCHAR) AS l_value FROM orders")
def store_compacted(spark, sf_dir):
    """Loops that several batches brought in, after compaction."""
    logs, loops = adapters.orders(spark, sf_dir)
    own = logs.where("value_name = 'totalprice'"), loops.where("l_name = 'order'")
    store = _stored(spark, own, own, new_contexts=True)
    return store.compact().loops()


@_query(ORACLE_SQL["unpack_incremental"])
def store_unpack(spark, sf_dir):
    """Runs that a store doesn't have, told from its table of runs alone."""
    logs, known = _ingested(spark, sf_dir)
    held = _stored(spark, (known, adapters.orders(spark, sf_dir)[1].limit(0))).snapshot()
    return tables.unseen(logs, tables.near(held.runs(), logs))


@_query("SELECT DISTINCT l_orderkey * 8 + l_linenumber AS ctx_id, l_orderkey * 8 AS p_ctx_id, 'line' AS l_name, CAST(l_linenumber AS BIGINT) AS iteration, CAST(NULL AS VARCHAR) AS l_value FROM lineitem")
def dedupe_loops(spark, sf_dir):
    loops = adapters.orders(spark, sf_dir)[1].where("l_name = 'line'")
    return paths.distinct_loops(loops.unionByName(loops.where("iteration < 4")).unionByName(loops))


@_query(f"SELECT DISTINCT * FROM ({_FRESH} WHERE o_orderpriority LIKE '1%')")
def distinct_logs(spark, sf_dir):
    logs = adapters.orders(spark, sf_dir)[0]
    return tables.distinct_logs(logs.unionByName(logs.where("ctx_id % 3 = 0")), "value_name = 'totalprice' AND filename LIKE '1%'")


_PATHS = """
SELECT o_orderkey * 8 AS ctx_id, 1 AS depth, 'order=' || o_orderkey AS path FROM orders
UNION ALL SELECT DISTINCT l_orderkey * 8 + l_linenumber, 2, 'order=' || l_orderkey || '/line=' || l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select("ctx_id", "depth", F.array_join(F.transform("path", lambda s: F.concat(s["name"], F.lit("="), s["iteration"])), "/").alias("path"))


@_query(_PATHS)
def ctx_paths(spark, sf_dir):
    return _shown(paths.context_paths(adapters.orders(spark, sf_dir)[1]))


@_query(_PATHS)
def ctx_paths_recursive(spark, sf_dir):
    return _shown(paths.context_paths_sql(adapters.orders(spark, sf_dir)[1]))


@_query(f"SELECT 'order: ' || o_orderkey || ', totalprice: ' || {_money('o_totalprice')} AS line FROM orders")
def console_lines(spark, sf_dir):
    logs, loops = adapters.orders(spark, sf_dir)
    rows = pivot.resolved(logs, paths.context_paths(loops.where("l_name = 'order'")), ["totalprice"])
    return rows.select(text.describe(F.col("path"), F.col("value_name"), F.col("value")).alias("line"))


@_query("SELECT 'model_conversation_' || conv_id || '_turn_t' || turn || '.pkl' AS file, 'model' AS object, 'object' AS kind, 2 AS n_steps, 't' || turn AS last FROM conversations")
def checkpoint_catalogue(spark, sf_dir):
    """File names made from context paths, and parsed back."""
    logs, loops = adapters.conversations(spark, sf_dir)
    rows = pivot.resolved(logs, paths.context_paths(loops), ["role"])
    named = rows.select(text.checkpoint_name(F.col("path"), F.lit("model"), F.lit(".pkl")).alias("file"))
    parsed = checkpoints.parse_paths(named.withColumn("path", F.concat(F.lit("/store/chat/2024-01-01T00:00:00/"), "file")))
    return parsed.select("file", "object", "kind", F.size("steps").alias("n_steps"), F.element_at("steps", -1)["value"].alias("last"))


# SQL over the relations

_EVENTS = f"""
logs AS (SELECT 'events' AS projid, date_trunc('day', ts)::TIMESTAMP AS tstamp, event_type AS filename, CAST(NULL AS BIGINT) AS ctx_id, 'value' AS value_name, {_money('"value"')} AS "value", 1 AS value_type FROM events
  UNION ALL SELECT 'events', date_trunc('day', ts)::TIMESTAMP, event_type, NULL, 'props', props, 1 FROM events
  UNION ALL SELECT 'events', date_trunc('day', ts)::TIMESTAMP, event_type, user_id * 2 + 1, 'seen', CAST(event_id AS VARCHAR), 1 FROM events),
loops AS (SELECT DISTINCT user_id * 2 + 1 AS ctx_id, CAST(NULL AS BIGINT) AS p_ctx_id, 'user' AS l_name, user_id AS iteration, CAST(NULL AS VARCHAR) AS l_value FROM events)
"""


def _sql(statement: str, adapter: Callable = adapters.events, lenient: bool = False):
    def run(spark, sf_dir):
        return sql.query(*adapter(spark, sf_dir), statement, typed=False, lenient=lenient)

    return run


_JOIN = "SELECT l.filename, p.iteration AS user_no, count(*) AS n FROM logs l JOIN loops p ON l.ctx_id = p.ctx_id WHERE l.value_name = 'seen' GROUP BY l.filename, p.iteration"
_SETS = "SELECT iteration AS no FROM loops INTERSECT SELECT CAST(value AS BIGINT) FROM logs WHERE value_name = 'seen' UNION SELECT -1 EXCEPT SELECT 3"
_WINDOW = "SELECT filename, tstamp, n, rank() OVER (PARTITION BY filename ORDER BY n DESC) AS place, sum(n) OVER (PARTITION BY filename ORDER BY tstamp) AS so_far FROM (SELECT filename, tstamp, count(*) AS n FROM logs WHERE value_name = 'value' GROUP BY filename, tstamp) AS g"
_GROUP = "SELECT filename, count(*) AS n, count(DISTINCT tstamp) AS days, max(CAST(value AS DOUBLE)) AS most, count(*) FILTER (WHERE CAST(value AS DOUBLE) > 50) AS large FROM logs WHERE value_name = 'value' GROUP BY filename HAVING count(*) > 10"
_RECURSE = "WITH RECURSIVE walk(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM walk WHERE n < 20) SELECT walk.n AS n, walk.total AS total, count(loops.ctx_id) AS users FROM walk LEFT JOIN loops ON loops.iteration = walk.n GROUP BY walk.n, walk.total"


@_query(f"WITH {_EVENTS} {_JOIN}")
def sql_join(spark, sf_dir):
    return _sql(_JOIN)(spark, sf_dir)


@_query(f"WITH {_EVENTS} {_SETS}")
def sql_setops(spark, sf_dir):
    return _sql(_SETS)(spark, sf_dir)


@_query(f"WITH {_EVENTS} {_WINDOW}")
def sql_window(spark, sf_dir):
    return _sql(_WINDOW)(spark, sf_dir)


@_query(f"WITH {_EVENTS} {_GROUP}")
def sql_group(spark, sf_dir):
    return _sql(_GROUP)(spark, sf_dir)


@_query(_RECURSE.replace("WITH RECURSIVE", f"WITH RECURSIVE {_EVENTS},"))
def sql_recursive(spark, sf_dir):
    return _sql(_RECURSE)(spark, sf_dir)


@_query(f"WITH {_EVENTS} SELECT filename, json_extract_string(\"value\", '$.k') AS k, count(*) AS n FROM logs WHERE value_name = 'props' GROUP BY ALL")
def sql_json(spark, sf_dir):
    return _sql("SELECT filename, get_json_object(value, '$.k') AS k, count(*) AS n FROM logs WHERE value_name = 'props' GROUP BY filename, get_json_object(value, '$.k')")(spark, sf_dir)


@_query(f"WITH {_EVENTS} SELECT tstamp, filename, CAST(\"value\" AS DOUBLE) AS \"value\" FROM logs WHERE value_name = 'value'")
def infer_types_query(spark, sf_dir):
    logs, loops = adapters.events(spark, sf_dir)
    return sql.query(logs, loops, "SELECT tstamp, filename, value FROM logs WHERE value_name = 'value'")


_LENIENT = """
SELECT filename, total(value) AS total, count(*) FILTER (WHERE CAST(value AS REAL) > 50) AS large, sum(CAST(value AS INTEGER) / 7) AS sevenths, sum(CAST(CAST(value AS INTEGER) || 'x' AS INTEGER)) AS whole,
  max(max(CAST(value AS REAL), 60)) AS at_least, count(*) FILTER (WHERE value GLOB '*.?5') AS fives, quote(filename) AS quoted, group_concat(DISTINCT substr(value, 1, 1) ORDER BY substr(value, 1, 1)) AS firsts
FROM logs WHERE value_name = 'value' AND filename GLOB '[a-p]*' GROUP BY filename"""


@_query(
    f"""
WITH {_EVENTS} SELECT filename, sum(CAST("value" AS DOUBLE)) AS total, count(*) FILTER (CAST("value" AS DOUBLE) > 50) AS large, CAST(sum(trunc(CAST("value" AS DOUBLE))::BIGINT // 7) AS BIGINT) AS sevenths,
  CAST(sum(trunc(CAST("value" AS DOUBLE))::BIGINT) AS BIGINT) AS whole, max(greatest(CAST("value" AS DOUBLE), 60)) AS at_least, count(*) FILTER ("value" GLOB '*.?5') AS fives, chr(39) || filename || chr(39) AS quoted,
  string_agg(DISTINCT substr("value", 1, 1), ',' ORDER BY substr("value", 1, 1)) AS firsts
FROM logs WHERE value_name = 'value' AND filename GLOB '[a-p]*' GROUP BY filename"""
)
def sql_lenient_text(spark, sf_dir):
    return _sql(_LENIENT, lenient=True)(spark, sf_dir)


@_query(
    f"""
WITH {_EVENTS} SELECT strftime(tstamp, '%Y-%m') AS month, strftime(tstamp, '%H:%M:%S') AS clock, count(*) AS n, CAST(min(epoch(tstamp)) AS BIGINT) AS first_second, max(epoch(tstamp) / 86400.0 + 2440587.5) AS last_day
FROM logs GROUP BY 1, 2"""
)
def sql_lenient_dates(spark, sf_dir):
    return _sql("SELECT strftime('%Y-%m', tstamp) AS month, strftime('%H:%M:%S', tstamp) AS clock, count(*) AS n, min(unixepoch(tstamp)) AS first_second, max(julianday(tstamp)) AS last_day FROM logs GROUP BY 1, 2")(spark, sf_dir)


@_query(
    f"""
WITH {_EVENTS}, p AS (SELECT filename, "value" AS v FROM logs WHERE value_name = 'props' UNION ALL SELECT filename, '[1, ' || length(filename) || ']' FROM logs WHERE value_name = 'seen' UNION ALL SELECT filename, 'no json' FROM logs WHERE value_name = 'value')
SELECT filename, CASE WHEN json_valid(v) THEN 1 ELSE 0 END AS ok, CASE WHEN json_valid(v) THEN lower(json_type(v)) END AS kind, count(*) AS n,
  CAST(count(DISTINCT CASE WHEN json_valid(v) THEN json_extract_string(v, '$.k') END) AS BIGINT) AS ks FROM p GROUP BY 1, 2, 3"""
)
def sql_lenient_json(spark, sf_dir):
    return _sql(
        "WITH p AS (SELECT filename, value AS v FROM logs WHERE value_name = 'props' UNION ALL SELECT filename, concat('[1, ', length(filename), ']') FROM logs WHERE value_name = 'seen' UNION ALL SELECT filename, 'no json' FROM logs WHERE value_name = 'value') "
        "SELECT filename, json_valid(v) AS ok, json_type(v) AS kind, count(*) AS n, count(DISTINCT json_extract(v, '$.k')) AS ks FROM p GROUP BY 1, 2, 3"
    )(spark, sf_dir)


# Statements as users of embedded databases write them


def _lenient(oracle: str, statement: str, name: str, adapter: Callable = adapters.events, views: str = _EVENTS) -> None:
    """Registers a statement that ``plans.dialect`` respells."""
    run = _sql(statement, adapter, lenient=True)
    run.__name__ = name
    _query(f"WITH {views} {oracle}")(run)


_ORDERS = f"logs AS (SELECT 'tpch' AS projid, o_orderdate AS tstamp, o_orderpriority AS filename, o_orderkey * 8 AS ctx_id, 'totalprice' AS value_name, {_money('o_totalprice')} AS \"value\" FROM orders)"

_lenient(
    """SELECT filename, "value", ctx_id FROM logs WHERE value_name = 'seen' AND "value" > '40' AND NOT ("value" BETWEEN '45' AND '47') AND "value" NOT IN ('50', '51') AND ctx_id > 100 AND filename ILIKE 'C%'""",
    "SELECT filename, value, ctx_id FROM logs WHERE value_name = 'seen' AND value > 40 AND value NOT BETWEEN 45 AND 47 AND value NOT IN (50, 51) AND ctx_id > '100' AND filename LIKE 'C%'",
    "sql_written_comparisons",
)
_INT = "CAST(trunc(CAST(\"value\" AS DOUBLE)) AS BIGINT)"
_lenient(
    f"""SELECT filename, "value", {_INT} // 7 AS sevenths, CAST("value" AS DOUBLE) / 4 AS quarter, CAST(length(filename) // 2 // 2 AS BIGINT) AS halves, CAST(NULL AS BIGINT) AS nothing, greatest({_INT}, 100) AS larger,
  least("value", '3') AS smaller, {_INT} AS digits, 3074457345618258602 AS third, "value" IS NOT DISTINCT FROM '9.99' AS same FROM logs WHERE value_name = 'value'""",
    """SELECT filename, value, CAST(value AS INTEGER) / 7 AS sevenths, CAST(value AS REAL) / 4 AS quarter, CAST(length(filename) AS INTEGER) / 2 / 2 AS halves, 1 / 0 AS nothing, max(CAST(value AS INTEGER), 100) AS larger,
  min(value, '3') AS smaller, CAST(value || 'x' AS INTEGER) AS digits, 9223372036854775807 / 3 AS third, value IS '9.99' AS same FROM logs WHERE value_name = 'value'""",
    "sql_written_numbers",
)
_lenient(
    """SELECT filename, coalesce(sum(TRY_CAST("value" AS DOUBLE)), 0) AS everything, CAST(0 AS DOUBLE) AS nothing FROM logs WHERE value_name <> 'seen' GROUP BY filename""",
    "SELECT filename, total(value) AS everything, total(value) FILTER (WHERE value_name = 'none') AS nothing FROM logs WHERE value_name <> 'seen' GROUP BY filename",
    "sql_written_total",
)
_lenient(
    """SELECT filename, tstamp, string_agg("value", '; ' ORDER BY "value") AS listed, string_agg(DISTINCT substr("value", 1, 1), ',' ORDER BY substr("value", 1, 1)) AS firsts FROM logs WHERE value_name = 'value' GROUP BY filename, tstamp""",
    "SELECT filename, tstamp, group_concat(value, '; ' ORDER BY value) AS listed, group_concat(DISTINCT substr(value, 1, 1) ORDER BY substr(value, 1, 1)) AS firsts FROM logs WHERE value_name = 'value' GROUP BY filename, tstamp",
    "sql_written_group_concat",
)
_lenient(
    """SELECT filename, arg_max(tstamp, no) AS tstamp, arg_max("value", no) AS "value", max(no) AS newest FROM (SELECT filename, tstamp, "value", CAST("value" AS BIGINT) AS no FROM logs WHERE value_name = 'seen') GROUP BY filename""",
    "SELECT filename, tstamp, value, max(no) AS newest FROM (SELECT filename, tstamp, value, CAST(value AS INTEGER) AS no FROM logs WHERE value_name = 'seen') AS s GROUP BY filename",
    "sql_written_bare_columns",
)
_MONTH = "CAST(date_trunc('month', {}) AS TIMESTAMP) + to_months({}) + to_days(CAST(day({}) AS INTEGER) - 1)"
_lenient(
    f"""SELECT tstamp, count(*) AS n, strftime({_MONTH.format('tstamp', 1, 'tstamp')}, '%Y-%m-%d') AS next_month, strftime({_MONTH.format('tstamp', -13, 'tstamp')}, '%Y-%m-%d') AS before,
  strftime(CAST(date_trunc('month', tstamp) AS TIMESTAMP) - INTERVAL 1 DAY + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS eve, strftime(CAST(tstamp AS TIMESTAMP) + to_days(CAST((8 - dayofweek(tstamp)) % 7 AS INTEGER)), '%Y-%m-%d') AS monday,
  strftime(CAST(tstamp AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ, week %W, day %j, year %Y, %w') AS iso, CAST(epoch(CAST(tstamp AS TIMESTAMP)) AS BIGINT) - 129600 AS early FROM logs GROUP BY tstamp""",
    """SELECT tstamp, count(*) AS n, date(tstamp, '+1 month') AS next_month, date(tstamp, '-13 months') AS before, datetime(tstamp, 'start of month', '-1 day', '+90 minutes') AS eve, date(tstamp, 'weekday 1') AS monday,
  strftime('%Y-%m-%dT%H:%M:%SZ, week %W, day %j, year %Y, %w', tstamp) AS iso, unixepoch(tstamp, '-36 hours') AS early FROM logs WHERE value_name = 'totalprice' GROUP BY tstamp""",
    "sql_written_dates",
    adapters.orders,
    _ORDERS,
)
_lenient(
    """SELECT filename, 'k' AS key, json_extract_string("value", '$.k') AS "value", 'integer' AS type, '$.k' AS fullkey, count(*) AS n FROM logs WHERE value_name = 'props' GROUP BY ALL""",
    "SELECT l.filename, e.key, e.value, e.type, e.fullkey, count(*) AS n FROM logs l, json_each(l.value) AS e WHERE l.value_name = 'props' GROUP BY l.filename, e.key, e.value, e.type, e.fullkey",
    "sql_written_json_each",
)
_lenient(
    """SELECT t.f AS fullkey, t.k AS type, count(*) AS n, CAST(sum(CASE WHEN t.f = '$.list[1].k' THEN CAST(json_extract_string("value", '$.k') AS BIGINT) END) AS BIGINT) AS held
FROM logs, (VALUES ('$', 'object'), ('$.name', 'text'), ('$.list', 'array'), ('$.list[0]', 'null'), ('$.list[1]', 'object'), ('$.list[1].k', 'integer')) t(f, k) WHERE value_name = 'props' GROUP BY t.f, t.k""",
    """SELECT t.fullkey, t.type, count(*) AS n, sum(CASE WHEN t.fullkey = '$.list[1].k' THEN CAST(t.atom AS INTEGER) END) AS held
FROM (SELECT '{"name": "' || filename || '", "list": [null, ' || value || ']}' AS j FROM logs WHERE value_name = 'props') AS p, json_tree(p.j) AS t GROUP BY t.fullkey, t.type""",
    "sql_written_json_tree",
)
_K = "json_extract_string(\"value\", '$.k')"
_EDITS = {
    "set": ("json_set(value, '$.k', length(filename), '$.more[0].name', filename)", "'{\"k\":' || length(filename) || ',\"more\":[{\"name\":\"' || filename || '\"}]}'"),
    "insert": ("json_insert(value, '$.k', 0, '$.list', json('[1,{\"a\":null}]'))", f"'{{\"k\":' || {_K} || ',\"list\":[1,{{\"a\":null}}]}}'"),
    "replace": ("json_replace('[' || value || ',2]', '$[1]', filename, '$[#-2].k', 1.5, '$[7]', 0)", "'[{\"k\":1.5},\"' || filename || '\"]'"),
    "remove": ("json_remove('[' || value || ',[1,2,3]]', '$[1][#-1]', '$[0].k', '$.none')", "'[{},[1,2]]'"),
    "patch": ("json_patch(value, '{\"n\":{\"m\":[1]},\"k\":null}')", "'{\"n\":{\"m\":[1]}}'"),
}
for _mode, (_written, _plain) in _EDITS.items():
    _lenient(
        f"SELECT filename, {_plain} AS edited, count(*) AS n FROM logs WHERE value_name = 'props' GROUP BY ALL",
        f"SELECT filename, edited, count(*) AS n FROM (SELECT filename, {_written} AS edited FROM logs WHERE value_name = 'props') AS e GROUP BY filename, edited",
        f"sql_written_json_{_mode}",
    )


_FRAMES = {
    "groups": "sum(n) OVER (PARTITION BY filename ORDER BY n GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS around, count(*) OVER (ORDER BY n DESC GROUPS 3 PRECEDING) AS so_far",
    "exclude_row": "sum(n) OVER (PARTITION BY filename ORDER BY tstamp ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS others, avg(n) OVER (PARTITION BY filename ORDER BY tstamp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS mean",
    "exclude_ties": "count(*) OVER (PARTITION BY filename ORDER BY n RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING EXCLUDE TIES) AS like_it, sum(n) OVER (ORDER BY n RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS below",
    "exclude_group": "count(n) OVER (ORDER BY n GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS beside, sum(n) OVER (PARTITION BY filename ORDER BY n RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING EXCLUDE GROUP) AS near_it",
}
for _name, _frame in _FRAMES.items():
    _counts = "SELECT filename, tstamp, n, {} FROM (SELECT filename, tstamp, count(*) AS n FROM logs WHERE value_name = 'value' GROUP BY filename, tstamp) AS g"
    _lenient(f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in re.findall(r'AS (\w+)(?:,|$)', _frame) if c != 'mean')}) FROM ({_counts.format(_frame)})", _counts.format(_frame), f"sql_written_frame_{_name}")


_KINDS = """
SELECT 'left' AS kind, count(*) AS n, count(p.ctx_id) AS met FROM logs l LEFT JOIN loops p ON l.ctx_id = p.ctx_id AND p.iteration < 20
UNION ALL SELECT 'right', count(*), count(l.value) FROM (SELECT * FROM logs WHERE value_name = 'seen' AND ctx_id < 40) AS l RIGHT JOIN loops p ON l.ctx_id = p.ctx_id
UNION ALL SELECT 'full', count(*), count(p.ctx_id) FROM (SELECT * FROM logs WHERE value_name <> 'seen' OR ctx_id < 40) AS l FULL JOIN loops p ON l.ctx_id = p.ctx_id
UNION ALL SELECT 'semi', count(*), count(ctx_id) FROM loops p WHERE EXISTS (SELECT 1 FROM logs l WHERE l.ctx_id = p.ctx_id AND l.filename = 'view')
UNION ALL SELECT 'anti', count(*), count(ctx_id) FROM loops p WHERE NOT EXISTS (SELECT 1 FROM logs l WHERE l.ctx_id = p.ctx_id AND l.filename = 'view' AND l.value > '5')
UNION ALL SELECT 'self', count(*), count(b.ctx_id) FROM loops a JOIN loops b ON a.iteration = b.iteration + 1"""


@_query(f"WITH {_EVENTS} {_KINDS}")
def sql_join_kinds(spark, sf_dir):
    return _sql(_KINDS)(spark, sf_dir)


@_query(
    """SELECT p.event_id, count(v.event_id) AS n, sum(v.event_id) AS ids FROM (SELECT * FROM events WHERE event_type = 'purchase') p JOIN (SELECT * FROM events WHERE event_type = 'view') v
  ON v.ts BETWEEN p.ts - (CASE WHEN p.user_id % 10 = 0 THEN INTERVAL 6 HOUR ELSE INTERVAL 20 MINUTE END) AND p.ts GROUP BY p.event_id"""
)
def join_range(spark, sf_dir):
    """Views in the minutes, for some users hours, before each purchase: a join by order of time alone."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    bought, seen = e.where("event_type = 'purchase'"), e.where("event_type = 'view'").select(F.col("event_id").alias("seen"), F.col("at").alias("seen_at"))
    back = F.when(F.col("user_id") % 10 == 0, 6 * 3_600_000_000).otherwise(20 * 60_000_000)
    pairs = joins.range_join(bought, seen, F.col("at") - back, F.col("at"), F.col("seen_at"))
    return pairs.groupBy("event_id").agg(F.count("seen").alias("n"), F.sum("seen").alias("ids"))


# Functions


@_query(
    """
SELECT event_id, event_id % 7 AS head, CAST(user_id // 3 AS BIGINT) AS third, CASE WHEN "value" < 0 THEN ceil("value") ELSE floor("value") END::BIGINT AS whole,
  CASE WHEN user_id IS NULL OR event_id IS NULL THEN NULL ELSE greatest(user_id, event_id) END AS larger, event_type ILIKE 'C%' AS like_c, event_type GLOB 'c*' AS glob_c, '''' || replace(event_type, '''', '''''') || '''' AS quoted
FROM events
"""
)
def lenient_functions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "event_id",
        compat.cast_integer(F.concat((F.col("event_id") % 7).cast("string"), F.lit("x"))).alias("head"),
        compat.divide_integers(F.col("user_id"), F.lit(3)).alias("third"),
        compat.trunc(F.col("value")).cast("bigint").alias("whole"),
        compat.greatest(F.col("user_id"), F.col("event_id")).alias("larger"),
        F.ilike(F.col("event_type"), F.lit("C%")).alias("like_c"),
        compat.glob(F.col("event_type"), "c*").alias("glob_c"),
        compat.quote(F.col("event_type")).alias("quoted"),
    )


@_query("SELECT event_type, CAST(coalesce(sum(CAST(user_id AS DOUBLE)), 0) AS DOUBLE) AS total FROM events GROUP BY event_type")
def lenient_total(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("event_type").agg(compat.total(F.col("user_id").cast("string")).alias("total"))


@_query(
    """
SELECT event_id, lower(event_type) IN ('yes', 'y', 'true', 't', '1') OR event_id % 3 = 0 AS yes, event_id % 4 < 2 AS is_int, event_id % 5 > 1 AS is_json, CAST(event_id AS VARCHAR) AS setting FROM events"""
)
def text_functions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    settings = text.parse_settings(F.concat(F.lit("lr=0.1 id="), n))
    answer = F.when(n % 3 == 0, F.element_at(F.array(*map(F.lit, ("Yes", "T", "1"))), (n % 9 / 3 + 1).cast("int"))).otherwise(F.col("event_type"))
    number = F.when(n % 4 == 0, n.cast("string")).when(n % 4 == 1, F.concat(F.lit(" -1_"), n)).when(n % 4 == 2, F.concat(n, F.lit(".0"))).otherwise("x1")
    value = F.when(n % 5 > 1, F.concat(F.lit('{"k": ['), n, F.lit("]}"))).when(n % 5 == 0, F.concat(F.lit("{k: "), n)).otherwise("")
    return e.select("event_id", text.to_bool(answer).alias("yes"), text.is_integer(number).alias("is_int"), text.is_json(value).alias("is_json"), F.element_at(settings, "id").alias("setting"))
