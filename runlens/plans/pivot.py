"""The pivot: logged names as columns, one row per run and loop path."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.inference import infer_types
from ..schema import LOGS, RUN_KEYS, USER
from ..scratch import spread
from .paths import context_paths


#: Most columns of a star pivot; a store with more names wants some of them asked for.
MOST_NAMES = 10_000


def star_names(logs: DataFrame) -> list[str]:
    """User names logged outside of any loop, ``MOST_NAMES`` at most (each becomes a column)."""
    names = logs.where((F.col("value_type") == USER) & F.col("ctx_id").isNull() & F.col("value_name").isNotNull()).select("value_name").distinct()
    found = names.limit(MOST_NAMES + 1).collect()
    if len(found) > MOST_NAMES:
        raise ValueError(f"over {MOST_NAMES} names are logged at top level: name the columns that you want")
    return sorted(r[0] for r in found)


def star(logs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per run: the text maximum of each top-level user name.

    Without such names the frame is empty but has the key columns.  ``names`` spares
    the job that looks them up.
    """
    names = star_names(logs) if names is None else names
    rows = logs.where((F.col("value_type") == USER) & F.col("ctx_id").isNull())
    if not names:
        return rows.where(F.lit(False)).select(*RUN_KEYS)
    _check_names(names, [])
    picked = [F.max(F.when(F.col("value_name") == n, F.col("value"))).alias(n) for n in names]
    return rows.groupBy(*RUN_KEYS).agg(*picked)


@dataclass(frozen=True)
class Shape:
    """What one name's frame looks like: its depth and its loop columns, outermost first; ``full`` ones hold no null; its ``rows`` at most."""

    depth: int
    columns: tuple[tuple[str, str, str], ...]  # (column, loop, field)
    full: frozenset[str] = frozenset()
    rows: int = field(default=0, compare=False)

    @property
    def names(self) -> list[str]:
        return [c for c, _, _ in self.columns]


def _step(loop: str, field: str) -> Column:
    return F.get(F.filter("path", lambda s: s["name"] == F.lit(loop)), F.lit(0))[field]


def _check_names(names: list[str], loop_columns: list[str]) -> None:
    clash = sorted(set(names) & {*RUN_KEYS, *loop_columns})
    if clash:
        raise ValueError(f"logged names {clash} are also key or loop columns of the result")


def resolved(logs: DataFrame, paths: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the names with their path; those with an unknown context are dropped.

    One scan for all names, with the filter at the scan and one equi-join.  Rows outside
    of loops meet no path; the second key deals them out, or one task would take them all.
    """
    return _with_paths(_named(logs, names), paths)


def _named(logs: DataFrame, names: list[str]) -> DataFrame:
    return logs.where(F.col("value_name").isin(names)).select(*RUN_KEYS, "ctx_id", "value_name", "value")


def _with_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    own = [c for c in rows.columns if c not in (*RUN_KEYS, "ctx_id")]
    dealt = F.coalesce("ctx_id", F.xxhash64(*RUN_KEYS, *own))
    known = paths.withColumnRenamed("ctx_id", "_known")
    joined = rows.join(known, (F.col("ctx_id") == F.col("_known")) & (dealt == F.col("_known")), "left")
    flat = F.col("ctx_id").isNull()
    known = joined.where(flat | F.col("depth").isNotNull())
    return known.select(*RUN_KEYS, *own, F.when(flat, 0).otherwise(F.col("depth")).alias("depth"), "path")


#: Most values in a row of ``packed``.
MOST_PACKED = 64
_PAIR = T.StructType([LOGS["value_name"], LOGS["value"]])
_PACKED = T.StructType([*(LOGS[c] for c in RUN_KEYS), LOGS["ctx_id"], T.StructField("held", T.ArrayType(_PAIR))])


#: Fewest names for which long rows are packed: with fewer, passing them through Arrow costs more than it saves.
PACKED_NAMES = 3


def packed(logs: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the names, with neighbouring ones of a run and round as one: ``held`` has their names and values.

    What a round logs stands together, so that runs, contexts and paths are shuffled and written
    once a round, not once a value.  Nothing is sorted or held back: rows that stand apart stay apart.
    Logs whose source has several values a record come with ``held`` already.
    """
    if "held" in logs.columns:
        asked = F.filter("held", lambda h: h["value_name"].isin(names))
        return logs.select(*RUN_KEYS, "ctx_id", asked.alias("held")).where(F.size("held") > 0)
    rows = _named(logs, names)
    return rows.mapInArrow(_pack, _PACKED) if len(names) >= PACKED_NAMES else _held(rows).drop("value_name", "value")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = [*RUN_KEYS, "ctx_id"]
    for batch in batches:
        if not (n := batch.num_rows):
            continue
        first = np.ones(n, dtype=bool)
        first[1:] = False
        for k in keys:
            above, below = batch.column(k).slice(0, n - 1), batch.column(k).slice(1)
            differs = pc.coalesce(pc.not_equal(above, below), pc.xor(pc.is_null(above), pc.is_null(below)))
            first[1:] |= differs.to_numpy(zero_copy_only=False)
        # values of a longer stretch stay rows of their own: equal ones are then found by a set of values
        sizes = np.diff(np.append(np.flatnonzero(first), n))
        starts = np.flatnonzero(first | np.repeat(sizes > MOST_PACKED, sizes))
        pairs = pa.StructArray.from_arrays([batch.column(c) for c in _PAIR.names], names=_PAIR.names)
        held = pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), pairs)
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(starts)) for k in keys), held], names=_PACKED.names)


def _held(rows: DataFrame) -> DataFrame:
    """Rows as ``packed`` has them; plain rows have one value each."""
    return rows if "held" in rows.columns else rows.withColumn("held", F.array(F.struct("value_name", "value")))


def _values(name: str) -> Column:
    return F.filter("held", lambda h: h["value_name"] == F.lit(name))["value"]


def _has(names: list[str]) -> Column:
    return F.exists("held", lambda h: h["value_name"].isin(names))


def shapes(rows: DataFrame, names: list[str]) -> dict[str, Shape]:
    """Depth and loop columns of each name: one pass over the rows, which keeps one row a kind of chain; those are few.

    A loop's number is left out if any is missing, its value if all are.
    """
    kind = F.transform(F.coalesce("path", F.array()), lambda s: F.struct(s["name"].alias("loop"), s["iteration"].isNull().alias("no_number"), s["value"].isNull().alias("no_value")))
    names_of = F.col("held.value_name") if "held" in rows.columns else F.array("value_name")
    packs = rows.groupBy(F.sort_array(names_of).alias("names"), "depth", kind.alias("kind")).agg(F.count("*").alias("packs"))
    kinds = packs.select(F.explode("names").alias("value_name"), "depth", "kind", "packs").groupBy("value_name", "depth", "kind").agg(F.sum("packs").alias("rows"))
    twice = F.size("kind") > F.size(F.array_distinct("kind.loop"))
    steps = kinds.select("value_name", "depth", "rows", twice.alias("twice"), F.posexplode_outer("kind").alias("pos", "step"))
    found = steps.groupBy("value_name", "depth", "pos", F.col("step.loop").alias("loop")).agg(
        F.bool_or("step.no_number").alias("no_number"), F.bool_and("step.no_value").alias("no_value"), F.bool_or("twice").alias("twice"), F.sum("rows").alias("rows")
    )
    found = found.collect()
    out = {}
    for name in names:
        own = [r for r in found if r["value_name"] == name]
        depth = max((r["depth"] for r in own), default=0)
        columns: list[tuple[str, str, str]] = []
        deepest = [r for r in own if r["depth"] == depth and depth]
        at = Counter(r["pos"] for r in deepest)
        if any(r["twice"] for r in deepest):
            raise ValueError(f"{name!r} is logged in a loop nested in a loop of the same name")
        full = frozenset(r["loop"] for r in deepest if at[r["pos"]] == 1 and not r["no_number"])
        for r in sorted(deepest, key=lambda r: (r["pos"], r["loop"])):
            if r["no_number"] and r["no_value"]:
                raise ValueError(f"iterations of loop {r['loop']!r} have neither number nor value")
            if not r["no_number"]:
                columns.append((r["loop"], r["loop"], "iteration"))
            if not r["no_value"]:
                columns.append((f"{r['loop']}_value", r["loop"], "value"))
        out[name] = Shape(depth, tuple(dict.fromkeys(columns)), full, sum(r["rows"] for r in own if r["depth"] == depth and not r["pos"]))
    return out


#: Rows that a task groups by their keys, and most tasks: a shuffle into more holds whole splits of its input in memory.
TASK_ROWS, MOST_TASKS = 1 << 17, 200


def _dealt(df: DataFrame, columns: list[Column], rows: int) -> DataFrame:
    """Rows dealt out by their keys, so that only a partition's rows are grouped at once, not those of a split of the input."""
    return df.repartition(min(MOST_TASKS, max(1, -(-rows // TASK_ROWS))), *columns)


#: Key columns that a join is on as one: rows dealt by it are grouped and joined where they are.
_KEY = "_joined_on"
#: Rows a task, at least, of the part that has fewest, for rows to be dealt by the columns of a join: fewer may be too few keys for all tasks.
KEYS_PER_TASK = 1 << 10


def _keys(shape: Shape, by: list[str]) -> tuple[list[Column], list[Column]]:
    """The key columns of a name's rows, those of ``by`` as one; and how they are shown once grouped."""
    own = {c: _step(loop, field) for c, loop, field in shape.columns} | {c: F.col(c) for c in RUN_KEYS}
    if not by:
        return [v.alias(c) for c, v in own.items()], [F.col(f"`{c}`") for c in own]
    inner = F.struct(*(own[c].alias(c) for c in by)).alias(_KEY)
    return [inner, *(v.alias(c) for c, v in own.items() if c not in by)], [F.col(_KEY), *(F.col(_KEY)[c].alias(c) if c in by else F.col(f"`{c}`") for c in own)]


def _single(rows: DataFrame, name: str, shape: Shape, by: list[str] | None = None, most: int = 0) -> DataFrame:
    """The distinct rows of a name, dealt out by their keys, or by those of ``by`` as ``most`` rows are."""
    own = _held(rows).where(_has([name]) & (F.col("depth") == shape.depth))
    keys, shown = _keys(shape, by or [])
    out = own.select(*keys, F.explode(_values(name)).alias(name))
    dealt = [F.col(_KEY)] if by else shown
    return _dealt(out, dealt, max(shape.rows, most)).distinct().select(*shown, F.col(f"`{name}`"))


#: Column that tells whether a fused row has a value of the first name.
_FIRST = "_has_first"


def _sets(rows: DataFrame, names: list[str], shape: Shape, by: list[str] | None = None, most: int = 0) -> DataFrame:
    """Names of one shape by one aggregation instead of a chain of full outer joins: a row a key, with each name's distinct values."""
    own = _held(rows).where(_has(names) & (F.col("depth") == shape.depth))
    values = [_values(n).alias(f"_values{k}") for k, n in enumerate(names)]
    keys, shown = _keys(shape, by or [])
    keyed = own.select(*keys, *values)
    grouped = [F.col(f"`{c}`") for c in keyed.columns[: len(keys)]]
    sets = [F.collect_set(F.when(F.size(f"_values{k}") > 0, F.col(f"_values{k}"))).alias(f"_set{k}") for k in range(len(names))]
    out = _dealt(keyed, [F.col(_KEY)] if by else grouped, max(shape.rows * len(names), most)).groupBy(*grouped).agg(*sets)
    return out.select(*shown, *(F.array_distinct(F.flatten(f"_set{k}")).alias(n) for k, n in enumerate(names)), (F.size("_set0") > 0).alias(_FIRST))


def _exploded(df: DataFrame, names: list[str]) -> DataFrame:
    """Every combination of the names' values a row; a name without any is null.

    Joining on all key columns pairs up, within a key, every value of one name with
    every value of the others; so does exploding one set of values after the other.
    """
    for n in names:
        df = df.select(*(F.explode_outer(F.col(f"`{c}`")).alias(c) if c == n else F.col(f"`{c}`") for c in df.columns))
    return df


def _fused(rows: DataFrame, names: list[str], shape: Shape) -> DataFrame:
    return _exploded(_sets(rows, names, shape), names)


def natural_full_join(left: DataFrame, right: DataFrame, met: Column | None = None) -> DataFrame:
    """Full outer join on all shared columns; missing values match each other, keys are merged.  Rows without ``met`` match none.

    Sides that have their shared columns as one, too, are joined on that: fields of it that are missing are equal.
    """
    shared = [c for c in left.columns if c in right.columns]
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in shared})
    cond = F.lit(True) if met is None else met
    if _KEY in shared:
        shared.remove(_KEY)
        cond = cond & (F.col(_KEY) == F.col(f"_right_{_KEY}"))
    else:
        for c in shared:
            cond = cond & F.col(f"`{c}`").eqNullSafe(F.col(f"`_right_{c}`"))
    merged = [F.coalesce(F.col(f"`{c}`"), F.col(f"`_right_{c}`")).alias(c) if c in shared else F.col(f"`{c}`") for c in left.columns if c != _KEY]
    return left.join(renamed, cond, "full").select(*merged, *(F.col(f"`{c}`") for c in right.columns if c not in (*shared, _KEY)))


def run_level_join(deep: DataFrame, flat: DataFrame, deep_runs: DataFrame, met: Column | None = None) -> DataFrame:
    """The full outer join on the run keys alone, where one side has no loop columns.

    As a left join and the flat side's runs that the deep one lacks, it can be split where one run
    has very many rounds, or broadcast, which full outer joins can't.  ``deep_runs`` are the run keys of ``deep``,
    of its rows with ``met`` if that is given: others match none.
    """
    same = lambda side: [F.col(c).eqNullSafe(F.col(f"{side}{c}")) for c in RUN_KEYS]
    added = [c for c in flat.columns if c not in RUN_KEYS]
    both = deep.join(flat.withColumnsRenamed({c: f"_right_{c}" for c in RUN_KEYS}), [*same("_right_"), *([] if met is None else [met])], "left").select(*(F.col(f"`{c}`") for c in [*deep.columns, *added]))
    alone = flat.join(deep_runs.select(*(F.col(c).alias(f"_held_{c}") for c in RUN_KEYS)).distinct(), same("_held_"), "left_anti")
    return both.unionByName(alone, allowMissingColumns=True)


def _dealt_alike(parts: list[tuple[list[str], Shape, bool]]) -> tuple[list[str], int]:
    """The columns that the first two parts are joined on, and the rows of the larger one, if they are many keys: both are dealt out by these, and shuffled once."""
    if len(parts) < 2 or bool(parts[0][1].names) != bool(parts[1][1].names):
        return [], 0
    one, two = (shape for _, shape, _ in parts)
    most = max(shape.rows * len(names) for names, shape, _ in parts)
    tasks = min(MOST_TASKS, -(-most // TASK_ROWS))
    if min(one.rows, two.rows) < KEYS_PER_TASK * tasks:
        return [], 0
    return [*(c for c in one.names if c in two.names), *RUN_KEYS], most


def dataframe(logs: DataFrame, loops: DataFrame, *names: str, typed: bool = False, paths: DataFrame | None = None, fuse: bool = True) -> DataFrame:
    """Wide frame of the named values; without names, the star pivot of all top-level ones.

    Of a name logged at several depths, the deepest rows stay.  Names are joined in
    call order by natural full outer joins.  Neighbouring names of one shape are fused
    into one aggregation where that is equal to joining them: at the start, where their
    key columns are all there already, and where they bring a loop column without nulls
    (rows without a value of the first of them then meet nothing that is there).  Every
    part has distinct rows, and so has the result.  Values are text unless ``typed``.
    """
    if not names:
        return infer_types(star(logs)) if typed else star(logs)
    wanted = list(dict.fromkeys(names))
    # written once: the shapes and every group of names read it again
    rows = spread(_with_paths(packed(logs, wanted), context_paths(loops) if paths is None else paths), "pivot")
    found = shapes(rows, wanted)
    _check_names(wanted, [c for s in found.values() for c in s.names])
    groups: list[list[str]] = []
    for n in wanted:
        if fuse and groups and found[groups[-1][-1]] == found[n]:
            groups[-1].append(n)
        else:
            groups.append([n])
    parts: list[tuple[list[str], Shape, bool]] = []  # names, their shape, and whether only rows with the first name meet what is there
    there: set[str] = set()
    for group in groups:
        shape = found[group[0]]
        inner = not parts or set(shape.names) <= there
        if len(group) == 1 or not (inner or shape.full - there):
            parts += [([n], found[n], False) for n in group]
        else:
            # names after the first join on the new loop column, too: a row without the first meets no earlier row
            parts.append((group, shape, not inner))
        there |= set(shape.names)
    by, most = _dealt_alike(parts[:2])
    out, there, held = None, set(), F.lit(False)  # the frame, its loop columns, and which of the rows are in it
    for k, (own, shape, first_only) in enumerate(parts):
        of = lambda names, depth=shape.depth: _has(names) & (F.col("depth") == depth)
        dealt = (by, most) if k < 2 else ()
        part = _single(rows, own[0], shape, *dealt) if len(own) == 1 else _sets(rows, own, shape, *dealt)
        met = F.col(_FIRST) if first_only else None
        if len(own) > 1 and not first_only:
            part = part.drop(_FIRST)
        if out is None:
            out = part
        elif bool(there) != bool(shape.names):
            deep, flat, runs = (out, part, held) if there else (part, out, of(own[:1] if first_only else own))
            columns = [*out.columns, *(c for c in part.columns if c not in out.columns)]
            out = run_level_join(deep, flat, rows.where(runs).select(*RUN_KEYS), met).select(*(F.col(f"`{c}`") for c in columns))
        else:
            out = natural_full_join(out, part, met)
        out = out.drop(_FIRST)
        there, held = there | set(shape.names), held | of(own)
    # fused names stay sets of values until all are joined: no join is on values
    sets = [n for own, _, _ in parts if len(own) > 1 for n in own]
    out = _exploded(out.select(*(F.col(f"`{c}`") for c in [*(c for c in out.columns if c not in wanted), *wanted])), sets)
    return infer_types(out, wanted) if typed else out
