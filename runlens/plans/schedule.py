"""What re-running past versions would cost, from the timings they logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LOOP, PREFIX, RUN_KEYS, SUFFIX, USER
from .pivot import dataframe, star_names


def _number(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def nested_loops(logs: DataFrame, loops: DataFrame, outer: str = "epoch", paths: DataFrame | None = None) -> DataFrame:
    """Per run: rounds of the outer loop, and time in loops nested in it.

    Equal timings of one round count once, as in the pivot's distinct rows.  Without
    an outer loop of that name the frame is empty.
    """
    wide = dataframe(logs, loops, LOOP, paths=paths)
    if outer not in wide.columns:
        return logs.where(F.lit(False)).select(*RUN_KEYS, F.lit(0).cast("bigint").alias("num_epochs"), F.lit(0.0).alias("sum_nested_loops"))
    spent = F.coalesce(F.sum(F.col(f"`{LOOP}`").try_cast("double")), F.lit(0.0))
    return wide.groupBy(*RUN_KEYS).agg(F.max(F.col(f"`{outer}`")).alias("num_epochs"), spent.alias("sum_nested_loops"))


def run_timings(logs: DataFrame, timings: list[str]) -> DataFrame:
    """Runs with a top-level user value: the star's columns and the run's own timings.

    One aggregation over the run keys; of several values that a run logged for a
    timing, every combination is a row, as in the pivot.  Rows have a value of one
    timing at least.
    """
    names = star_names(logs)
    clash = sorted({*names} & {*RUN_KEYS, *timings, COARSE})
    if clash:
        raise ValueError(f"logged names {clash} are also key or timing columns of the result")
    user = F.col("value_type") == USER
    own = logs.where(F.col("ctx_id").isNull() & (user | F.col("value_name").isin([*timings, LOOP])))
    held = F.struct("value")
    picked = [F.max(F.when(user & (F.col("value_name") == n), F.col("value"))).alias(n) for n in names]
    sets = [F.collect_set(F.when(F.col("value_name") == t, held)).alias(f"_set{k}") for k, t in enumerate(timings)]
    whole = F.collect_list(F.when(F.col("value_name") == LOOP, held)).alias("_whole")
    out = own.groupBy(*RUN_KEYS).agg(*picked, *sets, whole, F.bool_or(user).alias("_user"))
    out = out.where("_user").where(F.greatest(*(F.size(f"_set{k}") for k in range(len(timings))), F.lit(0)) > 0).drop("_user")
    for k, t in enumerate(timings):
        out = out.withColumn("_held", F.explode_outer(f"_set{k}")).withColumn(t, F.col("_held.value")).drop("_held", f"_set{k}")
    return out


#: Column of a root loop's whole duration.
COARSE = "coarse_loop"


def estimate(logs: DataFrame, loops: DataFrame, level: int, mark: str = "suffix", outer: str = "epoch", paths: DataFrame | None = None) -> DataFrame:
    """Runs with at least one top-level value, their timings, and ``composite``, the seconds to expect.

    Level 0 replays what stands before the loops (``mark`` "prefix") or also what
    follows them ("suffix"); level 1 the rounds of the outer loop without their
    nested loops; level 2 everything.  The run's own timings come from one aggregation,
    which only the nested loops are joined to.
    """
    if mark not in ("prefix", "suffix"):
        raise ValueError("mark is 'prefix' or 'suffix'")
    if level not in (0, 1, 2):
        raise ValueError(f"no cost model for loops nested {level} deep")
    runs = run_timings(logs, [PREFIX] if level == 0 and mark == "prefix" else [PREFIX, SUFFIX])
    if level == 0:
        costs = _number(PREFIX) if mark == "prefix" else _number(PREFIX) + _number(SUFFIX) + 1
        return runs.drop("_whole").withColumn("composite", costs)
    whole = runs.withColumn("_held", F.explode("_whole")).withColumn(COARSE, F.col("_held.value").try_cast("double")).drop("_whole", "_held")
    costs = whole.join(nested_loops(logs, loops, outer, paths), RUN_KEYS, "inner")
    ends = _number(PREFIX) + _number(SUFFIX)
    if level == 1:
        costs = costs.withColumn("marginal", F.col(COARSE) - F.col("sum_nested_loops")).drop(COARSE)
        return costs.drop("sum_nested_loops").withColumn("composite", F.col("num_epochs") + F.col("marginal") + ends)
    return costs.drop("sum_nested_loops").withColumn("composite", F.col(COARSE) + ends)


def total_cost(schedule: DataFrame) -> DataFrame:
    return schedule.agg(F.sum("composite").alias("total"))


def where(schedule: DataFrame, clause: str | None) -> DataFrame:
    """The runs that satisfy a SQL condition over the schedule's columns."""
    return schedule if clause is None else schedule.where(F.expr(clause))


def where_logged(schedule: DataFrame, logs: DataFrame, loops: DataFrame, names: list[str], clause: str, paths: DataFrame | None = None) -> DataFrame:
    """The runs of which some row of the pivot of ``names`` satisfies the condition.

    The condition may use these names, their loops' columns and the schedule's own;
    values are typed as the pivot infers them.
    """
    wide = dataframe(logs, loops, *names, typed=True, paths=paths)
    own = schedule.select(*RUN_KEYS, *(F.col(f"`{c}`") for c in schedule.columns if c not in wide.columns))
    met = own.join(wide, RUN_KEYS, "left").where(F.expr(clause)).select(*RUN_KEYS).distinct()
    return schedule.join(met, RUN_KEYS, "left_semi")


def lacking(schedule: DataFrame, logs: DataFrame, names: list[str]) -> DataFrame:
    """The runs that have not logged every one of the names yet, so replaying them adds something."""
    held = logs.where(F.col("value_name").isin(names) & F.col("value").isNotNull()).groupBy(*RUN_KEYS).agg(F.count_distinct("value_name").alias("_n"))
    return schedule.join(held.where(F.col("_n") >= len(set(names))).drop("_n"), RUN_KEYS, "left_anti")


def after_replay(schedule: DataFrame, logs: DataFrame, loops: DataFrame, *names: str, paths: DataFrame | None = None) -> DataFrame:
    """The pivot of the names over the schedule's runs: what a replay of them ends with."""
    own = logs.join(schedule.select(*RUN_KEYS).distinct(), RUN_KEYS, "left_semi")
    return dataframe(own, loops, *names, paths=paths)


def last_of_each_run(schedule: DataFrame) -> DataFrame:
    """The last row of each stretch of rows with one time stamp, ordered by stamp, project and file.

    Equal stamps are neighbours in that order, so a stretch is a time stamp, and the
    maximum over it needs no window over all rows.
    """
    return schedule.groupBy("tstamp").agg(F.max_by(F.struct("projid", "filename"), F.struct("projid", "filename")).alias("l")).select("l.projid", "tstamp", "l.filename")


def with_versions(schedule: DataFrame, versions: DataFrame) -> DataFrame:
    """Adds the version id of each run's time stamp; of several, that committed first."""
    first = versions.groupBy("tstamp").agg(F.min_by("vid", "authored").alias("vid"))
    return last_of_each_run(schedule).join(first, "tstamp", "inner")


def replay_commands(schedule: DataFrame, names: list[str], level: int, outer: str = "epoch", inner: str = "step") -> DataFrame:
    """The command line that would replay each run."""
    parts = [F.lit("python"), F.col("filename"), F.lit("--replay"), F.lit(",".join(names))]
    if level >= 1:
        rounds = F.when(F.col("num_epochs") > 0, F.concat(F.array_join(F.sequence(F.lit(0).cast("bigint"), F.col("num_epochs") - 1), ","), F.lit(","))).otherwise("")
        parts.append(F.concat(F.lit(f"{outer}="), rounds))
    if level >= 2:
        parts.append(F.lit(f"{inner}=1"))
    return schedule.select(*RUN_KEYS, F.concat_ws(" ", *parts).alias("command"))
