"""Context paths: each loop context with its chain of loop steps, outermost first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PATHS
from ..scratch import materialise, settings, spread


def distinct_loops(loops: DataFrame) -> DataFrame:
    """One row per context id; repeated ingestion leaves equal rows behind.

    The rows are dealt out first: only partitions of one shuffle are sorted, not whole splits of the input.
    """
    return loops.where(F.col("ctx_id").isNotNull()).repartition("ctx_id").dropDuplicates(["ctx_id"])


def context_paths(loops: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(ctx_id, depth, path) of every context whose chain reaches an outermost loop.

    A frontier walks down from the outermost loops, one equi-join a level, so each
    context is joined once.  A level is written to the shared folder before the next;
    the walk ends when every nested context is reached, or a level is empty.  Contexts with a dangling ancestor, or in a cycle,
    are never reached.  With the paths of ``known`` contexts, the walk also starts below
    those, and only the given loops are walked.
    """
    own = spread(_steps(distinct_loops(loops)), "contexts")  # each level reads them again, without the deduplication
    return walk(own, known)[0]


def _steps(loops: DataFrame) -> DataFrame:
    return loops.select("ctx_id", "p_ctx_id", F.struct(F.col("l_name").alias("name"), F.col("iteration").cast("long").alias("iteration"), F.col("l_value").alias("value")).alias("step"))


def walk(own: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``context_paths`` of written loops, or their steps, with one row a context; and how many of them are never reached."""
    own = own if "step" in own.columns else _steps(own)
    nested = own.where(F.col("p_ctx_id").isNotNull())
    out = frontier = own.where(F.col("p_ctx_id").isNull()).select("ctx_id", F.lit(1).alias("depth"), F.array("step").alias("path"))
    left = nested.count()

    def below(above: DataFrame) -> DataFrame:
        parents = above.select(F.col("ctx_id").alias("p_ctx_id"), "depth", "path")
        return spread(nested.join(parents, "p_ctx_id").select("ctx_id", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("step")).alias("path")), "paths")

    if known is not None and left:
        outside = nested.select(F.col("p_ctx_id").alias("ctx_id")).distinct().join(own.select("ctx_id"), "ctx_id", "left_anti")
        hung = below(known.join(outside, "ctx_id", "left_semi"))
        out = frontier = out.unionByName(hung)
        left -= hung.count()
    while left:
        frontier = below(frontier)
        met = frontier.count()
        if not met:
            break
        out = out.unionByName(frontier)
        left -= met
    return out.select(*PATHS.names), left


#: Spark stops a recursion of more rows than this setting says; -1 is no limit.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def context_paths_sql(loops: DataFrame, levels: int = 100) -> DataFrame:
    """The same by a recursive CTE, of any number of rows: written once, while the session's limit of rows is lifted."""
    spark = loops.sparkSession
    own = spread(distinct_loops(loops), "contexts")  # every level reads them again
    walk = spark.sql(
        f"""
        WITH RECURSIVE walk(ctx_id, depth, path) MAX RECURSION LEVEL {int(levels)} AS (
          SELECT ctx_id, 1, array(named_struct('name', l_name, 'iteration', cast(iteration AS bigint), 'value', l_value)) FROM {{own}} WHERE p_ctx_id IS NULL
          UNION ALL
          SELECT o.ctx_id, w.depth + 1, concat(w.path, array(named_struct('name', o.l_name, 'iteration', cast(o.iteration AS bigint), 'value', o.l_value)))
          FROM walk w JOIN {{own}} o ON o.p_ctx_id = w.ctx_id)
        SELECT * FROM walk""",
        own=own,
    )
    with settings(spark, {ROW_LIMIT: "-1"}):
        return materialise(walk, "paths")
