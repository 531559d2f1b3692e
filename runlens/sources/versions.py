"""Version logs: exported commit histories as (tstamp, vid, authored, message).

The export is the text that ``git log`` prints with ``EXPORT`` as its format: fields end with
a unit separator and commits with a record separator, so messages may hold anything else,
line breaks included.  Spark splits the text at the record separators, a large history
into many tasks.  A commit belongs to a run if its message has the marker exactly once and three
parts, the last of which is the run's time stamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT = "%H%x1f%aI%x1f%B%x1e"
_FIELD, _COMMIT = "\x1f", "\x1e"


def commit_stamp(message: Column, marker: str) -> Column:
    """The stamp in ``MARKER::kind::stamp``, null where the marker isn't there exactly once."""
    parts = F.split(F.trim(message), "::", -1)
    once = F.size(F.split(message, rf"\Q{marker}::\E", -1)) == 2
    return F.when(once & (F.size(parts) == 3), F.trim(parts[2]))


def read_versions(spark: SparkSession, paths: str | list[str], marker: str) -> DataFrame:
    """The commits of runs: stamp, id, authoring time (as text as long as the stamp), and that time as an instant."""
    fields = F.split(F.col("value"), _FIELD, 3)
    commits = spark.read.option("lineSep", _COMMIT).text(paths).where(F.size(fields) == 3)
    stamped = commits.select(F.regexp_replace(fields[0], r"^\s+|\s+$", "").alias("vid"), fields[1].alias("iso"), commit_stamp(F.regexp_replace(fields[2], r"^\s+|\s+$", ""), marker).alias("stamp")).where(F.col("stamp").isNotNull())
    return stamped.select(F.col("stamp").try_cast("timestamp_ntz").alias("tstamp"), "vid", F.substr("iso", F.lit(1), F.length("stamp")).alias("authored"), F.col("iso").try_cast("timestamp").alias("at"))


def newest_first(versions: DataFrame) -> DataFrame:
    """The walk of a history, as one distributed sort."""
    return versions.orderBy(F.desc("at"), "vid")
