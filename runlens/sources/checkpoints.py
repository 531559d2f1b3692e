"""Catalogue of checkpoint files: ``<root>/<project>/<stamp>/<name>[_<loop>_<value>...].<ext>``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each extension holds.
KINDS = {"pth": "state", "npy": "array", "parquet": "frame", "pkl": "object"}


def _plain(c):
    for raw, quoted in ((".", "%2E"), ("/", "%2F"), ("_", "%5F"), ("%", "%25")):
        c = F.replace(c, F.lit(quoted), F.lit(raw))
    return c


def parse_paths(files: DataFrame) -> DataFrame:
    """Splits the ``path`` column into project, stamp, object name, steps and kind."""
    parts = F.split("path", "/")
    file = F.element_at(parts, -1)
    stem = F.split(F.regexp_replace(file, r"\.[^.]*$", ""), "_")
    extension = F.regexp_extract(file, r"\.([^.]*)$", 1)
    kind = F.coalesce(*(F.when(extension == e, F.lit(k)) for e, k in KINDS.items()), F.lit("other"))
    steps = F.transform(F.sequence(F.lit(1), F.size("stem") - 1, F.lit(2)), lambda i: F.struct(_plain(F.col("stem")[i]).alias("name"), _plain(F.col("stem")[i + 1]).alias("value")))
    out = files.withColumn("stem", stem)
    return out.select(
        "*",
        F.element_at(parts, -3).alias("projid"),
        F.element_at(parts, -2).alias("tstamp_text"),
        _plain(F.col("stem")[0]).alias("object"),
        F.when(F.size("stem") >= 3, steps).otherwise(F.array().cast("array<struct<name:string,value:string>>")).alias("steps"),
        kind.alias("kind"),
    ).drop("stem")


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """One row per file; contents are read only if the ``content`` column is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return parse_paths(files)
