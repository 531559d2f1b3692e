"""Corpus pipeline: documents in, packed training sequences out.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows it is given, and but
for the last returns the columns of ``docs``; ``run`` writes each result to the shared
folder and reads it again before the next stage.

Rows are told apart by doc_id and text together, so documents that share an id are
judged each for itself.  A row's other columns travel as one struct, so that they may
have any names.  An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import decontaminate, jaccard_join, line_dedup, packing, quality_rules
from runlens.llm.common import materialise, table

#: No SQL: the packing stage is a greedy retrieval.
ORACLE_SQL = None


def _boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """(row, doc_id, text_key): each row as one column, beside what identifies it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), *(c.alias(k) for k, c in more.items()))


def _same(left: DataFrame, right: DataFrame, *more: str) -> Column:
    """Join condition: equal id and text, missing ids equal to each other."""
    same = left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])
    for c in more:
        same = same & (left[c] == right[c])
    return same


def _with_text(docs: DataFrame, boxed: DataFrame, text: Column, changed: Column) -> DataFrame:
    """The rows in ``row`` with another text, and n_chars to match, where ``changed``."""
    out = {c: F.col(f"row.`{c}`") for c in docs.columns}
    out["text"] = F.when(changed, text).otherwise(out["text"])
    if "n_chars" in out:
        out["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return boxed.select(*(out[c].alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines above the limit of their host.

    A null or empty text has no words and goes; a null source is a host of its own; rows
    without a doc_id count as one last document; of a frequent line the smallest
    doc_id keeps its copy; repeated rows count once and stay or go together.
    """
    verdicts = quality_rules.apply_rules(docs.select("doc_id", "text", "source"))
    marked = verdicts.where(~F.col("kept") | F.col("removed_lines").isNotNull()).select("doc_id", "text_key", "host", "kept", "removed_lines")
    # written first: both uses below would measure the texts again
    marked = materialise(marked, "quality-verdicts").dropDuplicates(["doc_id", "text_key", "host"])
    own = _boxed(docs, host=F.coalesce(F.col("source").cast("string"), F.lit("")))
    kept = own.join(marked, _same(own, marked, "host"), "left").where(F.coalesce("kept", F.lit(True))).select("row", "removed_lines")
    cut = kept.select("row", F.when(F.col("removed_lines").isNotNull(), F.col("row.text")).alias("text"), "removed_lines")
    cut = cut.mapInArrow(_cut_lines, cut.select("row", F.col("text").alias("cut_text")).schema)
    return _with_text(docs, cut, F.col("cut_text"), F.col("cut_text").isNotNull())


def _cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = zip(batch.column("text").to_pylist(), batch.column("removed_lines").to_pylist())
        texts = [quality_rules.without_lines(t or "", x) if x else None for t, x in both]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "cut_text"])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one (by doc_id) has.

    Rows without a doc_id count as one last document; all rows of the smallest doc_id that
    holds a line keep it; a null text stays null; a text that loses all its lines becomes empty.
    """
    found = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")))
    return _with_text(docs, found, F.col("kept_text"), F.col("n_dropped") > 0)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of the smallest id.

    Rows without a doc_id stay, as do texts without words; of rows that repeat id and
    text one stays; rows that share an id but not the text are documents of their own.
    Of several documents with the smallest id in a group, one stays.
    """
    marked = materialise(jaccard_join.copies_to_drop(docs.select("doc_id", "text")), "copies-to-drop")
    own = _boxed(docs)
    kept = own.join(marked, _same(own, marked), "left").where(F.coalesce("kept", F.lit(True))).select("row", own["doc_id"], own["text_key"], "rows")
    once = kept.where("rows is null")
    several = kept.where("rows is not null").dropDuplicates(["doc_id", "text_key"])
    return once.unionByName(several).select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts hold no window and stay; repeated rows stay or go together.
    """
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    # written first: the optimizer would push the filter, and with it the verification, below the join
    hit = materialise(found.select("doc_id", "text_key", "contaminated"), "contaminated").where("contaminated")
    own = _boxed(docs)
    return own.join(hit, _same(own, hit), "left_anti").select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; a null text is packed as an empty one."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("jaccard_join", near_copies), ("decontaminate", benchmark), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
