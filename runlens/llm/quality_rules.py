"""Quality rules: per-document measures and the frequency of lines across a host's documents.

Each line is normalised (A-Z lower-cased, white space collapsed, digits to 0) and
hashed to 128 bits.  A line found in more than ``max_line_docs`` distinct documents
of its host is boilerplate: it is taken out of all of them but the document with
the smallest id (``without_lines`` writes the text that is left).  A document left with under ``min_left`` of its words is depleted
and rejected, as is one that fails the base rules (under 50 words, or more than
half of the words in repeated three-word windows).

One Python pass per document makes the measures and the line hashes, which are
written once to the shared folder; counts are distributed aggregates with
map-side combination, and a hot (host, line) is joined back under skew-aware joins.

Edge cases: null texts have no words; a null source is a host of its own; rows
without a doc_id count as one last document of their host; repeated rows count as one
document and get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_UPPER, ASCII_LOWER, materialise, rank

MIN_WORDS = 50
MAX_LINE_DOCS = 20
MIN_LEFT = 0.3
SYMBOLS = "#*$%&|<>"
_NORMAL = str.maketrans(ASCII_UPPER + "123456789", ASCII_LOWER + "0" * 9)


def repeated_words(words: list) -> int:
    """Words covered by three-word windows that occur twice or more in the list."""
    if len(words) < 4:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    size = len(seen)
    _, pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
    _, which, counts = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def line_key(line: str) -> tuple[bytes | None, int]:
    """Hash of the normalised line, and its words; None for a blank one."""
    parts = line.translate(_NORMAL).encode("utf-8", "surrogatepass").split()
    return (xxhash.xxh3_128_digest(b" ".join(parts)) if parts else None), len(parts)


def without_lines(text: str, removed: list) -> str:
    """The text without the lines of these hashes; blank lines stay."""
    gone = set(removed)
    return "\n".join(line for line in text.split("\n") if line_key(line)[0] not in gone)


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, [line hashes], [their words]."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen, dup, hashes, sizes = set(), 0, [], []
    for line in text.split("\n"):
        key, size = line_key(line)
        if size:
            dup += line in seen
            seen.add(line)
            hashes.append(key)
            sizes.append(size)
    blanks = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    return len(words), len(text) - blanks, sum(text.count(c) for c in SYMBOLS), dup, repeated_words(words), hashes, sizes


def measure_documents(docs: DataFrame) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.int64()), ("host", pa.string()), *((n, pa.int64()) for n in names), ("line_hashes", pa.list_(pa.binary())), ("line_words", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(measure(t) for t in batch.column("text").to_pylist())))
            if columns:
                ids = [batch.column(n) for n in ("doc_id", "text_key", "host")]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, schema.field(3 + k).type) for k, c in enumerate(columns))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, host string, " + ", ".join(f"{n} long" for n in names) + ", line_hashes array<binary>, line_words array<int>")


def apply_rules(docs: DataFrame, max_line_docs: int = MAX_LINE_DOCS, min_left: float = MIN_LEFT, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: the measures, n_removed_words, removed_lines (hashes, null for none), base_failed, kept."""
    measured = materialise(measure_documents(docs), "quality-rules").withColumn("rank", rank())
    base, repeated = measured.drop("line_hashes", "line_words"), _repeats_ids(measured)
    lines = measured.select("rank", "text_key", "host", F.explode(F.arrays_zip("line_hashes", "line_words")).alias("l"))
    lines = lines.select("rank", "text_key", "host", F.col("l.line_hashes").alias("hash"), F.col("l.line_words").alias("words"))
    per_doc = lines.groupBy("rank", "text_key", "host", "hash").agg(F.max("words").alias("words"), F.count("*").alias("times"))
    # repeated rows double "times"; the share below is taken of the same doubled total
    docs_of = per_doc.select("host", "hash", "rank").distinct() if repeated else per_doc
    frequent = docs_of.groupBy("host", "hash").agg(F.count("*").alias("n_docs"), F.min("rank").alias("first_doc")).where(F.col("n_docs") > max_line_docs).drop("n_docs")
    removed = per_doc.join(frequent, ["host", "hash"]).where("rank > first_doc")
    removed = removed.groupBy("rank", "text_key", "host").agg(F.sum(F.col("words") * F.col("times")).alias("removed"), F.collect_list("hash").alias("removed_lines"))
    if repeated:
        copies = base.groupBy("rank", "text_key", "host").agg(F.count("*").alias("copies"))
        removed = removed.join(copies, ["rank", "text_key", "host"]).withColumn("removed", F.col("removed") / F.col("copies")).drop("copies")
    out = base.join(removed, ["rank", "text_key", "host"], "left").withColumn("n_removed_words", F.coalesce("removed", F.lit(0)).cast("long")).drop("removed", "rank")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("n_removed_words")) < F.lit(min_left) * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted)


def _repeats_ids(measured: DataFrame) -> bool:
    row = measured.agg(F.count("*").alias("n"), F.count_distinct("rank").alias("d")).first()
    return row["n"] != row["d"]
