"""Line deduplication with DataFrame operations only.

Lines travel as 128-bit hashes, written once to the shared folder.  They are dealt
out by equal ranges of the hash, 4096 or one for each ``RANGE_BYTES`` of input (hashes are
uniform, so the splitters need no sample) with a secondary sort by document and position; a running window streams the first occurrence of
every hash, and what comes back per document is a sparse bitmap of dropped lines
(one 64-bit mask for each 64 lines that lose any), never text.

Skew: the ``HOT_KEYS`` most frequent hashes are aggregated map-side and broadcast
(that many rows at most, whatever the input); every other hash has at most
``1 / HOT_KEYS`` of all lines, so no range partition holds an unbounded group.

Edge cases: null text is one empty line; rows without a doc_id count
as one last document and lose to all others; repeated rows get equal results; a document whose lines are all
dropped gets the empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_SPACE, ASCII_UPPER, input_bytes, materialise, rank, row_key

HOT_KEYS, RANGE_BYTES = 1000, 1 << 24
MIN_CHARS = 10


def _lines(text: str = "text"):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased.

    Trimming and character-wise translation scan every character, so both are kept
    to the lines that need them: those with white space at an end, and those with
    an upper-case letter beyond ASCII, which ``lower`` would change too.
    """
    ends = F.lit(False)
    for c in ASCII_SPACE:
        ends = ends | F.startswith(line, F.lit(c)) | F.endswith(line, F.lit(c))
    trimmed = F.when(ends, F.btrim(line, F.lit(ASCII_SPACE))).otherwise(line)
    plain = F.when(F.octet_length(trimmed) == F.length(trimmed), F.lit(True)).otherwise(~trimmed.rlike(r"[[\p{javaUpperCase}\p{javaTitleCase}]&&[^A-Z]]"))
    return F.when(plain, F.lower(trimmed)).otherwise(F.translate(trimmed, ASCII_UPPER, ASCII_LOWER))


def line_occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hash, rank, text_key, pos) of every line whose key has ``min_chars`` code points."""
    lines = docs.select(rank(), row_key()[1], "text").select("rank", "text_key", F.posexplode(_lines()).alias("pos", "line"))
    return lines.select("rank", "text_key", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars).select(F.unhex(F.md5("key")).alias("hash"), "rank", "text_key", "pos")


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(rank, text_key, masks map<word, bits>, n_dropped) for documents that lose lines."""
    occ = materialise(line_occurrences(docs, min_chars), "line-dedup")
    n_ranges = max(4096, input_bytes(docs) // RANGE_BYTES)
    occ = occ.withColumn("range", F.expr(f"cast(conv(substring(hex(hash), 1, 8), 16, 10) as long) * {n_ranges}L div 4294967296L").cast("int"))
    hot = occ.groupBy("hash").agg(F.count("*").alias("n"), F.min("rank").alias("hot_doc"))
    hot = hot.orderBy(F.desc("n"), "hash").limit(HOT_KEYS).select("hash", "hot_doc")
    marked = occ.join(F.broadcast(hot), "hash", "left")
    dropped_hot = marked.where(F.col("hot_doc") < F.col("rank")).select("rank", "text_key", "pos")
    cold = marked.where(F.col("hot_doc").isNull()).drop("hot_doc")
    ordered = cold.repartition("range").sortWithinPartitions("range", "hash", "rank", "pos")
    first = F.first("rank").over(Window.partitionBy("range", "hash").orderBy("rank", "pos").rowsBetween(Window.unboundedPreceding, 0))
    dropped_cold = ordered.withColumn("first_doc", first).where("first_doc < rank").select("rank", "text_key", "pos")
    bits = dropped_hot.unionByName(dropped_cold).groupBy("rank", "text_key", F.expr("pos div 64").cast("int").alias("word"))
    words = bits.agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("mask"))
    return words.groupBy("rank", "text_key").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("masks"), F.sum(F.bit_count("mask")).cast("long").alias("n_dropped")
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` plus ``n_lines``, ``n_dropped`` and ``kept_text``; columns of these names are replaced.

    A key of at least ``min_chars`` code points found in two documents or more
    loses all its lines but those of the smallest doc_id that holds it.
    """
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped", "kept_text")]
    packed = docs.select("doc_id", "text", *([F.struct(*[F.col(f"`{c}`") for c in extra]).alias("_rest")] if extra else []), row_key()[1], rank())
    joined = packed.join(drop_bitmaps(docs, min_chars), ["rank", "text_key"], "left")
    joined = joined.withColumn("_lines", _lines())
    kept = F.expr(
        """array_join(flatten(transform(
             transform(sequence(0, cast((size(_lines) - 1) div 64 as int)), w -> struct(w as w, coalesce(masks[w], 0L) as m)),
             x -> if(x.m = 0, slice(_lines, x.w * 64 + 1, 64),
                     filter(slice(_lines, x.w * 64 + 1, 64), (l, i) -> (shiftright(x.m, i) & 1) = 0)))), '\n')"""
    )
    out = joined.select(
        "doc_id",
        "text",
        *[F.col(f"_rest.`{c}`").alias(c) for c in extra],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("masks").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"),
    )
    return out
