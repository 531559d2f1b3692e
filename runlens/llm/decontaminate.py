"""Benchmark decontamination with DataFrame operations only.

A prefix-filtered containment join.  Item words are cut into windows of ten
consecutive words (shorter items are one window).  A window is the set of its
shingles of ``SHINGLE`` words (of all its words, if it has fewer), ordered by rarity
over all documents.  Full containment makes one shingle, the rarest, the necessary
prefix of a window.  One pass over the documents writes down where shingles of
items occur, from which come both the counts and the probes; length and position
bounds drop candidates that would leave the document, and the rest are verified word
by word against the document.

What is broadcast is measured first: windows of more than ``BROADCAST_BYTES`` with
their items are joined by a shuffle instead.

Edge cases: null texts have no words; items without words match nothing; items
without an id are ignored; rows without a doc_id are judged like all others;
repeated rows get equal results; items that repeat an id count once; an empty
table of documents gives an empty result, one of items no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, row_key

WINDOW, SHINGLE = 10, 3
BROADCAST_BYTES = 1 << 25
#: Everything but ASCII letters, digits and what lies beyond ASCII; A-Z are lower-cased word by word.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _parts(text: str = "text") -> Column:
    """Words, with an empty one before a leading and behind a trailing separator.

    Splitting is several times cheaper than extracting matches.
    """
    return F.split(F.coalesce(F.col(text), F.lit("")), SEPARATORS, -1)


def raw_words(parts: str) -> Column:
    """A column of parts without the empty ones at its ends."""
    lead = F.when(F.col(parts)[0] == "", 1).otherwise(0)
    trail = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, 1 + lead, F.greatest(F.size(parts) - lead - trail, F.lit(0)))


def _sized(df: DataFrame, held: int) -> DataFrame:
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: (words array, items array of ids as strings)."""
    words = items.where(F.col("item_id").isNotNull()).select("item_id", _parts().alias("p"))
    words = words.select("item_id", F.transform(raw_words("p"), ascii_lower).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    cut = words.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(window)).alias("words"))
    return cut.groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))


def _shingle(words: list) -> Column:
    """Hash of consecutive words; null where one is missing or not a word."""
    inside = F.lit(True)
    for w in words:
        inside = inside & w.isNotNull() & (w != "")
    return F.when(inside, F.xxhash64(F.lit(len(words)), *words))


def window_shingles(windows: DataFrame) -> DataFrame:
    """(words, items, at, shingle) of every shingle of every window."""
    size = F.least(F.size("words"), F.lit(SHINGLE))
    placed = windows.select("words", "items", size.alias("k"), F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("at"))
    each = [F.when(F.col("k") == k, _shingle([F.get("words", F.col("at") + j) for j in range(k)])) for k in range(1, SHINGLE + 1)]
    return placed.select("words", "items", "at", F.coalesce(*each).alias("shingle"))


def document_shingles(docs: DataFrame, sizes: list) -> DataFrame:
    """(doc_id, text_key, pos, shingle) of every shingle of ``sizes`` words of every document."""
    # keys come first: computed beside the generator, they would make it copy the text to every word
    plain = F.octet_length("text") == F.length("text")
    keyed = docs.select(*row_key(), F.coalesce(plain, F.lit(True)).alias("plain"), "text")
    keyed = keyed.select("doc_id", "text_key", "plain", F.when(F.col("plain"), F.lower("text")).otherwise(F.col("text")).alias("text"))
    parts = keyed.select("doc_id", "text_key", "plain", _parts().alias("w0"))
    names = [f"w{k}" for k in range(max(sizes))]
    shifted = parts.select("doc_id", "text_key", "plain", F.when(F.col("w0")[0] == "", 1).otherwise(0).alias("lead"), "w0", *[F.slice("w0", k + 1, F.size("w0")).alias(n) for k, n in enumerate(names) if k])
    exploded = shifted.select("doc_id", "text_key", "plain", "lead", F.posexplode(F.arrays_zip(*names)).alias("at", "z"))
    words = [F.when(F.col("plain"), F.col(f"z.{n}")).otherwise(ascii_lower(F.col(f"z.{n}"))).alias(n) for n in names]
    rows = exploded.where("z.w0 <> ''").select("doc_id", "text_key", (F.col("at") - F.col("lead")).alias("pos"), *words)
    hashes = [_shingle([F.col(n) for n in names[:k]]) for k in sizes]
    shingle = F.explode(F.array(*hashes)) if len(sizes) > 1 else hashes[0]
    return rows.select("doc_id", "text_key", "pos", shingle.alias("shingle")).where("shingle is not null")


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, item_ids) for every row; item_ids are sorted strings."""
    windows = item_windows(items, window)
    length = lambda c: F.octet_length(F.array_join(c, " "))
    # shingles, windows and what is made of them below hold no more than a few times these bytes
    facts = windows.agg(F.sum(length("words") + length("items") + 64).alias("held"), F.collect_set(F.least(F.size("words"), F.lit(SHINGLE))).alias("sizes")).first()
    held, sizes = facts["held"] or 0, sorted(facts["sizes"]) or [SHINGLE]
    placed = window_shingles(windows)
    shared = materialise(document_shingles(docs, sizes).join(_sized(placed.select("shingle").distinct(), held), "shingle"), "shared-shingles")
    counts = shared.groupBy("shingle").agg(F.count("*").alias("n"))
    # the rarest shingle of each window and its place there; a window with one that no document has can't
    # occur; min_by's key breaks ties by shingle, then place
    placed = placed.join(_sized(counts, held), "shingle")
    prefixes = placed.groupBy("words", "items").agg(F.min_by(F.struct("shingle", "at"), F.struct("n", "shingle", "at")).alias("p"), F.count("*").alias("found"))
    prefixes = prefixes.where(F.col("found") == F.size("words") - F.least(F.size("words"), F.lit(SHINGLE)) + 1).select(F.col("p.shingle").alias("shingle"), F.col("p.at").alias("at"), "words", "items")
    probes = shared.join(_sized(prefixes, held), "shingle").where(F.col("pos") >= F.col("at"))
    candidate = F.struct((F.col("pos") - F.col("at")).alias("start"), "words", "items")
    # a set, as rows that repeat id and text have the same candidates
    candidates = probes.groupBy(F.col("doc_id").alias("at_id"), F.col("text_key").alias("at_key")).agg(F.collect_set(candidate).alias("cand"))
    texts = docs.select("doc_id", "text", row_key()[1])
    texts = texts.join(candidates, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_key") == F.col("at_key")), "left")
    texts = texts.select("doc_id", "text_key", "cand", _parts().alias("p")).select("doc_id", "text_key", "cand", raw_words("p").alias("w"))
    texts = texts.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), "cand", F.when(F.col("cand").isNotNull(), F.transform("w", ascii_lower)).alias("lw"))
    # element by element, as slicing would copy the whole document for each candidate; two uses of
    # lw keep the optimizer from inlining it, that is from lower-casing the document for each element
    verified = F.expr("filter(cand, c -> c.start + size(c.words) <= size(lw) and forall(transform(c.words, (w, k) -> lw[c.start + k] = w), same -> same))")
    found = texts.select("doc_id", "text_key", "n_words", F.when(F.col("cand").isNotNull(), verified).alias("found"))
    n_hit = F.expr("size(array_distinct(flatten(transform(found, m -> sequence(m.start, m.start + size(m.words) - 1)))))")
    ids = F.array_sort(F.array_distinct(F.flatten(F.col("found.items"))))
    some = F.size("found") > 0
    return found.select(
        "doc_id", "text_key", "n_words", F.when(some, n_hit).otherwise(0).cast("long").alias("n_hit"), F.when(some, ids).otherwise(F.array().cast("array<string>")).alias("item_ids")
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (sorted strings) and contaminated."""
    return find_hits(docs, items, window).withColumn("contaminated", F.col("n_hit") > 0)
