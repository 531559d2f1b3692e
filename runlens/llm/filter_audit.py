"""Filter interaction audit: what each of several filters removes in every order of them.

Inclusion-exclusion.  A row's failures are flags; for each of the 2^k sets of filters
one sum of flag products counts the rows that fail all of the set.  Everything else is
arithmetic on these joint counts, per part: the Möbius inversion over subsets gives
the rows that survive any set of filters, that over supersets the rows that fail one
filter only, and since a set's joint count is, but for its sign, the Harsanyi dividend
of the game "rows removed by a set of filters", sharing it equally among the set's
filters gives their Shapley values.  No order is ever applied to rows.

Texts are read once and never shuffled: a row goes on as its id, its part, a SHA-256
digest and its flags, summed up by these before anything else, so that repeated rows
travel once.  Whether a text has a smaller id's copy is settled by the smallest id of
each digest (an aggregation that combines ahead of its shuffle) and a join on digest
and id together, which no group of copies makes hot.

Edge cases: a null text is the empty text; it has no words, so A fails and B and C
don't; a null part is the part named by the empty string; rows without an id rank
behind all ids and aren't copies of each other; rows that repeat an id and a text are
no copies of each other either; several labels of one id count as one that holds if
any does; null labels, and labels without a document, count nowhere; extra columns are
ignored; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, rank

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 100, 80, 10
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides, as 0 or 1."""
    words = F.array_remove(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    failed = {
        "A": n < MIN_WORDS,
        "B": 100 * distinct < MIN_DISTINCT_PERCENT * n,
        "C": 100 * capitals > MAX_CAPITAL_PERCENT * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }
    return {k: v.cast("long") for k, v in failed.items()}


def flag_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (0 or 1), and how many rows are so: n, good, toxic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), rank(), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *(c.alias(k) for k, c in text_failures(text).items())
    )
    own = [k for k in FILTERS if k != "E"]
    rows = plain.groupBy("doc_id", "rank", "part", "digest", *own).agg(F.count("*").alias("n"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(*(F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("long")).alias(c) for c in ("quality", "toxic")))
    held = rows.join(marks, "doc_id", "left")
    counted = held.select("rank", "part", "digest", *own, "n", *((F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    counted = materialise(counted, "audit")  # read twice: for the first ids, and to be held against them
    first = counted.groupBy("digest").agg(F.min("rank").alias("rank")).withColumn("_first", F.lit(True))
    copies = counted.join(first, ["digest", "rank"], "left").withColumn("E", F.col("_first").isNull().cast("long"))
    return copies.groupBy("part", *FILTERS).agg(*(F.sum(c).alias(c) for c in COUNTS))


def joint_failures(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, arrays over all sets of filters (bit k: the k-th one) of the rows that fail the whole set."""
    products = [reduce(mul, (F.col(f) for k, f in enumerate(filters) if s >> k & 1), F.lit(1).cast("long")) for s in range(1 << len(filters))]
    return rows.groupBy("part").agg(*(F.array(*(F.sum(F.col(c) * p) for p in products)).alias(c) for c in COUNTS))


def interactions(joint: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step, from the joint counts."""
    sets, k = f"sequence(0, {(1 << len(filters)) - 1})", len(filters)

    def survivors(c: str) -> Column:
        return F.expr(f"transform({sets}, p -> aggregate({sets}, 0L, (t, s) -> t + if((s & ~p) = 0, if(bit_count(s) % 2 = 0, {c}[s], -{c}[s]), 0L)))").alias(f"left_{c}")

    def over_sets_with_each(share: str) -> str:
        return f"transform(sequence(0, {k - 1}), f -> aggregate({sets}, 0L, (t, s) -> t + if((s & shiftleft(1, f)) = 0, 0L, if(bit_count(s) % 2 = 1, n[s], -n[s]){share})))"

    solved = joint.select("part", "n", *(survivors(c) for c in COUNTS), F.expr(over_sets_with_each("")).alias("alone"), F.expr(over_sets_with_each(f" * ({factorial(k)} div bit_count(s))")).alias("shared"))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    steps = solved.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    place = f"instr('{filters}', substr(filter_order, {{}}, 1)) - 1"
    at = steps.withColumn("f", F.expr(place.format("step"))).withColumn("before", F.expr(f"aggregate(filter(sequence(1, {k}), i -> i < step), 0, (m, i) -> m | shiftleft(1, {place.format('i')}))"))
    at = at.withColumn("after", F.expr("before | shiftleft(1, f)"))
    gone = {c: f"left_{c}[before] - left_{c}[after]" for c in COUNTS}
    shown = {
        "kept": "left_n[after]", "removed": gone["n"], "redundant": f"n[shiftleft(1, f)] - ({gone['n']})", "unique_fails": "alone[f]",
        "good_lost": gone["good"], "toxic_lost": gone["toxic"], "shapley": "shared[f]",
    }
    return at.select("part", "filter_order", "step", *(F.expr(e).alias(c) for c, e in shown.items()))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return interactions(joint_failures(flag_rows(docs, labels)))
