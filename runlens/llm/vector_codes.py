"""Vector code compression: product codes with codebooks refined by integer k-means.

Components become integers, so every distance and sum is exact and no result depends
on how rows are dealt.  Each of ``PARTS`` part positions has a codebook of at most
``ENTRIES`` entries.  A round sends out a kd-tree of each codebook (bounded: entries
times dimension), tasks look up their vectors' nearest entries by branch and bound,
a batch at a time: a node is entered by the rows of the batch whose distance to its
bounding box is not above the best found, equal ones included, so that of entries
equally near the lowest index is found.  Tasks add up integers per entry, Spark adds
up the tasks' sums, and the driver divides (entries times dimension numbers again).

Errors are summed by label; a label with over a ten-thousandth of all rows (so under
10,000 labels) is joined by broadcast, the others by a shuffle, where each is small.

Edge cases: vectors that are null or hold null or non-finite components are dropped;
shorter vectors, and dimensions that don't divide by the number of parts, count as
filled up with zeros; integers are held within a bound that keeps squared distances
in 60 bits (for 64 dimensions, components within 131,072); with fewer vectors than
entries the codebook has one entry a vector; rows without an id rank last in the
choice of first entries and equal ids rank by their components; repeated rows each get
their row; null labels are one label; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LEAF, CHUNK = 16, 4096
#: A label with over one in so many rows is joined by broadcast.
HOT_SHARE = 10_000


@dataclass
class Node:
    low: np.ndarray
    high: np.ndarray
    ids: np.ndarray | None = None
    points: np.ndarray | None = None
    norms: np.ndarray | None = None
    below: tuple | None = None


class Tree:
    """A kd-tree over a codebook; ``nearest`` finds (squared distance, index), ties to the lower index."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        # doubles are exact, and have a fast product, while squared distances stay within 53 bits
        most = int(np.abs(entries).max(initial=0))
        self.entries, self.leaf, self.most = entries, leaf, most
        self.roots = {kind: self._build(entries.astype(kind), np.arange(len(entries))) for kind in (np.float64, np.int64)}

    def _build(self, entries: np.ndarray, ids: np.ndarray) -> Node:
        own = entries[ids]
        node = Node(own.min(0), own.max(0))
        spread = node.high - node.low
        if len(ids) <= self.leaf or not spread.any():
            node.ids, node.points, node.norms = ids, own.T.copy(), (own * own).sum(1)
            return node
        axis = int(spread.argmax())
        order = np.argsort(own[:, axis], kind="stable")
        half = len(ids) // 2
        node.below = tuple(self._build(entries, np.sort(ids[part])) for part in (order[:half], order[half:]))
        return node

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = max(self.most, int(np.abs(points).max(initial=0)))
        kind = np.float64 if 4 * most * most * max(points.shape[1], 1) < 1 << 53 else np.int64
        queries = points.astype(kind)
        norms = (queries * queries).sum(1)
        best = np.full(len(queries), np.inf if kind is np.float64 else np.iinfo(np.int64).max, kind)
        at = np.zeros(len(queries), np.int64)

        def distance(node: Node, q: np.ndarray) -> np.ndarray:
            off = q - np.clip(q, node.low, node.high)
            return np.einsum("ij,ij->i", off, off)

        def visit(node: Node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            q = queries[rows]
            if node.below is None:
                d = norms[rows, None] - 2 * (q @ node.points) + node.norms
                pick = d.argmin(1)
                found, index = d[np.arange(len(rows)), pick], node.ids[pick]
                better = (found < best[rows]) | ((found == best[rows]) & (index < at[rows]))
                best[rows[better]], at[rows[better]] = found[better], index[better]
                return
            bounds = [distance(child, q) for child in node.below]
            left_first = bounds[0] <= bounds[1]
            for near, chosen in ((0, left_first), (1, ~left_first)):
                for side in (near, 1 - near):
                    some = chosen & (bounds[side] <= best[rows])
                    visit(node.below[side], rows[some])

        visit(self.roots[kind], np.arange(len(queries)))
        return best.astype(np.int64), at


def kept(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Rows whose vector is there and finite."""
    return vectors.where(F.col(embedding).isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def integers(embedding: Column, width: int) -> Column:
    """floor(1024 x) of each component, filled up with zeros to ``PARTS`` parts of ``width``."""
    most = float(isqrt((1 << 60) // max(width, 1)) // 2)
    cells = F.transform(embedding, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-most)), F.lit(most))).cast("int"))
    return F.concat(cells, F.array_repeat(F.lit(0), F.lit(PARTS * width) - F.size(embedding)))


def _points(column: pa.Array, width: int) -> np.ndarray:
    """Rows, parts, components."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), PARTS, width)


def first_codebooks(cells: DataFrame, width: int) -> np.ndarray:
    """The parts of the vectors of smallest id: parts, entries, components."""
    rows = cells.orderBy(F.col("vec_id").asc_nulls_last(), "cells").limit(ENTRIES).select("cells").collect()
    return np.array([r["cells"] for r in rows], np.int64).reshape(len(rows), PARTS, width).transpose(1, 0, 2)


def refine(cells: DataFrame, books: np.ndarray, trees: object) -> np.ndarray:
    """One round: every entry becomes the floor of its parts' mean; unused ones stay."""
    parts, entries, width = books.shape

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                points = _points(batch.column(0).slice(a, CHUNK), width)
                for p, tree in enumerate(trees.value):
                    at = tree.nearest(points[:, p])[1]
                    sums[p, :, width] += np.bincount(at, minlength=entries)
                    for c in range(width):
                        sums[p, :, c] += np.bincount(at, points[:, p, c], entries).astype(np.int64)
        p, e, c = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((p, pa.int32()), (e, pa.int32()), (c, pa.int32()), (sums[p, e, c], pa.int64()))], names=["part", "entry", "component", "total"])

    found = cells.select("cells").mapInArrow(tally, "part int, entry int, component int, total long").groupBy("part", "entry", "component").agg(F.sum("total").alias("total")).toArrow()
    sums = np.zeros((parts, entries, width + 1), np.int64)
    sums[tuple(found.column(c).to_numpy() for c in ("part", "entry", "component"))] = found.column("total").to_numpy()
    counts = sums[:, :, width:]
    return np.where(counts > 0, sums[:, :, :width] // np.maximum(counts, 1), books)


def assign(cells: DataFrame, trees: object, width: int) -> DataFrame:
    """vec_id, label, code, error."""
    schema = T.StructType([cells.schema["vec_id"], cells.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                points = _points(part.column(2), width)
                found = [tree.nearest(points[:, p]) for p, tree in enumerate(trees.value)]
                codes = np.stack([at for _, at in found], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(d for d, _ in found), pa.int64())], names=schema.names)

    return cells.select("vec_id", "label", "cells").mapInArrow(run, schema)


def with_label_errors(coded: DataFrame, rows: int) -> DataFrame:
    """Adds the errors summed over equal labels."""
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    hot = F.broadcast(totals.where(F.col("_n") > rows // HOT_SHARE))
    rare = coded.join(hot, same, "left_anti").join(totals.where(F.col("_n") <= rows // HOT_SHARE), same)
    return coded.join(hot, same).unionByName(rare).drop("_label", "_n")


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of each kept vector, and the codebooks: parts, entries, components."""
    spark = vectors.sparkSession
    good = kept(vectors, embedding)
    dimension, rows = good.agg(F.max(F.size(embedding)), F.count("*")).first()
    width = -(-(dimension or 0) // PARTS)
    cells = materialise(good.select("vec_id", "label", integers(F.col(embedding), width).alias("cells")), "vectors")
    books = first_codebooks(cells, width)
    for step in range(ROUNDS + 1):
        trees = spark.sparkContext.broadcast([Tree(book) for book in books] if rows else [])
        if step < ROUNDS and rows:
            books = refine(cells, books, trees)
    coded = materialise(assign(cells, trees, width), "codes")
    return with_label_errors(coded, rows), books
