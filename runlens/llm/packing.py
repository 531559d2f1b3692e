"""Lexical retrieval packing: BM25 neighbours fill each seed document's window.

One pass tokenizes every whole text, cuts off full windows (sequences of their own)
and keeps each document's tail, under one window long.  Tails are dealt into shards
of bounded size by content: a document's BM25 weights, over its whole text, are
projected to ``DIMS`` numbers, and a tree of median splits along principal directions,
built on a sample, leads those that point the same way to one leaf.  A leaf is a
shard; one that came out too large (copies, or more than the sample tells apart) is
split by hash.  A shard builds an inverted index over the whole texts of its tails'
documents, with frequencies and mean length of the corpus.  The longest unused tail
seeds a window; the index returns its unused neighbours by BM25, which are appended
in that order; the one that no longer fits is cut, and its rest stays available.
So only a shard's last sequence, and ends under ``MIN_CUT`` tokens, are padded.

Neighbours are those of the shard: the tree finds a share of the corpus's best ones
only, which the README gives as measured.  A text of whole windows has nothing to be
placed; it counts in the frequencies.

Terms are token ids, so the frequency table has a fixed size: it is summed in a few
tasks, read by the driver, and sent with the tasks (a few hundred kB at any scale).

Texts of Latin script are encoded with tiktoken over the same vocabulary, several
times quicker than tokenizers; the two split other scripts by Unicode tables of
their own versions, so texts with characters beyond ``U+024F`` (general punctuation
aside) take tokenizers itself.

Edge cases: a null or empty text is the separator alone; rows without a doc_id and
repeated rows are packed like any other; ties in score go to the smaller place; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialise
from .repeats import flatten_ranges

WINDOW, SEPARATOR, MIN_CUT = 1024, 0, 16
SHARD_DOCS, K1, B = 512, 1.2, 0.75
#: Numbers in a sketch, sampled tails a shard, and the most and the least (in a node that is split) of them.
DIMS, SAMPLES, MAX_SAMPLE, LEAST_SAMPLE = 64, 16, 1 << 17, 8
VOCABULARY = 1 << 16
#: Bits of a sequence's number in its shard, also where repeated rows fill one; shards are under 2**31 as well.
NUMBER_BITS = 31
_OTHER = re.compile("[^\x00-\u024f\u2000-\u206f]")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TOKENIZED = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("terms", pa.binary())])
FULL, TAIL, FREQUENCY = 0, 1, 2


def vocabulary_path(name: str) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids as uint16, for the byte-level vocabulary file at ``path``, of ``VOCABULARY`` ids at most."""
    exact, quick = Tokenizer.from_file(path), None
    if (largest := max(exact.get_vocab(with_added_tokens=True).values(), default=0)) >= VOCABULARY:
        raise ValueError(f"ids up to {largest} don't fit 16 bits; this packing takes vocabularies of {VOCABULARY} ids at most")
    ranked = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranked):
        with open(ranked, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {t.content: i for i, t in exact.get_added_tokens_decoder().items()}
        quick = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if quick is None or _OTHER.search(text):
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint16)
        return np.asarray(quick.encode_to_numpy(text, allowed_special="all")).astype(np.uint16)

    return encode


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def counted(ids: bytes, terms: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of a whole text and their counts; ``terms`` has them where the text is more than its tail."""
    if terms is None:
        return np.unique(np.frombuffer(ids, np.uint16), return_counts=True)
    n = len(terms) // 6
    return np.frombuffer(terms, np.uint16, n), np.frombuffer(terms, np.uint32, n, 2 * n)


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """Full windows, tails with their ids and the text's terms, and a row of document frequencies per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path), np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint16(SEPARATOR))
                n = len(ids)
                for a in range(0, n - WINDOW + 1, WINDOW):
                    rows.append((FULL, doc_id, a, WINDOW, _crc(ids[a : a + WINDOW]), n, None, None))
                tail = ids[n - n % WINDOW :]
                terms, counts = np.unique(ids, return_counts=True)
                seen[terms] += 1
                if len(tail):
                    whole = terms.tobytes() + counts.astype(np.uint32).tobytes() if n > WINDOW else None
                    rows.append((TAIL, doc_id, n - len(tail), len(tail), None, n, tail.tobytes(), whole))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _TOKENIZED)], schema=_TOKENIZED)
        if seen.any():
            last = (FREQUENCY, None, None, None, None, None, zlib.compress(seen.tobytes(), 1), None)
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(last, _TOKENIZED)], schema=_TOKENIZED)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "kind int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, terms binary")


def frequencies(tokenized: DataFrame) -> np.ndarray:
    """In how many documents each id occurs, over the whole corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for vector in batch.column("ids").to_pylist():
                total += np.frombuffer(zlib.decompress(vector), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    sums = tokenized.where(F.col("kind") == FREQUENCY).select("ids").repartition(16).mapInArrow(add, "sum binary").collect()
    return sum((np.frombuffer(r["sum"], np.int64) for r in sums), np.zeros(VOCABULARY, np.int64))


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    return np.random.default_rng(8).standard_normal((VOCABULARY, DIMS), np.float32)


def sketches(ids: list, terms: list, idf: np.ndarray) -> np.ndarray:
    """Unit vectors whose products follow the BM25 weight that two whole texts share."""
    out = np.empty((len(ids), DIMS), np.float32)
    for a in range(0, len(ids), 256):
        pairs = [counted(i, t) for i, t in zip(ids[a : a + 256], terms[a : a + 256])]
        term, tf = (np.concatenate(c) for c in zip(*pairs))
        weight = np.sqrt(idf[term] * tf / (tf + K1)).astype(np.float32)
        starts = np.r_[0, np.cumsum([len(t) for t, _ in pairs])[:-1]]
        out[a : a + 256] = np.add.reduceat(_directions()[term] * weight[:, None], starts)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), np.float32(1e-9))


class Tree:
    """Median splits of sampled sketches along their principal directions, until a leaf stands for a shard."""

    def __init__(self, sample: np.ndarray, n: int):
        self.child, self.direction, self.least = [[-1, -1]], [np.zeros(DIMS, np.float32)], [np.float32(0)]
        todo, share = [(0, sample)], n / max(1, len(sample))
        while todo:
            node, own = todo.pop()
            if len(own) * share <= SHARD_DOCS or len(own) < LEAST_SAMPLE:
                continue
            centred = own - own.mean(0)
            line = centred[np.argmax((centred * centred).sum(1))]
            for _ in range(8):
                line = centred.T @ (centred @ line)
                line = line / np.maximum(np.sqrt((line * line).sum()), np.float32(1e-30))
            along = (own * line).sum(1)
            least = np.partition(along, len(own) // 2)[len(own) // 2]
            if least == along.min():
                above = along[along > least]
                if not len(above):
                    continue  # copies: nothing tells them apart
                least = above.min()
            self.direction[node], self.least[node] = line, least
            for side, part in enumerate((own[along < least], own[along >= least])):
                self.child[node][side] = len(self.child)
                todo.append((len(self.child), part))
                self.child.append([-1, -1])
                self.direction.append(self.direction[0] * 0)
                self.least.append(np.float32(0))
        self.child, self.direction, self.least = np.array(self.child), np.stack(self.direction), np.array(self.least, np.float32)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        at = np.zeros(len(vectors), np.int64)
        while len(inner := np.flatnonzero(self.child[at, 0] >= 0)):
            along = (vectors[inner] * self.direction[at[inner]]).sum(1)
            at[inner] = self.child[at[inner], (along >= self.least[at[inner]]).astype(np.int64)]
        return at


def deal(tails: DataFrame, n: int, idf: np.ndarray) -> DataFrame:
    """``tails`` with a shard each, of some ``SHARD_DOCS`` at most, near texts in one."""
    key = F.xxhash64("doc_id", "start", "ids")
    if n <= SHARD_DOCS:
        return tails.withColumn("shard", F.lit(0).cast("long"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(batch.column("ids").to_pylist(), batch.column("terms").to_pylist(), idf)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in found], pa.binary())], names=["sketch"])

    wanted = min(MAX_SAMPLE, max(1 << 12, n * SAMPLES // SHARD_DOCS))
    chosen = tails if wanted >= n else tails.where(F.pmod(key, F.lit(n)) < wanted)
    sample = sorted(bytes(r["sketch"]) for r in chosen.select("ids", "terms").mapInArrow(sketch, "sketch binary").collect())
    tree = Tree(np.frombuffer(b"".join(sample), np.float32).reshape(-1, DIMS), n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaves(sketches(batch.column("ids").to_pylist(), batch.column("terms").to_pylist(), idf))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", *batch.schema.names])

    placed = materialise(tails.mapInArrow(place, "leaf long, doc_id long, start long, doc_tokens long, ids binary, terms binary"), "placed")
    parts = np.zeros(len(tree.child), np.int64)
    for leaf, found in placed.groupBy("leaf").count().collect():
        parts[leaf] = -(-found // SHARD_DOCS)
    rows = tails.sparkSession.createDataFrame(list(zip(range(len(parts)), (np.cumsum(parts) - parts).tolist(), parts.tolist())), "leaf long, first long, parts long")
    shard = F.col("first") + F.pmod(key, F.col("parts"))
    return placed.join(F.broadcast(rows), "leaf").withColumn("shard", shard).drop("leaf", "first", "parts")


class Index:
    """BM25 inverted index over a shard's tails, by their whole texts: postings of (tail, weight) by term."""

    def __init__(self, counts: list, size: np.ndarray, idf: np.ndarray, mean: float):
        self.terms = [terms.astype(np.int64) for terms, _ in counts]
        term = np.concatenate(self.terms)
        tail = np.repeat(np.arange(len(counts)), [len(t) for t in self.terms])
        tf = np.concatenate([c for _, c in counts]).astype(np.float64)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[tail] / mean))
        order = np.argsort(term, kind="stable")
        self.tail, self.weight = tail[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(VOCABULARY + 1))

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused tails that share a term with the seed, best first; the others behind them."""
        terms = self.terms[seed]
        at = flatten_ranges(self.first[terms], self.first[terms + 1] - self.first[terms])
        score = np.bincount(self.tail[at], weights=self.weight[at], minlength=len(used))
        score[used] = -1.0
        best = np.argsort(-score, kind="stable")
        return best[: len(used) - int(used.sum())]


def pack_shard(rows: list, idf: np.ndarray, shard: int, mean: float | None = None) -> list:
    """Pieces of one shard's tails; rows are (doc_id, start, doc_tokens, ids, and terms where the text has more).

    ``mean`` is the mean length of a text; that of the shard where it isn't given.
    """
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3].tobytes(), (*r[4:], None)[0] or b""))
    size, left = np.array([r[2] for r in rows], np.float64), np.array([len(r[3]) for r in rows])
    index = Index([counted(r[3].tobytes(), *(r[4:] or (None,))) for r in rows], size, idf, mean or size.mean())
    begin, used, out, number = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool), [], 0
    while not used.all():
        seed = int(np.argmax(np.where(used, -1, left)))
        sequence, offset = (shard << NUMBER_BITS | number) * 2 + 1, 0

        def put(k: int, n: int) -> None:
            nonlocal offset
            doc_id, start, doc_tokens, ids = rows[k][:4]
            out.append((doc_id, start + int(begin[k]), n, _crc(ids[begin[k] : begin[k] + n]), doc_tokens, sequence, offset))
            begin[k] += n
            left[k] -= n
            used[k] = left[k] == 0
            offset += n

        put(seed, int(left[seed]))
        if WINDOW - offset >= MIN_CUT and not used.all():
            for k in index.neighbours(seed, used).tolist():
                put(k, min(int(left[k]), WINDOW - offset))
                if WINDOW - offset < MIN_CUT:
                    break
        number += 1
    return out


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokenized = materialise(tokenize(docs, vocabulary_path(vocabulary)), "tokenized")
    seen = frequencies(tokenized)
    tails = tokenized.where(F.col("kind") == TAIL)
    n, mean = tails.agg(F.count("*"), F.avg("doc_tokens")).first()
    n_docs = seen[SEPARATOR]  # each text ends in one
    idf = np.log1p((n_docs - seen + 0.5) / (seen + 0.5)).astype(np.float32)
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])

    def run(shard: pa.Table) -> pa.Table:
        columns = [shard.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids", "terms")]
        rows = [(d, s, t, np.frombuffer(i, np.uint16), w) for d, s, t, i, w in zip(*columns)]
        pieces = pack_shard(rows, idf, shard.column("shard")[0].as_py(), mean)
        return pa.table([pa.array(c, pa.int64()) for c in zip(*pieces)], schema=schema)

    dealt = deal(tails.select("doc_id", "start", "doc_tokens", "ids", "terms"), n, idf)
    filled = dealt.groupBy("shard").applyInArrow(run, PIECES)
    full = tokenized.where(F.col("kind") == FULL).withColumn("sequence_id", 2 * F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return filled.unionByName(full.select(*schema.names))
