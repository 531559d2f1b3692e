"""Quality classifier: random-indexing word vectors, pooled, then a small numpy network.

Fitting takes a bounded sample of labelled training rows (``MAX_FIT_ROWS``), those of
smallest id hash, which the driver holds.  Tokens are runs of letters, runs of one
other mark, ``^caps`` for words in capitals, and ``=again`` for a word equal to the
one before it; tokens in under ``MIN_DOCS`` sample texts share one name.  Every token
has a sparse random index vector, drawn from a hash of the token; its word vector
adds the mean index vector of its neighbours in the sample to its own.  A document
is the mean of its tokens' vectors and its length on a log scale.  A network of two
layers is trained on these by Adam; a temperature fitted on rows kept out of that
training calibrates its probabilities.

Scoring streams every whole text through the model, which travels with the tasks
(its size is bounded by the sample) and needs no shuffle.

Edge cases: null and empty texts pool to zeros and get the score of that vector; null
ids and null labels take no part in fitting; labels without a document are ignored;
several labels of one row fit as several rows; without two classes in the sample
every score is the share of label 1 (0.5 without any label); held_out is false for
a null id; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FIT_ROWS = 4_000
DIMENSION, NONZERO, NEAR, HIDDEN = 64, 6, 2, 32
MIN_DOCS, THRESHOLD, CHUNK, MOST_WORDS = 5, 0.7, 256, 300_000
_TOKEN = re.compile(r"[^\W\d_]+|\d+|([^\w\s]|_)\1*")
RARE, AGAIN, CAPS = "=rare", "=again", "^caps"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_tokens(word: str) -> list:
    out = []
    for found in _TOKEN.finditer(word):
        token = found.group()
        out.append(CAPS if token.isupper() and len(token) > 1 else token.lower() if token[0].isalpha() else "0" if token[0].isdigit() else token[:3])
    return out


def index_vectors(tokens: list) -> np.ndarray:
    """Sparse ternary vectors by a hash of each token."""
    out = np.zeros((len(tokens), DIMENSION), np.float32)
    for k, token in enumerate(tokens):
        rng = np.random.Generator(np.random.PCG64(xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))))
        out[k, rng.choice(DIMENSION, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


@dataclass
class Words:
    """The vocabulary and its vectors; ``pool`` turns texts into rows of features."""

    places: dict
    vectors: np.ndarray
    met: dict = field(default_factory=dict)  # words that a task has met, with their tokens' places

    def __getstate__(self) -> dict:
        return self.__dict__ | {"met": {}}

    def places_of(self, word: str) -> list:
        found = self.met.get(word)
        if found is None:
            if len(self.met) >= MOST_WORDS:
                self.met.clear()
            rare = self.places[RARE]
            found = self.met[word] = [self.places.get(t, rare) for t in word_tokens(word)]
        return found

    def pool(self, texts: list) -> np.ndarray:
        split = [(t or "").split() for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        known: dict = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for words in split for w in words), np.int64, int(sizes.sum()))
        of_word = np.zeros((len(known), DIMENSION + 1), np.float32)
        parts = [self.places_of(w) for w in known]
        lengths = np.array([len(p) for p in parts], np.int64)
        if lengths.sum():
            flat = self.vectors[np.fromiter((t for p in parts for t in p), np.int64, int(lengths.sum()))]
            some = lengths > 0
            of_word[some, :-1] = np.add.reduceat(flat, np.r_[0, np.cumsum(lengths[some])[:-1]])
            of_word[:, -1] = lengths
        doc = np.repeat(np.arange(len(texts)), sizes)
        again = np.r_[False, (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])] if len(ids) else np.zeros(0, bool)
        out = np.zeros((len(texts), DIMENSION + 1), np.float32)
        some = sizes > 0
        if some.any():
            out[some] = np.add.reduceat(of_word[ids], np.r_[0, np.cumsum(sizes[some])[:-1]])
        repeats = np.bincount(doc[again], minlength=len(texts)).astype(np.float32)
        total = out[:, :-1] + repeats[:, None] * self.vectors[self.places[AGAIN]]
        count = out[:, -1] + repeats
        return np.concatenate([total / np.maximum(count, 1)[:, None], np.log1p(count)[:, None]], 1)


def word_vectors(texts: list) -> Words:
    """Random indexing over the sample."""
    streams, of_word = [], {}
    for text in texts:
        stream, before = [], None
        for word in (text or "").split():
            if word not in of_word:
                of_word[word] = word_tokens(word)
            stream += of_word[word]
            if word == before:
                stream.append(AGAIN)
            before = word
        streams.append(stream)
    held = Counter(t for s in streams for t in set(s))
    names = [RARE, AGAIN, *sorted(t for t, n in held.items() if n >= MIN_DOCS and t != AGAIN)]
    places = {t: k for k, t in enumerate(names)}
    index = index_vectors(names)
    near, seen = np.zeros((len(names), DIMENSION), np.float64), np.zeros(len(names), np.float32)
    for a in range(0, len(streams), CHUNK):
        # texts one behind the other, far enough apart that none is near another; the gaps' vector is zero
        parts = [np.r_[np.array([places.get(t, 0) for t in s], np.int64), np.full(NEAR, len(names))] for s in streams[a : a + CHUNK]]
        ids = np.concatenate(parts)
        own = np.concatenate([index, np.zeros((1, DIMENSION), np.float32)])[ids]
        around = np.zeros_like(own)
        for k in range(1, NEAR + 1):
            around[k:] += own[:-k]
            around[:-k] += own[k:]
        for c in range(DIMENSION):
            near[:, c] += np.bincount(ids, around[:, c], len(names) + 1)[:-1]
        seen += np.bincount(ids, minlength=len(names) + 1)[:-1]
    near = near.astype(np.float32)
    near /= np.maximum(seen, 1)[:, None] * 2 * NEAR
    return Words(places, index + near)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class Model:
    words: Words | None
    layers: list
    center: np.ndarray | None
    scale: np.ndarray | None
    temperature: float
    share: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.center) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list) -> np.ndarray:
        if self.words is None:
            return np.full(len(texts), self.share)
        return _sigmoid(self.logits(self.words.pool(texts)).astype(np.float64) / self.temperature)


def fit(texts: list, labels: list, epochs: int = 60, rate: float = 3e-3) -> Model:
    """Trains on four fifths of the rows and calibrates on the rest."""
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.5
    if len(set(labels)) < 2:
        return Model(None, [], None, None, 1.0, share)
    words, rng = word_vectors(texts), np.random.Generator(np.random.PCG64(11))
    x = np.concatenate([words.pool(texts[a : a + CHUNK]) for a in range(0, len(texts), CHUNK)])
    center, scale = x.mean(0), x.std(0) + 1e-3
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    model = Model(words, layers, center, scale, 1.0, share)
    aside = np.arange(len(y)) % 5 == 4
    z, target = (x[~aside] - center) / scale, y[~aside]
    weight = np.where(target == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) ** 0.5
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(z)), max(1, len(z) // 64)):
            hidden = np.tanh(z[at] @ layers[0] + layers[1])
            slope = (_sigmoid(hidden @ layers[2] + layers[3]) - target[at]) * weight[at] / len(at)
            back = slope[:, None] * layers[2] * (1 - hidden**2)
            grads = [z[at].T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ slope + 1e-4 * layers[2], slope.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    rest, truth = model.logits(x[aside]), y[aside]

    def loss(t: float) -> float:
        p = np.clip(_sigmoid(rest / t), 1e-6, 1 - 1e-6)
        return float(-(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean())

    model.temperature = min(np.geomspace(0.5, 8, 40).tolist(), key=loss) if len(truth) else 1.0
    model.layers = [w.astype(np.float32) for w in layers]
    return model


def fit_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_FIT_ROWS) -> Model:
    """Fits on the ``most`` labelled training rows of smallest id hash; of rows that repeat an id, all up to that number."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    picked = usable.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("text")).limit(most).collect()
    rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r["doc_id"]).encode()), r["quality"], r["text"] or ""))
    return fit([r["text"] for r in rows], [r["quality"] for r in rows])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                found = model.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
