"""Language identification by unigrams of pieces, summed over all segmentations.

A language is a distribution over the pieces of a fixed public vocabulary.  A word's
probability in it is the sum, over every way to cut the word into pieces, of the
product of their probabilities, which a forward pass over the word adds up; a text's
is the product over its words.  Words are runs of letters in lower case, with the
vocabulary's word mark in front; a letter outside the vocabulary is a piece of its own kind.

Training takes every training row: tasks count words by language, Spark adds them up,
and ``ROUNDS`` rounds of expectation-maximisation run over the counted words.  A round
computes expected piece counts by forward and backward passes in the tasks, rounded
to 1/1024 a word so that their sums don't depend on the order, and Spark sums them; the
driver holds one number per language and piece (bounded by the vocabulary and
``MAX_LANGUAGES``).  Scoring streams every whole text through the model.

Both passes go over many words at once: all positions of a block of words walk down a
trie of the pieces together, and what they find, the edges of the words' lattices, is
summed position by position.  A task keeps the words it has met, a bounded number.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and teach
nothing; rows without a language or an id aren't learned from; a language whose
training texts have no letter is not learned; with no learned language every row is
``und``; over ``MAX_LANGUAGES`` values of lang are an error; equal probabilities go to
the first language in order; repeated rows each get their row; very long words take
time in proportion to their length; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .quality_classifier import held_out

MARK, UNKNOWN, UNDECIDED = "▁", 0, "und"
ROUNDS, SMOOTHING, GRAIN, MAX_LANGUAGES = 3, 0.1, 1024, 500
#: Words of a block, words that a task keeps, texts scored together, cells of a table of sums.
BLOCK, MOST_WORDS, TEXTS, CELLS = 8192, 400_000, 512, 1 << 22
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def letters(word: str) -> str:
    """The word without the numerals that a word pattern lets in."""
    return word if word.isascii() else "".join(c for c in word if c.isalpha())


def public_pieces(path: str | None = None) -> list[str]:
    """Lower-case pieces of a sentencepiece vocabulary with the word mark at the start, if anywhere."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    read = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [read.id_to_piece(k) for k in range(read.get_piece_size()) if not (read.is_control(k) or read.is_unknown(k) or read.is_byte(k))]
    return sorted({p for p in plain if p == p.lower() and MARK not in p[1:]})


@dataclass
class Edges:
    """The lattices of a block of words: ``starts`` of the groups of edges with one end and length."""

    lengths: np.ndarray
    word: np.ndarray
    piece: np.ndarray
    groups: list  # (end, length, from, to)


class Trie:
    """Pieces by their letters, in arrays: a node's children lie at ``base[node] + symbol``, as far as ``owner`` says so.

    Piece 0 stands for any single letter that is no piece.
    """

    def __init__(self, pieces: list[str]):
        self.pieces = ["", *pieces]
        letters_used = sorted({c for p in pieces for c in p})
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[[ord(c) for c in letters_used]] = np.arange(1, len(letters_used) + 1)
        below: list[dict] = [{}]
        ends: dict[int, int] = {}
        for k, p in enumerate(pieces, 1):
            node = 0
            for c in p:
                at = below[node].setdefault(int(self.symbol[ord(c)]), len(below))
                if at == len(below):
                    below.append({})
                node = at
            ends[node] = k
        self.longest = max(map(len, pieces), default=1)
        size = 8 * len(below) + len(letters_used) + 1
        self.base, self.owner, self.child = np.zeros(len(below), np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
        rng = np.random.Generator(np.random.PCG64(3))
        for node in sorted(range(len(below)), key=lambda n: -len(below[n])):
            held = np.fromiter(below[node], np.int64, len(below[node]))
            if len(held):
                while (self.owner[held + (base := int(rng.integers(8 * len(below))))] >= 0).any():
                    pass
                self.base[node], self.owner[held + base], self.child[held + base] = base, node, list(below[node].values())
        self.ends = np.full(len(below), -1, np.int32)
        self.ends[list(ends)] = list(ends.values())

    def edges(self, words: list[str]) -> Edges:
        """All pieces at all places of the words."""
        marked = [MARK + w for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        text = self.symbol[np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)]
        offset = np.r_[0, np.cumsum(lengths)[:-1]]
        word = np.repeat(np.arange(len(words)), lengths)
        end = (offset + lengths)[word]
        place, node, found = np.arange(len(text)), np.zeros(len(text), np.int32), []
        for k in range(1, self.longest + 1):
            inside = place + k <= end[place]
            place, node = place[inside], node[inside]
            slot = self.base[node] + text[place + k - 1]
            known = self.owner[slot] == node
            if k == 1:
                single = np.where(known, self.ends[self.child[slot]], -1)
                found.append((place, k, np.maximum(single, UNKNOWN)))
            place, node = place[known], self.child[slot[known]]
            if k > 1:
                piece = self.ends[node]
                some = piece >= 0
                found.append((place[some], k, piece[some]))
            if not len(place):
                break
        place = np.concatenate([p for p, _, _ in found])
        size = np.concatenate([np.full(len(p), k) for p, k, _ in found])
        piece = np.concatenate([e for _, _, e in found])
        stop = place - offset[word[place]] + size
        key = stop * (self.longest + 1) + size
        order = np.argsort(key, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(key[order])) + 1, len(order)]
        at = key[order[cuts[:-1]]]
        groups = [(int(v) // (self.longest + 1), int(v) % (self.longest + 1), int(a), int(b)) for v, a, b in zip(at, cuts[:-1], cuts[1:])]
        return Edges(lengths, word[place[order]], piece[order], groups)


def forward(edges: Edges, logs: np.ndarray) -> np.ndarray:
    """Log sums over the segmentations of each word's beginnings: place, word, language; ``logs`` is piece by language."""
    out = np.full((int(edges.lengths.max(initial=0)) + 1, len(edges.lengths), logs.shape[1]), -np.inf)
    out[0] = 0
    for stop, size, a, b in edges.groups:
        word = edges.word[a:b]
        out[stop, word] = np.logaddexp(out[stop, word], out[stop - size, word] + logs[edges.piece[a:b]])
    return out


def word_logs(trie: Trie, words: list[str], logs: np.ndarray) -> np.ndarray:
    """Log probability of each word (rows) in each language (columns)."""
    out = np.zeros((len(words), logs.shape[1]))
    for some in blocks(words):
        own = [words[k] for k in some]
        edges = trie.edges(own)
        step = max(1, CELLS // ((int(edges.lengths.max()) + 1) * len(own)))
        for a in range(0, logs.shape[1], step):
            out[some, a : a + step] = forward(edges, logs[:, a : a + step])[edges.lengths, np.arange(len(own))]
    return out


def blocks(words: list[str]) -> Iterator[np.ndarray]:
    """Places of the words, like lengths together, so many that their table stays small (a long word is alone)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    a = 0
    while a < len(order):
        b = min(a + BLOCK, len(order))
        while b - a > 1 and (lengths[order[b - 1]] + 2) * (b - a) > CELLS:
            b = a + max(1, (b - a) // 2)
        yield order[a:b]
        a = b


def expected(trie: Trie, words: list[str], counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in one language, in 1/GRAIN of a piece."""
    out = np.zeros(len(trie.pieces), np.int64)
    for some in blocks(words):
        edges = trie.edges([words[k] for k in some])
        times = counts[some]
        ahead = forward(edges, logs[:, None])[:, :, 0]
        whole = ahead[edges.lengths, np.arange(len(some))]
        behind = np.full(ahead.shape, -np.inf)
        behind[edges.lengths, np.arange(len(some))] = 0
        for stop, size, a, b in reversed(edges.groups):
            word, piece = edges.word[a:b], edges.piece[a:b]
            rest = behind[stop, word] + logs[piece]
            share = np.exp(ahead[stop - size, word] + rest - whole[word])
            out += np.bincount(piece, np.rint(share * GRAIN * times[word]), len(out)).astype(np.int64)
            behind[stop - size, word] = np.logaddexp(behind[stop - size, word], rest)
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, n over all training rows; the empty word counts a language's texts."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := words_of(text):
                    own = held.setdefault(lang, Counter())
                    own.update(found)
                    own[""] += 1
                if len(held) > MAX_LANGUAGES or sum(map(len, held.values())) > MOST_WORDS:
                    yield from emit(held)
                    held = {}
        yield from emit(held)

    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    trie: Trie
    logs: np.ndarray  # piece by language
    prior: np.ndarray

    def posterior(self, sums: np.ndarray) -> np.ndarray:
        all_in = sums + self.prior
        share = np.exp(all_in - all_in.max(1, keepdims=True))
        return share / share.sum(1, keepdims=True)


def learn(docs: DataFrame, vocabulary: str | None = None, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of every language of the training rows."""
    trie = Trie(public_pieces(vocabulary))
    spark = docs.sparkSession
    counted = materialise(count_words(docs).sortWithinPartitions("lang"), "words")
    texts = sorted((r["lang"], r["n"]) for r in counted.where("word = ''").limit(MAX_LANGUAGES + 1).collect())
    if len(texts) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    places, n = {lang: k for k, (lang, _) in enumerate(texts)}, len(texts)
    logs = np.full((len(trie.pieces), n), -np.log(len(trie.pieces)))
    words = counted.where("word <> ''")
    for _ in range(rounds if n else 0):
        sent = spark.sparkContext.broadcast((trie, logs, places))

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie, logs, places = sent.value
            sums = np.zeros((logs.shape[1], logs.shape[0]), np.int64)
            for batch in batches:
                langs = np.array([places[x] for x in batch.column(0).to_pylist()], np.int64)
                found, counts = [letters(w) for w in batch.column(1).to_pylist()], batch.column(2).to_numpy()
                for k in np.unique(langs):
                    own = [i for i in np.flatnonzero(langs == k) if found[i]]
                    sums[k] += expected(trie, [found[i] for i in own], counts[own], logs[:, k])
            k, p = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(p, pa.int32()), pa.array(sums[k, p], pa.int64())], names=["language", "piece", "total"])

        found = words.mapInArrow(tally, "language int, piece int, total long").groupBy("language", "piece").agg(F.sum("total").alias("total")).toArrow()
        sums = np.full(logs.shape, SMOOTHING)
        sums[found.column("piece").to_numpy(), found.column("language").to_numpy()] += found.column("total").to_numpy() / GRAIN
        logs = np.log(sums) - np.log(sums.sum(0))
        sent.unpersist()
    shares = np.array([t for _, t in texts], np.float64)
    return Model(list(places), trie, logs, np.log(shares / shares.sum()) if n else shares)


class Reader:
    """Scores texts in a task; keeps the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, np.int64)

    def sums(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of texts by language, and their numbers of letters."""
        if len(self.places) > MOST_WORDS:
            self.clear()
        split = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        places = self.places
        ids = np.fromiter((places.setdefault(w, len(places)) for words in split for w in words), np.int64, int(sizes.sum()))
        if fresh := [letters(w) for w in list(places)[len(self.letters) :]]:
            some = [k for k, w in enumerate(fresh) if w]
            logs = np.zeros((len(fresh), self.logs.shape[1]))
            logs[some] = word_logs(self.model.trie, [fresh[k] for k in some], self.model.logs)
            self.logs, self.letters = np.concatenate([self.logs, logs]), np.r_[self.letters, [len(w) for w in fresh]]
        out, count, full = np.zeros((len(texts), self.logs.shape[1])), np.zeros(len(texts), np.int64), sizes > 0
        if full.any():
            cuts = np.r_[0, np.cumsum(sizes[full])[:-1]]
            out[full], count[full] = np.add.reduceat(self.logs[ids], cuts), np.add.reduceat(self.letters[ids], cuts)
        return out, count


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        reader = Reader(model)
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                n = part.num_rows
                pred, score = [UNDECIDED] * n, np.zeros(n)
                if model.languages:
                    sums, count = reader.sums(part.column("text").to_pylist())
                    share = model.posterior(sums)
                    best = share.argmax(1)
                    score = np.where(count > 0, share[np.arange(n), best], 0.0)
                    pred = [model.languages[b] if c else UNDECIDED for b, c in zip(best, count)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
