"""Substring deduplication by super-k-mers: words covered by a repeated 35-word window.

Consecutive windows that share a minimiser (see ``repeats``) travel as one packed
string, their words joined by a space, to the bucket of that minimiser; equal
windows have equal minimisers and so meet there.  A bucket numbers its words and
ranks windows exactly by doubling: sorting pairs of ranks of 1, 2, 4, 8, 16 and 32
words, then 32 + 3 overlapping.  A window counted twice or more is repeated.

Skew: a block sends equal strings once, with their number, so a passage held by a
third of all documents gives its bucket one string per block.  A common phrase amid ever
different words is the minimiser of no window that spans a rarer gram (``repeats.common_grams``).

Edge cases: null text has no words; windows never cross documents; repeated rows
are documents of their own, so each repeats the other; rows without a doc_id are
handled like any other; documents of under 35 words are kept whole; periodic text
is cut into strings of bounded length; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import repeats
from .repeats import by_block, cover, flatten_ranges

WINDOW, GRAM = 35, 6
MOST = WINDOW - GRAM + 1
#: The sample of common grams grows with the number of buckets up to this many.
MOST_KNOWN = 1 << 16
ENTRY = np.dtype([("hash", "<u8"), ("pos", "<u4"), ("count", "<u4"), ("periodic", "u1")])
ENTRY_SCHEMA = "bucket int, block int, kind int, content binary, meta binary"


def _scan(block: pa.Table, common: np.ndarray | None = None) -> tuple:
    rows = repeats.ordered(block)
    words = [t.encode("utf-8", "surrogatepass").split() for _, t in rows]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [w for doc in words for w in doc]
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in flat), np.int64, len(flat))
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
    hashes = repeats.gram_hashes(table[ids] if len(ids) else np.empty(0, np.uint64), GRAM)
    return rows, words, flat, sizes, hashes, repeats.find_runs(hashes, sizes, WINDOW, GRAM, common)


def sample_common(blocks: DataFrame, n_buckets: int) -> np.ndarray:
    """Common grams, from a sample of blocks."""

    def sample(block: pa.Table) -> pa.Table:
        *_, hashes, _ = _scan(block)
        return pa.table({"drawn": pa.array([repeats.sample_hashes(hashes, block.column("block")[0].as_py()).tobytes()], pa.binary())})

    buckets = min(n_buckets, MOST_KNOWN)
    found = repeats.sampled_blocks(blocks, buckets).groupBy("block").applyInArrow(sample, "drawn binary").collect()
    return repeats.common_grams(np.concatenate([np.frombuffer(r["drawn"], "<u8") for r in found] or [np.empty(0, np.uint64)]), buckets, MOST)


def _send_grams(n_buckets: int, common: np.ndarray):
    def send(block: pa.Table) -> pa.Table:
        *_, hashes, (_, _, place) = _scan(block, common)
        held, many = repeats.block_grams(hashes[place], place)
        return repeats.spread(held, many, n_buckets, block.column("block")[0].as_py())

    return send


def _send_entries(n_filter: int, n_buckets: int, common: np.ndarray):
    def send(block: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict = {"bucket": [], "block": [], "kind": [], "content": [], "meta": []}
        if block.num_rows and answers.num_rows:
            number = block.column("block")[0].as_py()
            *_, flat, _, hashes, (first, last, place) = _scan(block, common)
            alive = repeats.survives(hashes[place], answers, n_filter)
            first, last, place = first[alive], last[alive], place[alive]
            places = place
            first, last, place = repeats.merge_runs(first, last, place, hashes[place], MOST)
            inside = np.searchsorted(places, last + MOST, "left") - np.searchsorted(places, first, "left") > 1
            ends = last + WINDOW
            held: dict = {}
            same = np.fromiter((held.setdefault(b" ".join(flat[a:z]), len(held)) for a, z in zip(first.tolist(), ends.tolist())), np.int64, len(first))
            strings = list(held)
            count = np.bincount(same, minlength=len(strings))
            twice = count[same] > 1
            if twice.any():  # repeated within the block: covered, and told to the bucket once
                out["bucket"].append(n_buckets + number), out["kind"].append(1), out["content"].append(b"")
                out["meta"].append(repeats.spans_payload(first[twice], ends[twice]))
            lead = np.unique(same, return_index=True)[1]
            meta = np.empty(len(strings), ENTRY)
            meta["hash"], meta["pos"], meta["count"], meta["periodic"] = hashes[place[lead]], first[lead], count, inside[lead]
            bucket = (repeats.mixed(meta["hash"].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            names, at = np.unique(bucket[order], return_index=True)
            for b, a, z in zip(names, at, np.r_[at[1:], len(order)]):
                part = order[a:z]
                out["bucket"].append(int(b)), out["kind"].append(0), out["meta"].append(meta[part].tobytes())
                out["content"].append(b"\n".join(strings[k] for k in part.tolist()))
            out["block"] = [number] * len(out["bucket"])
        return pa.table({k: pa.array(v, pa.binary() if k in ("content", "meta") else pa.int32()) for k, v in out.items()})

    return send


def _pair_ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def window_ranks(ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Equal numbers for equal windows, by the place of their first word (exact)."""
    ranks, size = ids, 1
    while 2 * size <= window:
        ranks = _pair_ranks(ranks[: len(ranks) - size], ranks[size:])
        size *= 2
    rest = window - size
    return _pair_ranks(ranks[: len(ranks) - rest], ranks[rest:]) if rest else ranks


def _resolve(bucket: pa.Table) -> pa.Table:
    if bucket.column("kind")[0].as_py():
        return pa.table({"block": bucket.column("block"), "payload": bucket.column("meta")})
    metas = [np.frombuffer(m, ENTRY) for m in bucket.column("meta").to_pylist()]
    meta, blocks = np.concatenate(metas), np.repeat(bucket.column("block").to_numpy(), [len(m) for m in metas])
    held: dict = {}
    same = np.fromiter((held.setdefault(s, len(held)) for c in bucket.column("content").to_pylist() for s in c.split(b"\n")), np.int64, len(meta))
    strings = list(held)
    lead = np.unique(same, return_index=True)[1]
    total = np.bincount(same, weights=meta["count"]).astype(np.int64)
    periodic = np.bincount(same, weights=meta["periodic"]) > 0
    grams = np.unique(meta["hash"][lead], return_inverse=True)[1]
    compare = np.flatnonzero((np.bincount(grams)[grams] > 1) | periodic)
    whole = total > 1
    length = np.zeros(len(strings), np.int64)
    words: dict = {}
    flat: list = []
    for u in compare.tolist():
        parts = strings[u].split(b" ")
        length[u] = len(parts)
        flat.extend(parts)
    for u in np.flatnonzero(whole).tolist():
        length[u] = length[u] or strings[u].count(b" ") + 1
    pos = meta["pos"].astype(np.int64)
    every = whole[same]
    out = [(blocks[every], pos[every], (pos + length[same])[every])]
    if len(compare):
        ids = np.fromiter((words.setdefault(w, len(words)) for w in flat), np.int64, len(flat))
        ranks = window_ranks(ids)
        n, begin = length[compare] - WINDOW + 1, np.r_[0, np.cumsum(length[compare])[:-1]]
        at, owner = flatten_ranges(begin, n), np.repeat(compare, n)
        times = np.bincount(ranks[at], weights=total[owner])
        dup = (times[ranks[at]] > 1) & ~whole[owner]
        edge = np.flatnonzero(dup & np.r_[True, ~dup[:-1] | (owner[1:] != owner[:-1])])
        stop = np.flatnonzero(dup & np.r_[~dup[1:] | (owner[1:] != owner[:-1]), True])
        # an entry that is not repeated as a whole is held by one block only
        who = lead[owner[edge]]
        shift = np.zeros(len(strings), np.int64)
        shift[compare] = begin
        out.append((blocks[who], pos[who] + at[edge] - shift[owner[edge]], pos[who] + at[stop] - shift[owner[stop]] + WINDOW))
    return by_block(*(np.concatenate(x) for x in zip(*out)))


def _apply(block: pa.Table, answers: pa.Table) -> pa.Table:
    rows = repeats.ordered(block)
    words = [t.encode("utf-8", "surrogatepass").split() for _, t in rows]
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    gone = cover(int(ends[-1]) if len(ends) else 0, *repeats.read_spans(answers))
    kept, removed = [], []
    for w, z in zip(words, ends.tolist()):
        mask = gone[z - len(w) : z]
        n = int(mask.sum())
        kept.append(b" ".join([w[k] for k in np.flatnonzero(~mask).tolist()] if n else w))
        removed.append(n)
    return pa.table(
        {"doc_id": pa.array([i for i, _ in rows], pa.int64()), "n_words": pa.array([len(w) for w in words], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())}
    )


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the kept words joined by one space."""
    blocks, n_blocks = repeats.into_blocks(docs)
    n_filter, n_buckets = repeats.filter_buckets(n_blocks), n_blocks
    common = sample_common(blocks, n_buckets)
    grouped = lambda df: df.groupBy("block")
    answers = repeats.gram_filter(grouped(blocks).applyInArrow(_send_grams(n_filter, common), repeats.FILTER_SCHEMA))
    entries = grouped(blocks).cogroup(grouped(answers)).applyInArrow(_send_entries(n_filter, n_buckets, common), ENTRY_SCHEMA)
    spans = entries.groupBy("bucket").applyInArrow(_resolve, repeats.SPAN_SCHEMA)
    return grouped(blocks).cogroup(grouped(spans)).applyInArrow(_apply, "doc_id long, n_words long, n_removed long, kept_text string")
