"""Suffix-array deduplication: bytes covered by a 50-byte string of an earlier document.

Suffixes start at anchors, the places of the windows' minimisers (see ``repeats``),
which two equal windows share; so the array holds one suffix for about eighteen
bytes.  After the filter on repeated grams:

* splitters, taken from the suffixes of a bounded sample of blocks, range-partition
  the suffixes by their leading tokens (eight bytes each);
* each bucket sorts its suffixes by multikey quicksort (three-way partitions by one
  token at a time, all groups of a round at once) until equal entries lie together;
* neighbours that share the gram are compared window by window, again by multikey
  quicksort, to find for every window the smallest doc_id that holds it.

Splitters are exactly one gram (two tokens) long: suffixes that share a gram never
lie on both sides of a boundary, so the comparison across boundaries is settled by
where boundaries may fall.  A window's text travels with its own anchor, so what a
window needs from beyond its neighbours' range is in the bucket already.

Skew: a block sends equal entries once, with the smallest doc_id, so a passage held
by a third of all documents gives its bucket one entry per block.  A common gram amid
ever different text anchors no window that spans a rarer one (``repeats.common_grams``).

Edge cases: null text is empty; matches never cross documents; rows without a
doc_id count as one last document and lose to all others; repeated rows share an id
and do not match each other; texts under 50 bytes are kept whole; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .repeats import LAST_ID, by_block, cover, flatten_ranges

WINDOW, GRAM, TOKEN = 50, 16, 8
MOST = WINDOW - GRAM + 1
WIDTH = MOST - 1 + WINDOW
#: Anchors of the sampled blocks (see ``repeats``) give the splitters of ``MOST_RANGES`` ranges at most.  Beyond that
#: a range is dealt to several buckets by a hash of the gram, so that buckets stay as small in larger inputs.
MOST_RANGES = 1 << 16
ENTRY = np.dtype([("length", "u1"), ("offset", "u1"), ("pos", "<u4"), ("id", "<i8")])
ENTRY_SCHEMA = "bucket int, block int, kind int, content binary, meta binary"
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _scan(block: pa.Table, common: np.ndarray | None = None) -> tuple:
    """A block's bytes, document ids and sizes, gram hashes and runs."""
    rows = repeats.ordered(block)
    raw = [t.encode("utf-8", "surrogatepass") for _, t in rows]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids = np.array([LAST_ID if i is None else i for i, _ in rows], np.int64)
    hashes = repeats.gram_hashes(_TABLE[data], GRAM)
    return rows, data, sizes, ids, hashes, repeats.find_runs(hashes, sizes, WINDOW, GRAM, common)


def _send_grams(n_buckets: int, common: np.ndarray):
    def send(block: pa.Table) -> pa.Table:
        _, _, sizes, ids, hashes, (first, _, place) = _scan(block, common)
        held, many = repeats.block_grams(hashes[place], ids[np.searchsorted(np.cumsum(sizes), first, "right")])
        return repeats.spread(held, many, n_buckets, block.column("block")[0].as_py())

    return send


def _leading(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The gram at each place as a sortable string (what ends in NUL sorts as if cut there)."""
    return np.ascontiguousarray(repeats.slices(data, place, np.full(len(place), GRAM), GRAM)).view(f"S{GRAM}").ravel()


def _sample(block: pa.Table) -> pa.Table:
    """Anchors of a block with their hashes, and the hashes of grams at any places."""
    _, data, _, _, hashes, (_, _, place) = _scan(block)
    place = place[:: max(1, len(place) // repeats.SAMPLE_EACH)]
    drawn = repeats.sample_hashes(hashes, block.column("block")[0].as_py())
    parts = (_leading(data, place), hashes[place], drawn)
    return pa.table({k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(("grams", "hashes", "drawn"), parts)})


def sample_order(blocks: DataFrame, n_ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``n_ranges - 1`` splitters, some twenty sampled suffixes for each, and the common grams."""
    found = repeats.sampled_blocks(blocks, n_ranges).groupBy("block").applyInArrow(_sample, "grams binary, hashes binary, drawn binary").collect()
    grams, hashes, drawn = (
        np.concatenate([np.frombuffer(r[k], t) for r in found] or [np.empty(0, t)]) for k, t in (("grams", f"S{GRAM}"), ("hashes", "<u8"), ("drawn", "<u8"))
    )
    common = repeats.common_grams(drawn, n_ranges, MOST)
    grams = np.sort(grams[~np.isin(hashes, common)])
    return (np.unique(grams[np.arange(1, n_ranges) * len(grams) // n_ranges]) if len(grams) else grams), common


def _send_entries(n_filter: int, splitters: np.ndarray, parts: int, common: np.ndarray):
    n_buckets = (len(splitters) + 1) * parts

    def send(block: pa.Table, answers: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "content": pa.array([], pa.binary()), "meta": pa.array([], pa.binary())})
        if not block.num_rows or not answers.num_rows:
            return empty
        number = block.column("block")[0].as_py()
        _, data, sizes, ids, hashes, (first, last, place) = _scan(block, common)
        alive = repeats.survives(hashes[place], answers, n_filter)
        first, last, place = first[alive], last[alive], place[alive]
        if not len(first):
            return empty
        first, last, place = repeats.merge_runs(first, last, place, hashes[place], MOST)
        length, offset = last - first + WINDOW, place - first
        owner = ids[np.searchsorted(np.cumsum(sizes), first, "right")]
        rows = np.concatenate([repeats.slices(data, first, length, WIDTH), offset[:, None].astype(np.uint8), length[:, None].astype(np.uint8)], 1)
        _, same = np.unique(np.ascontiguousarray(rows).view(f"S{WIDTH + 2}").ravel(), return_inverse=True)
        least = np.full(same.max() + 1, LAST_ID)
        np.minimum.at(least, same, owner)
        late = owner > least[same]
        out: dict = {"bucket": [], "block": [], "kind": [], "content": [], "meta": []}
        if late.any():  # a smaller id of the same block has the entry: covered, nothing to ask
            out["bucket"].append(n_buckets + number), out["kind"].append(1), out["content"].append(b"")
            out["meta"].append(repeats.spans_payload(first[late], (first + length)[late]))
        asks = np.flatnonzero(~late)
        bucket = np.searchsorted(splitters, _leading(data, place[asks]), "right") * parts + (hashes[place[asks]] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        asks, bucket = asks[order], bucket[order]
        meta = np.empty(len(asks), ENTRY)
        meta["length"], meta["offset"], meta["pos"], meta["id"] = length[asks], offset[asks], first[asks], owner[asks]
        names, at = np.unique(bucket, return_index=True)
        for b, a, z in zip(names, at, np.r_[at[1:], len(asks)]):
            part = asks[a:z]
            out["bucket"].append(int(b)), out["kind"].append(0), out["meta"].append(meta[a:z].tobytes())
            out["content"].append(data[flatten_ranges(first[part], length[part])].tobytes())
        out["block"] = [number] * len(out["bucket"])
        return pa.table({k: pa.array(v, pa.binary() if k in ("content", "meta") else pa.int32()) for k, v in out.items()})

    return send


def multikey_sort(token, n: int, depth: int, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: order of ``n`` items by their tokens, and for each place the start of its group of equals.

    ``token(levels, items)`` gives each item's token at its level.  A round parts all
    groups at once in three by a pivot, the median of three of their tokens: the
    smaller and the larger stay at their level, the equal go on to the next token.
    Items alone in their group, and groups equal in all tokens, are done.
    ``labels`` are ordered groups to start from, named by the place of their start.
    """
    order, label, level = np.arange(n), np.zeros(n, np.int64) if labels is None else labels.copy(), np.zeros(n, np.int64)
    active = np.flatnonzero(np.bincount(label, minlength=n)[label] > 1) if n else order
    while len(active):
        items, group = order[active], label[active]
        keys = token(level[active], items)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        counts = np.diff(np.r_[starts, len(items)])
        a, b, c = keys[starts], keys[starts + counts // 2], keys[starts + counts - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), counts)
        side = (keys >= pivot).astype(np.int64) + (keys > pivot)
        sizes = np.bincount(np.repeat(np.arange(len(starts)) * 3, counts) + side, minlength=3 * len(starts))
        begin = np.r_[0, np.cumsum(sizes)[:-1]]
        target = np.empty(len(items), np.int64)
        for s in range(3):
            target[np.flatnonzero(side == s)] = flatten_ranges(begin[s::3], sizes[s::3])
        moved = np.empty_like(items)
        moved[target] = items
        order[active] = moved
        label[active] = np.repeat(active[np.minimum(begin, len(active) - 1)], sizes)
        after = (level[active[starts]][:, None] + np.array([0, 1, 0])).ravel()
        level[active] = np.repeat(after, sizes)
        active = active[np.repeat((sizes > 1) & (after < depth), sizes)]
    return order, label


def _tokens(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian tokens."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // TOKEN) * TOKEN), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def _resolve(bucket: pa.Table) -> pa.Table:
    kinds = bucket.column("kind").to_pylist()
    if kinds[0]:
        return pa.table({"block": bucket.column("block"), "payload": bucket.column("meta")})
    metas = [np.frombuffer(m, ENTRY) for m in bucket.column("meta").to_pylist()]
    meta, blocks = np.concatenate(metas), np.repeat(bucket.column("block").to_numpy(), [len(m) for m in metas])
    data = np.frombuffer(b"".join(bucket.column("content").to_pylist()), np.uint8)
    length, offset, ids = meta["length"].astype(np.int64), meta["offset"].astype(np.int64), meta["id"].astype(np.int64)
    pos, begin = meta["pos"].astype(np.int64), np.r_[0, np.cumsum(length)[:-1]]
    # the suffix from the anchor on, then what stands before it
    right = _tokens(repeats.slices(data, begin + offset, length - offset, WIDTH))
    left = _tokens(repeats.slices(data, begin, offset, MOST))
    ends = (length * 256 + offset).astype(np.uint64)
    tokens = np.concatenate([right, left, ends[:, None]], 1)
    order, label = multikey_sort(lambda k, items: tokens[items, k], len(meta), tokens.shape[1])
    starts = np.flatnonzero(label == np.arange(len(label)))
    same = np.empty(len(meta), np.int64)
    same[order] = np.cumsum(label == np.arange(len(label))) - 1
    head, least = order[starts], np.minimum.reduceat(ids[order], starts)
    late = ids > least[same]
    out = [(blocks[late], pos[late], (pos + length)[late])]
    # entries that share the gram with other ones are compared window by window
    gram = tokens[head, :2]
    new = np.r_[True, (gram[1:] != gram[:-1]).any(1)]
    group = np.cumsum(new) - 1
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(several):
        count = length[head[several]] - WINDOW + 1
        at = flatten_ranges(begin[head[several]], count)
        owner = np.repeat(several, count)
        group_at = np.flatnonzero(np.r_[True, np.diff(group[owner]) != 0])
        labels = np.repeat(group_at, np.diff(np.r_[group_at, len(owner)]))
        words = np.lib.stride_tricks.sliding_window_view(data, TOKEN)
        offsets = np.array([*range(0, WINDOW - TOKEN, TOKEN), WINDOW - TOKEN])
        worder, wlabel = multikey_sort(lambda k, items: words[at[items] + offsets[k]].copy().view(">u8").ravel().astype(np.uint64), len(at), len(offsets), labels)
        wstarts = np.flatnonzero(wlabel == np.arange(len(wlabel)))
        smallest = np.minimum.reduceat(least[owner[worder]], wstarts)
        dup = np.zeros(len(at), bool)
        dup[worder] = np.repeat(smallest, np.diff(np.r_[wstarts, len(at)])) < least[owner[worder]]
        out.append(_expand(dup, owner, at - begin[head[owner]], same, late, blocks, pos))
    blocks, starts, ends = (np.concatenate(x) for x in zip(*out))
    return by_block(blocks, starts, ends)


def _expand(dup: np.ndarray, owner: np.ndarray, start: np.ndarray, same: np.ndarray, late: np.ndarray, blocks: np.ndarray, pos: np.ndarray) -> tuple:
    """Runs of repeated windows as spans of every entry that holds them."""
    edge = np.flatnonzero(dup & np.r_[True, ~dup[:-1] | (owner[1:] != owner[:-1])])
    stop = np.flatnonzero(dup & np.r_[~dup[1:] | (owner[1:] != owner[:-1]), True])
    holders = np.flatnonzero(~late)
    holders = holders[np.argsort(same[holders], kind="stable")]
    low, high = (np.searchsorted(same[holders], owner[edge], side) for side in ("left", "right"))
    who = holders[flatten_ranges(low, high - low)]
    a, z = (np.repeat(start[x], high - low) for x in (edge, stop))
    return blocks[who], pos[who] + a, pos[who] + z + WINDOW


def _apply(block: pa.Table, answers: pa.Table) -> pa.Table:
    rows = repeats.ordered(block)
    raw = [t.encode("utf-8", "surrogatepass") for _, t in rows]
    ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    gone = cover(len(data), *repeats.read_spans(answers))
    kept, removed, spans = [], [], []
    for r, z in zip(raw, ends):
        mask = gone[z - len(r) : z]
        n = int(mask.sum())
        kept.append(data[z - len(r) : z][~mask].tobytes() if n else r)
        removed.append(n)
        spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if n else 0)
    return pa.table(
        {"doc_id": pa.array([i for i, _ in rows], pa.int64()), "n_bytes": pa.array([len(r) for r in raw], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())}
    )


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and the kept bytes."""
    blocks, n_blocks = repeats.into_blocks(docs)
    n_filter, n_ranges = repeats.filter_buckets(n_blocks), min(n_blocks, MOST_RANGES)
    splitters, common = sample_order(blocks, n_ranges)
    grouped = lambda df: df.groupBy("block")
    answers = repeats.gram_filter(grouped(blocks).applyInArrow(_send_grams(n_filter, common), repeats.FILTER_SCHEMA))
    entries = grouped(blocks).cogroup(grouped(answers)).applyInArrow(_send_entries(n_filter, splitters, -(-n_blocks // n_ranges), common), ENTRY_SCHEMA)
    spans = entries.groupBy("bucket").applyInArrow(_resolve, repeats.SPAN_SCHEMA)
    return grouped(blocks).cogroup(grouped(spans)).applyInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
