"""Finding repeated windows of units (bytes or words) over all documents.

Shared by the suffix-array and the substring deduplication.  A window's minimiser
is the gram with the smallest hash among those it spans, common grams last; it depends
on the window's content alone, so equal windows have equal minimisers.  Consecutive
windows with one minimiser form a run.

Which grams are common is estimated once from a sample of blocks (``common_grams``).  A
phrase found everywhere is thus a minimiser only of windows that hold common grams alone;
other windows around it go by a rarer gram, so the phrase fills no single bucket.  The
estimate changes where windows meet, never which windows are compared.

Work is cut into blocks, bounded sets of documents by a hash of their identity:

1. ``gram_filter``: every block sends each distinct minimiser hash once to a hash
   bucket, which answers the blocks with those that occur again.  Runs of other
   minimisers hold no repeated window and travel no further.
2. The operator packs the surviving runs of a block, one entry for equal runs, and
   sends them to buckets of its own choice, which find the repeated windows.  A
   group of copies or a common passage thus costs a bucket at most one entry per
   block, however many documents hold it.
3. The buckets' spans return to their blocks, where they are laid over the texts.

The three steps read one shuffle of the documents by block (Spark reuses it).
Hashes only filter; windows are compared by content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, input_bytes

#: Bytes of input files in a block and the most blocks that share one filter bucket.
BLOCK_BYTES, BLOCKS_A_BUCKET = 1 << 20, 8
_MULT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_POS = np.uint64((1 << 28) - 1)
#: The sample: blocks at least, one more for each ``BLOCKS_A_SAMPLE`` buckets, and places of each block.
SAMPLE_BLOCKS, BLOCKS_A_SAMPLE, SAMPLE_EACH, LEAST_SEEN = 4, 1000, 20_000, 4


def into_blocks(docs: DataFrame, packed: bool = False, least: int = 4) -> tuple[DataFrame, int]:
    """(block, doc_id, text), and the number of blocks, which is ``least`` at least.

    With ``packed`` the texts are compressed ahead of the shuffles, as ``packed``.
    """
    n = max(4, least, -(-input_bytes(docs) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))), F.lit(n)).cast("int")
    rows = docs.select(block.alias("block"), F.col("doc_id").cast("long"), "text")
    return (rows.mapInArrow(_pack_texts, "block int, doc_id long, packed binary") if packed else rows), n


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [None if t is None else pack(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("doc_id"), pa.array(texts, pa.binary())], names=["block", "doc_id", "packed"])


def ordered(block: pa.Table) -> list[tuple]:
    """(id or None, text) of a block's rows in an order that its content fixes."""
    if "packed" in block.schema.names:
        unpack = zstandard.ZstdDecompressor().decompress
        texts = [None if t is None else unpack(t).decode("utf-8", "surrogatepass") for t in block.column("packed").to_pylist()]
    else:
        texts = block.column("text").to_pylist()
    rows = zip(block.column("doc_id").to_pylist(), texts)
    return sorted(((i, t or "") for i, t in rows), key=lambda r: (LAST_ID if r[0] is None else r[0], r[1]))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(31))


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram that starts at each unit; the last ``gram - 1`` places are left out."""
    if len(units) < gram:
        return np.empty(0, np.uint64)
    out, done, power, have, weight = None, 0, 1, units, int(_MULT)
    while True:
        if gram & power:
            if out is None:
                out = have
            else:  # append this piece behind what is there
                tail = have[done:]
                out = out[: len(tail)] * np.uint64(weight) + tail
            done += power
        if 2 * power > gram:
            return mixed(out)
        have = have[: len(have) - power] * np.uint64(weight) + have[power:]
        power, weight = 2 * power, (weight * weight + int(_MIX) | 1) & ((1 << 64) - 1)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    have, size = keys, 1
    while 2 * size <= width:
        have = np.minimum(have[: len(have) - size], have[size:])
        size *= 2
    rest = width - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def sampled_blocks(blocks: DataFrame, n_buckets: int) -> DataFrame:
    return blocks.where(F.col("block") < max(SAMPLE_BLOCKS, n_buckets // BLOCKS_A_SAMPLE))


def sample_hashes(hashes: np.ndarray, block: int) -> np.ndarray:
    """Hashes of ``SAMPLE_EACH`` places of a block, drawn with its number as the seed."""
    if len(hashes) <= SAMPLE_EACH:
        return hashes
    return hashes[np.random.Generator(np.random.PCG64(block)).integers(0, len(hashes), SAMPLE_EACH)]


def common_grams(sampled: np.ndarray, n_buckets: int, span: int) -> np.ndarray:
    """Sorted hashes of the grams that could fill half a bucket as minimisers of windows of ``span`` grams.

    Each was seen ``LEAST_SEEN`` times or more, so there are at most a ``LEAST_SEEN``-th of the sample.
    """
    hashes, counts = np.unique(sampled, return_counts=True)
    return hashes[counts >= max(LEAST_SEEN, len(sampled) / (n_buckets * (span + 1)))]


def _is_common(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Places of common grams: most others fail a look at a table of low bits."""
    low = np.zeros(1 << 20, bool)
    low[common & np.uint64(len(low) - 1)] = True
    maybe = np.flatnonzero(low[hashes & np.uint64(len(low) - 1)])
    at = np.minimum(np.searchsorted(common, hashes[maybe]), len(common) - 1)
    return maybe[common[at] == hashes[maybe]]


#: Windows whose minimisers are found at once; a place among them and their grams fits in ``_POS``.
PIECE = 1 << 27


def find_runs(hashes: np.ndarray, sizes: np.ndarray, window: int, gram: int, common: np.ndarray | None = None, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs over concatenated documents of ``sizes`` units: first and last window start, minimiser place."""
    total, none = int(sizes.sum()), np.empty(0, np.int64)
    if total < window:
        return none, none, none
    place = np.empty(total - window + 1, np.int64)
    for a in range(0, len(place), piece):
        own = hashes[a : min(a + piece, len(place)) + window - gram]
        keys = (own >> np.uint64(1)) & ~_POS | np.arange(len(own), dtype=np.uint64)
        if common is not None and len(common):
            keys[_is_common(own, common)] |= np.uint64(1 << 63)
        place[a : a + piece] = (sliding_min(keys, window - gram + 1) & _POS).astype(np.int64) + a
    ends = np.cumsum(sizes)
    valid = np.ones(len(place), bool)
    for a, b in zip(np.maximum(ends - window + 1, ends - sizes), ends):  # windows that would leave their document
        valid[a:b] = False
    change = np.ones(len(place) + 1, bool)
    change[1:-1] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
    edges = np.flatnonzero(change)
    first, last = edges[:-1], edges[1:] - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    return first, last, place[first]


def merge_runs(first: np.ndarray, last: np.ndarray, place: np.ndarray, hashes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins neighbouring runs of one hash (periodic text), then cuts runs after ``most`` windows."""
    if not len(first):
        return first, last, place
    start = np.r_[True, (first[1:] != last[:-1] + 1) | (hashes[1:] != hashes[:-1])]
    at = np.flatnonzero(start)
    before = first
    first, last = first[at], last[np.r_[at[1:], len(last)] - 1]
    pieces = (last - first) // most + 1
    nth = flatten_ranges(np.zeros(len(first), np.int64), pieces)
    begin = np.repeat(first, pieces) + nth * most
    return begin, np.minimum(np.repeat(last, pieces), begin + most - 1), place[np.searchsorted(before, begin, "right") - 1]


FILTER_SCHEMA = "bucket int, block int, payload binary"


def block_grams(hashes: np.ndarray, holders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and whether each is held by more than one of ``holders``."""
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], holders[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    if not len(h):
        return h, np.empty(0, bool)
    return h[starts], np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)


def spread(hashes: np.ndarray, many: np.ndarray, n_buckets: int, block: int) -> pa.Table:
    """The filter's rows: per bucket the sorted 39-bit hashes with the flag as the last bit, five bytes each."""
    again = mixed(hashes * _MULT)
    bucket = (again >> np.uint64(40)) % np.uint64(n_buckets)
    code = ((again & np.uint64((1 << 39) - 1)) << np.uint64(1)) | many.astype(np.uint64)
    order = np.lexsort((code, bucket))
    bucket, code = bucket[order].astype(np.int64), code[order]
    raw = code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    used, at = np.unique(bucket, return_index=True)
    payload = [raw[a:z].tobytes() for a, z in zip(at, np.r_[at[1:], len(bucket)])]
    return pa.table({"bucket": pa.array(used, pa.int32()), "block": pa.array(np.full(len(used), block), pa.int32()), "payload": pa.array(payload, pa.binary())})


def _codes(payload: bytes) -> np.ndarray:
    raw = np.zeros((len(payload) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(payload, np.uint8).reshape(-1, 5)
    return raw.view("<u8").ravel()


def _answer(bucket: pa.Table) -> pa.Table:
    blocks = np.asarray(bucket.column("block").to_numpy())
    parts = [_codes(p) for p in bucket.column("payload").to_pylist()]
    codes, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    same = codes >> np.uint64(1)
    starts = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
    counts = np.diff(np.r_[starts, len(same)])
    alive = np.repeat((counts > 1) | (np.maximum.reduceat(codes & np.uint64(1), starts) > 0), counts)
    same, owner = same[alive], owner[alive]
    order = np.argsort(owner, kind="stable")
    same, owner = same[order], owner[order]
    edges = np.searchsorted(owner, np.arange(len(parts) + 1))
    used = np.flatnonzero(edges[1:] > edges[:-1])
    number = bucket.column("bucket")[0].as_py()
    raw = same.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return pa.table(
        {"bucket": pa.array(np.full(len(used), number), pa.int32()), "block": pa.array(blocks[used], pa.int32()), "payload": pa.array([raw[edges[k] : edges[k + 1]].tobytes() for k in used], pa.binary())}
    )


def gram_filter(sent: DataFrame) -> DataFrame:
    """(bucket, block, payload): for each block, its hashes that occur again."""
    return sent.groupBy("bucket").applyInArrow(_answer, FILTER_SCHEMA)


def filter_buckets(n_blocks: int) -> int:
    return max(4, n_blocks // BLOCKS_A_BUCKET)


def survives(hashes: np.ndarray, answers: pa.Table, n_buckets: int) -> np.ndarray:
    """Which of a block's hashes the filter let through."""
    again = mixed(hashes * _MULT)
    bucket = (again >> np.uint64(40)) % np.uint64(n_buckets)
    code = (bucket << np.uint64(39)) | (again & np.uint64((1 << 39) - 1))
    known = [(np.uint64(b) << np.uint64(39)) | _codes(p) for b, p in zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist())]
    if not known:
        return np.zeros(len(hashes), bool)
    return np.isin(code, np.concatenate(known))


def slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """A row of ``width`` bytes for each slice, padded with zeros."""
    at = np.arange(width)
    rows = data[np.minimum(starts[:, None] + at, len(data) - 1)]
    rows[at >= lengths[:, None]] = 0
    return rows


def flatten_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + length), one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = starts - np.r_[0, np.cumsum(lengths)[:-1]]
    return np.arange(total) + np.repeat(shift, lengths)


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean mask of the units that lie in some span."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks[:-1]) > 0


def spans_payload(starts: np.ndarray, ends: np.ndarray) -> bytes:
    return np.stack([starts, ends], 1).astype("<u4").tobytes()


def read_spans(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(p, "<u4").reshape(-1, 2) for p in answers.column("payload").to_pylist()]
    both = np.concatenate(parts).astype(np.int64) if parts else np.empty((0, 2), np.int64)
    return both[:, 0], both[:, 1]


SPAN_SCHEMA = "block int, payload binary"


def by_block(blocks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
    """Spans as one row per block."""
    order = np.argsort(blocks, kind="stable")
    blocks, starts, ends = blocks[order], starts[order], ends[order]
    names, at = np.unique(blocks, return_index=True)
    edges = np.r_[at, len(blocks)]
    payload = [spans_payload(starts[a:b], ends[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    return pa.table({"block": pa.array(names, pa.int32()), "payload": pa.array(payload, pa.binary())})
