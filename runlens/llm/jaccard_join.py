"""N-gram Jaccard join: universe-partition pigeonhole with one-deletion neighbourhoods.

A document is the set of its distinct word shingles.  Sizes are cut into bands
whose ends differ by the threshold, so a linked pair lies in one band or in two
neighbouring ones; a document takes part in its own band's layout and, as the
smaller partner, in the next one's.  For each band at most ``H`` shingles differ
between linked sets.  Its layout splits the universe of shingle hashes into ``m``
segments; ``x`` of them also index their one-deletion neighbourhood, so they still
match when one shingle differs.  With ``m + x = H + 1 + slack`` allotted, linked sets
agree on a total weight above ``slack``, and segments of under ``least`` shingles, which
unlinked sets often share, need no index entry in documents with at most ``slack``
weight in them (the few others index those, too).  ``layout`` picks ``m``, ``x``,
``slack`` and ``least`` of least cost: index entries a document against false
candidates expected at the corpus's size.

The index goes out in two parts, over blocks of documents (see ``repeats``):

1. Documents of the same words are one from here on (copies of a block at once, then
   across blocks by a digest of the words).  Of each set, the last ``FIRST`` segments
   are indexed; in the groups that share one, the first document is verified against
   the others.  The links found join most near copies into components.
2. The whole index follows, each entry with its component so far.  Buckets return only
   groups that are still split between components, so copies and near copies, however
   many, cause no rows here.  Members of different components compare bitmaps of
   shingle hashes; a bitmap's differing bits bound the differing shingles from below,
   so what is ruled out is no link.  What remains is verified exactly, on the words.
   A large group is compared in tiles of ``TILE`` members, a task a pair of tiles.
   A member that meets many of one likely component puts pairs off to a further
   round, which comes only while its group is split, with sixteen times as many.

No link between components is missed: the second part alone is complete.

Edge cases: null or blank texts have no shingles and no links; a text of fewer words
than a shingle is one shingle; rows without a doc_id are never linked and have a null
component; every row is a document of its own, also where it repeats an id, and has the
smallest doc_id of its own component; an empty table gives an empty result;
further columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import materialise
from .repeats import flatten_ranges, mixed

SHINGLE, PERCENT = 4, 85
#: Chance that two shingles drawn from the corpus are equal, for the cost model only.
REPEAT_CHANCE = 1e-3
_K = [np.uint64(k) for k in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _salt(k: int, number: int) -> np.uint64:
    return np.uint64(int(_K[k]) * number & ((1 << 64) - 1))


def bands(percent: int = PERCENT, most: int = 1 << 40) -> list[tuple[int, int]]:
    out, low = [], 1
    while low <= most:
        high = max(low, low * 100 // percent)
        out.append((low, high))
        low = high + 1
    return out


def differing(high: int, percent: int = PERCENT) -> int:
    """Most shingles in which linked sets of at most ``high`` can differ."""
    return 2 * high * (100 - percent) // (100 + percent)


def _at_most(k: int, mean: float) -> float:
    """Chance that a Poisson variable is at most ``k``."""
    term = total = math.exp(-mean)
    for j in range(1, k + 1):
        term *= mean / j
        total += term
    return total


def layout(low: int, high: int, n_docs: int, percent: int = PERCENT) -> tuple[int, int, int, int]:
    """(segments, how many of them index deletions, slack, least) of least cost for a band."""
    best = None
    must = differing(high, percent) + 1
    for least in (2, 3, 4):
        for slack in sorted({0, 1, 2, 3, *(must // k for k in (20, 12, 10, 8, 7, 6, 5, 4))}):
            weight = must + slack
            for m in sorted({*range(-(-weight // 2), weight, max(1, weight // 32)), weight}):
                x, size = weight - m, low / m
                none, few = math.exp(-size), _at_most(least - 1, size)
                edge = _at_most(least, size) - few
                stay = _at_most(slack, (m - x) * few + x * (2 * few + edge))
                false = n_docs * (REPEAT_CHANCE**least * (m + 3 * x) * edge + m * none * (1 - stay) ** 2)
                cost = m * (1 - few) + x * size + 10 * false
                if m == 1 and slack == 0:
                    cost = 1 + x * low  # the whole set: never empty
                if best is None or cost < best[0]:
                    best = (cost, m, x, slack, least)
    return best[1:]


#: Bands from this size on take the plain layout of one segment more than can differ.
PLAIN = 20_000


def layouts(n_docs: int, percent: int = PERCENT) -> list[tuple]:
    """(low, high, m, x, slack, least) of the bands below ``PLAIN``; ``reaching`` adds what a block needs beyond."""
    return [(low, high, *layout(low, high, n_docs, percent)) for low, high in bands(percent, PLAIN - 1)]


def reaching(plans: list, largest: int, percent: int = PERCENT) -> list[tuple]:
    """The plans, carried on until sets of any size up to ``largest`` lie in a band."""
    out = list(plans)
    while not out or out[-1][1] < largest:
        low = out[-1][1] + 1 if out else 1
        high = max(low, low * 100 // percent)
        out.append((low, high, differing(high, percent) + 1, 0, 0, 2))
    return out


def words_of(text: str | None) -> list:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _sets(texts: list, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, list]:
    """Sorted distinct shingle hashes of each text, concatenated, their numbers, and digests of the words."""
    known: dict = {}
    words = [words_of(t) for t in texts]
    ids = np.fromiter((known.setdefault(w, len(known)) for doc in words for w in doc), np.int64)
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
    units, out, at = table[ids] if len(ids) else np.empty(0, np.uint64), [], 0
    for doc in words:
        own = units[at : at + len(doc)]
        at += len(doc)
        if 0 < len(own) < n:
            own = np.r_[own, np.zeros(n - len(own), np.uint64)]
        out.append(np.unique(repeats.gram_hashes(own, n)))
    digests = [hashlib.blake2b(b" ".join(doc), digest_size=16).digest() for doc in words]
    return np.concatenate(out or [np.empty(0, np.uint64)]), np.array([len(o) for o in out], np.int64), digests


#: Segments of each layout that the first part indexes.
FIRST = 8


def signatures(hashes: np.ndarray, sizes: np.ndarray, plans: list, percent: int = PERCENT, first: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document) index entries; with ``first`` those of the last ``FIRST`` segments alone."""
    ends = np.cumsum(sizes)
    sigs, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for b, (low, high, m, x, slack, least) in enumerate(reaching(plans, sizes.max(initial=0), percent)):
        chosen = np.flatnonzero((sizes * 100 >= percent * low) & (sizes <= high) & (sizes > 0))
        if not len(chosen):
            continue
        h = hashes[flatten_ranges((ends - sizes)[chosen], sizes[chosen])]
        doc = np.repeat(np.arange(len(chosen)), sizes[chosen])
        segment = ((mixed(h ^ _salt(0, b + 1)) >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
        if first and m > FIRST:
            own = segment >= m - FIRST
            h, doc, segment = h[own], doc[own], segment[own]
        value, cell = mixed(h * _K[1]), doc * m + segment
        count = np.bincount(cell, minlength=len(chosen) * m)
        order = np.argsort(cell, kind="stable")
        total = np.zeros(len(chosen) * m, np.uint64)
        total[count > 0] = np.add.reduceat(value[order], np.r_[0, np.cumsum(count[count > 0])[:-1]]) if len(order) else 0
        place = np.tile(np.arange(m), len(chosen))
        weight = np.where(place < x, np.where(count < least, 2, np.where(count == least, 1, 0)), count < least)
        full = np.repeat(weight.reshape(len(chosen), m).sum(1) > slack, m)  # these index small and empty segments, too
        salt = lambda seg: _salt(2, b) ^ (seg.astype(np.uint64) * _K[3])
        keep = np.flatnonzero(count >= min(2, least) if first else (count >= least) | full)
        sigs.append(mixed(mixed(total[keep]) + salt(place[keep])))
        docs.append(chosen[keep // m])
        less = np.empty(0, np.int64) if first else np.flatnonzero((segment < x) & ((count[cell] > least) | full[cell]))
        if len(less):
            sigs.append(mixed(mixed(total[cell[less]] - value[less]) + salt(segment[less])))
            docs.append(chosen[doc[less]])
    return np.concatenate(sigs), np.concatenate(docs)


#: Documents in a block, on average at most, and bits of a document's place in its block.
BLOCK_ROWS, PLACE_BITS = 1 << 15, 32
#: Kinds of rows that the first part returns.
GROUP, NODES = 0, 1
NODE = np.dtype([("id", "<i8"), ("none", "?"), ("n", "<i8"), ("key", "<i8"), ("digest", "S16"), ("first", "<i8"), ("bytes", "<i4")])


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """One bit a shingle, in eight to sixteen times as many bits, half that for large sets."""
    bits = max(64, 1 << ((8 if len(hashes) <= 1024 else 4) * len(hashes) - 1).bit_length()) if len(hashes) else 64
    out = np.zeros(bits, np.uint8)
    out[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap over fewer bits, as ``bitmap`` would have set them."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def may_link(one: np.ndarray, n_one: int, others: np.ndarray, n_others: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """False only for pairs that aren't linked: each bit that differs is a shingle that does."""
    differ = np.maximum(np.bitwise_count(others ^ one).sum(1, dtype=np.int64), np.abs(n_others - n_one))
    return (100 + percent) * differ <= (100 - percent) * (n_others + n_one)


def _payloads(sig: np.ndarray, doc: np.ndarray, n_buckets: int, number: int, label: dict) -> tuple[list, list]:
    """Index entries by bucket: buckets, and for each its entries in order of signature.

    An entry is five bytes of the signature and the document's place; entries of
    documents in a component add its id, eight bytes.
    """
    bucket = ((sig >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)
    code = sig & np.uint64((1 << 40) - 1)
    order = np.lexsort((code, bucket))
    bucket, code, doc = bucket[order], code[order], doc[order]
    wide = 4 if len(doc) and doc.max() >= 1 << 16 else 2  # many copies of a row share a block
    codes, places = code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5], doc.astype(f"<u{wide}")
    named = np.isin(doc, np.fromiter(label, np.int64, len(label)))
    used, at = np.unique(bucket, return_index=True)
    out = []
    for a, z in zip(at, np.r_[at[1:], len(bucket)]):
        has = named[a:z]
        labels = np.fromiter((label[p] for p in doc[a:z][has].tolist()), np.int64, int(has.sum()))
        out.append(bytes([wide]) + int(z - a).to_bytes(4, "little") + codes[a:z].tobytes() + places[a:z].tobytes() + np.packbits(has).tobytes() + labels.tobytes())
    return used.tolist(), out


def _entries(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, place, whether in a component, component) of one payload."""
    wide, n = payload[0], int.from_bytes(payload[1:5], "little")
    code = np.zeros((n, 8), np.uint8)
    code[:, :5] = np.frombuffer(payload, np.uint8, 5 * n, 5).reshape(-1, 5)
    at = 5 + 5 * n
    place = np.frombuffer(payload, f"<u{wide}", n, at).astype(np.int64)
    at += wide * n
    named = np.unpackbits(np.frombuffer(payload, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
    label = np.zeros(n, np.int64)
    label[named] = np.frombuffer(payload, "<i8", -1, at + (n + 7) // 8)
    return code.view("<u8").ravel(), place, named, label


def text_key(text: str) -> int:
    """As Spark's ``xxhash64`` of the text."""
    key = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42)
    return key - (key >> 63 << 64)


def _index_table(number: int, buckets: list, payload: list) -> pa.Table:
    return pa.table({"bucket": pa.array(buckets, pa.int32()), "block": pa.array([number] * len(buckets), pa.int32()), "payload": pa.array(payload, pa.binary())})


def _send_first(plans: list, n_buckets: int, n: int, percent: int):
    def send(block: pa.Table) -> pa.Table:
        number, rows = block.column("block")[0].as_py(), repeats.ordered(block)
        hashes, sizes, digests = _sets([t for _, t in rows], n)
        ends = np.cumsum(sizes)
        lead, nodes, bitmaps = {}, np.zeros(len(rows), NODE), []
        for k, (doc_id, text) in enumerate(rows):  # copies within the block index once
            own = hashes[ends[k] - sizes[k] : ends[k]]
            first = lead.setdefault(digests[k], k) if sizes[k] and doc_id is not None else k
            bits = bitmap(own).tobytes() if first == k else b""
            nodes[k] = (doc_id or 0, doc_id is None, sizes[k], text_key(text), digests[k], first, len(bits))
            bitmaps.append(bits)
        kept = np.array(sorted(lead.values()), np.int64)
        own = hashes[flatten_ranges((ends - sizes)[kept], sizes[kept])]
        sig, doc = signatures(own, sizes[kept], plans, percent, first=True)
        buckets, payload = _payloads(sig, kept[doc], n_buckets, number, {})
        # the block's nodes go to a bucket of their own
        return _index_table(number, [*buckets, -1 - number], [*payload, nodes.tobytes() + b"".join(bitmaps) + len(nodes).to_bytes(4, "little")])

    return send


def _send_all(plans: list, n_buckets: int, n: int, percent: int):
    def send(block: pa.Table, known: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _index_table(0, [], [])
        number, rows = block.column("block")[0].as_py(), repeats.ordered(block)
        hashes, sizes, digests = _sets([t for _, t in rows], n)
        ends, lead = np.cumsum(sizes), {}
        for k, (doc_id, _) in enumerate(rows):
            if sizes[k] and doc_id is not None:
                lead.setdefault(digests[k], k)
        places, away = (known.column("ref").to_numpy() & ((1 << PLACE_BITS) - 1)).tolist(), known.column("away").to_pylist()
        label = dict(zip(places, known.column("label").to_pylist()))
        gone = {p for p, a in zip(places, away) if a}  # another block has the same words and indexes them
        kept = np.array(sorted(p for p in lead.values() if p not in gone), np.int64)
        own = hashes[flatten_ranges((ends - sizes)[kept], sizes[kept])]
        sig, doc = signatures(own, sizes[kept], plans, percent)
        return _index_table(number, *_payloads(sig, kept[doc], n_buckets, number, label))

    return send


FOUND = "kind int, block int, refs array<long>, payload binary"


def _groups(bucket: pa.Table) -> pa.Table:
    """The bucket's distinct groups of documents (block << PLACE_BITS | place) that share a signature
    and aren't known to be of one component."""
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("refs", pa.list_(pa.int64())), ("payload", pa.binary())])
    payload = bucket.column("payload").to_pylist()
    if bucket.column("bucket")[0].as_py() < 0:
        return pa.table([pa.array([NODES] * len(payload), pa.int32()), bucket.column("block"), pa.array([None] * len(payload), pa.list_(pa.int64())), bucket.column("payload")], schema=schema)
    parts = [_entries(p) for p in payload]
    code, place, named, label = (np.concatenate([p[k] for p in parts]) for k in range(4))
    ref = (np.repeat(bucket.column("block").to_numpy().astype(np.int64) << PLACE_BITS, [len(p[0]) for p in parts])) | place
    order = np.lexsort((ref, code))
    code, ref, named, label = code[order], ref[order], named[order], label[order]
    fresh = np.r_[True, (code[1:] != code[:-1]) | (ref[1:] != ref[:-1])]
    code, ref, named, label = code[fresh], ref[fresh], named[fresh], label[fresh]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    counts = np.diff(np.r_[starts, len(code)])
    one = np.minimum.reduceat(named, starts) & (np.minimum.reduceat(label, starts) == np.maximum.reduceat(label, starts))
    many = np.flatnonzero((counts > 1) & ~one)
    seen = dict.fromkeys(ref[a : a + n].tobytes() for a, n in zip(starts[many].tolist(), counts[many].tolist()))
    lists = [np.frombuffer(s, np.int64) for s in seen]
    flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
    offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
    refs, n = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), len(lists)
    return pa.table([pa.array([GROUP] * n, pa.int32()), pa.array([None] * n, pa.int32()), refs, pa.array([None] * n, pa.binary())], schema=schema)


def _fetch(block: pa.Table, wanted: pa.Table) -> pa.Table:
    """Wanted documents' texts, compressed."""
    rows = repeats.ordered(block) if wanted.num_rows else []
    pack, refs = zstandard.ZstdCompressor(level=3).compress, sorted(wanted.column("ref").to_pylist())
    return pa.table({"ref": pa.array(refs, pa.int64()), "packed": pa.array([pack(rows[r & ((1 << PLACE_BITS) - 1)][1].encode("utf-8", "surrogatepass")) for r in refs], pa.binary())})


def linked(left: str, right: str, n: int = SHINGLE, percent: int = PERCENT) -> bool:
    """Exact: 100 * intersection >= percent * union of the two texts' shingle sets."""
    known: dict = {}
    sets = []
    for words in (words_of(left), words_of(right)):
        sets.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
    if not len(sets[0]) or not len(sets[1]):
        return False
    sets = [s if len(s) >= n else np.r_[s, np.full(n - len(s), len(known))] for s in sets]
    cut = [[s[k : len(s) - n + 1 + k] for k in range(n)] for s in sets]
    codes, split = np.concatenate([np.concatenate([a[0], b[0]]) for a, b in [cut]]), len(cut[0][0])
    for k in range(1, n):
        codes = np.unique(codes * (len(known) + 1) + np.concatenate([cut[0][k], cut[1][k]]), return_inverse=True)[1]
    a, b = np.unique(codes[:split]), np.unique(codes[split:])
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sides(nodes: DataFrame, fields: list) -> list[DataFrame]:
    return [nodes.select(F.col("ref").alias(side), *(F.col(f).alias(f"{side}_{f}") for f in fields)) for side in ("left", "right")]


def _screen(percent: int):
    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, n_x, y, n_y in zip(*(batch.column(c).to_pylist() for c in ("left_bits", "left_n", "right_bits", "right_n"))):
                size = min(len(x), len(y))
                one, other = (folded(np.frombuffer(v, np.uint8), size) for v in (x, y))
                good.append(bool(may_link(one, n_x, other[None, :], np.array([n_y]), percent)[0]))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("left", "right")], names=["left", "right"])

    return screen


def _check(n: int, percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = ([unpack(t).decode("utf-8", "surrogatepass") for t in batch.column(c).to_pylist()] for c in ("left_packed", "right_packed"))
            mask = pa.array([linked(x, y, n, percent) for x, y in zip(*texts)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("left").filter(mask), batch.column("right").filter(mask)], names=["a", "b"])

    return check


def screen(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (left, right) of refs that bitmaps don't rule out."""
    a, b = _sides(nodes, ["n", "bits"])
    return pairs.join(b, "right").join(a, "left").mapInArrow(_screen(percent), "left long, right long")


def verify(likely: DataFrame, blocks: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b): pairs of refs whose words show it."""
    wanted = likely.select(F.col("left").alias("ref")).union(likely.select("right")).distinct().select(F.shiftright("ref", PLACE_BITS).cast("int").alias("block"), "ref")
    texts = materialise(blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_fetch, "ref long, packed binary"), "texts")
    a, b = _sides(texts, ["packed"])
    read = likely.join(b, "right").join(a, "left").select("left", "left_packed", "right", "right_packed")
    return materialise(read.mapInArrow(_check(n, percent), "a long, b long"), "verified")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link.

    Alternating large-star and small-star steps, until every id has one edge, to an id
    without one; each round's edges are written to the shared folder, and only a count
    comes to the driver.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    up, down = (F.struct(F.col(c).alias("id"), F.lit(int(c == "u")).alias("above"), F.lit(int(c == "v")).alias("below")) for c in "uv")
    while True:
        ends = edges.select(F.inline(F.array(up, down))).groupBy("id").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
        if not ends.where("above > 1 or (above = 1 and below = 1)").agg(F.count("*")).first()[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lowest.select("u", F.col("m").alias("v")))
        edges = materialise(small.distinct(), "links")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def grown_by(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` (id, component) after further links (a, b), which are followed between components only."""
    held = [parts.select(F.col("id").alias(side), F.col("component").alias(f"{side}_part")) for side in ("a", "b")]
    between = materialise(links.join(held[0], "a", "left").join(held[1], "b", "left"), "between")
    merged = components(between.select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b")))
    alone = [between.where(F.col(f"{side}_part").isNull()).select(F.col(side).alias("id")) for side in ("a", "b")]
    members = parts.unionByName(alone[0].union(alone[1]).distinct().select("id", F.col("id").alias("component")))
    placed = members.join(merged.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left")
    return materialise(placed.select("id", F.coalesce("now", "component").alias("component")), "parts")


#: Bitmaps compared at once.
COMPARED_BYTES = 1 << 22


def earlier_groups(lists: list, gid: int) -> np.ndarray | None:
    """Members' groups below ``gid`` that two of them share, as bits; two members with a bit in common meet in another group."""
    flat = np.concatenate(lists)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    below = flat < gid
    groups, at, counts = np.unique(flat[below], return_inverse=True, return_counts=True)
    if not (counts > 1).any():
        return None
    place = np.cumsum(counts > 1) - 1
    shared = counts[at] > 1
    out = np.zeros((len(lists), -(-int((counts > 1).sum()) // 64) * 64), np.uint8)
    out[row[below][shared], place[at[shared]]] = 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def cross_pairs(part: np.ndarray, n: np.ndarray, bits: np.ndarray, most: int, percent: int = PERCENT, sides: np.ndarray | None = None, earlier: np.ndarray | None = None) -> tuple[list, bool]:
    """Likely pairs (i, j) of members of different components, and whether any was put off.

    With ``sides`` only pairs of members on different sides count, with ``earlier`` only those
    that share no earlier group: of all groups of a pair, the first one compares it.

    A member pairs up with at most ``most`` others of one provisional component (likely
    pairs taken as links); once they are verified, the rest is mostly settled.
    """
    provisional, out, put_off = part.copy(), [], False
    step = max(1, COMPARED_BYTES // max(1, bits[0].nbytes))
    for i in range(len(part) - 1):
        apart = part[i + 1 :] != part[i]
        others = i + 1 + np.flatnonzero(apart if sides is None else apart & (sides[i + 1 :] != sides[i]))
        if earlier is not None:
            others = others[~(earlier[others] & earlier[i]).any(1)]
        chunks = [others[a : a + step] for a in range(0, len(others), step)]
        others = np.concatenate([c[may_link(bits[i], n[i], bits[c], n[c], percent)] for c in chunks] or [others])
        if not len(others):
            continue
        by = np.argsort(provisional[others], kind="stable")
        labels = provisional[others[by]]
        starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
        nth = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
        put_off = put_off or bool((nth >= most).any())
        out += [(i, j) for j in others[by[nth < most]].tolist()]
        provisional[np.isin(provisional, labels[starts])] = provisional[i]
    return out, put_off


#: Members of a group that one task compares with each other, or with as many others, and
#: members of groups of one head in a chunk, which one task takes.
TILE, CHUNK_ROWS = 2048, 2048
LIKELY = "left long, right long, gid long, low int, high int"


def _likely(most: int, percent: int):
    """Likely pairs within the units of a chunk, and the units (gid, low, high) of which some were put off.

    A document's bitmap and groups come once a chunk, however many of its units the document is in.
    """

    def pairs(chunk: pa.Table, documents: pa.Table) -> pa.Table:
        gid, low, high, ref, tile = (chunk.column(c).to_numpy() for c in ("gid", "low", "high", "ref", "tile"))
        order = np.lexsort((ref, high, low, gid))
        gid, low, high, ref, tile = (c[order] for c in (gid, low, high, ref, tile))
        known = documents.column("doc").to_numpy()
        by = np.argsort(known)
        at = by[np.searchsorted(known[by], ref)]
        part, n = (documents.column(c).to_numpy()[at] for c in ("part", "n"))
        raw = [np.frombuffer(v, np.uint8) for v in documents.column("bits").to_pylist()]
        held = documents.column("groups").combine_chunks()
        ends, flat = held.offsets.to_numpy(), held.values.to_numpy()
        groups = [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
        out, put_off = [], []
        starts = np.flatnonzero(np.r_[True, (gid[1:] != gid[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(gid)]):
            if (part[a:z] == part[a]).all():
                continue
            own = [raw[k] for k in at[a:z].tolist()]
            size = min(map(len, own))
            bits = np.stack([folded(v, size) for v in own]).view(np.uint64)
            sides = None if low[a] == high[a] else tile[a:z] == low[a]
            earlier = earlier_groups([groups[k] for k in at[a:z].tolist()], int(gid[a]))
            found, more = cross_pairs(part[a:z], n[a:z], bits, most, percent, sides, earlier)
            out += [(a + i, a + j) for i, j in found]
            put_off += [a] if more else []
        i, j = np.array(list({(ref[a], ref[z]): (a, z) for a, z in out}.values()), np.int64).reshape(-1, 2).T
        columns = [[*c.tolist(), *[None] * len(put_off)] for c in (ref[i], ref[j])]
        columns += [[*[None] * len(i), *c[put_off].tolist()] for c in (gid, low, high)]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2
        return pa.table({f.split()[0]: pa.array(c, k) for f, c, k in zip(LIKELY.split(", "), columns, kinds)})

    return pairs


def _nodes(found: DataFrame) -> DataFrame:
    """(ref, id, n, key, digest, first, bits): every row; ``first`` is the ref of its block's first copy, which has the bitmap."""
    return found.where(F.col("kind") == NODES).select("block", "payload").mapInArrow(_unpack_nodes, "ref long, id long, n long, key long, digest binary, first long, bits binary")


def _blocks(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, list, int]:
    """Documents by block, what the first part finds over them (see ``FOUND``), layouts and number of blocks."""
    n_docs = max(1, docs.count())
    blocks, n_blocks = repeats.into_blocks(docs, packed=True, least=-(-n_docs // BLOCK_ROWS))
    plans = layouts(n_docs, percent)
    sent = blocks.groupBy("block").applyInArrow(_send_first(plans, max(4, n_blocks // 8), n, percent), repeats.FILTER_SCHEMA)
    return blocks, materialise(sent.groupBy("bucket").applyInArrow(_groups, FOUND), "groups"), plans, n_blocks


def _distinct_groups(found: DataFrame) -> DataFrame:
    groups = found.where(F.col("kind") == GROUP).groupBy("refs").agg(F.lit(1).alias("one"))
    return groups.select("refs", F.xxhash64("refs").alias("gid"), F.size("refs").alias("size"))


def _copies(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between documents of the same words, and refs (ref) that another block's copy stands for."""
    leads = nodes.where("ref = first and n > 0 and id is not null")
    held = leads.groupBy("digest").agg(F.min("ref").alias("least"), F.max("ref").alias("most")).where("least < most").drop("most")
    across = materialise(leads.select("ref", "digest").join(held, "digest").where("ref <> least").select("least", "ref"), "copies")
    inside = nodes.where("ref <> first").select(F.col("first").alias("a"), F.col("ref").alias("b"))
    return across.select(F.col("least").alias("a"), F.col("ref").alias("b")).unionByName(inside), across.select("ref")


def _components(blocks: DataFrame, found: DataFrame, plans: list, n_blocks: int, n: int, percent: int) -> DataFrame:
    """(id, component), both refs, of every document that has a link."""
    nodes = _nodes(found)
    light = materialise(nodes.select("ref", "id", "n", "digest", "first"), "nodes")
    copies, away = _copies(light)
    # the first part: one leader against the rest of each group
    groups = _distinct_groups(found)
    members = groups.select(F.explode("refs").alias("right"), F.col("refs")[0].alias("left")).where("left <> right").distinct()
    digests = [light.select(F.col("ref").alias(side), F.col("digest").alias(f"{side}_digest")) for side in ("left", "right")]
    tested = materialise(members.join(digests[1], "right").join(digests[0], "left").where("left_digest <> right_digest").select("left", "right"), "pairs")
    bitmaps = nodes.where("ref = first").select("ref", "n", "bits")
    likely = materialise(screen(tested, bitmaps, percent), "likely")
    links = materialise(copies, "links").unionByName(verify(likely, blocks, n, percent))
    parts = components(links)
    # the second part: all index entries, with components
    placed = parts.select(F.col("id").alias("ref"), F.col("component").alias("label")).join(away.withColumn("away", F.lit(True)), "ref", "left")
    known = placed.select(F.shiftright("ref", PLACE_BITS).cast("int").alias("block"), "ref", "label", F.coalesce("away", F.lit(False)).alias("away"))
    sent = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_send_all(plans, max(4, n_blocks // 2), n, percent), repeats.FILTER_SCHEMA)
    groups = materialise(_distinct_groups(materialise(sent.groupBy("bucket").applyInArrow(_groups, FOUND), "split")), "groups")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    heads = groups.groupBy(F.col("refs")[0].alias("head")).agg(F.ceil(F.sum("size") / CHUNK_ROWS).alias("pieces"))
    groups = groups.withColumn("head", F.col("refs")[0]).join(heads, "head")
    members = groups.select("gid", "head", F.pmod("gid", "pieces").alias("piece"), tiles.alias("tiles"), F.explode("refs").alias("ref"))
    members = members.withColumn("tile", F.pmod(F.xxhash64("ref", "gid"), F.col("tiles")).cast("int"))
    units = members.select("gid", "head", "piece", "ref", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    units = units.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    # groups of one head often have the same members: they go to one chunk as far as its size allows, each pair of tiles to one of its own
    units = materialise(units.select("gid", F.xxhash64("head", "piece", "low", "high").alias("chunk"), "ref", "tile", "low", "high"), "units")
    # a document's groups tell which of a pair's groups comes first, in every round
    met = materialise(bitmaps.join(units.groupBy("ref").agg(F.collect_set("gid").alias("groups")), "ref"), "met")
    key, chunks, most = ["gid", "low", "high"], max(4, -(-2 * units.count() // CHUNK_ROWS)), 16
    part = F.coalesce("component", "ref").alias("part")
    while True:
        labels = parts.withColumnRenamed("id", "ref")
        dealt = units.withColumn("chunk", F.pmod("chunk", F.lit(chunks)))
        placed = dealt.select(F.col("chunk").alias("goes_to"), "ref").distinct().join(met.join(labels, "ref", "left").select("ref", "n", "bits", "groups", part), "ref").withColumnRenamed("ref", "doc")
        found = materialise(dealt.groupBy("chunk").cogroup(placed.groupBy("goes_to")).applyInArrow(_likely(most, percent), LIKELY), "likely")
        likely = found.where("gid is null").select("left", "right").distinct().join(tested, ["left", "right"], "left_anti")
        likely = materialise(likely, "likely")
        if not likely.isEmpty():
            links = verify(likely, blocks, n, percent)
            if not links.isEmpty():
                parts = grown_by(parts, links)
        put_off = found.where("gid is not null").select(*key)
        if put_off.isEmpty():
            return parts
        # of the units with pairs put off, those that are still split; a unit has two tiles of members at most
        late = units.join(put_off, key, "left_semi").join(parts.withColumnRenamed("id", "ref"), "ref", "left").withColumn("part", part)
        late = late.groupBy(*key).agg(F.first("chunk").alias("chunk"), F.min("part").alias("least"), F.max("part").alias("most"), F.collect_list(F.struct("ref", "tile")).alias("members"))
        units = materialise(late.where("least < most").select(*key, "chunk", F.inline("members")), "units")
        tested, most = tested.unionByName(likely), most * 16


def join_components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Sets hold shingles of ``n`` words; sets link from ``percent`` of 100 on.
    """
    blocks, found, plans, n_blocks = _blocks(docs, n, percent)
    parts = _components(blocks, found, plans, n_blocks, n, percent).withColumnRenamed("id", "ref")
    counted = _nodes(found).select("ref", F.col("id").alias("doc_id"), F.col("n").alias("n_shingles")).join(parts, "ref", "left")
    least = counted.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    # rows without links are joined under their own ref, so that no partition takes all of them
    return counted.withColumn("component", F.coalesce("component", "ref")).join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def copies_to_drop(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, kept, rows) of rows that are not to stay once each, if one document of each component does.

    The one of the smallest doc_id stays.  ``kept`` is false where no row of this id and
    text is to stay; ``rows`` is the number of rows that repeat both, of which one may.
    Rows without a doc_id are linked with nothing and not listed.
    """
    blocks, found, plans, n_blocks = _blocks(docs, n, percent)
    parts = _components(blocks, found, plans, n_blocks, n, percent).withColumnRenamed("id", "ref")
    nodes = _nodes(found).where("id is not null").select("ref", "id", "key").join(parts, "ref", "left")
    chosen = nodes.where("component is not null").groupBy("component").agg(F.min(F.struct("id", "ref")).alias("one"))
    judged = nodes.withColumn("component", F.coalesce("component", "ref")).join(chosen, "component", "left").withColumn("kept", F.coalesce(F.col("ref") == F.col("one.ref"), F.lit(True)))
    return judged.groupBy(F.col("id").alias("doc_id"), F.col("key").alias("text_key")).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1")


def _unpack_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
            count = int.from_bytes(payload[-4:], "little")
            rows = np.frombuffer(payload, NODE, count)
            ends = count * NODE.itemsize + np.r_[0, np.cumsum(rows["bytes"])]
            bits = [payload[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
            at = NODE.fields["digest"][1]
            digests = [payload[k * NODE.itemsize + at : k * NODE.itemsize + at + 16] for k in range(count)]
            base = number << PLACE_BITS
            columns = [pa.array(base + np.arange(count)), pa.array(rows["id"], pa.int64(), mask=rows["none"]), *(pa.array(rows[c], pa.int64()) for c in ("n", "key")), pa.array(digests, pa.binary()), pa.array(base + rows["first"]), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["ref", "id", "n", "key", "digest", "first", "bits"])
