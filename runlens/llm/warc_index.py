"""WARC archives with a two-level capture index.

``write_archives`` sorts captures by their reversed-host URL key, range-partitioned
by Spark, and each partition writes one archive of gzip members, one block file of
its sorted index lines in compressed blocks of ``BLOCK_LINES``, and returns the
sparse directory: the first and last key of each block, its file, place and length.
Records whose payload was seen with a smaller id become revisits.

``read_captures`` looks URLs up, all at once: a binary search among the archives' key
ranges (one for each task that wrote, which is all that comes to the driver) sends each
key to the archives that may hold it; there a binary search in the directory finds its
blocks, one range read gets a block, a binary search finds the key's lines, and one
range read each gets the records.  ``Lookup`` does the same for single URLs, and
``read_archives`` reads everything without keys: blocks, then records by range.

Files are reached through ``pyarrow.fs`` (local, HDFS, S3, ...) in the shared folder.

Skew: equal payloads are found by an aggregate of digests with map-side combination;
the response's id comes back by a join that adaptive execution may split.  Pages of
one host are spread over several archives, as (key, id) pairs are the sort key.

Edge cases: a null html is the empty payload; null or malformed URLs sort under the
key ``-``; a row without an id has none in its record either and is never the response
that others refer to; repeated ids with equal payloads are all responses; an empty
table writes no archive.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, shared_dir

BLOCK_LINES = 500
#: Bytes of the pages' files that make an archive: the number of archives grows with the input, and one is what a task writes or reads.
ARCHIVE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
DIRECTORY = "first_key string, last_key string, archive string, blocks string, place long, length long, n_lines int"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
_URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", re.S)


def url_key(url: str | None) -> str:
    """com,example,www)/path?query in lower case; white space is escaped, for index lines."""
    found = _URL.match(url or "")
    if not found or not found.group(1):
        return "-"
    host, port, rest = found.groups()
    key = ",".join(reversed(host.lower().split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (rest.lower() or "/")
    return re.sub(r"[\s%]", lambda c: f"%{ord(c.group()):02x}", key)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, name: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{name}")
    if refers_to is None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        body = http + payload
    else:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse_record(member: bytes) -> dict:
    """Headers, and the payload or (revisits) the length it has."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http).group(1))
    number = lambda v: int(v[len("<urn:page:") : -1]) if v and len(v) > len("<urn:page:>") else None
    kind = headers["WARC-Type"]
    if kind == "response" and len(payload) != size:
        raise ValueError("a response's payload is incomplete")
    return {
        "page_id": number(headers["WARC-Record-ID"]),
        "url": headers.get("WARC-Target-URI"),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest(payload) if kind == "response" else headers["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": number(headers.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
    }


CAPTURES = "key string, page_id long, url string, payload binary, sha binary, n long"


def captures(pages: DataFrame) -> DataFrame:
    """Keyed pages with their payload compressed, so the two shuffles to come carry little."""
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("sha", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, raw = batch.column("url").to_pylist(), [(h or "").encode("utf-8", "surrogatepass") for h in batch.column("html").to_pylist()]
            columns = [[url_key(u) for u in urls], batch.column("page_id"), urls, [zlib.compress(r, 1) for r in raw], [hashlib.sha1(r).digest() for r in raw], [len(r) for r in raw]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, CAPTURES)


def mark_revisits(found: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Captures with refers_to: the smallest id with the same payload, where that is another."""
    firsts = found.where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    firsts = firsts.where("first < last").drop("last")
    refers_to = F.when((F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return found.join(firsts, "sha", "left").select("key", "page_id", "url", "payload", refers_to.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes archives and index blocks; returns the sparse directory (see ``DIRECTORY``)."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    schema = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("archive", pa.string()), ("blocks", pa.string()), ("place", pa.int64()), ("length", pa.int64()), ("n_lines", pa.int32())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = archive = None
        name = uuid.uuid4().hex  # a task that runs again writes files of its own
        place, lines, blocks, out = 0, [], [], []

        def close_block() -> None:
            packed = gzip.compress("".join(x[1] for x in lines).encode("utf-8", "surrogatepass"), 6, mtime=0)
            out.append((lines[0][0], lines[-1][0], f"{name}.warc.gz", f"{name}.idx.gz", sum(map(len, blocks)), len(packed), len(lines)))
            blocks.append(packed)
            lines.clear()

        for batch in batches:
            for key, page_id, url, packed, refers_to in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "url", "payload", "refers_to"))):
                if archive is None:
                    target, path = fs.FileSystem.from_uri(folder)
                    target.create_dir(path, recursive=True)
                    archive = target.open_output_stream(f"{path}/{name}.warc.gz", compression=None)
                payload = zlib.decompress(packed)
                member = gzip.compress(_record(page_id, url, payload, refers_to, digest(payload)), 3, mtime=0)
                archive.write(member)
                lines.append((key, f"{key} {'' if page_id is None else page_id} {place} {len(member)}\n"))
                place += len(member)
                if len(lines) == BLOCK_LINES:
                    close_block()
        if archive is not None:
            archive.close()
            if lines:
                close_block()
            with target.open_output_stream(f"{path}/{name}.idx.gz", compression=None) as index:
                for packed in blocks:
                    index.write(packed)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    rows = mark_revisits(captures(pages), min_bytes)
    n = max(pages.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(pages, "html") // ARCHIVE_BYTES))
    ordered = rows.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    directory = ordered.mapInArrow(write, DIRECTORY).select("first_key", "last_key", F.concat(F.lit(folder + "/"), "archive").alias("archive"), F.concat(F.lit(folder + "/"), "blocks").alias("blocks"), "place", "length", "n_lines")
    path = f"{folder}/directory"
    directory.write.parquet(path)  # only the files that this names are part of the result
    return pages.sparkSession.read.schema(DIRECTORY).parquet(path)


def _range(uri: str, place: int, length: int) -> bytes:
    source, path = fs.FileSystem.from_uri(uri)
    with source.open_input_file(path) as file:
        return file.read_at(length, place)


def _lines(blocks: str, place: int, length: int) -> list[list]:
    """The index lines of a block: [key, page_id, place, length], all text, in order of keys."""
    return [x.rsplit(" ", 3) for x in gzip.decompress(_range(blocks, place, length)).decode("utf-8", "surrogatepass").splitlines()]


def _records(archive: str, lines: list) -> pa.RecordBatch:
    source, path = fs.FileSystem.from_uri(archive)
    with source.open_input_file(path) as file:
        found = [parse_record(file.read_at(int(n), int(at))) for _, _, at, n in lines]
    return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in zip(_RECORD.names, _RECORD.types)], schema=_RECORD)


def _blocks_of(firsts: list, lasts: list, key: str) -> range:
    """Places of the entries whose key range holds the key; both lists are sorted."""
    return range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))


def archive_ranges(directory: DataFrame) -> list:
    """(first key, last key, archive), sorted: one row for each task that wrote."""
    ranges = directory.groupBy("archive").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last"))
    return sorted((r["first"], r["last"], r["archive"]) for r in ranges.collect())


def read_captures(directory: DataFrame, urls: DataFrame) -> DataFrame:
    """Every record whose URL has the key of one in ``urls`` (column url), each once."""
    ranges = archive_ranges(directory)
    firsts, lasts, archives = ([r[k] for r in ranges] for k in range(3))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(dict.fromkeys(url_key(u) for u in batch.column("url").to_pylist()))
            found = [(archives[k], key) for key in keys for k in _blocks_of(firsts, lasts, key)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in range(2)], names=["archive", "key"])

    def read(entries: pa.Table, wanted: pa.Table) -> pa.Table:
        held = sorted(zip(*(entries.column(c).to_pylist() for c in ("first_key", "last_key", "archive", "blocks", "place", "length"))))
        firsts, lasts = [e[0] for e in held], [e[1] for e in held]
        keys_of: dict = {}
        for key in sorted(set(wanted.column("key").to_pylist())):
            for k in _blocks_of(firsts, lasts, key):
                keys_of.setdefault(k, []).append(key)
        out = []
        for k, keys in keys_of.items():
            lines = _lines(*held[k][3:6])
            sorted_keys = [x[0] for x in lines]
            chosen = [x for key in keys for x in lines[bisect.bisect_left(sorted_keys, key) : bisect.bisect_right(sorted_keys, key)]]
            out.append(_records(held[k][2], chosen))
        return pa.Table.from_batches(out, schema=_RECORD)

    located = urls.select(F.col("url").cast("string")).mapInArrow(locate, "archive string, key string").distinct()
    n = max(1, 2 * len(ranges))  # a number of tasks that doesn't depend on how little text names and keys are
    return directory.repartition(n, "archive").groupBy("archive").cogroup(located.repartition(n, "archive").groupBy("archive")).applyInArrow(read, RECORD)


def read_archives(directory: DataFrame) -> DataFrame:
    """Every record, by way of its index block: page_id, url, type, bytes, digest, refers_to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, blocks, place, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "blocks", "place", "length"))):
                yield _records(archive, _lines(blocks, place, length))

    n = max(1, -(-directory.count() // 8))
    return directory.repartition(n, "archive", "place").mapInArrow(read, RECORD)


@dataclass
class Lookup:
    """Single captures: the archives' key ranges in memory, their directory read by archive."""

    directory: DataFrame
    ranges: list

    @classmethod
    def of(cls, directory: DataFrame) -> Lookup:
        return cls(directory, archive_ranges(directory))

    def find(self, url: str) -> list[dict]:
        """All captures of a URL."""
        key, out = url_key(url), []
        near = [self.ranges[k][2] for k in _blocks_of([r[0] for r in self.ranges], [r[1] for r in self.ranges], key)]
        held = self.directory.where(F.col("archive").isin(near) & (F.col("first_key") <= key) & (F.col("last_key") >= key))
        for e in held.orderBy("first_key", "last_key", "place").collect() if near else []:
            lines = _lines(e["blocks"], e["place"], e["length"])
            keys = [x[0] for x in lines]
            for k in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                out.append(parse_record(_range(e["archive"], int(lines[k][2]), int(lines[k][3]))))
        return out
