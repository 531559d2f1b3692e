"""Chat formatting: a finite-state machine over roles and a declarative template.

``format_turns`` streams the turns of each conversation in order and emits text
segments with a loss flag each; ``read_back`` parses emitted segments again.  A
conversation is never gathered: rows are partitioned by conversation, sorted, and
both steps keep only the machine's state and running hashes, so a conversation of
any length needs constant memory.

Control strings inside texts are escaped by one more backslash between ``<`` and
``|`` (``<|`` -> ``<\\|``, ``<\\|`` -> ``<\\\\|``), which is undone exactly.

Edge cases: null texts and roles are empty; rows of a null conv_id form one
conversation; equal turn numbers are ordered by role, then text; a broken order of
roles is formatted all the same and flagged; an empty table gives no segments.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles count for the loss, and which order is valid."""

    head: str = "<|im_start|>{role}\n"
    tail: str = "<|im_end|>\n"
    loss_roles: frozenset = frozenset({"assistant"})
    #: state -> roles that may come next; a state is the last role, "" the start.
    follows: dict = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")}
    )


CHATML = Template()
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
SEGMENTS = "conv_id long, turn_no long, part int, segment string, loss boolean, valid boolean"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def _rows(batches: Iterator[pa.RecordBatch], names: tuple) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def format_turns(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """Segments in order: head, body and tail of every turn, with the loss flag of each.

    ``valid`` is the machine's verdict on the order of roles up to that turn.
    The result is partitioned by conversation and sorted within partitions.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("part", pa.int32()), ("segment", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, state, number, valid = object(), "", 0, True
        for conv, role, text in _rows(batches, ("conv_id", "role", "text")):
            if conv != current:
                current, state, number, valid = conv, "", 0, True
            valid = valid and role in template.follows.get(state, ())
            yield conv, number, 0, template.head.replace("{role}", escape(role)), False, valid
            yield conv, number, 1, escape(text), role in template.loss_roles, valid
            yield conv, number, 2, template.tail, False, valid
            state, number = role, number + 1

    return rows.mapInArrow(lambda batches: _batches(emit(batches), schema), SEGMENTS)


def read_back(segments: DataFrame, template: Template = CHATML) -> DataFrame:
    """Digest per conversation, from the segments alone as ``format_turns`` left them."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid_order", pa.bool_())]
    )
    before, after = template.head.split("{role}")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, started = None, False
        for conv, part, segment, loss, valid in _rows(batches, ("conv_id", "part", "segment", "loss", "valid")):
            if not started or conv != current:
                if started:
                    yield current, n, turns.hexdigest(), chars, losses.hexdigest(), total, good
                current, started, n, chars, total, good, turns, losses = conv, True, 0, 0, 0, True, hashlib.sha256(), hashlib.sha256()
            total += len(segment)
            good = good and valid
            if part == 0:
                turns.update((unescape(segment[len(before) : len(segment) - len(after)]) + "\n").encode())
                n += 1
            elif part == 1:
                text = unescape(segment)
                turns.update((text + "\n").encode())
                if loss:
                    chars += len(text)
                    losses.update(text.encode())
        if started:
            yield current, n, turns.hexdigest(), chars, losses.hexdigest(), total, good

    fields = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid_order boolean"
    return segments.mapInArrow(lambda batches: _batches(digest(batches), schema), fields)
