"""Recording: log values inside nested loops, and flush them as rows of the two relations.

A recorder lives in the program that logs, not in Spark; what it holds is one run's
records, in the run file's layout.  Loops close also when they are left by a break.
"""

from __future__ import annotations

import random
import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import datetime
from typing import Any

from pyspark.sql import SparkSession

from .functions.text import cast_like, jsonable
from .schema import ITERATION, LOOP, PREFIX, SUFFIX, TIMING, USER
from .sources import runfiles
from .sources.tables import Store


class Recorder:
    """One program's records.  ``replay`` holds the names to keep and the rounds to visit."""

    def __init__(self, projid: str, filename: str, settings: dict[str, str] | None = None, replay: dict | None = None, tstamp: str | None = None):
        self.projid, self.filename = projid, filename
        self.settings, self.replay = dict(settings or {}), replay
        if replay is not None and tstamp is None:
            raise ValueError("a replay writes under its run's time stamp")
        self.tstamp = tstamp or datetime.now().isoformat(timespec="seconds")
        self.records: list[dict] = []
        self.checkpoints: dict[str, Any] = {}
        self._context: dict | None = None
        self._clock = time.perf_counter()

    def _put(self, name: str, value: Any, kind: int) -> None:
        self.records.append({"projid": self.projid, "tstamp": self.tstamp, "filename": self.filename, "ctx": self._context, "name": name, "value": value, "type": kind})

    def log(self, name: str, value: Any) -> Any:
        """Keeps a value under a name in the current context; in a replay only wanted names."""
        if self.replay is None or name in self.replay.get("VARS", ()):
            self._put(name, value if jsonable(value) else str(value), USER)
        return value

    def arg(self, name: str, default: Any = None) -> Any:
        """A setting: the past run's in a replay, else the given one in the default's type."""
        if name in self.settings:
            value = self.settings[name]
            if default is not None and self.replay is None and isinstance(value, str):
                value = cast_like(value, default)
        elif self.replay is None and default is not None:
            value = default
        else:
            raise KeyError(f"no value and no default for {name!r}")
        return self.log(name, value)

    def _enter(self, name: str, number: int | None, value: Any) -> None:
        held = None if value is None or not jsonable(value) else str(value)
        self._context = {"ctx_id": random.randint(-(1 << 63), (1 << 63) - 1), "p_ctx": self._context, "name": name, "iteration": number, "value": held}

    def _depth(self) -> int:
        n, ctx = 0, self._context
        while ctx is not None:
            n, ctx = n + 1, ctx["p_ctx"]
        return n

    def loop(self, name: str, items: Iterable) -> Iterator:
        """Rounds of a loop, numbered from 1.  A replay visits the rounds asked for, by default the last."""
        outer, began, top = self._context, time.perf_counter(), self._depth() == 0
        try:
            for place, item in self._rounds(name, items):
                self._context = outer
                self._enter(name, place + 1, item)
                yield item
                if top and self.replay is None:
                    self.on_checkpoint(name, place + 1)
        finally:
            self._context = outer
            self._put(LOOP, time.perf_counter() - began, TIMING)

    def _rounds(self, name: str, items: Iterable) -> Iterable:
        if self.replay is None:
            return enumerate(items)
        held = list(enumerate(items))
        picks = self.replay.get(name)
        if picks is None:
            return held[-1:]
        return [held[int(p)] for p in picks if str(p).isdigit() and int(p) < len(held)]

    @contextmanager
    def iteration(self, name: str, number: int | None = None, value: Any = None):
        """A single named round."""
        if self.replay is not None:
            raise RuntimeError("single rounds can't be replayed")
        outer, began = self._context, time.perf_counter()
        self._enter(name, number, value)
        try:
            yield
            self.on_checkpoint(name, number)
        finally:
            self._context = outer
            self._put(ITERATION, time.perf_counter() - began, TIMING)

    @contextmanager
    def checkpointing(self, **objects: Any):
        """Marks the end of the set-up; the objects are offered to ``on_checkpoint``."""
        self._put(PREFIX, time.perf_counter() - self._clock, TIMING)
        self.checkpoints.update(objects)
        try:
            yield
        finally:
            self.checkpoints.clear()
            self._clock = time.perf_counter()

    def on_checkpoint(self, loop: str, number: int | None) -> None:
        """Called after each outermost round; override to save ``self.checkpoints``."""

    def commit(self, spark: SparkSession | None = None, store: Store | None = None, path: str | None = None) -> list[dict]:
        """Ends the run: writes its run file, appends it to the store, starts a new stamp."""
        self._put(SUFFIX, time.perf_counter() - self._clock, TIMING)
        done, self.records = self.records, []
        if path is not None and self.replay is None:
            runfiles.write_run_file(done, path)
        if store is not None:
            rows = (spark or store.spark).createDataFrame([runfiles.record_row(r) for r in done], runfiles.RECORDS)
            store.append(runfiles.logs_of(rows), runfiles.loops_of(rows))
        if self.replay is None:
            self.tstamp = datetime.now().isoformat(timespec="seconds")
        self._clock = time.perf_counter()
        return done


def settings_of(records: list[dict]) -> dict[str, Any]:
    """A past run's settings: its top-level user values."""
    return {r["name"]: r["value"] for r in records if r["ctx"] is None and r["type"] == USER}
