"""Sessions and documents whose state ends by itself: map and value state with timers of event time.

A session ends by a stop, by a start or by being idle. It doesn't matter whether the idle gap shows by the session's next
event or by the watermark passing it: both give one `idle` row, so batches change nothing for events that arrive in order.
Events older than the watermark are left out by the engine, which is what makes it safe to forget: once the timer of a
key has fired, no event that its state would have turned away can still arrive.

The state store has to be RocksDB's; `with_timers` sets it for streams that start within. A key's rows of one batch are ordered in memory; the size of
a batch is the source's to bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palisade.sources.package import ship
from palisade.streaming.audit import KEPT_FILES, NEWEST, RESCANNED

SESSION = "session string, seq long, kind string, files array<string>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_timers(spark: SparkSession) -> Iterator[SparkSession]:
    """The session, set to the state store that timers need until the block ends; a stream keeps the one it started with."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    try:
        yield spark
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Session(StatefulProcessor):
    """files: path -> (ms, seq) of its last edit. marks: the last boundary, the last event and the timer that is set."""

    def __init__(self, idle_ms: int, kept: int, rescanned: int):
        self.idle_ms, self.kept, self.rescanned = idle_ms, kept, rescanned

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "path string", "ms long, seq long")
        self.marks = handle.getValueState("marks", "boundary_ms long, boundary_seq long, last_ms long, last_seq long, timer long")

    def _latest(self, files: dict) -> list[str]:
        return [path for path, _ in sorted(files.items(), key=lambda f: (f[1], f[0]))][-self.rescanned :]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = {path: (ms, seq) for (path,), (ms, seq) in self.files.iterator()}
        files = dict(stored)
        none = (-(2**62), -(2**62))
        b_ms, b_seq, l_ms, l_seq, timer = self.marks.get() if self.marks.exists() else (*none, *none, None)
        boundary, last = (b_ms, b_seq), (l_ms, l_seq)
        for at, kind, path in sorted(((r.ms, r.seq), r.kind, r.path or "") for r in rows):
            if at <= boundary:
                continue  # of a part that has ended
            if files and at[0] - last[0] > self.idle_ms:
                yield Row(session=key[0], seq=last[1], kind="idle", files=self._latest(files))
                files, boundary = {}, last
            if kind == "edit":
                if files.get(path, none) >= at:
                    continue  # repeated, or older than what was asked for
                files[path] = at
                if len(files) > self.kept:
                    del files[min(files, key=files.get)]
                yield Row(session=key[0], seq=at[1], kind="edit", files=[path])
            elif kind in ("start", "stop"):
                if kind == "stop":
                    yield Row(session=key[0], seq=at[1], kind="stop", files=self._latest(files))
                files, boundary = {}, at
            else:
                continue
            last = max(last, at)
        if last == none:
            return
        for path in stored.keys() - files.keys():
            self.files.removeKey((path,))
        for path, at in files.items():
            if stored.get(path) != at:
                self.files.updateValue((path,), at)
        due = last[0] + self.idle_ms
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.marks.update((*boundary, *last, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        files = {path: (ms, seq) for (path,), (ms, seq) in self.files.iterator()}
        if files:
            yield Row(session=key[0], seq=self.marks.get()[3], kind="idle", files=self._latest(files))
        self.files.clear()
        self.marks.clear()

    def close(self) -> None:
        pass


def sessions(events: DataFrame, idle: int, late: str = "10 minutes", kept: int = KEPT_FILES, rescanned: int = RESCANNED) -> DataFrame:
    """(session, seq, kind, files): what to scan. events: session, seq, at (timestamp), kind (start, edit, stop), path.

    An `edit` row asks for its file; `stop` and `idle` rows end the session with its last `rescanned` files by their last
    edits, and a start ends it without a row. Events are ordered by time, then seq. idle: seconds without an event after
    which a session ends; its state is removed once the watermark, `late` behind the newest event, has passed that.
    Repeated events give nothing, nor do those older than the session's last end. Rows without session, seq or at are
    left out; a null path is the empty one; unknown kinds are no events.
    """
    ship(events.sparkSession)
    known = events.where("session IS NOT NULL AND seq IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    rows = known.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), "at", F.unix_millis("at").alias("ms"), "kind", "path")
    return rows.groupBy("session").transformWithState(Session(idle * 1000, kept, rescanned), SESSION, "append", "EventTime")


class Newest(StatefulProcessor):
    """version: the newest so far and, for a closed document, the timer after which it is forgotten."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.version = handle, handle.getValueState("version", "version long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, timer = self.version.get() if self.version.exists() else (None, None)
        best = None
        for row in rows:
            if (last is None or row.version > last) and (best is None or row.version > best.version):
                best = row
        if best is None:
            return
        closed = best.kind == "close"
        if timer is not None:
            self.handle.deleteTimer(timer)
        due = best.ms + self.forget_ms if closed else None
        if closed:
            self.handle.registerTimer(due)
        self.version.update((best.version, due))
        yield Row(uri=key[0], version=best.version, state="closed" if closed else "open", text=None if closed else best.text)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.version.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest(events: DataFrame, forget: int, late: str = "10 minutes") -> DataFrame:
    """As `audit.newest`, of events with a time: uri, kind, version, at (timestamp), text.

    A closed document's version is forgotten `forget` seconds of event time after its close, as soon as the watermark
    has passed that: older events are then late and turned away by the engine, and the state of closed documents is gone.
    """
    ship(events.sparkSession)
    known = events.where("uri IS NOT NULL AND version IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    rows = known.select("uri", F.col("version").cast("long").alias("version"), "at", F.unix_millis("at").alias("ms"), "kind", "text")
    return rows.groupBy("uri").transformWithState(Newest(forget * 1000), NEWEST, "update", "EventTime")
