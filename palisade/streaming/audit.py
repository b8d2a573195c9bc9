"""Streams: the audit of each document's latest text, session state, append-only logs, windowed counts.

A document's text is replaced as a whole by each event, so the state of a key is the newest version alone, and the output
mode is update: the last writer wins, and writing the same text again changes nothing. Streams and tables are scanned by
one engine, `findings.scan_files`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palisade.operators.findings import LineRule, scan_files
from palisade.sources.files import described

KEPT_FILES, RESCANNED = 200, 50
EVENT = "uri string, kind string, version long, text string"
NEWEST = "uri string, version long, state string, text string"


def newest(events: DataFrame) -> DataFrame:
    """(uri, version, state, text): each document's newest event so far; a closed one has no text.

    An event that isn't newer than the state is ignored, so replays are harmless. A close keeps the document's version,
    one number a key, so an older event never brings the document back.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        best = None
        for rows in batches:
            rows = rows if last is None else rows[rows["version"] > last]
            if len(rows):
                best, last = rows.loc[rows["version"].idxmax()], int(rows["version"].max())
        if best is None:
            return
        state.update((last,))
        closed = best["kind"] == "close"
        yield pd.DataFrame({"uri": [key[0]], "version": [last], "state": ["closed" if closed else "open"], "text": [None if closed else best["text"]]})

    known = events.where("version IS NOT NULL")
    return known.groupBy("uri").applyInPandasWithState(update, NEWEST, "version long", "update", GroupStateTimeout.NoTimeout)


def audit_documents(events: DataFrame, rules: list[LineRule]) -> DataFrame:
    """Per document the findings of its newest text. events: uri, kind (open, change, save, close), version, text.

    (uri, version, state, findings): findings as `scan_files` makes them, with languages, kinds and caps, by uri.
    """
    files = described(newest(events).withColumn("path", F.col("uri")).withColumn("size", F.octet_length("text").cast("long")))
    return scan_files(files, rules).select("uri", "version", "state", "findings")


def session_files(events: DataFrame, kept: int = KEPT_FILES, rescanned: int = RESCANNED) -> DataFrame:
    """Per session the files to scan. events: session, seq, kind (edit, stop, start), path.

    An edit asks for its file; a stop asks for the last `rescanned` distinct files of the session and ends it. The list
    that is kept has at most `kept` files, which bounds the state.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        files = list(state.get[0]) if state.exists else []
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            if row.kind == "start":
                files = []
            elif row.kind == "edit":
                files = [f for f in files if f != row.path] + [row.path]
                files = files[-kept:]
                out.append((key[0], row.seq, "edit", [row.path]))
            elif row.kind == "stop":
                out.append((key[0], row.seq, "stop", files[-rescanned:]))
                files = []
        if files:
            state.update((files,))
        elif state.exists:
            state.remove()  # a session that ended keeps nothing
        yield pd.DataFrame(out, columns=["session", "seq", "kind", "files"])

    return events.groupBy("session").applyInPandasWithState(
        update, "session string, seq long, kind string, files array<string>", "files array<string>", "append", GroupStateTimeout.NoTimeout
    )


def line_findings(documents: DataFrame, rules: list[LineRule]) -> DataFrame:
    """Stateless: findings of each arriving row (path, text); works on streams and tables alike."""
    files = described(documents.select("path", "text", F.octet_length("text").cast("long").alias("size")))
    return scan_files(files, rules).select("path", F.inline("findings"))


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are left out, which bounds the state."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n")).select("window.start", by, "n")


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """An append-only JSON log; the checkpoint makes it exactly once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
