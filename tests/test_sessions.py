"""Sessions with timers: restarts, late and repeated events, and state that is gone in the end."""

import datetime as dt
import random

import pytest

from palisade.streaming import sessions as ss

SCHEMA = "session string, seq long, at timestamp, kind string, path string"
DOCUMENT = "uri string, kind string, version long, at timestamp, text string"
DAY = dt.datetime(2024, 1, 1)
IDLE = 3600


@pytest.fixture
def timers(spark):
    with ss.with_timers(spark):
        yield spark


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def put(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, op, schema=SCHEMA):
    """One run of the query to its end; a later one goes on from the checkpoint. The last progress with state."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = op(stream).writeStream.format("json").option("path", f"{folder}/out") if op is not doc else op(stream).writeStream.foreachBatch(lambda df, i: df.write.mode("append").json(f"{folder}/out")).outputMode("update")
    q = out.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def session(stream):
    return ss.sessions(stream, IDLE, "10 minutes", kept=4, rescanned=3)


def doc(stream):
    return ss.newest(stream, 600, "10 minutes")


def got(spark, folder, schema=ss.SESSION):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in spark.read.schema(schema).json(f"{folder}/out").collect())


def expected(rows, kept=4, rescanned=3):
    """Plain walk over the distinct events of each session in order; every session ends in the end."""
    out, by = [], {}
    for s, seq, when, kind, path in sorted(set(rows), key=lambda r: (r[0], r[2], r[1])):
        by.setdefault(s, []).append((seq, when, kind, path))
    for s, events in by.items():
        files, last = [], None
        for seq, when, kind, path in events:
            if files and (when - last[1]).total_seconds() > IDLE:
                out.append((s, last[0], "idle", tuple(files[-rescanned:])))
                files = []
            if kind == "edit":
                files = ([f for f in files if f != path] + [path])[-kept:]
                out.append((s, seq, "edit", (path,)))
            else:
                if kind == "stop":
                    out.append((s, seq, "stop", tuple(files[-rescanned:])))
                files = []
            last = (seq, when)
        if files:
            out.append((s, last[0], "idle", tuple(files[-rescanned:])))
    return sorted(out)


def test_restart_gives_what_one_run_gives_and_state_ends(timers, tmp_path):
    rng = random.Random(5)
    rows = [(f"s{rng.randrange(5)}", i, at(i * 7 + rng.random()), rng.choice(["edit"] * 8 + ["stop", "start"]), f"p{rng.randrange(7)}") for i in range(300)]
    closing = ("z", 10_000, at(300 * 7 + 600), "start", None)
    parts = [rows[:80], rows[60:170], rows[170:], [closing]]  # twenty events come twice
    for part in parts[:2]:
        put(timers, tmp_path, part)
    assert run(timers, tmp_path, session)[-1] > 0
    for part in parts[2:]:
        put(timers, tmp_path, part)
    run(timers, tmp_path, session)
    assert got(timers, tmp_path) == expected([*rows, closing])
    put(timers, tmp_path, [("z", 10_001, at(300 * 7 + 1200), "start", None)])
    put(timers, tmp_path, [("z", 10_002, at(300 * 7 + 1800), "other", None)])
    assert run(timers, tmp_path, session)[-1] == 0
    assert got(timers, tmp_path) == expected([*rows, closing])


def test_late_and_repeated_events(timers, tmp_path):
    put(timers, tmp_path, [("a", 1, at(0), "edit", "p"), ("a", 1, at(0), "edit", "p"), ("a", 3, at(9), "edit", "r")])
    put(timers, tmp_path, [("a", 2, at(8), "edit", "q"), ("a", 3, at(9), "edit", "r"), (None, 4, at(9), "edit", "x"), ("a", None, at(9), "edit", "x"), ("a", 5, None, "edit", "x"), ("a", 6, at(9), "odd", "x")])
    put(timers, tmp_path, [("a", 7, at(10), "stop", None), ("a", 8, at(11), "edit", None)])
    put(timers, tmp_path, [("a", 7, at(10), "stop", None), ("a", 2, at(8), "edit", "q")])
    put(timers, tmp_path, [("b", 9, at(200), "edit", "y")])
    put(timers, tmp_path, [("a", 3, at(9), "edit", "r")])  # the session is forgotten, and this is late
    run(timers, tmp_path, session)
    want = [("a", 1, "edit", ("p",)), ("a", 2, "edit", ("q",)), ("a", 3, "edit", ("r",)), ("a", 7, "stop", ("p", "q", "r")), ("a", 8, "edit", ("",)), ("a", 8, "idle", ("",)), ("b", 9, "edit", ("y",))]
    assert got(timers, tmp_path) == want


def test_closed_documents_are_forgotten(timers, tmp_path):
    put(timers, tmp_path, [("a", "open", 1, at(0), "x"), ("b", "open", 1, at(0), "y")], DOCUMENT)
    put(timers, tmp_path, [("a", "close", 5, at(1), None), ("b", "close", 2, at(1), None)], DOCUMENT)
    put(timers, tmp_path, [("a", "change", 3, at(1), "old"), ("b", "open", 3, at(2), "new")], DOCUMENT)
    put(timers, tmp_path, [("c", "close", 1, at(60), None)], DOCUMENT)
    put(timers, tmp_path, [("a", "change", 2, at(0), "late")], DOCUMENT)
    assert run(timers, tmp_path, doc, DOCUMENT)[-1] > 0
    rows = got(timers, tmp_path, ss.NEWEST)
    assert [r[:3] for r in rows] == [("a", 1, "open"), ("a", 5, "closed"), ("b", 1, "open"), ("b", 2, "closed"), ("b", 3, "open"), ("c", 1, "closed")]
    put(timers, tmp_path, [("b", "close", 4, at(61), None)], DOCUMENT)
    put(timers, tmp_path, [("d", "close", 1, at(300), None)], DOCUMENT)
    put(timers, tmp_path, [("d", "close", 2, at(301), None)], DOCUMENT)
    counts = run(timers, tmp_path, doc, DOCUMENT)
    assert counts[-1] <= 2  # the last document's version and its timer
