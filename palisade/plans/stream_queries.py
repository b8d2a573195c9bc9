"""Queries that write and read what they wrote: streams run to their end, reports, logs that grow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from palisade.operators.scratch import shared_folder
from palisade.plans.registry import query
from palisade.sources import reports
from palisade.streaming import sessions

IDLE, LATE = 12 * 3600, 3600


def drained(stream: DataFrame) -> DataFrame:
    """All rows of an append stream; a lost executor's tasks are run again, and a file counts once its batch is done."""
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


@query(
    f"""WITH e AS (SELECT user_id::VARCHAR AS session, event_id AS seq, epoch_ms(ts) AS ms, 'p' || event_id % 7 AS path,
CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'stop' ELSE 'edit' END AS kind FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL),
m AS (SELECT *, lag(kind) OVER w AS kind0, lag(ms) OVER w AS ms0, lead(ms) OVER w AS ms1 FROM e WINDOW w AS (PARTITION BY session ORDER BY ms, seq)),
s AS (SELECT *, count(*) FILTER (WHERE kind0 <> 'edit' OR ms - ms0 > {IDLE * 1000}) OVER (PARTITION BY session ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS part FROM m),
f AS (SELECT session, part, path, max((ms, seq)) AS edited FROM s WHERE kind = 'edit' GROUP BY ALL),
g AS (SELECT session, part, list(path ORDER BY edited) AS files FROM f GROUP BY ALL),
l AS (SELECT session, part, arg_max(kind, (ms, seq)) AS kind, arg_max(seq, (ms, seq)) AS seq, arg_max((ms1), (ms, seq)) AS ms1, max(ms) AS ms,
bool_or(ms1 IS NULL) AS ends FROM s GROUP BY ALL)
SELECT session, seq, kind, [path] AS files FROM s WHERE kind = 'edit'
UNION ALL SELECT session, seq, 'stop', coalesce(files, []) FROM l LEFT JOIN g USING (session, part) WHERE kind = 'stop'
UNION ALL SELECT session, seq, 'idle', files FROM l JOIN g USING (session, part)
WHERE kind = 'edit' AND (NOT ends OR ms + {IDLE * 1000} < (SELECT max(ms) FROM e) - {LATE * 1000})"""
)
def stream_sessions(spark, tables):
    """Sessions of users as a stream with timers: files of each edit, of each stop and of each session that went idle."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "stop").otherwise("edit")
    path = F.concat(F.lit("p"), F.col("event_id") % 7)
    events = tables("events", stream=True).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), path.alias("path"))
    with sessions.with_timers(spark):
        return drained(sessions.sessions(events, IDLE, f"{LATE} seconds"))


@query(
    """SELECT 'R' || l_linenumber AS rule_id, 'f' || lpad((l_suppkey % 1000)::VARCHAR, 3, '0') AS path, CASE l_returnflag WHEN 'A' THEN 'error' WHEN 'R' THEN 'warning' ELSE 'note' END AS level,
count(*) AS n, min(l_partkey) AS first_line, max('"' || l_linestatus || '"') AS snippet
FROM lineitem WHERE l_linenumber IN (1, 3) AND 'f' || lpad((l_suppkey % 1000)::VARCHAR, 3, '0') BETWEEN 'f003' AND 'f090' GROUP BY ALL"""
)
def report_results(spark, tables):
    """Order lines as findings, written as one report by many tasks; some rules' results on a range of paths read from it."""
    severity = F.when(F.col("l_returnflag") == "A", "HIGH").when(F.col("l_returnflag") == "R", "MEDIUM").otherwise("LOW")
    path = F.concat(F.lit("f"), F.lpad((F.col("l_suppkey") % 1000).cast("string"), 3, "0"))
    rows = tables("lineitem").select(F.concat(F.lit("R"), "l_linenumber").alias("rule_id"), severity.alias("severity"), path.alias("path"), F.col("l_partkey").alias("line"), F.concat(F.lit('"'), "l_linestatus", F.lit('"')).alias("snippet"))
    folder = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    reports.save(rows, folder)
    got = reports.load(spark, folder, rules=["R1", "R3"], first="f003", last="f090")
    return got.groupBy("rule_id", "path", "level").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.max("snippet").alias("snippet"))
