"""Queries over events: logs, series, trials, gates, as-of joins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from palisade.functions.scalars import ratio
from palisade.operators import governance, logs, matching, shapes, summaries
from palisade.plans.registry import query

_KIND = "CASE event_type WHEN 'error' THEN 'revoke' WHEN 'purchase' THEN 'forget' ELSE 'approve' END"


def _log(tables):
    kind = F.when(F.col("event_type") == "error", "revoke").when(F.col("event_type") == "purchase", "forget").otherwise("approve")
    return tables("events").select(
        (F.col("event_id") % 500).alias("id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("user_id").alias("target"), F.date_add(F.to_date("ts"), 20).alias("expires")
    )


_STATE = f"""log AS (SELECT event_id % 500 AS id, event_id AS seq, {_KIND} AS kind, user_id AS target, CAST(CAST(ts AS DATE) + 20 AS DATE) AS expires FROM events),
st AS (SELECT id, arg_max(kind, seq) AS kind, max(seq) AS seq, arg_max(target, seq) FILTER (WHERE kind = 'approve') AS target, arg_max(expires, seq) FILTER (WHERE kind = 'approve') AS expires,
  count(*) FILTER (WHERE kind = 'approve') AS n FROM log GROUP BY id),
state AS (SELECT id, seq, CASE WHEN kind = 'revoke' THEN 'revoked' ELSE 'active' END AS state, target, expires FROM st WHERE kind <> 'forget' AND n > 0)"""


@query(f"WITH {_STATE} SELECT * FROM state")
def approval_log_fold(spark, tables):
    """Current state of an append-only log of approvals, revocations and removals."""
    return logs.approvals(_log(tables))


@query(
    f"""WITH {_STATE} SELECT id, target, CASE WHEN state = 'revoked' THEN 'revoked' WHEN expires < DATE '2024-02-10' THEN 'invalid'
  WHEN target % 3 = 0 THEN 'valid' WHEN target % 3 = 1 THEN 'resolved' ELSE 'unobserved' END AS status FROM state"""
)
def approval_status(spark, tables):
    users = tables("events").select(F.col("user_id")).distinct()
    found = users.where("user_id % 3 = 0").select(F.col("user_id").alias("finding_id"))
    scanned = users.where("user_id % 3 < 2").select(F.col("user_id").alias("target"))
    return logs.approval_status(logs.approvals(_log(tables)), found, scanned, "2024-02-10")


@query(
    """WITH l AS (SELECT event_id % 200 AS id, event_id AS seq, CASE event_type WHEN 'error' THEN 'invalidate' WHEN 'purchase' THEN 'supersede' ELSE 'add' END AS kind, user_id % 20 AS rule_id, user_id % 3 AS v FROM events),
s AS (SELECT id, arg_max(kind, seq) AS kind, arg_max(rule_id, seq) FILTER (WHERE kind = 'add') AS rule_id, arg_max(v, seq) FILTER (WHERE kind = 'add') AS v, count(*) FILTER (WHERE kind = 'add') AS n FROM l GROUP BY id)
SELECT id, rule_id, CASE WHEN kind = 'supersede' THEN 'superseded' WHEN kind = 'invalidate' THEN 'invalid' WHEN v <> 1 THEN 'stale' ELSE 'active' END AS state FROM s WHERE n > 0"""
)
def experience_fold(spark, tables):
    kind = F.when(F.col("event_type") == "error", "invalidate").when(F.col("event_type") == "purchase", "supersede").otherwise("add")
    log = tables("events").select((F.col("event_id") % 200).alias("id"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("user_id") % 20).alias("rule_id"), (F.col("user_id") % 3).alias("rule_version"))
    versions = log.select("rule_id").distinct().withColumn("version", F.lit(1))
    return logs.experience(log, versions)


_CHAIN = """own AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_type, value, event_id FROM events),
h AS (SELECT *, sha256(concat_ws('|', CAST(user_id AS VARCHAR), CAST(seq AS VARCHAR), event_type)) AS hash FROM own),
c AS (SELECT *, lag(hash) OVER (PARTITION BY user_id ORDER BY seq) AS prev FROM h),
bad AS (SELECT user_id, seq, CASE WHEN event_id % 97 = 0 THEN 'tampered' ELSE event_type END AS event_type, hash, CASE WHEN event_id % 101 = 0 THEN 'x' ELSE prev END AS prev FROM c)"""


@query(
    f"""WITH {_CHAIN}, k AS (SELECT *, lag(hash) OVER (PARTITION BY user_id ORDER BY seq) AS last, sha256(concat_ws('|', CAST(user_id AS VARCHAR), CAST(seq AS VARCHAR), event_type)) AS content FROM bad),
p AS (SELECT user_id, seq, CASE WHEN prev IS DISTINCT FROM last THEN 'broken_link' WHEN hash <> content THEN 'changed' END AS problem FROM k)
SELECT user_id, CAST(seq AS INTEGER) AS seq, problem FROM p WHERE problem IS NOT NULL"""
)
def hash_chain_check(spark, tables):
    """Chains of each user with some links and contents tampered with; all of them must be found."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    own = tables("events").select("user_id", F.row_number().over(order).alias("seq"), "event_type", "event_id")
    chain = logs.chained(own, "user_id", ("event_type",))
    bad = chain.withColumn("event_type", F.when(F.col("event_id") % 97 == 0, "tampered").otherwise(F.col("event_type"))).withColumn("prev", F.when(F.col("event_id") % 101 == 0, "x").otherwise(F.col("prev")))
    return logs.link_problems(bad, "user_id", ("event_type",))


@query(
    """SELECT user_id % 2 AS arm, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75,
  round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS risk_rate, round(avg(value) + 120.0 / count(*), 6) AS with_setup FROM events GROUP BY 1"""
)
def pilot_summary(spark, tables):
    """A trial of two arms: size, median and upper quartile, share of risks, cost with the setup shared."""
    out = logs.pilot(tables("events").withColumn("arm", F.col("user_id") % 2), "arm", "value", F.col("event_type") == "error", 120.0)
    return out.select("arm", "n", *(F.round(c, 6).alias(c) for c in ("median", "p75", "risk_rate", "with_setup")))


@query(
    """SELECT event_type, count(*) FILTER (WHERE user_id % 3 = 0) AS accepted, count(*) FILTER (WHERE user_id % 3 = 1) AS false_positive, count(*) FILTER (WHERE user_id % 3 = 2) AS deferred,
  round(avg(value), 6) AS mean_minutes FROM events GROUP BY event_type"""
)
def feedback_summary(spark, tables):
    part = lambda k: F.count_if(F.col("user_id") % 3 == k)
    return tables("events").groupBy("event_type").agg(part(0).alias("accepted"), part(1).alias("false_positive"), part(2).alias("deferred"), F.round(F.avg("value"), 6).alias("mean_minutes"))


_DAILY = "d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)"


@query(
    f"""WITH {_DAILY}, m AS (SELECT *, first_value(n) OVER (PARTITION BY event_type ORDER BY day) AS first, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS previous FROM d)
SELECT event_type, arg_max(first, day) AS first, arg_max(previous, day) AS previous, arg_max(n, day) AS latest, arg_max(n, day) - arg_max(first, day) AS change FROM m GROUP BY event_type"""
)
def habit_trend(spark, tables):
    daily = tables("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return logs.trend(daily, "event_type", "day", "n")


@query(
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS in_scope, count(*) FILTER (WHERE event_type = 'error') AS gaps,
  CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0 THEN round(count(*) FILTER (WHERE event_type = 'error') / count(*) FILTER (WHERE event_type = 'view'), 6) END AS gap_rate,
  CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0 THEN round(count(*) FILTER (WHERE event_type = 'error') / count(*) FILTER (WHERE event_type = 'view'), 6) <= 0.25 END AS passed
FROM events GROUP BY user_id"""
)
def gate_check(spark, tables):
    """A rate is null, and a gate neither passed nor failed, when there is nothing in scope."""
    n = tables("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("in_scope"), F.count_if(F.col("event_type") == "error").alias("gaps"))
    return governance.gate(n.withColumn("gap_rate", F.round(ratio(F.col("gaps"), F.col("in_scope")), 6)), "gap_rate", 0.25)


@query(
    """WITH p AS (SELECT event_type AS family, CASE WHEN user_id % 5 = 0 THEN 'unresolved' WHEN user_id % 5 = 1 THEN 'unsupported' ELSE 'evidence_met' END AS state, user_id % 2 = 0 AS in_scope FROM events),
n AS (SELECT family, count(*) AS total, count(*) FILTER (WHERE in_scope) AS in_scope, count(*) FILTER (WHERE in_scope AND state IN ('unresolved', 'unsupported', 'budget_exceeded')) AS gaps FROM p GROUP BY family)
SELECT *, CASE WHEN in_scope > 0 THEN round(gaps / in_scope, 6) END AS gap_rate, CASE WHEN in_scope = 0 THEN 'not_applicable' WHEN gaps = 0 THEN 'met' ELSE 'unmet' END AS status FROM n"""
)
def coverage_ledger(spark, tables):
    state = F.when(F.col("user_id") % 5 == 0, "unresolved").when(F.col("user_id") % 5 == 1, "unsupported").otherwise("evidence_met")
    points = tables("events").select(F.col("event_type").alias("family"), state.alias("state"), (F.col("user_id") % 2 == 0).alias("in_scope"))
    return governance.ledger(points).withColumn("gap_rate", F.round("gap_rate", 6))


@query(
    """SELECT e.user_id, e.ts, s.event_type AS state FROM events e ASOF LEFT JOIN (SELECT user_id, ts, event_type FROM events WHERE event_type IN ('click', 'view')) s
  ON e.user_id = s.user_id AND s.ts < e.ts WHERE e.event_type = 'error'"""
)
def setting_before_use(spark, tables):
    """As-of join: what the user did last before each error."""
    e = tables("events")
    return matching.last_before(e.where("event_type = 'error'"), e.where("event_type IN ('click', 'view')"), ("user_id",), "ts", "event_type")


@query(
    """SELECT e.user_id, e.ts, min(u.ts) AS next_at FROM events e LEFT JOIN events u ON u.user_id = e.user_id AND u.event_type = 'view' AND u.ts > e.ts WHERE e.event_type = 'error' GROUP BY e.user_id, e.ts"""
)
def first_use_after(spark, tables):
    """The first view after each error of the same user."""
    e = tables("events")
    return matching.first_after(e.where("event_type = 'error'"), e.where("event_type = 'view'"), ("user_id",), "ts")


@query("SELECT user_id, map_from_entries(list_sort(list((event_type, n)))) AS states FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def state_histogram(spark, tables):
    return governance.by_state(tables("events"), ("user_id",), "event_type")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS opened, count(*) FILTER (WHERE event_type = 'purchase') AS closed FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'error') > count(*) FILTER (WHERE event_type = 'purchase')")
def open_risks(spark, tables):
    return logs.open_risks(tables("events"), ("user_id",), F.col("event_type") == "error", F.col("event_type") == "purchase")


@query(
    """WITH r AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, event_id, value, before FROM r WHERE before >= 5 AND value >= 3.0 * before"""
)
def cost_regression(spark, tables):
    return logs.cost_regression(tables("events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 3.0, 5.0)


@query(
    """WITH c AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events)
SELECT user_id, sum(CASE WHEN last IS NULL OR epoch_us(ts) - epoch_us(last) > 21600000000 THEN 1 ELSE 0 END)::BIGINT AS sessions FROM c GROUP BY user_id"""
)
def sessions(spark, tables):
    """Sessions that close after six hours without an event."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))
    marked = tables("events").select("user_id", F.coalesce((gap > 21_600_000_000).cast("long"), F.lit(1)).alias("opens"))
    return marked.groupBy("user_id").agg(F.sum("opens").alias("sessions"))


@query(
    """WITH a AS (SELECT user_id, event_type, count(*) AS was FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS now FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL)
SELECT user_id, event_type, coalesce(was, 0) AS was, coalesce(now, 0) AS now, CASE WHEN coalesce(now, 0) > coalesce(was, 0) THEN 'new' ELSE 'resolved' END AS change FROM a FULL JOIN b USING (user_id, event_type) WHERE coalesce(was, 0) <> coalesce(now, 0)"""
)
def snapshot_changes(spark, tables):
    e = tables("events")
    half = F.lit("2024-01-16").cast("timestamp")
    return matching.multiset_changes(e.where(F.col("ts") < half), e.where(F.col("ts") >= half), ("user_id", "event_type"))


@query(
    """WITH l AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT k, count(*) AS n, count(DISTINCT user_id) AS users FROM l GROUP BY k HAVING count(*) >= 3 ORDER BY n DESC, k LIMIT 10"""
)
def key_scatter(spark, tables):
    """Attribute keys read from JSON that are repeated, the ten most frequent."""
    k = tables("events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return k.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).where("n >= 3").orderBy(F.col("n").desc(), "k").limit(10)


@query(
    """WITH d AS (SELECT event_id, event_type, user_id, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, 'event.kind' AS code, '$.kind' AS place, 'value' AS problem FROM d WHERE event_type NOT IN ('click', 'view', 'purchase')
UNION ALL SELECT event_id, 'event.user', '$.user', 'missing' FROM d WHERE user_id % 10 = 0
UNION ALL SELECT event_id, 'event.value', '$.value', 'range' FROM d WHERE value > 40
UNION ALL SELECT event_id, 'props.k', '$.props[' || i || '].k', 'range' FROM d, (VALUES (0), (1)) t(i) WHERE k + i > 90
UNION ALL SELECT event_id, 'props.unit', '$.props[0].unit', 'missing' FROM d
UNION ALL SELECT event_id, 'props.unit', '$.props[1].unit', 'type' FROM d WHERE k % 5 = 0
UNION ALL SELECT event_id, 'document', '$', 'unreadable' FROM d WHERE k = 13"""
    .replace("FROM d WHERE", "FROM d WHERE k <> 13 AND").replace("FROM d\n", "FROM d WHERE k <> 13\n").replace("t(i) WHERE", "t(i) WHERE k <> 13 AND").replace("k <> 13 AND k = 13", "k = 13")
)
def event_shapes(spark, tables):
    """Events as nested documents, made from their columns and props, against a table of expectations."""
    k = F.get_json_object("props", "$.k").cast("int")
    unit = F.when(k % 5 == 0, F.lit(7).cast("string")).otherwise(F.lit('"u"'))
    user = F.when(F.col("user_id") % 10 == 0, "").otherwise(F.concat(F.lit('"user":'), "user_id", F.lit(",")))
    text = F.concat(
        F.lit('{"kind":"'), "event_type", F.lit('",'), user, F.lit('"value":'), F.col("value").cast("string"), F.lit(',"props":['), "props", F.lit(',{"k":'), (k + 1).cast("string"),
        F.lit(',"unit":'), unit, F.lit("}]}"),
    )
    docs = tables("events").select("event_id", F.when(k == 13, F.lit("{broken")).otherwise(text).alias("text"))
    wanted = [
        shapes.expect("$", "object", "event"), shapes.expect("$.kind", "string", "event.kind", True, ("click", "view", "purchase")), shapes.expect("$.user", "integer", "event.user", True),
        shapes.expect("$.value", "number", "event.value", True, (), 0, 40), shapes.expect("$.props", "array", "props", True), shapes.expect("$.props[*].k", "integer", "props.k", True, (), 0, 90),
        shapes.expect("$.props[*].unit", "string", "props.unit", True),
    ]
    return shapes.problems(shapes.flatten(docs, "event_id", "text"), shapes.spec(spark, wanted)).withColumnRenamed("id", "event_id")


_INDICATORS = (
    summaries.Indicator("median", "value", 34.0, 38.0, 0.5), summaries.Indicator("tail", "value", 108.0, 125.0, 0.9), summaries.Indicator("users", "user_id", 100, 135),
)


@query(
    """WITH s AS (SELECT event_type, ts::DATE AS day, value, user_id FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL),
d AS (SELECT DISTINCT event_type, day FROM s),
w AS (SELECT d.event_type, d.day, count(value) AS n, avg((value <= 34)::INT) AS m1, avg((value <= 38)::INT) AS m2, avg((value <= 108)::INT) AS t1, avg((value <= 125)::INT) AS t2, count(DISTINCT user_id) AS u
FROM d JOIN s ON s.event_type = d.event_type AND s.day BETWEEN d.day - 6 AND d.day GROUP BY ALL),
i AS (SELECT event_type, day, CASE WHEN n = 0 THEN 'unknown' WHEN m2 < 0.5 THEN 'bad' WHEN m1 < 0.5 THEN 'warn' ELSE 'ok' END AS median,
CASE WHEN n = 0 THEN 'unknown' WHEN t2 < 0.9 THEN 'bad' WHEN t1 < 0.9 THEN 'warn' ELSE 'ok' END AS tail,
CASE WHEN u = 0 THEN 'unknown' WHEN u > 135 THEN 'bad' WHEN u > 100 THEN 'warn' ELSE 'ok' END AS users FROM w),
l AS (SELECT *, [median, tail, users] AS all_ FROM i),
b AS (SELECT event_type, day, median, tail, users, CASE WHEN len(list_filter(all_, lambda x: x <> 'unknown')) = 0 THEN 'unknown' WHEN len(list_filter(all_, lambda x: x = 'bad')) >= 2 THEN 'bad'
WHEN len(list_filter(all_, lambda x: x = 'bad')) > 0 OR len(list_filter(all_, lambda x: x = 'warn')) >= 2 THEN 'warn' ELSE 'ok' END AS band FROM l),
r AS (SELECT *, CASE band WHEN 'ok' THEN 0 WHEN 'warn' THEN 1 WHEN 'bad' THEN 2 END AS k FROM b),
p AS (SELECT *, lag(k) OVER (PARTITION BY event_type ORDER BY day) AS k0 FROM r)
SELECT event_type, day, median, tail, users, band, CASE WHEN k > k0 THEN 'worse' WHEN k < k0 THEN 'better' WHEN k = k0 THEN 'same' END AS change FROM p"""
)
def series_bands(spark, tables):
    """Bands of each event type's last seven days, day by day, from merged sketches."""
    rows = tables("events").select("event_type", F.to_date("ts").alias("day"), "value", "user_id")
    found = summaries.states(rows, ["event_type"], "day", _INDICATORS, 7)
    each = found.groupBy("event_type", "day").agg(*(F.max(F.when(F.col("indicator") == i.name, F.col("state"))).alias(i.name) for i in _INDICATORS))
    return each.join(summaries.bands(found, ["event_type"], "day"), ["event_type", "day"])
