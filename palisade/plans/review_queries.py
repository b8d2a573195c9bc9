"""Queries of reviews: trust, decision times, inherited rows, growth, directives."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators import review
from palisade.plans.registry import query

_STATE = "CASE l_returnflag WHEN 'A' THEN 'evidence_met' WHEN 'R' THEN 'unresolved' ELSE 'unsupported' END"
_REASON = "CASE l_linenumber % 4 WHEN 0 THEN 'parse error' WHEN 1 THEN 'Dynamic call' WHEN 2 THEN 'import of another file' ELSE 'odd' END"


@query(
    f"""WITH p AS (SELECT l_linestatus AS family, 'c' || l_suppkey % 50 AS callee, {_STATE} AS state, lower({_REASON}) AS reason FROM lineitem),
g AS (SELECT *, CASE WHEN state = 'unsupported' THEN 'language' WHEN contains(reason, 'parse') THEN 'syntax' WHEN contains(reason, 'import') THEN 'cross_file' WHEN contains(reason, 'dynamic') THEN 'dynamic_call' ELSE 'unknown' END AS cause FROM p WHERE state <> 'evidence_met')
SELECT family, callee, state, cause, count(*) AS n FROM g GROUP BY ALL"""
)
def trust_summary(spark, tables):
    """Gaps by family, callee, state and cause."""
    state = F.expr(_STATE)
    points = tables("lineitem").select(F.col("l_linestatus").alias("family"), F.concat(F.lit("c"), F.col("l_suppkey") % 50).alias("callee"), state.alias("state"), F.expr(_REASON).alias("reason"))
    return review.trust_summary(points)


@query(
    """SELECT lang, count(*) FILTER (WHERE k = 'resolved') AS resolved, count(*) FILTER (WHERE k = 'gap') AS gap, count(*) FILTER (WHERE k = 'limit') AS "limit",
CASE WHEN count(*) FILTER (WHERE k IN ('resolved', 'gap')) > 0 THEN count(*) FILTER (WHERE k = 'gap') / count(*) FILTER (WHERE k IN ('resolved', 'gap')) END AS rate
FROM (SELECT lang, CASE WHEN text IS NULL THEN 'limit' WHEN length(text) % 3 = 0 THEN 'gap' ELSE 'resolved' END AS k FROM documents) GROUP BY lang"""
)
def gaps_by_language(spark, tables):
    """Resolved rows, gaps and limits of each language, and the rate of gaps."""
    k = F.when(F.col("text").isNull(), "limit").when(F.length("text") % 3 == 0, "gap").otherwise("resolved")
    return review.counts_by(tables("documents").select("lang", k.alias("k")), "lang", "k", ("resolved", "gap", "limit"), "gap", ("resolved", "gap"))


@query(
    """WITH o AS (SELECT user_id, event_id % 3 AS team, min(ts) AS t0 FROM events WHERE event_type = 'click' GROUP BY ALL),
d AS (SELECT o.user_id, team, t0, min(ts) AS t1 FROM o JOIN events e ON e.user_id = o.user_id AND e.event_type = 'purchase' AND e.ts >= t0 GROUP BY ALL)
SELECT team, count(*) AS decisions, round(avg((epoch_us(t1) - epoch_us(t0)) / 60e6), 4) AS mean_minutes, round(quantile_cont((epoch_us(t1) - epoch_us(t0)) / 60e6, 0.5), 4) AS median_minutes FROM d GROUP BY team"""
)
def decision_times(spark, tables):
    """Minutes from the first opening to the first decision after it."""
    log = tables("events").select("user_id", "ts", "event_type", (F.col("event_id") % 3).alias("team"))
    out = review.decision_times(log, "user_id", "ts", "event_type", "click", "purchase", "team")
    return out.withColumns({c: F.round(c, 4) for c in ("mean_minutes", "median_minutes")})


@query(
    """WITH l AS (SELECT o_orderkey AS old_id, o_custkey AS path, o_orderpriority AS rule FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT o_orderkey AS new_id, o_custkey AS path, o_orderpriority AS rule FROM orders WHERE o_orderstatus = 'O'),
a AS (SELECT rule, path, min(old_id) AS old_id FROM l GROUP BY ALL HAVING count(*) = 1), b AS (SELECT rule, path, min(new_id) AS new_id FROM r GROUP BY ALL HAVING count(*) = 1), p AS (SELECT old_id, new_id FROM a JOIN b USING (rule, path))
SELECT l.old_id, p.new_id, CASE WHEN p.new_id IS NOT NULL THEN 'inherited' WHEN l.path IN (SELECT path FROM r) THEN 'needs_review' ELSE 'resolved' END AS status FROM l LEFT JOIN p USING (old_id)"""
)
def inherited_rows(spark, tables):
    """Rows that are each other's only counterpart inherit; the rest needs a review or is resolved."""
    side = lambda status, name: tables("orders").where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias(name), F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("rule"))
    return review.inherited(side("F", "old_id"), side("O", "new_id"), ("rule", "path"), "old_id", "new_id", ("path",))


@query(
    """WITH b AS (SELECT l_suppkey, l_linestatus, count(*) AS before FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL), a AS (SELECT l_suppkey, l_linestatus, count(*) AS after FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL)
SELECT l_suppkey, l_linestatus, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM b FULL JOIN a USING (l_suppkey, l_linestatus) WHERE coalesce(after, 0) > coalesce(before, 0)"""
)
def grown_gaps(spark, tables):
    """Groups that have more rows afterwards."""
    rows = tables("lineitem")
    return review.grown(rows.where("l_linenumber <= 2"), rows.where("l_linenumber > 2"), ("l_suppkey", "l_linestatus"))


@query("SELECT substr(o_orderpriority, 1, 1) || o_orderstatus || CAST(year(o_orderdate) AS VARCHAR) AS p, count(*) AS n, count(DISTINCT o_custkey) AS places FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 2")
def spread_patterns(spark, tables):
    """Patterns that occur in two places or more."""
    p = F.concat(F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus"), F.year("o_orderdate").cast("string"))
    return review.spread_patterns(tables("orders").select(p.alias("p"), "o_custkey"), "p", "o_custkey")
