"""Append-only logs and series: folds to the current state, hash chains, trends, trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def approvals(log: DataFrame) -> DataFrame:
    """The last state of each id of a log (id, seq, kind in approve, revoke, forget, target, expires).

    A forgotten id has no state; a revocation stays until a later approval. One pass: max_by over partial aggregates.
    """
    return (
        log.groupBy("id")
        .agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"), F.max(F.when(F.col("kind") == "approve", F.struct("seq", "target", "expires"))).alias("a"))
        .where((F.col("kind") != "forget") & F.col("a").isNotNull())
        .select("id", "seq", F.when(F.col("kind") == "revoke", "revoked").otherwise("active").alias("state"), "a.target", "a.expires")
    )


def approval_status(state: DataFrame, findings: DataFrame, scanned: DataFrame, as_of: str) -> DataFrame:
    """(id, target, status): revoked, invalid (expired), valid, resolved (scanned, gone) or unobserved (not scanned)."""
    f = findings.select(F.col("finding_id").alias("target"), F.lit(True).alias("found")).distinct()
    s = scanned.select("target", F.lit(True).alias("seen")).distinct()
    day = F.lit(as_of).cast("date")
    status = (
        F.when(F.col("state") == "revoked", "revoked").when(F.col("expires") < day, "invalid").when(F.col("found"), "valid")
        .when(F.col("seen"), "resolved").otherwise("unobserved")
    )
    return state.join(f, "target", "left").join(s, "target", "left").select("id", "target", status.alias("status"))


def experience(log: DataFrame, versions: DataFrame) -> DataFrame:
    """(id, rule_id, state): active, superseded, invalid or stale (its rule has another version now)."""
    last = log.groupBy("id").agg(F.max_by("kind", "seq").alias("kind"), F.max(F.when(F.col("kind") == "add", F.struct("seq", "rule_id", "rule_version"))).alias("e")).where("e IS NOT NULL")
    now = versions.select("rule_id", F.col("version").alias("now"))
    state = F.when(F.col("kind") == "supersede", "superseded").when(F.col("kind") == "invalidate", "invalid").when(F.col("e.rule_version") != F.col("now"), "stale").otherwise("active")
    return last.select("*", F.col("e.rule_id").alias("rule_id")).join(now, "rule_id", "left").select("id", "rule_id", state.alias("state"))


def entry_hash(previous: Column, *fields: str) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)), 256)


def chain_problems(log: DataFrame, by: str, fields: tuple) -> DataFrame:
    """(by, seq, problem) of a log (by, seq, prev, hash, fields): gap, broken link, changed content. by: independent chains."""
    order = Window.partitionBy(by).orderBy("seq")
    checked = log.withColumns({"nth": F.row_number().over(order), "last": F.lag("hash").over(order)})
    problem = (
        F.when(F.col("seq") != F.col("nth"), "gap").when(~F.col("prev").eqNullSafe(F.col("last")), "broken_link")
        .when(F.col("hash") != entry_hash(F.col("prev"), *fields), "changed")
    )
    return checked.select(by, "seq", problem.alias("problem")).where("problem IS NOT NULL")


def chained(log: DataFrame, by: str, fields: tuple) -> DataFrame:
    """The log with hash = H(previous content | own content) and prev; the link is over contents, so it needs no loop."""
    order = Window.partitionBy(by).orderBy("seq")
    own = log.withColumn("hash", F.sha2(F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in (by, "seq", *fields))), 256))
    return own.withColumn("prev", F.lag("hash").over(order))


def link_problems(log: DataFrame, by: str, fields: tuple) -> DataFrame:
    """As chain_problems, for logs of `chained`."""
    order = Window.partitionBy(by).orderBy("seq")
    content = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in (by, "seq", *fields))), 256)
    checked = log.withColumns({"nth": F.row_number().over(order), "last": F.lag("hash").over(order), "content": content})
    problem = F.when(F.col("seq") != F.col("nth"), "gap").when(~F.col("prev").eqNullSafe(F.col("last")), "broken_link").when(F.col("hash") != F.col("content"), "changed")
    return checked.select(by, "seq", problem.alias("problem")).where("problem IS NOT NULL")


def trend(series: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, first, previous, latest, change): change is latest - first."""
    order = Window.partitionBy(key).orderBy(at)
    marked = series.withColumns({"previous": F.lag(value).over(order), "first": F.first(value).over(order)})
    last = marked.groupBy(key).agg(F.max_by(F.struct("first", "previous", F.col(value).alias("latest")), at).alias("t"))
    return last.select(key, "t.first", "t.previous", "t.latest", (F.col("t.latest") - F.col("t.first")).alias("change"))


def keep_latest(series: DataFrame, key: str, at: str) -> DataFrame:
    """Upsert: the last row of each key."""
    n = Window.partitionBy(key).orderBy(F.col(at).desc())
    return series.withColumn("__n", F.row_number().over(n)).where("__n = 1").drop("__n")


def pilot(reviews: DataFrame, arm: str, minutes: str, risk: Column, setup: float = 0.0) -> DataFrame:
    """Per arm: n, median and upper quartile (linear interpolation), share of risky reviews, minutes with setup shared."""
    return reviews.groupBy(arm).agg(
        F.count("*").alias("n"),
        F.percentile(minutes, F.lit(0.5)).alias("median"),
        F.percentile(minutes, F.lit(0.75)).alias("p75"),
        (F.count_if(risk) / F.count("*")).alias("risk_rate"),
        (F.avg(minutes) + setup / F.count("*")).alias("with_setup"),
    )


def blocks(reviews: DataFrame, team: tuple, order: tuple, seed: int) -> DataFrame:
    """Block randomisation: pairs within a team get one row in each arm, which first by a hash of seed, team and block."""
    nth = F.row_number().over(Window.partitionBy(*team).orderBy(*order)) - 1
    flip = F.pmod(F.crc32(F.concat_ws("|", F.lit(seed).cast("string"), *(F.col(t).cast("string") for t in team), F.col("block").cast("string"))), F.lit(2))
    out = reviews.withColumn("nth", nth).withColumn("block", F.floor(F.col("nth") / 2))
    return out.withColumn("arm", F.when((F.col("nth") % 2 + flip) % 2 == 0, "control").otherwise("treatment")).drop("nth")


def open_risks(events: DataFrame, key: tuple, opens: Column, closes: Column) -> DataFrame:
    """Keys with more openings than closings."""
    return events.groupBy(*key).agg(F.count_if(opens).alias("opened"), F.count_if(closes).alias("closed")).where("opened > closed")


def cost_regression(runs: DataFrame, by: str, at: str, cost: str, ratio: float, least: float) -> DataFrame:
    """Runs that cost `ratio` times the run before them or more, where that one cost at least `least`."""
    before = F.lag(cost).over(Window.partitionBy(by).orderBy(at))
    return runs.withColumn("before", before).where((F.col("before") >= least) & (F.col(cost) >= ratio * F.col("before")))
