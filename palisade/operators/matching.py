"""Matching of findings across scans: suppression, baselines, moves, multiset differences, containment, as-of joins.

One-to-one matching consumes each side at most once; whatever is ambiguous never inherits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.operators.graphs import _cut

DIRECTIVE = r"(?i)audit:\s*(ignore|ignore-file)\[([A-Za-z0-9_, -]+)\]\s*(.*?)(?:\s+until=([0-9]{4}-[0-9]{2}-[0-9]{2}))?\s*$"
FILE_LINES, REASON_CHARS = 30, 3


def directives(lines: DataFrame) -> DataFrame:
    """(path, line, scope, rule_id, reason, until) of ignore directives with a reason; file directives near the top only."""
    got = lines.where(F.col("text").contains("audit:") & F.col("text").rlike(DIRECTIVE))
    part = lambda i: F.regexp_extract("text", DIRECTIVE, i)
    rows = got.select("path", "line", F.lower(part(1)).alias("scope"), F.explode(F.split(part(2), r"\s*,\s*")).alias("rule_id"), F.trim(part(3)).alias("reason"), F.try_to_date(part(4)).alias("until"))
    return rows.where((F.length("reason") >= REASON_CHARS) & ((F.col("scope") == "ignore") | (F.col("line") <= FILE_LINES))).withColumn("rule_id", F.trim("rule_id"))


def comment_directives(files: DataFrame) -> DataFrame:
    """`directives` of files (path, comment_text): what stands in a string is none."""
    each = files.select("path", F.posexplode(F.split("comment_text", "\n")).alias("at", "text"))
    return directives(each.select("path", (F.col("at") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text")))


def covers(finding_line: Column, scope: Column, directive_line: Column) -> Column:
    """An ignore directive covers its own line and the next one; a file directive the whole file."""
    return (scope == "ignore-file") | (directive_line == finding_line) | (directive_line == finding_line - 1)


def suppress(findings: DataFrame, found: DataFrame, as_of: str, on: tuple = ("path", "rule_id")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept findings, suppressed findings with the first matching directive, directives that cover nothing).

    as_of: the day that expiry is judged by; an expired directive covers nothing.
    """
    live = found.where(F.col("until").isNull() | (F.col("until") >= F.lit(as_of).cast("date")))
    d = live.select(*(F.col(c).alias(f"d_{c}") for c in on), F.col("line").alias("d_line"), F.col("scope").alias("d_scope"), F.col("reason").alias("d_reason"))
    match = covers(F.col("line"), F.col("d_scope"), F.col("d_line"))
    for c in on:
        match = match & (F.col(c) == F.col(f"d_{c}"))
    kept = findings.join(d, match, "left_anti")
    hit = findings.join(d, match)
    first = Window.partitionBy(*findings.columns).orderBy("d_line", "d_scope")
    suppressed = hit.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*findings.columns, "d_line", "d_reason")
    unused = d.join(findings, match, "left_anti").select(*(F.col(f"d_{c}").alias(c) for c in on), F.col("d_line").alias("line"))
    return kept, suppressed, unused


def baseline(findings: DataFrame, known: DataFrame, scanned: DataFrame, present: DataFrame) -> DataFrame:
    """Findings and baseline entries with a status, matched in phases.

    findings: finding_id, fingerprint, loose, path, rule_version. known: the same without finding_id, with entry_id.
    scanned, present: (path) of this scan and of the tree. Statuses of findings: existing (same fingerprint), review
    (same loose key and path under another rule version, both sides alone), moved (same loose key, the old path gone,
    both sides alone), new. Of entries left: resolved if their path was scanned, else unobserved.
    """
    one = lambda *cs: Window.partitionBy(*cs)
    findings, known = _cut(findings), _cut(known)  # each phase reads both again
    f = findings.withColumn("__nth", F.row_number().over(one("fingerprint").orderBy("finding_id")))
    k = known.withColumn("__nth", F.row_number().over(one("fingerprint").orderBy("entry_id")))
    exact = f.join(k.select("fingerprint", "__nth", "entry_id"), ["fingerprint", "__nth"]).select("finding_id", "entry_id", F.lit("existing").alias("status"))

    def alone(left: DataFrame, right: DataFrame, cs: list[str], status: str, extra: Column | None = None) -> DataFrame:
        def single(side: DataFrame, prefix: str) -> DataFrame:
            """Keys with one row, by aggregation: a key that many rows share is counted where they lie."""
            rest = [F.col(c).alias(c if c in ("entry_id", "finding_id") else prefix + c) for c in side.columns if c not in cs]
            return side.groupBy(*cs).agg(F.count("*").alias("__n"), F.min(F.struct(*rest)).alias("__r")).where("__n = 1").select(*cs, "__r.*")

        joined = single(left, "").join(single(right, "k_"), cs)
        if extra is not None:
            joined = joined.where(extra)
        return joined.select("finding_id", "entry_id", F.lit(status).alias("status"))

    f1 = findings.join(exact, "finding_id", "left_anti")
    k1 = known.join(exact, "entry_id", "left_anti")
    review = alone(f1, k1, ["loose", "path"], "review", F.col("rule_version") != F.col("k_rule_version"))
    f2 = f1.join(review, "finding_id", "left_anti")
    k2 = k1.join(review, "entry_id", "left_anti").join(present, "path", "left_anti")
    moved = alone(f2, k2, ["loose"], "moved")
    matched = _cut(exact.unionByName(review).unionByName(moved))
    new = findings.join(matched, "finding_id", "left_anti").select("finding_id", F.lit(None).cast("string").alias("entry_id"), F.lit("new").alias("status"))
    rest = known.join(matched, "entry_id", "left_anti")
    seen = rest.join(scanned, "path", "left_semi").select(F.lit(None).cast("string").alias("finding_id"), "entry_id", F.lit("resolved").alias("status"))
    unseen = rest.join(scanned, "path", "left_anti").select(F.lit(None).cast("string").alias("finding_id"), "entry_id", F.lit("unobserved").alias("status"))
    return matched.unionByName(new).unionByName(seen).unionByName(unseen)


def migrate(findings: DataFrame, known: DataFrame, band: int = 5) -> DataFrame:
    """(finding_id, entry_id, tier): exact, then loose on the same path, then a unique near line of the same rule and path."""
    one = lambda *cs: Window.partitionBy(*cs)

    def paired(left: DataFrame, right: DataFrame, cs: list[str], tier: str) -> DataFrame:
        a = left.withColumn("__n", F.row_number().over(one(*cs).orderBy("line", "finding_id")))
        b = right.withColumn("__n", F.row_number().over(one(*cs).orderBy("line", "entry_id"))).select(*cs, "__n", "entry_id")
        return a.join(b, [*cs, "__n"]).select("finding_id", "entry_id", F.lit(tier).alias("tier"))

    exact = paired(findings, known, ["fingerprint"], "exact")
    f1, k1 = findings.join(exact, "finding_id", "left_anti"), known.join(exact, "entry_id", "left_anti")
    loose = paired(f1, k1, ["loose", "path"], "loose")
    f2, k2 = f1.join(loose, "finding_id", "left_anti"), k1.join(loose, "entry_id", "left_anti")
    near = f2.join(k2.select("rule_id", "path", F.col("line").alias("k_line"), "entry_id"), ["rule_id", "path"]).where(F.abs(F.col("line") - F.col("k_line")) <= band)
    near = near.withColumn("__a", F.count("*").over(one("finding_id"))).withColumn("__b", F.count("*").over(one("entry_id"))).where("__a = 1 AND __b = 1")
    return exact.unionByName(loose).unionByName(near.select("finding_id", "entry_id", F.lit("near").alias("tier")))


def compare_snapshots(before: DataFrame, after: DataFrame, key: tuple, place: str, present: DataFrame | None = None) -> DataFrame:
    """(key, place, outcome, n): maintained where both have a row, then moved between places of one key, new, resolved.

    A row only moves out of a place that is gone: where `present` still has the old place, its row is resolved and the
    row elsewhere is new.
    """
    cs = [*key, place]
    a = before.groupBy(*cs).agg(F.count("*").alias("was"))
    b = after.groupBy(*cs).agg(F.count("*").alias("now"))
    both = a.join(b, cs, "full_outer").fillna(0, ["was", "now"])
    both = both.withColumn("less", F.greatest(F.col("was") - F.col("now"), F.lit(0))).withColumn("more", F.greatest(F.col("now") - F.col("was"), F.lit(0)))
    if present is not None:
        gone = both.join(present.select(F.col(place).alias("__p")).distinct(), F.col(place) == F.col("__p"), "left").withColumn("free", F.when(F.col("__p").isNull(), F.col("less")).otherwise(0)).drop("__p")
    else:
        gone = both.withColumn("free", F.col("less"))
    totals = gone.groupBy(*key).agg(F.least(F.sum("free"), F.sum("more")).alias("moves"))
    upto = Window.partitionBy(*key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    rows = gone.join(totals, list(key)).withColumn("more0", F.coalesce(F.sum("more").over(upto), F.lit(0))).withColumn("free0", F.coalesce(F.sum("free").over(upto), F.lit(0)))
    take = lambda n, n0: F.greatest(F.least(F.col(n), F.col("moves") - F.col(n0)), F.lit(0))
    rows = rows.withColumn("arrived", take("more", "more0")).withColumn("left", take("free", "free0"))
    out = rows.select(*cs, F.explode(F.array(
        F.struct(F.lit("maintained").alias("outcome"), F.least("was", "now").alias("n")),
        F.struct(F.lit("moved").alias("outcome"), F.col("arrived").alias("n")),
        F.struct(F.lit("new").alias("outcome"), (F.col("more") - F.col("arrived")).alias("n")),
        F.struct(F.lit("resolved").alias("outcome"), (F.col("less") - F.col("left")).alias("n")),
    )).alias("o"))
    return out.select(*cs, "o.outcome", "o.n").where("n > 0")


def multiset_changes(before: DataFrame, after: DataFrame, key: tuple) -> DataFrame:
    """(key, was, now, change): groups that gained or lost rows."""
    a = before.groupBy(*key).agg(F.count("*").alias("was"))
    b = after.groupBy(*key).agg(F.count("*").alias("now"))
    both = a.join(b, list(key), "full_outer").fillna(0, ["was", "now"]).where("was <> now")
    return both.withColumn("change", F.when(F.col("now") > F.col("was"), "new").otherwise("resolved"))


def innermost(points: DataFrame, spans: DataFrame, on: tuple, at: str, start: str, end: str, name: str) -> DataFrame:
    """Each point with the name of the smallest span that holds it (ties: the smaller name), null if none does.

    The join is an equi-join on `on` with a residual range test; spans of one key should be few (functions of a file).
    """
    s = spans.select(*(F.col(c).alias(f"s_{c}") for c in on), F.col(start).alias("s_start"), F.col(end).alias("s_end"), F.col(name).alias("s_name"))
    match = (F.col("s_start") <= F.col(at)) & (F.col(at) <= F.col("s_end"))
    for c in on:
        match = match & (F.col(c) == F.col(f"s_{c}"))
    best = F.min(F.when(F.col("s_name").isNotNull(), F.struct((F.col("s_end") - F.col("s_start")).alias("width"), F.col("s_name").alias("name"))))
    return points.join(s, match, "left").groupBy(*points.columns).agg(best.alias("best")).select(*points.columns, F.col("best.name").alias("scope"))


def last_before(uses: DataFrame, settings: DataFrame, on: tuple, at: str, value: str, out: str = "state") -> DataFrame:
    """As-of join: each use with the value of the last setting before it, by one sort of both together."""
    both = uses.select(*on, F.col(at).alias("__at"), F.lit(1).alias("__use"), F.lit(None).alias("__v")).unionByName(
        settings.select(*on, F.col(at).alias("__at"), F.lit(0).alias("__use"), F.col(value).alias("__v"))
    )
    # at the same place the use comes first: a setting counts from the next place on
    before = Window.partitionBy(*on).orderBy("__at", F.col("__use").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(out, F.last("__v", ignorenulls=True).over(before)).where("__use = 1").select(*on, F.col("__at").alias(at), out)


def first_after(events: DataFrame, uses: DataFrame, on: tuple, at: str, out: str = "next_at") -> DataFrame:
    """Each event with the place of the first use after it; null if there is none."""
    both = events.select(*on, F.col(at).alias("__at"), F.lit(0).alias("__use")).unionByName(uses.select(*on, F.col(at).alias("__at"), F.lit(1).alias("__use")))
    after = Window.partitionBy(*on).orderBy(F.col("__at").desc(), F.col("__use")).rowsBetween(Window.unboundedPreceding, -1)
    nearest = F.last(F.when(F.col("__use") == 1, F.col("__at")), ignorenulls=True).over(after)
    return both.withColumn(out, nearest).where("__use = 0").select(*on, F.col("__at").alias(at), out)


def missing(left: DataFrame, right: DataFrame, keys: tuple) -> DataFrame:
    """The distinct keys of left without a counterpart in right; null keys of left have none."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")
