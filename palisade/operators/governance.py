"""Ledgers, gates, invariants, coverage, receipts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.scalars import ratio
from palisade.operators.findings import severity_rank

VOLATILE = ("run_id", "started_at", "finished_at", "host", "root", "duration_s", "tool_path")


def ledger(points: DataFrame, family: str = "family", state: str = "state", in_scope: str = "in_scope") -> DataFrame:
    """Per family: total, in scope, unresolved in scope, the gap rate (null without points in scope) and its status."""
    counts = points.groupBy(family).agg(
        F.count("*").alias("total"), F.count_if(in_scope).alias("in_scope"),
        F.count_if(F.col(in_scope) & F.col(state).isin("unresolved", "unsupported", "budget_exceeded")).alias("gaps"),
    )
    status = F.when(F.col("in_scope") == 0, "not_applicable").when(F.col("gaps") == 0, "met").otherwise("unmet")
    return counts.withColumn("gap_rate", ratio(F.col("gaps"), F.col("in_scope"))).withColumn("status", status)


def by_state(points: DataFrame, keys: tuple, state: str) -> DataFrame:
    """(keys, states): a map from state to count."""
    n = points.groupBy(*keys, state).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(state, "n")))).alias("states"))


def gate(rates: DataFrame, rate: str, most: float) -> DataFrame:
    """passed: true, false, or null where the rate can't be told."""
    return rates.withColumn("passed", F.when(F.col(rate).isNotNull(), F.col(rate) <= most))


def coverage(items: DataFrame, mapping: DataFrame, active: DataFrame, found: DataFrame) -> DataFrame:
    """(item, status, n): found, clean, manual (no rule is mapped) or missing (no mapped rule is active)."""
    rules = mapping.join(active.select("rule_id", F.lit(1).alias("on")), "rule_id", "left").join(found.groupBy("rule_id").agg(F.count("*").alias("n")), "rule_id", "left")
    per = rules.groupBy("item").agg(F.count("*").alias("mapped"), F.coalesce(F.sum("on"), F.lit(0)).alias("on"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    status = F.when(F.coalesce("mapped", F.lit(0)) == 0, "manual").when(F.col("on") == 0, "missing").when(F.col("n") > 0, "found").otherwise("clean")
    return items.join(per, "item", "left").select("item", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


def support_matrix(pairs: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """One row a rule, one column a language, counts (0 where there are none)."""
    return pairs.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def verdict(checks: DataFrame, keys: tuple = ()) -> DataFrame:
    """failed if a required check failed, undeterminable if one is open, else verified."""
    required = F.col("required")
    fold = F.when(F.bool_or(required & (F.col("result") == "fail")), "failed").when(F.bool_or(required & (F.col("result") == "open")), "undeterminable").otherwise("verified")
    return checks.groupBy(*keys).agg(fold.alias("verdict")) if keys else checks.agg(fold.alias("verdict"))


def invariants(findings: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(code, violations) of row checks over findings, in one pass; a null is a violation, not a pass."""
    counts = findings.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(code) for code, ok in checks.items()))
    pairs = F.array(*(F.struct(F.lit(code).alias("code"), F.col(code).alias("violations")) for code in checks))
    return counts.select(F.explode(pairs).alias("c")).select("c.code", "c.violations")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def set_differences(recorded: DataFrame, current: DataFrame, key: str, values: str) -> DataFrame:
    """(key, added, removed) of arrays that differ; a side without the key is an empty array."""
    none = F.array().cast(recorded.schema[values].dataType)
    both = recorded.select(key, F.col(values).alias("was")).join(current.select(key, F.col(values).alias("now")), key, "full_outer")
    was, now = F.coalesce("was", none), F.coalesce("now", none)
    return both.select(key, F.array_sort(F.array_except(now, was)).alias("added"), F.array_sort(F.array_except(was, now)).alias("removed")).where("size(added) + size(removed) > 0")


def repeated(df: DataFrame, value: str, place: str, least: int, places: int, k: int) -> DataFrame:
    """(value, n, places): the k most frequent values with `least` rows in `places` places or more."""
    n = df.groupBy(value).agg(F.count("*").alias("n"), F.countDistinct(place).alias("places"))
    return n.where((F.col("n") >= least) & (F.col("places") >= places)).orderBy(F.col("n").desc(), value).limit(k)


def review_queue(*parts: DataFrame, k: int | None = None) -> DataFrame:
    """The union of queues (severity, path, line, kind), worst first; all of it, or the first k."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("rank", severity_rank(F.col("severity"))).orderBy("rank", "path", "line", "kind").drop("rank")
    return out.limit(k) if k else out


def canonical(df: DataFrame, volatile: tuple = VOLATILE) -> DataFrame:
    """(document): rows as JSON with sorted names and without what changes from run to run."""
    names = sorted(c for c in df.columns if c not in volatile)
    return df.select(F.to_json(F.struct(*names)).alias("document"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(path, result): one SARIF 2.1.0 result a finding."""
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select("path", F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("snippet").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("result"))


def sarif_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules that some finding names."""
    return rules.join(findings.select("rule_id"), "rule_id", "left_semi")


def gitlab(findings: DataFrame) -> DataFrame:
    """(fingerprint, issue): one code quality issue a finding."""
    level = F.when(F.col("severity") == "CRITICAL", "blocker").when(F.col("severity") == "HIGH", "critical").when(F.col("severity") == "MEDIUM", "major").otherwise("minor")
    place = F.struct(F.col("path"), F.struct(F.col("line").alias("begin")).alias("lines"))
    issue = F.struct(F.col("snippet").alias("description"), F.col("rule_id").alias("check_name"), F.col("fingerprint"), level.alias("severity"), place.alias("location"))
    return findings.select("fingerprint", F.to_json(issue).alias("issue"))


def markdown(summary_rows: list, title: str) -> str:
    """A small aggregated table as markdown; rows are dicts."""
    if not summary_rows:
        return f"# {title}\n\nNothing.\n"
    names = list(summary_rows[0])
    body = "\n".join("| " + " | ".join(str(r[n]) for n in names) + " |" for r in summary_rows)
    return f"# {title}\n\n| " + " | ".join(names) + " |\n|" + "---|" * len(names) + f"\n{body}\n"


def patch_files(lines: DataFrame, order: str = "line", key: str = "path") -> DataFrame:
    """(key, file, added, removed, deleted) of unified diffs given as lines."""
    from pyspark.sql import Window

    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.when(F.col("text").startswith("diff --git "), F.regexp_extract("text", r" b/(.+)$", 1))
    rows = lines.withColumn("file", F.last(head, ignorenulls=True).over(upto)).where("file IS NOT NULL")
    t = F.col("text")
    return rows.groupBy(key, "file").agg(
        F.count_if(t.startswith("+") & ~t.startswith("+++ ")).alias("added"), F.count_if(t.startswith("-") & ~t.startswith("--- ")).alias("removed"), F.bool_or(t == "+++ /dev/null").alias("deleted")
    )
