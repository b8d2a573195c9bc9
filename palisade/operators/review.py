"""Reviews as relations: trust and gap summaries, inherited rows, coverage, bypasses, hunks, directives, rule selection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.operators.findings import SEVERITIES, LineRule

#: What a gap's reason is about: fixed values, the first that its text holds.
CAUSES = (("parse", "syntax"), ("import", "cross_file"), ("dynamic", "dynamic_call"), ("limit", "limit"), ("language", "language"))


def gap_cause(state: Column, reason: Column) -> Column:
    """The category of a point that isn't settled; null for settled points."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    cause = F.lit("unknown")
    for word, name in reversed(CAUSES):
        cause = F.when(low.contains(word), name).otherwise(cause)
    return F.when(state == "evidence_met", F.lit(None).cast("string")).when(state == "unsupported", "language").otherwise(cause)


def trust_summary(points: DataFrame) -> DataFrame:
    """(family, callee, state, cause, n): gaps grouped, settled points left out."""
    gaps = points.withColumn("cause", gap_cause(F.col("state"), F.col("reason"))).where("cause IS NOT NULL")
    return gaps.groupBy("family", "callee", "state", "cause").agg(F.count("*").alias("n"))


def counts_by(rows: DataFrame, by: str, of: str, values: Iterable[str], part: str, whole: Iterable[str]) -> DataFrame:
    """One row a value of `by`: how often `of` has each value, and the rate of `part` among `whole` (null if there is none)."""
    values = list(values)
    cols = [F.count_if(F.col(of) == v).alias(v) for v in values]
    total = sum((F.col(v) for v in whole), F.lit(0))
    return rows.groupBy(by).agg(*cols).withColumn("rate", F.when(total > 0, F.col(part) / total))


def decision_times(log: DataFrame, key: str, at: str, kind: str, opened: str, closed: str, by: str) -> DataFrame:
    """(by, decisions, mean_minutes, median_minutes): time from an item's first opening to its first closing after it.

    log: rows of kind `opened` or `closed`; an item that isn't closed counts for nothing.
    """
    first = log.where(F.col(kind) == opened).groupBy(key, by).agg(F.min(at).alias("t0"))
    ends = log.where(F.col(kind) == closed).select(F.col(key), F.col(at).alias("t1"))
    done = first.join(ends, key).where("t1 >= t0").groupBy(key, by, "t0").agg(F.min("t1").alias("t1"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    minutes = (micros("t1") - micros("t0")) / 60e6
    return done.groupBy(by).agg(F.count("*").alias("decisions"), F.avg(minutes).alias("mean_minutes"), F.percentile(minutes, F.lit(0.5)).alias("median_minutes"))


def inherited(left: DataFrame, right: DataFrame, keys: tuple, left_id: str, right_id: str, near: tuple) -> DataFrame:
    """(left_id, right_id, status): leftovers of two sides that are each other's only counterpart on `keys` inherit it.

    A leftover of left without one needs a review if right has any row on the keys `near`, and else is resolved. Counts
    are aggregated before rows are joined, so a key that all rows share joins nothing.
    """
    one = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(c).alias(c)).where("n = 1").drop("n")
    pairs = one(left, left_id).join(one(right, right_id), list(keys)).select(left_id, right_id)
    around = right.select(*near).distinct().withColumn("__near", F.lit(True))
    out = left.join(pairs, left_id, "left").join(around, list(near), "left")
    status = F.when(F.col(right_id).isNotNull(), "inherited").when(F.col("__near"), "needs_review").otherwise("resolved")
    return out.select(left_id, right_id, status.alias("status"))


def grown(before: DataFrame, after: DataFrame, keys: tuple) -> DataFrame:
    """(keys, before, after): groups that have more rows afterwards; a missing group has none."""
    n = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    both = n(before, "before").join(n(after, "after"), list(keys), "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select(*keys, zero("before"), zero("after")).where("after > before")


#: What weakens an audit when a change adds or removes it: fixed values. name, pattern of lines, 1 if adding it counts.
WEAKENS = (
    ("suppression_added", r"audit:\s*ignore|#\s*noqa\b|eslint-disable|@SuppressWarnings|//\s*nosec", 1),
    ("test_skipped", r"@(?:pytest\.mark\.)?skip\b|\b(?:it|test|describe)\.skip\(|@Disabled\b", 1),
    ("assertion_removed", r"^\s*assert\b|\bself\.assert\w+\(|\bexpect\(", -1),
)


def bypasses(before: DataFrame, after: DataFrame, policies: tuple = (r"\.audit\.ya?ml$", r"(?:^|/)\.github/workflows/")) -> DataFrame:
    """(path, kind, before, after): where a change suppresses, skips, drops assertions, deletes tests or edits policies.

    before, after: files (path, text, is_test). Counts are made in a file's own row; one full join by path compares them.
    """

    def counted(df: DataFrame, suffix: str) -> DataFrame:
        lines = F.split(F.coalesce("text", F.lit("")), "\n")
        matching = lambda p: lambda t: t.rlike(p)
        counts = [F.size(F.filter(lines, matching(p))).alias(f"{name}_{suffix}") for name, p, _ in WEAKENS]
        return df.select("path", F.col("is_test").alias(f"test_{suffix}"), F.xxhash64("text").alias(f"hash_{suffix}"), *counts)

    both = counted(before, "b").join(counted(after, "a"), "path", "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    row = lambda kind, b, a: F.struct(F.lit(kind).alias("kind"), b.cast("int").alias("before"), a.cast("int").alias("after"))
    found = [F.when((n(f"{k}_a") - n(f"{k}_b")) * sign > 0, row(k, n(f"{k}_b"), n(f"{k}_a"))) for k, _, sign in WEAKENS if sign > 0]
    found += [F.when(F.col("hash_a").isNotNull() & (n(f"{k}_b") > n(f"{k}_a")), row(k, n(f"{k}_b"), n(f"{k}_a"))) for k, _, sign in WEAKENS if sign < 0]
    found.append(F.when(F.col("test_b") & F.col("hash_a").isNull(), row("test_deleted", F.lit(1), F.lit(0))))
    policy = F.lit(False)
    for p in policies:
        policy = policy | F.col("path").rlike(p)
    found.append(F.when(policy & ~F.col("hash_a").eqNullSafe(F.col("hash_b")), row("policy_changed", F.col("hash_b").isNotNull(), F.col("hash_a").isNotNull())))
    return both.select("path", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def hunks(lines: DataFrame, key: str = "patch", order: str = "line") -> DataFrame:
    """(key, file, hunk, start, removed, added, text): a unified diff as patches of one hunk each.

    Hunks of a patch are numbered by a running count of their heads; a patch is one group, as its lines depend on order.
    """
    t = F.col("text")
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        lines.withColumn("file", F.last(F.when(t.startswith("+++ b/"), F.substring(t, 7, 4096)), ignorenulls=True).over(upto))
        .withColumn("hunk", F.count_if(t.startswith("@@ ")).over(upto).cast("int"))
        .withColumn("head", F.max(F.when(t.rlike("^(?:diff |--- |\\+\\+\\+ )"), F.col(order))).over(upto))
        .withColumn("at", F.max(F.when(t.startswith("@@ "), F.col(order))).over(upto))
    )
    body = rows.where("at IS NOT NULL AND (head IS NULL OR at > head)")
    start = F.regexp_extract(F.min_by("text", order), r"^@@ -([0-9]+)", 1).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), t.alias("t"))))
    return body.groupBy(key, "file", "hunk").agg(
        start.alias("start"), F.count_if(t.startswith("-")).alias("removed"), F.count_if(t.startswith("+")).alias("added"),
        F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("text"),
    )


def spread_patterns(rows: DataFrame, pattern: str, place: str, least: int = 2) -> DataFrame:
    """(pattern, n, places): what occurs in `least` places or more."""
    counted = rows.groupBy(pattern).agg(F.count("*").alias("n"), F.countDistinct(place).alias("places"))
    return counted.where(F.col("places") >= least)


#: Words that make a sentence a directive, and those that make it forbid: fixed values.
MUST, NEVER = r"(?i)\b(?:must|always|required|shall|never|do not|don't)\b", r"(?i)\b(?:never|must not|do not|don't|shall not)\b"


def directives(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, place, sentence, forbids): the sentences of a guideline that direct something."""
    sentences = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), r"(?<=[.!?]) "), lambda s, i: F.struct((i + 1).alias("place"), F.trim(s).alias("sentence")))
    found = documents.select(key, F.inline(F.filter(sentences, lambda s: s["sentence"].rlike(MUST))))
    return found.withColumn("forbids", F.col("sentence").rlike(NEVER))


def enforced(found: DataFrame, topics: dict[str, tuple[str, ...]]) -> DataFrame:
    """directives with `rules`: the rules whose topic a sentence names; an empty array is a directive that nothing checks."""
    named = [F.when(F.col("sentence").rlike(p), F.array(*map(F.lit, ids))).otherwise(F.array().cast("array<string>")) for p, ids in topics.items()]
    return found.withColumn("rules", F.array_sort(F.array_distinct(F.concat(F.array().cast("array<string>"), *named))))


def test_counts(outputs: DataFrame, text: str = "output") -> DataFrame:
    """outputs with passed, failed, errors and skipped of a test run's summary; null where there is none."""
    number = lambda word: F.try_to_number(F.nullif(F.regexp_extract(text, rf"([0-9]+) {word}", 1), F.lit("")), F.lit("999999999")).cast("long")
    has = F.col(text).rlike(r"[0-9]+ (?:passed|failed|errors?|skipped)\b")
    return outputs.withColumns({name: F.when(has, F.coalesce(number(word), F.lit(0))) for name, word in (("passed", "passed"), ("failed", "failed"), ("errors", "errors?"), ("skipped", "skipped"))})


def ant_regex(pattern: str) -> str:
    """An ant path pattern as a regular expression: ** spans folders, * and ? don't; a trailing /** takes the folder too."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i:] == "/**":
            out, i = out + "(?:/.*)?", len(pattern)
        elif pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or (c if c.isalnum() or c in "/_-" else "\\" + c)
            i += 1
    return f"^{out}$"


def vendored(path: Column, text: Column) -> Column:
    """Copies of other people's scripts: in a folder of such, minified by name, or with a banner that states a version."""
    return path.rlike(r"(?i)(?:^|/)(?:vendor|third[_-]?party|bower_components|node_modules)/|\.min\.js$") | F.left(text, F.lit(400)).rlike(r"(?s)^\s*/\*[!*].*?\bv?[0-9]+\.[0-9]+\.[0-9]+")


def active(rules: list[LineRule], enabled: Iterable[str] = (), disabled: Iterable[str] = ()) -> list[LineRule]:
    """The rules that are on: all, or those enabled, without those disabled. An id that no rule has is an error."""
    known, on, off = {r.rule_id for r in rules}, set(enabled), set(disabled)
    if unknown := sorted((on | off) - known):
        raise ValueError(f"unknown rules: {', '.join(unknown)}")
    return [r for r in rules if (not on or r.rule_id in on) and r.rule_id not in off]


def custom_rules(spark, spec: list[dict]) -> tuple[list[LineRule], list[tuple[str, str]]]:
    """(rules, problems) of a user's spec: entries with rule_id, severity, pattern, matches and rejects (examples).

    An entry is a rule only if its pattern finds every example of `matches` and none of `rejects`; the examples run through
    the engine's own matching. What is wrong with an entry is a problem (rule_id, reason), never a silent omission.
    """
    rules, problems = [], []
    for entry in spec:
        name = str(entry.get("rule_id", ""))
        missing = [k for k in ("rule_id", "severity", "pattern", "matches", "rejects") if not entry.get(k)]
        if missing:
            problems.append((name, "missing " + ", ".join(missing)))
        elif entry["severity"] not in SEVERITIES:
            problems.append((name, f"unknown severity {entry['severity']}"))
        else:
            rules.append((LineRule(name, entry["severity"], entry["pattern"], entry.get("unless", ""), include_tests=True), list(entry["matches"]), list(entry["rejects"])))
    kept = []
    for rule, matches, rejects in rules:
        texts = [(t, True) for t in matches] + [(t, False) for t in rejects]
        try:
            rows = spark.createDataFrame(texts, "text string, wanted boolean")
            hit = F.col("text").rlike(rule.pattern) & (~F.col("text").rlike(rule.unless) if rule.unless else F.lit(True))
            wrong = [r["text"] for r in rows.where(hit != F.col("wanted")).collect()]
        except Exception as e:  # a pattern that the engine can't compile is the user's, and is reported as such
            problems.append((rule.rule_id, f"pattern: {type(e).__name__}"))
            continue
        if wrong:
            problems.append((rule.rule_id, f"example: {wrong[0]}"))
        else:
            kept.append(rule)
    return kept, problems


def with_opinions(findings: DataFrame, opinions: DataFrame) -> DataFrame:
    """findings with opinion, basis_line and grounded: a stated basis counts only if it is a line within ten of the finding.

    An opinion never changes a finding's severity or verdict; of several for one finding the newest counts.
    """
    last = opinions.groupBy("finding_id").agg(F.max_by(F.struct("opinion", "basis_line"), "seq").alias("o"))
    joined = findings.join(last, "finding_id", "left")
    near = F.abs(F.col("o.basis_line") - F.col("line")) <= 10
    return joined.select(*findings.columns, F.col("o.opinion").alias("opinion"), F.col("o.basis_line").alias("basis_line"), F.when(F.col("o").isNotNull(), F.coalesce(near, F.lit(False))).alias("grounded"))
