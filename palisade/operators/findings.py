"""Line rules and the identity of findings: scan, dedupe, redact, fingerprint, context, summary, grade."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions import scalars

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


@dataclass(frozen=True)
class LineRule:
    """One rule: lines that `pattern` matches and `unless` doesn't, in the given languages or kinds of file."""

    rule_id: str
    severity: str
    pattern: str
    unless: str = ""
    languages: tuple = ()
    kinds: tuple = ()
    include_tests: bool = False
    confidence: str = "CONFIRMED"
    cap: int = 0
    comments: bool = False  # looks at comments as well


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int")


def _applies(r: LineRule, columns: list[str]) -> Column:
    """Whether a rule looks at a file, by what is known of the file."""
    ok, where = F.lit(True), F.lit(False)
    if r.languages and "language" in columns:
        where = where | F.coalesce(F.col("language").isin(*r.languages), F.lit(False))
    if r.kinds and "kind" in columns:
        where = where | F.coalesce(F.col("kind").isin(*r.kinds), F.lit(False))
    if (r.languages or r.kinds) and "language" in columns:
        ok = where
    if not r.include_tests and "is_test" in columns:
        ok = ~F.col("is_test") & ok
    return ok


def _spelled(op: str, value, most: int = 16) -> set[str] | None:
    """All strings in lower case that a part of a parsed pattern stands for; None if they are many or not of ASCII."""
    out = None
    if op == "LITERAL":
        out = {chr(value).lower()} if value < 128 else None
    elif op in ("AT", "ASSERT_NOT"):
        out = {""}
    elif op == "IN" and all(str(o) == "LITERAL" and v < 128 for o, v in value):
        out = {chr(v).lower() for _, v in value}
    elif op in ("SUBPATTERN", "ATOMIC_GROUP") or op.endswith("_REPEAT") and tuple(value[:2]) == (0, 1):
        out = {""}
        for o, v in value[3] if op == "SUBPATTERN" else value if op == "ATOMIC_GROUP" else value[2]:
            each = _spelled(str(o), v)
            out = out and each and {a + b for a in out for b in each}
        out = out and out | ({""} if op.endswith("_REPEAT") else set())
    elif op == "BRANCH":
        ways = [_spelled("ATOMIC_GROUP", b) for b in value[1]]
        out = set().union(*ways) if all(ways) else None
    return out if out and len(out) <= most else None


def _needed(tree) -> set[str] | None:
    """Strings in lower case of which a match of a parsed pattern holds one at least; None if none are known."""
    found, run = [], {""}
    for op, value in (*((str(o), v) for o, v in tree), ("END", None)):
        each = _spelled(op, value)
        longer = each and {a + b for a in run for b in each}
        if longer and len(longer) <= 64:
            run = longer
            continue
        found.append(run)
        run, inner = each or {""}, None
        if op == "SUBPATTERN":
            inner = _needed(value[3])
        elif op == "ATOMIC_GROUP":
            inner = _needed(value)
        elif op.endswith("_REPEAT") and value[0] > 0:
            inner = _needed(value[2])
        elif op == "BRANCH":
            ways = [_needed(b) for b in value[1]]
            inner = None if None in ways else set().union(*ways)
        found.append(inner or {""})
    best = max(found, key=lambda n: (min(map(len, n)), -len(n)))
    return None if "" in best else best


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Strings of ASCII of which any line that the pattern matches holds one at least, in either case; none if they aren't known.

    Known for patterns that Python reads without a doubt and as the engine does; flags in their middle, classes in
    classes and case by Unicode are left out.
    """
    if re.search(r"\(\?[a-zA-Z]*[uUx]|(?<!\\)\[\^?\]?(?:\\.|[^\]\\])*\[", pattern):
        return ()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            return tuple(sorted(_needed(re._parser.parse(pattern)) or ()))
    except (re.error, Warning, AttributeError, OverflowError):
        return ()


def _may_hit(r: LineRule, low: Column) -> Column:
    """Whether a text in lower case holds what the rule's pattern needs; a search for strings is much cheaper than for patterns."""
    out = F.lit(False)
    for n in needed(r.pattern):
        out = out | low.contains(n)
    return out if needed(r.pattern) else F.lit(True)


def _hits(r: LineRule, text: Column) -> Column:
    return text.rlike(r.pattern) & ~text.rlike(r.unless) if r.unless else text.rlike(r.pattern)


def scan(lines: DataFrame, rules: list[LineRule], keys: tuple = ("path",)) -> DataFrame:
    """Findings (keys, line, column, rule_id, severity, confidence, snippet) of all rules in one pass over the lines.

    lines may carry language, kind and is_test; a rule that names some applies to those alone.
    """
    hits, known = [], lines.columns
    lines = lines.withColumn("__low", F.lower("text"))
    for r in rules:
        hits.append(
            F.when(_applies(r, known) & _may_hit(r, F.col("__low")) & _hits(r, F.col("text")), F.struct(
                F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"),
                F.regexp_instr("text", F.lit(r.pattern)).alias("column"), F.lit(r.cap).alias("cap"),
            ))
        )
    # outer, as else a filter by the array's size is put before and all rules are tried once more for it
    found = lines.select(*keys, "line", "text", F.explode_outer(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("hit")).where("hit IS NOT NULL")
    out = found.select(*keys, "line", "hit.column", "hit.rule_id", "hit.severity", "hit.confidence", F.col("text").alias("snippet"), "hit.cap")
    if any(r.cap for r in rules):
        nth = Window.partitionBy(*keys, "rule_id").orderBy("line", "column")
        out = out.withColumn("__n", F.row_number().over(nth)).where((F.col("cap") == 0) | (F.col("__n") <= F.col("cap"))).drop("__n")
    return out.drop("cap")


FOUND = "array<struct<line:int,column:int,rule_id:string,severity:string,confidence:string,snippet:string>>"


def scan_files(files: DataFrame, rules: list[LineRule]) -> DataFrame:
    """files with `findings`: what `scan` finds in each, an array of (line, column, rule_id, severity, confidence, snippet).

    Made in the file's own row, so it needs no shuffle and works on streams. The cap of a rule id holds over all of its
    rules. A null text has no findings. With code_text beside text (`lexing.with_views`), rules don't see comments unless
    they look for them; snippets are the lines as they are.
    """
    split = lambda c: F.split(F.coalesce(c, F.lit("")), "\n")
    seen = "code_text" if "code_text" in files.columns else "text"
    plain = lambda t: F.regexp_replace(t, "\r$", "")
    both = F.arrays_zip(split("text").alias("text"), split(seen).alias("code"))
    rows = files.withColumn("__lines", F.transform(both, lambda z, i: F.struct((i + 1).alias("line"), plain(z["text"]).alias("text"), plain(z["code"]).alias("code"))))

    def one(r: LineRule) -> Column:
        at = "text" if r.comments else "code"
        made = F.transform(
            F.filter("__lines", lambda x: _hits(r, x[at])),
            lambda x: F.struct(
                x["line"].alias("line"), F.regexp_instr(x[at], F.lit(r.pattern)).alias("column"), F.lit(r.rule_id).alias("rule_id"),
                F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"), x["text"].alias("snippet"),
            ),
        )
        return F.when(_applies(r, files.columns) & _may_hit(r, F.lower(F.col("text" if r.comments else seen))), made).otherwise(F.array().cast(FOUND))

    found = [F.array().cast(FOUND)]
    for rule_id in dict.fromkeys(r.rule_id for r in rules):
        own = [r for r in rules if r.rule_id == rule_id]
        all_, cap = F.concat(*map(one, own)), max(r.cap for r in own)
        found.append(F.slice(F.array_sort(all_), 1, cap) if cap else all_)
    return rows.withColumn("findings", F.array_sort(F.concat(*found))).drop("__lines")



def dedupe(findings: DataFrame, keys: tuple = ("rule_id", "path", "line"), order: tuple = ("column",)) -> DataFrame:
    """The first finding of each rule, file and line, in the given order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return findings.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def redacted(findings: DataFrame, secrets: DataFrame | None = None, size: int = 200, keys: tuple = ("path",)) -> DataFrame:
    """Snippets without secrets: those that any finding of the file shows, then token formats; then cut to size.

    secrets: (keys, secrets array) gathered per file; a secret of one line vanishes from all of the file's findings.
    """
    if secrets is None:
        secrets = findings.select(*keys, F.explode(scalars.secret_values(F.col("snippet"))).alias("s")).groupBy(*keys).agg(F.array_sort(F.collect_set("s")).alias("secrets"))
    joined = findings.join(secrets, list(keys), "left")
    none = F.array().cast("array<string>")
    return joined.withColumn("snippet", scalars.limit(scalars.redact(F.col("snippet"), F.coalesce("secrets", none)), size)).drop("secrets")


def fingerprinted(findings: DataFrame, version: int = 1, keys: tuple = ("path",)) -> DataFrame:
    """Adds shape, occurrence, fingerprint, loose key and finding_id; lines may move without changing a fingerprint."""
    out = findings.withColumn("shape", scalars.shape(scalars.mask_secrets(F.col("snippet"))))
    nth = Window.partitionBy("rule_id", *keys, "shape").orderBy("line", "column")
    out = out.withColumn("occurrence", F.row_number().over(nth))
    fingerprint = scalars.digest(20, "rule_id", F.lit(version), *keys, "shape", "occurrence")
    return out.withColumns(
        {
            "fingerprint": fingerprint,
            "loose": scalars.digest(20, "rule_id", "shape"),
            "finding_id": F.concat(F.lit("F-"), scalars.digest(12, fingerprint, "rule_id", *keys)),
        }
    )


def _flagged(files: DataFrame, key: str, **patterns: str) -> DataFrame:
    """(key, lines): a file's lines as an array of structs of flags, one a pattern."""
    flags = lambda t: F.struct(*(t.rlike(p).alias(name) for name, p in patterns.items()))
    lines = F.transform(F.split("text", "\n"), lambda t: flags(F.regexp_replace(t, "\r$", "")))
    return files.where("text IS NOT NULL").select(key, lines.alias("__lines"))


def in_context(files: DataFrame, rule: str, flag: str, before: int = 5, after: int = 5, key: str = "path") -> DataFrame:
    """(key, line, severity) of lines that match `rule`, HIGH if a line of the frame around matches `flag`, else MEDIUM.

    A file's lines are looked at in its own row: nothing is shuffled or sorted.
    """

    def one(x: Column, i: Column) -> Column:
        first = F.greatest(i - before, F.lit(0))
        near = F.when(x["rule"], F.exists(F.slice("__lines", first + 1, i + after - first + 1), lambda y: y["flag"]))
        return F.struct((i + 1).alias("line"), x["rule"].alias("hit"), F.when(near, "HIGH").otherwise("MEDIUM").alias("severity"))

    found = F.filter(F.transform("__lines", one), lambda x: x["hit"])
    return _flagged(files, key, rule=rule, flag=flag).select(key, F.inline(found)).drop("hit")


def exempt_by_previous(files: DataFrame, rule: str, exemption: str, back: int = 2, key: str = "path") -> DataFrame:
    """(key, line) of lines that match `rule` unless one of the `back` lines before matches the exemption; in the file's row."""

    def one(x: Column, i: Column) -> Column:
        first = F.greatest(i - back, F.lit(0))
        exempt = F.exists(F.slice("__lines", first + 1, i - first), lambda y: y["exempt"])
        return F.struct((i + 1).alias("line"), (x["rule"] & ~exempt).alias("hit"))

    found = F.filter(F.transform("__lines", one), lambda x: x["hit"])
    return _flagged(files, key, rule=rule, exempt=exemption).select(key, F.inline(found)).drop("hit")


def grade(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    return F.when(critical > 0, "F").when(high > 0, "D").when(medium > 0, "B").when(low > 0, "A-").otherwise("A+")


def summary(findings: DataFrame) -> DataFrame:
    """One row: findings by severity, the grade, and whether a gate at HIGH passes."""
    counts = findings.agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES))
    return counts.withColumn("grade", grade(*(F.col(s.lower()) for s in SEVERITIES))).withColumn("passed", F.expr("critical + high = 0"))
