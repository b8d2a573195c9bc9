"""Reviews: bypasses, hunks, directives, rule selection, custom rules, opinions."""

import pytest
from pyspark.sql import functions as F

from palisade.operators import review
from palisade.operators.findings import LineRule
from palisade.sources import files as src


def test_bypasses(spark):
    schema = "path string, text string, is_test boolean"
    before = spark.createDataFrame([("a.py", "x\ny", False), ("tests/t.py", "assert x\nassert y", True), ("tests/gone.py", "assert z", True), (".audit.yml", "gate: HIGH", False), ("same.py", "# noqa", False)], schema)
    after = spark.createDataFrame([("a.py", "x  # noqa\ny", False), ("tests/t.py", "@pytest.mark.skip\nassert x", True), (".audit.yml", "gate: none", False), ("same.py", "# noqa", False), ("new.py", "q // nosec", False)], schema)
    got = {(r.path, r.kind): (r.before, r.after) for r in review.bypasses(before, after).collect()}
    assert got == {
        ("a.py", "suppression_added"): (0, 1), ("tests/t.py", "test_skipped"): (0, 1), ("tests/t.py", "assertion_removed"): (2, 1), ("tests/gone.py", "test_deleted"): (1, 0),
        (".audit.yml", "policy_changed"): (1, 1), ("new.py", "suppression_added"): (0, 1),
    }
    assert review.bypasses(before, before).count() == 0


def test_hunks(spark):
    text = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n-old\n+new\n same\n@@ -9 +9,2 @@\n kept\n+more\ndiff --git a/y.py b/y.py\n--- a/y.py\n+++ b/y.py\n@@ -3 +2,0 @@\n-gone"
    lines = src.lines(spark.createDataFrame([("p", text)], "patch string, text string"), ("patch",))
    got = sorted((r.file, r.start, r.removed, r.added, r.text.count("\n")) for r in review.hunks(lines).collect())
    assert got == [("x.py", 1, 1, 1, 3), ("x.py", 9, 0, 1, 2), ("y.py", 3, 1, 0, 1)]


def test_directives_and_their_rules(spark):
    text = "We like tests. Secrets must never be committed! Always close files.\nThe sky is blue. You must write poems."
    df = spark.createDataFrame([("g", text), ("h", None)], "doc string, text string")
    found = review.enforced(review.directives(df, "doc"), {r"(?i)secret|password": ("IL-101",), r"(?i)close": ("IL-518",)})
    assert [(r.place, r.forbids, r.rules) for r in found.orderBy("place").collect()] == [(2, True, ["IL-101"]), (3, False, ["IL-518"]), (5, False, [])]


def test_counts_of_test_runs(spark):
    df = spark.createDataFrame([("== 3 failed, 12 passed, 1 skipped in 2s ==",), ("nothing",), ("5 passed",), (None,)], "output string")
    assert [(r.passed, r.failed, r.errors, r.skipped) for r in review.test_counts(df).collect()] == [(12, 3, 0, 1), (None,) * 4, (5, 0, 0, 0), (None,) * 4]


def test_paths(spark):
    cases = [("/admin/**", "/admin", True), ("/admin/**", "/admin/a/b", True), ("/admin/**", "/administer", False), ("/a/*", "/a/b/c", False), ("/**/x?", "/q/r/xy", True), ("/a.b", "/aXb", False)]
    for pattern, path, want in cases:
        assert spark.range(1).select(F.lit(path).rlike(review.ant_regex(pattern))).first()[0] is want, pattern
    files = spark.createDataFrame([("web/vendor/x.js", "a"), ("x.min.js", "a"), ("lib.js", "/*! lib v1.2.3 */"), ("own.js", "/* mine */ 1.2.3")], "path string, text string")
    assert [r.v for r in files.select(review.vendored(F.col("path"), F.col("text")).alias("v")).collect()] == [True, True, True, False]


def test_rule_selection_and_custom_rules(spark):
    rules = [LineRule("A", "LOW", "a"), LineRule("B", "LOW", "b"), LineRule("B", "LOW", "c")]
    assert [r.rule_id for r in review.active(rules, disabled=["A"])] == ["B", "B"] and len(review.active(rules, enabled=["A"])) == 1
    with pytest.raises(ValueError, match="unknown rules: C"):
        review.active(rules, enabled=["C"])
    good = {"rule_id": "X-1", "severity": "LOW", "pattern": r"print\(", "matches": ["print(1)"], "rejects": ["log(1)"]}
    kept, problems = review.custom_rules(spark, [good, good | {"rule_id": "X-2", "rejects": ["pprint(1)"]}, good | {"rule_id": "X-3", "pattern": "("}, {"rule_id": "X-4"}, good | {"rule_id": "X-5", "severity": "BAD"}])
    assert [r.rule_id for r in kept] == ["X-1"]
    assert [p[0] for p in problems] == ["X-4", "X-5", "X-2", "X-3"] and problems[2][1] == "example: pprint(1)"


def test_opinions_change_nothing(spark):
    f = spark.createDataFrame([("F-1", 10, "HIGH"), ("F-2", 20, "LOW"), ("F-3", 30, "LOW")], "finding_id string, line int, severity string")
    o = spark.createDataFrame([("F-1", 1, "real", 12), ("F-1", 2, "false alarm", 90), ("F-2", 3, "real", 25)], "finding_id string, seq int, opinion string, basis_line int")
    got = [(r.finding_id, r.severity, r.opinion, r.grounded) for r in review.with_opinions(f, o).orderBy("finding_id").collect()]
    assert got == [("F-1", "HIGH", "false alarm", False), ("F-2", "LOW", "real", True), ("F-3", "LOW", None, None)]
