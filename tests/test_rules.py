"""Positive and negative cases of rules, whole pipeline: files in, lines out."""

import pytest

from palisade.operators import findings as fd, rules, syntax
from palisade.plans.rule_corpus import LINE_CASES, SYNTAX_CASES, cases
from palisade.sources import files as src


def test_line_rules(spark):
    """By lines of all files, and in each file's own row: each case's rule fires on the hit and not on the miss."""
    texts = [(f"{i}/{kind}/{path}", text) for i, (_, path, *both) in enumerate(LINE_CASES) for kind, text in zip(("hit", "miss"), both)]
    files = src.from_table(spark.createDataFrame(texts, "path string, text string"), "path", "text")
    numbered = src.lines(files, ("path", "language", "kind", "is_test"))
    by_lines = {(r.path, r.rule_id) for r in fd.dedupe(fd.scan(numbered, rules.LINE_RULES)).collect()}
    by_files = {(r.path, f.rule_id) for r in fd.scan_files(files, rules.LINE_RULES).collect() for f in r.findings}
    assert by_lines == by_files
    assert not [c for i, c in enumerate(LINE_CASES) if (f"{i}/hit/{c[1]}", c[0]) not in by_lines or (f"{i}/miss/{c[1]}", c[0]) in by_lines]


def test_every_line_rule_has_a_case():
    assert {r.rule_id for r in rules.LINE_RULES} == {c[0] for c in LINE_CASES}


@pytest.mark.parametrize("variant", ["plain", "comments", "renamed", "blank"])
def test_syntax_rules_and_their_variants(spark, variant):
    """Comments, other names and blank lines before don't flip a verdict."""
    shift = 2 if variant in ("comments", "blank") else 0

    def changed(text):
        if variant == "comments":
            return "# one\n# two\n" + text
        if variant == "blank":
            return "\n\n" + text
        return text.replace("given", "asked_for") if variant == "renamed" else text

    files = spark.createDataFrame([(f"{i}/a.py", changed(text)) for i, (_, text, _) in enumerate(SYNTAX_CASES)], "path string, text string")
    found = {}
    for r in syntax.python_findings(src.from_table(files, "path", "text")).collect():
        found.setdefault((r.path, r.rule_id), set()).add(r.line)
    wrong = [c for i, c in enumerate(SYNTAX_CASES) if sorted(found.get((f"{i}/a.py", c[0]), ())) != [n + shift for n in c[2]]]
    assert not wrong


def test_tests_need_assertions(spark):
    text = "def test_x():\n    run()\n\ndef helper():\n    assert 1\n\ndef test_y():\n    helper()\n"
    files = spark.createDataFrame([("tests/test_a.py", text)], "path string, text string")
    assert [(r.rule_id, r.line) for r in syntax.python_findings(src.from_table(files, "path", "text")).collect()] == [("IL-306", 1)]


def test_interest_points_and_their_ledger(spark):
    from palisade.operators import governance

    text = "def h(n):\n    cur.execute('select 1')\n    cur.execute('select ' + n)\n    cur.execute('select ' + request.args['q'])\n    open('x')\n"
    files = spark.createDataFrame([("a.py", text), ("b.py", "def broken(:")], "path string, text string")
    points = syntax.python_points(src.from_table(files, "path", "text"))
    got = {(r.path, r.family, r.line): (r.state, r.evidence) for r in points.collect()}
    assert got[("a.py", "sql", 2)] == ("evidence_met", "closed_value") and got[("a.py", "sql", 3)] == ("unresolved", "") and got[("a.py", "sql", 4)] == ("evidence_met", "finding")
    assert got[("b.py", "command", 1)] == ("unsupported", "")
    ledger = {r.family: (r.total, r.gaps, r.status) for r in governance.ledger(points).collect()}
    assert ledger == {"sql": (4, 2, "unmet"), "path": (2, 1, "unmet"), "command": (1, 1, "unmet")}


def test_rules_fire_on_the_lines_of_their_own_files(spark):
    """What each rule finds in the files written for it, held against the lines where it has to."""
    corpus = spark.createDataFrame([(rule, path, text) for rule, path, text, _ in cases()], "wanted string, path string, text string")
    files = src.from_table(corpus.select("path", "text"), "path", "text")
    by_line = fd.scan_files(files, rules.LINE_RULES).selectExpr("path", "inline(findings)").select("path", "rule_id", "line")
    found = by_line.unionByName(syntax.python_findings(files).select("path", "rule_id", "line")).distinct()
    got = found.join(corpus.selectExpr("path", "wanted AS rule_id"), ["path", "rule_id"])
    assert {(r.rule_id, r.path, r.line) for r in got.collect()} == {(rule, path, line) for rule, path, _, lines in cases() for line in lines}


def test_needed_strings_are_in_every_hit(spark):
    """A line that a rule hits holds one of the strings looked for first, and a pattern that isn't understood names none."""
    assert fd.needed(r"(?i)api_?key\s*=|PASSW(?:or)?d") == ("api_key", "apikey", "passwd", "password")
    assert fd.needed(r"\b(?:x(?:it|test)|go)\(") == ("go(", "xit(", "xtest(")
    assert fd.needed(r"a|b*") == fd.needed(r"[a[bc]]") == fd.needed(r"\x{202A}") == fd.needed(r"a|(?i)b") == fd.needed("(?iu)k") == ()
    assert fd.needed(r"(?:ab)?c+dd") == ("dd",) and fd.needed(r"(ab){2,}z|q") == ("ab", "q")
    # most rules are told by strings, so prose meets hardly any pattern
    assert sum(not fd.needed(r.pattern) for r in rules.LINE_RULES) <= 3
    lines = spark.createDataFrame([("a.x", 1, "API_KEY = 1"), ("a.x", 2, "PassWord"), ("a.x", 3, "nothing")], "path string, line int, text string")
    one = [fd.LineRule("R", "LOW", r"(?i)api_?key\s*=|PASSW(?:or)?d")]
    assert sorted(r.line for r in fd.scan(lines, one).collect()) == [1, 2]
