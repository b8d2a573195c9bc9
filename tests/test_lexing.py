"""Views of code against a lexer that reads character by character; rules and suppressions by them."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from palisade.operators import findings as fd, lexing, matching, rules
from palisade.sources import files as src


def upto(text, at, close, escapes, lines):
    """Where a token ends that goes on from `at`."""
    while at < len(text):
        if not lines and text[at] == "\n":
            return at
        if escapes and text[at] == "\\":
            at = min(at + 2, len(text))
        elif text.startswith(close, at):
            return at + len(close)
        else:
            at += 1
    return at


def to_line_end(text, at):
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def heredoc(text, at):
    m = re.compile(r"<<-?[ \t]*([\"']?)([A-Za-z_]\w*)\1").match(text, at)
    if not m or text[at - 1 : at] == "<" and at:
        return None
    if text.startswith("<<<", at):
        return None
    at = to_line_end(text, m.end())
    while at < len(text):
        end = to_line_end(text, at + 1)
        if text[at + 1 : end].strip(" \t") == m[2]:
            return end
        at = end
    return at


def lexed(text, family):
    """(kind, start, end) of the tokens."""
    out, at = [], 0
    while at < len(text):
        kind, end = None, at + 1
        c, before = text[at], text[at - 1] if at else "\n"
        word = before.isalnum() or before == "_"
        if family == "python" and text[at : at + 3] in ("'''", '"""'):
            kind, end = "s", upto(text, at + 3, text[at : at + 3], True, True)
        elif family == "jvm" and text.startswith('"""', at):
            kind, end = "s", upto(text, at + 3, '"""', True, True)
        elif family == "script" and c == "`":
            kind, end = "s", upto(text, at + 1, c, True, True)
        elif family in ("python", "script", "jvm", "c") and c in "'\"":
            kind, end = "s", upto(text, at + 1, c, True, False)
        elif family == "shell" and heredoc(text, at):
            kind, end = "s", heredoc(text, at)
        elif family == "shell" and c in "'\"":
            kind, end = "s", upto(text, at + 1, c, c == '"', True)
        elif family == "hash" and c in "'\"" and not word:
            kind, end = "s", upto(text, at + 1, c, c == '"', False)
        elif family == "sql" and c == '"':
            kind, end = "s", upto(text, at + 1, c, False, True)
        elif family == "sql" and c == "'":
            end = at + 1
            while end < len(text) and (text[end] != "'" or text[end + 1 : end + 2] == "'"):
                end += 2 if text[end] == "'" else 1
            kind, end = "s", min(end + 1, len(text))
        elif family == "python" and c == "#" or family == "hash" and c == "#" and before in " \t\n" or family == "shell" and c == "#" and before in " \t\n;&|()":
            kind, end = "c", to_line_end(text, at)
        elif family in ("script", "jvm", "c") and text.startswith("//", at) or family == "sql" and text.startswith("--", at):
            kind, end = "c", to_line_end(text, at)
        elif family in ("script", "jvm", "c", "sql") and text.startswith("/*", at):
            kind, end = "c", upto(text, at + 2, "*/", False, True)
        elif family == "markup" and text.startswith("<!--", at):
            kind, end = "c", upto(text, at + 4, "-->", False, True)
        elif c == "\\" and family not in lexing.UNESCAPED and at + 1 < len(text):
            kind, end = "e", at + 2
        if kind:
            out.append((kind, at, end))
        at = end
    return out


def view(text, family, shown):
    out = [c if "x" in shown or c in "\r\n" else " " for c in text]
    for kind, a, b in lexed(text, family):
        for i in range(a, b):
            out[i] = text[i] if kind in shown or text[i] in "\r\n" else " "
    return "".join(out)


BITS = ["'", '"', "'''", '"""', "`", "#", " # ", "//", "/*", "*/", "*", "/", "--", "<!--", "-->", "-", "\\", "\\n", "\n", "\n", " ", "a", "word", "x = ", "é😀", "<<EOF", "\nEOF\n", "<<-'T'", "\n\tT\n", "<<<EOF", ";", "\r\n"]


@pytest.mark.parametrize("family", ["python", "script", "jvm", "c", "shell", "sql", "hash", "markup"])
def test_views_equal_a_plain_lexer(spark, family):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    which = F.lit(family)
    rows = df.select("text", lexing.code(F.col("text"), which).alias("code"), lexing.code_without_strings(F.col("text"), which).alias("bare"), lexing.comments(F.col("text"), which).alias("comments")).collect()
    for r in rows:
        assert r.code == view(r.text, family, "xse"), r.text
        assert r.bare == view(r.text, family, "xe"), r.text
        assert r.comments == view(r.text, family, "c"), r.text


def test_long_texts_take_proportional_time(spark):
    long = ["'''" + "x\\'" * 40_000, "/*" + "* " * 40_000, "# " + "'" * 120_000, "<<EOF\n" + "line\n" * 40_000, '"' * 120_000, "'" + "a''" * 40_000, "<!-" * 40_000 + "<!--" + "- " * 40_000, "\\" * 120_001]
    df = spark.createDataFrame([(t,) for t in long] + [(None,), ("",)], "text string")
    began = time.time()
    for family in lexing.FAMILIES:
        rows = df.select("text", lexing.code(F.col("text"), F.lit(family)).alias("code"), lexing.comments(F.col("text"), F.lit(family)).alias("c")).collect()
        assert all(r.text is None and r.code is None or len(r.code) == len(r.c) == len(r.text) for r in rows)
    assert time.time() - began < 90


def test_rules_look_at_code_and_suppressions_at_comments(spark):
    text = 'h = "a"\n# verify=False in old code\nrequests.get(u, verify=False)  # audit: ignore[IL-106] internal host\nnote = "audit: ignore[IL-106] never meant"\n"""\nverify=False\n"""\n# smtp_password = hunter2hunter2\n'
    files = src.from_table(spark.createDataFrame([("app/a.py", text), ("app/b.txt", "verify=False"), ("app/n.py", None)], "path string, text string"), "path", "text")
    seen = lexing.with_views(files)
    found = lambda f: sorted((r.path, x.line) for r in fd.scan_files(f, rules.LINE_RULES).collect() for x in r.findings if x.rule_id == "IL-106")
    assert found(files) == [("app/a.py", 2), ("app/a.py", 3), ("app/a.py", 6), ("app/b.txt", 1)]
    assert found(seen) == [("app/a.py", 3), ("app/a.py", 6), ("app/b.txt", 1)]  # strings stay visible to rules
    ids = {x.rule_id: x.line for r in fd.scan_files(seen, rules.LINE_RULES).collect() for x in r.findings if x.rule_id == "IL-111"}
    assert ids == {"IL-111": 8}
    assert [(r.path, r.line) for r in matching.comment_directives(seen).collect()] == [("app/a.py", 3)]
    plain = matching.directives(src.lines(files))
    assert sorted(r.line for r in plain.collect()) == [3, 4]
