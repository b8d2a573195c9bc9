"""Queries of the code rules over documents: every line rule of the library in one pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators import findings as fd, rules, syntax
from palisade.plans.registry import query
from palisade.sources import files as src


@query()
def rule_library_scan(spark, tables):
    """All line rules of the library over all documents; most of them are for code, which these tables hardly hold."""
    documents = tables("documents").where("text IS NOT NULL").select(F.concat(F.lit("doc/"), "doc_id", F.lit(".txt")).alias("path"), "text")
    numbered = src.lines(src.from_table(documents, "path", "text"), ("path", "language", "kind", "is_test"))
    return fd.dedupe(fd.scan(numbered, rules.LINE_RULES)).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query()
def python_syntax_scan(spark, tables):
    """The rules over Python's syntax with all documents read as Python files; prose that can't be parsed, and a text that is skipped, is a diagnostic."""
    documents = tables("documents").select(F.concat(F.lit("doc/"), "doc_id", F.lit(".py")).alias("path"), "text")
    found = syntax.python_findings(src.from_table(documents, "path", "text"))
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))

