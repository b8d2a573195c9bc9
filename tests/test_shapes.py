"""Shape checks against a plain walk over parsed JSON."""

import json
import random

from palisade.operators import shapes


def kind(v):
    return "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def nodes(v, path="$", place="$"):
    yield path, place, v
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        yield from nodes(x, path + (f".{k}" if isinstance(v, dict) else "[*]"), place + (f".{k}" if isinstance(v, dict) else f"[{k}]"))


def plain(doc, spec):
    out, there = set(), {}
    for path, place, v in nodes(doc):
        there.setdefault(path, []).append((place, v))
    for path, wanted, required, allowed, low, high, code in spec:
        for place, v in there.get(path, []):
            if v is None:
                continue
            if kind(v) != wanted and not (wanted == "number" and kind(v) == "integer"):
                out.add((code, place, "type"))
            elif allowed and v not in allowed:
                out.add((code, place, "value"))
            elif low is not None and v < low or high is not None and v > high:
                out.add((code, place, "range"))
        if required and "." in path:
            above, _, name = path.rpartition(".")
            out |= {(code, f"{place}.{name}", "missing") for place, v in there.get(above, []) if isinstance(v, dict) and v.get(name) is None}
    return out


def report(rng):
    pick = lambda *v: rng.choice(v)
    entry = lambda: {"rule_id": pick("AI-1", None, 7), "severity": pick("HIGH", "LOW", "huge"), "path": "a.py", "line": pick(0, 3, "x", 2.5), "fingerprint": "f"}
    out = {
        "schema_version": pick("1.8", 1), "tool": pick({"name": "n", "version": "1"}, {}, None), "as_of": "d", "passed": pick(True, "yes"), "summary": {"total": pick(3, -1), "files": 2, "by_severity": {"CRITICAL": 0, "HIGH": pick(1, 1.5)}},
        "findings": [entry() for _ in range(rng.randint(0, 3))], "approvals": pick([], [{"id": "a", "fingerprint": "f", "status": pick("valid", "odd")}], {}), "checks": [{"name": "c", "result": "pass", "required": pick(True, None)}],
        "coverage": [], "ledger": [{"rule_id": "r", "runs": pick(1, -2), "failures": 0}, 5], "trust": {"level": pick("full", "most"), "reasons": ["r", pick("s", 4)]}, "future": {"field": [1]},
    }
    return {k: v for k, v in out.items() if rng.random() < 0.9}


def found(spark, rows, spec):
    df = spark.createDataFrame(rows, "key long, body string")
    got = shapes.problems(shapes.flatten(df, "key", "body"), shapes.spec(spark, spec)).collect()
    assert len(got) == len(set(got))
    return {(r.id, r.code, r.place, r.problem) for r in got}


def test_reports_equal_a_plain_walk(spark):
    rng = random.Random(7)
    docs = [report(rng) for _ in range(60)]
    got = found(spark, [(i, json.dumps(d)) for i, d in enumerate(docs)], shapes.REPORT)
    want = {(i, *p) for i, d in enumerate(docs) for p in plain(d, shapes.REPORT)}
    assert got == want
    assert len({w[1] for w in want}) > 25 and {w[3] for w in want} == {"missing", "type", "value", "range"}
    assert len({s[6] for s in shapes.REPORT}) >= 40


def test_edges(spark):
    rows = [(1, None), (2, "{broken"), (3, "[]"), (4, "null"), (5, "{}"), (6, '{"a": {"a": {"a": [[1, [null]]]}}}')]
    spec = [shapes.expect("$", "object", "doc"), shapes.expect("$.a", "object", "a", True), shapes.expect("$.a.a.a[*][*]", "integer", "deep")]
    assert found(spark, rows, spec) == {(1, "document", "$", "unreadable"), (2, "document", "$", "unreadable"), (3, "doc", "$", "type"), (5, "a", "$.a", "missing"), (6, "deep", "$.a.a.a[0][1]", "type")}
    assert found(spark, [], spec) == set()


def test_missing_fields_are_told_without_a_shuffle(spark):
    """Each node was brought together with its parent by a shuffle of all nodes."""
    df = spark.createDataFrame([(1, '{"a": {"b": null, "c": 1}, "d": [{"b": 2}, {}]}')], "key long, body string")
    spec = [shapes.expect("$.a.b", "integer", "b", True), shapes.expect("$.a.c", "integer", "c", True), shapes.expect("$.d[*].b", "integer", "e", True)]
    got = shapes.problems(shapes.flatten(df, "key", "body"), shapes.spec(spark, spec))
    assert {(r.id, r.code, r.place, r.problem) for r in got.collect()} == {(1, "b", "$.a.b", "missing"), (1, "e", "$.d[1].b", "missing")}
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
