"""Dependency paths against a plain breadth-first search, VEX by its table of cases; fragments against all substrings."""

import collections
import random

from pyspark.sql import functions as F

from palisade.operators import fragments, reachability


def shortest(edges, root):
    """{name: least path} by breadth-first search, children in order of their paths."""
    out, front = {root: (root,)}, {root: (root,)}
    while front:
        new = {}
        for name, path in front.items():
            for a, b in edges:
                if a == name and b not in out:
                    new[b] = min(new.get(b, (*path, b)), (*path, b))
        out |= new
        front = new
    return out


def test_paths_equal_a_search(spark):
    rng, edges, roots, targets, want = random.Random(3), [], [], [], set()
    for scope in range(12):
        own = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(14)]
        mine, aims = {f"n{rng.randrange(9)}" for _ in range(2)}, {f"n{rng.randrange(9)}" for _ in range(3)}
        edges += [(scope, a, b) for a, b in own * 2]
        roots += [(scope, r) for r in mine]
        targets += [(scope, t) for t in aims]
        for r in mine:
            want |= {(scope, r, t, len(p) - 1, p) for t, p in shortest(own, r).items() if t in aims}
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    edges += [(None, "n1", "n2"), (0, None, "n1")]
    got = reachability.dependency_paths(frame(edges, "scope int, parent string, child string"), frame(roots, "scope int, name string"), frame(targets, "scope int, name string")).collect()
    assert {(r.scope, r.root, r.name, r.depth, tuple(r.path)) for r in got} == want and len(got) == len(want) > 15


def test_vex_table(spark):
    edges = [("l", "app", "a", False), ("l", "app", "b", True), ("l", "app", "c", None), ("l", "a", "d", False), ("l", "b", "d", False), ("l", "b", "e", False), ("l", "c", "f", False)]
    packages = [("l", n, True) for n in "abcdef"] + [("l", "a", None), ("l", "x", None), ("l", "clean", False), ("l", "app", None), ("l", "y", True)]
    out = reachability.vex_statements(
        spark.createDataFrame(packages, "scope string, name string, affected boolean"), spark.createDataFrame(edges, "scope string, parent string, child string, dev boolean"),
        spark.createDataFrame([("l", "app")], "scope string, name string"),
    ).collect()
    got = {r.name: (r.status, ">".join(r.path) if r.path else None) for r in out}
    assert got == {
        "a": ("affected", "app>a"), "b": ("not_affected", "app>b"), "c": ("under_investigation", "app>c"), "d": ("affected", "app>a>d"), "e": ("not_affected", "app>b>e"),
        "f": ("under_investigation", "app>c>f"), "x": ("not_affected", None), "app": ("under_investigation", "app"), "y": ("not_affected", None),
    }


def test_union_equals_painted_cells(spark):
    rng = random.Random(4)
    rows = [(k, a, a + rng.randint(-1, 9)) for k in range(20) for a in (rng.randrange(60) for _ in range(rng.randint(1, 14)))] + [(1, None, 5), (1, 5, None)]
    got = collections.defaultdict(list)
    for r in fragments.union_of(spark.createDataFrame(rows * 2, "k int, start int, end int"), "k").collect():
        got[r.k].append((r.start, r.end))
    for k in range(20):
        cells = {c for q, a, b in rows if q == k and a is not None and b is not None for c in range(a, b)}
        edges = sorted(c for c in cells if c - 1 not in cells), sorted(c + 1 for c in cells if c + 1 not in cells)
        # cells that touch are one interval
        assert sorted(got[k]) == list(zip(*edges))


def test_fragments_equal_all_substrings(spark):
    rng = random.Random(5)
    secret = lambda: "".join(rng.choice("abcdé😀12") for _ in range(rng.choice((5, 8, 12, 20))))
    texts, secrets = [], []
    for p in range(40):
        own = [secret() for _ in range(rng.randint(0, 3))]
        bits = [s[i : i + rng.randint(1, 14)] for s in own for i in range(0, len(s), 3)] + ["plain words", "x", *own]
        texts.append((f"p{p}", "".join(rng.choice(bits) for _ in range(8))))
        secrets += [(f"p{p}", s) for s in own]
    texts += [("null", None), ("empty", "")]
    secrets += [("null", "abcdefghij"), ("empty", "abcdefghij"), ("none", "abcdefghij"), ("p1", None)]
    t, s = spark.createDataFrame(texts, "path string, text string"), spark.createDataFrame(secrets, "path string, secret string")
    found = fragments.fragments(t, s)
    got = collections.defaultdict(list)
    for r in found.collect():
        got[r.path].append((r.start, r.end))
    out = {r.path: r.text for r in fragments.masked(t.withColumn("end", F.lit("clash")), found).collect()}
    for path, text in texts:
        grams = {x[i : i + 8] for p, x in secrets if p == path and x for i in range(len(x) - 7)}
        cells = {c for i in range(len(text or "") - 7) if text[i : i + 8] in grams for c in range(i, i + 8)}
        starts, ends = sorted(c for c in cells if c - 1 not in cells), sorted(c + 1 for c in cells if c + 1 not in cells)
        assert sorted(got[path]) == list(zip(starts, ends))
        want, at = "", 0
        for a, b in zip(starts, ends):
            want, at = want + text[at:a] + fragments.MASK, b
        assert out[path] == (None if text is None else want + text[at:])
    assert len(got) > 10


def test_statements_of_all_classes_come_from_one_search(spark, monkeypatch):
    """Random graphs with edges of every kind; three searches over the edges took three times the disk of one."""
    calls, plain = [], reachability.leading_to
    monkeypatch.setattr(reachability, "leading_to", lambda *a: calls.append(1) or plain(*a))
    rng = random.Random(5)
    edges = [(s, rng.randrange(8), rng.randrange(8), rng.choice([True, False, None])) for s in range(25) for _ in range(14)]
    edges += [e for e in edges if rng.random() < 0.1] + [(s, a, b, True) for s, a, b, _ in edges[:20]]
    roots, packages = [(s, r) for s in range(25) for r in (0, 1)], [(s, n, rng.choice([True, None])) for s in range(25) for n in range(8)]
    want = {}
    for s, name, _ in packages:
        for k, kinds in enumerate([(False,), (False, None), (False, None, True)]):
            front, seen, best = {r: [r] for x, r in roots if x == s}, set(), []
            for root in front:
                at, seen = {root: [root]}, {root}
                while at and name not in at:
                    step = {}
                    for n, path in at.items():
                        for c in {c for x, p, c, d in edges if x == s and p == n and d in kinds} - seen:
                            step[c] = min(step.get(c, path + [c]), path + [c])
                    at, seen = step, seen | set(step)
                best += [(len(at[name]) - 1, root, at[name])] if name in at else []
            if best:
                want[s, name] = min(best)
                break
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = reachability.vex_statements(frame(packages, "scope long, name long, affected boolean"), frame(edges, "scope long, parent long, child long, dev boolean"), frame(roots, "scope long, name long")).collect()
    assert {(r.scope, r.name): (r.depth, r.root, list(r.path)) for r in rows if r.root is not None} == want
    assert len(rows) == len(packages) and len(calls) == 1
