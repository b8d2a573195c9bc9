"""Data flow against a plain worklist and against paths walked with an explicit stack."""

import collections
import random

import pytest

from palisade.operators import flow, scratch


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def worklist(steps, defs, uses):
    """(unit, node, var, def) by sets at each node's entry, until nothing changes."""
    out_of, sure = collections.defaultdict(set), collections.defaultdict(bool)
    for u, a, b in steps:
        out_of[u, a].add(b)
    for u, n, v, s in defs:
        sure[u, n, v] |= bool(s)
    entry = collections.defaultdict(set)
    todo = {(u, n) for u, n, _, _ in defs}
    while todo:
        u, n = todo.pop()
        kept = {(v, d) for v, d in entry[u, n] if not sure.get((u, n, v))} | {(v, n) for x, m, v, _ in defs if (x, m) == (u, n)}
        for b in out_of[u, n]:
            if not kept <= entry[u, b]:
                entry[u, b] |= kept
                todo.add((u, b))
    return {(u, n, v, d) for u, n, v in uses for w, d in entry[u, n] if w == v}


def graph(rng, unit, n):
    steps = [(unit, i, i + 1) for i in range(n - 1) if rng.random() < 0.9]
    steps += [(unit, rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, n // 2))]
    defs = [(unit, rng.randrange(n), rng.choice("xy"), rng.random() < 0.6) for _ in range(n // 2 + 1)]
    return steps, defs, [(unit, rng.randrange(n), rng.choice("xyz")) for _ in range(n)]


def reached(spark, steps, defs, uses):
    out = flow.reaching_definitions(
        frame(spark, steps, "unit long, src long, dst long"), frame(spark, defs, "unit long, node long, var string, sure boolean"), frame(spark, uses, "unit long, node long, var string")
    ).collect()
    assert len(out) == len(set(out))
    return {(r.unit, r.node, r.var, r["def"]) for r in out}


def test_definitions_equal_a_worklist(spark):
    rng = random.Random(4)
    parts = [graph(rng, u, rng.randint(1, 14)) for u in range(60)]
    # closed runs without an entry, a long straight run, a self loop, repeated rows
    parts.append(([(100, 1, 2), (100, 2, 3), (100, 3, 1)], [(100, 2, "x", True), (100, 3, "y", False)], [(100, n, v) for n in (1, 2, 3) for v in "xy"]))
    parts.append(([(101, i, i + 1) for i in range(300)] + [(101, 300, 0)], [(101, 7, "x", False), (101, 90, "x", True), (101, 90, "x", False)], [(101, n, "x") for n in (0, 7, 8, 90, 91, 300)]))
    parts.append(([(102, 1, 1)] * 2, [(102, 1, "x", True)], [(102, 1, "x")] * 2))
    steps, defs, uses = ([r for p in parts for r in p[k]] for k in range(3))
    want = worklist(steps, defs, uses)
    assert (101, 0, "x", 90) in want and (100, 1, "x", 2) in want
    assert reached(spark, steps, defs, uses) == want


def test_definitions_edges(spark):
    assert reached(spark, [], [], []) == set()
    assert reached(spark, [(None, 1, 2), (1, 1, None), (1, 1, 2)], [(1, 1, "x", None), (1, None, "x", True)], [(1, 2, "x"), (None, 2, "x")]) == {(1, 2, "x", 1)}


def test_rounds_follow_branches_not_length(spark, monkeypatch):
    """A straight run of 2,000 nodes takes a few more rounds than one of 20."""
    counts = []
    keep = scratch.Scratch.keep
    monkeypatch.setattr(scratch.Scratch, "keep", lambda *a, **b: counts.append(1) or keep(*a, **b))
    for n in (20, 2000):
        counts.clear()
        steps = [(1, i, i + 1) for i in range(n)] + [(1, n, 0)]
        assert reached(spark, steps, [(1, 3, "x", True)], [(1, 2, "x"), (1, n, "x")]) == {(1, 2, "x", 3), (1, n, "x", 3)}
    assert len(counts) < 30


def test_small_units_are_solved_after_one_shuffle(spark, monkeypatch):
    """Units of a few rows need one table and no rounds; the plainer path for large ones finds the same."""
    rng = random.Random(11)
    steps, defs, uses = ([r for p in parts for r in p] for parts in zip(*(graph(rng, u, rng.randint(1, 14)) for u in range(40))))
    tables, shuffles = [], []
    keep, cut = scratch.Scratch.keep, flow._cut
    monkeypatch.setattr(scratch.Scratch, "keep", lambda *a, **b: tables.append(1) or keep(*a, **b))
    monkeypatch.setattr(flow, "_cut", lambda df: shuffles.append(1) or cut(df))
    want = worklist(steps, defs, uses)
    assert reached(spark, steps, defs, uses) == want and len(want) > 100
    assert (len(tables), len(shuffles)) == (1, 1)
    for small, bits in ((0, 64), (12, 64), (256, 3)):
        monkeypatch.setattr(flow, "SMALL", small)
        monkeypatch.setattr(flow, "BITS", bits)
        assert reached(spark, steps, defs, uses) == want


def test_all_bits_of_a_word(spark):
    """64 definitions of one variable fill a word; one more makes the unit a large one."""
    for n in (64, 65):
        steps, defs = [(1, i, i + 1) for i in range(n)], [(1, i, "x", False) for i in range(n)]
        assert reached(spark, steps, defs, [(1, n, "x")]) == {(1, n, "x", i) for i in range(n)}


def walked(program, limit):
    """All hits by a search over (function, slot, path of functions entered, open calls that will return)."""
    flows, params, returns, args, results, sources, sinks = program
    best = {}
    for f, s in set(sources):
        todo, seen = collections.deque([(f, s, True, (f,), ())]), set()
        while todo:
            state = todo.popleft()
            if state in seen:
                continue
            seen.add(state)
            fn, slot, rising, path, nest = state
            if not nest and (fn, slot) in sinks:
                key, way = (f, s, fn, slot), (len(path) - 1, path)
                best[key] = min(best.get(key, way), way)
            todo.extend((fn, b, rising, path, nest) for g, a, b in flows if (g, a) == (fn, slot))
            for site, g, callee, place, at in args:
                if (g, at) != (fn, slot):
                    continue
                for h, p, enter in params:
                    if (h, p) == (callee, place):
                        if len(nest) < limit:
                            todo.append((h, enter, rising, path, (*nest, site)))
                        if not nest and len(path) <= limit:
                            todo.append((h, enter, False, (*path, h), ()))
            if (fn, slot) in returns:
                for site, g, callee, at in results:
                    if callee == fn and nest and nest[-1] == site:
                        todo.append((g, at, rising, path, nest[:-1]))
                    if callee == fn and not nest and rising and len(path) <= limit:
                        todo.append((g, at, True, (*path, g), ()))
    return {(*k, d, p) for k, (d, p) in best.items()}


def program(rng, functions=6, slots=5):
    pick, some = lambda: rng.randrange(slots), lambda: rng.randrange(functions)
    flows = [(f, a, b) for f in range(functions) for a in range(slots) for b in range(slots) if a != b and rng.random() < 0.18]
    params = [(f, p, p) for f in range(functions) for p in range(2)]
    returns = [(f, slots - 1) for f in range(functions)]
    args, results = [], []
    for site in range(functions * 2):
        f, callee = some(), some()  # calls of oneself among them
        args += [(site, f, callee, p, pick()) for p in range(2)]
        if rng.random() < 0.8:
            results.append((site, f, callee, pick()))
    return flows, params, returns, args, results, [(some(), pick()) for _ in range(3)], [(some(), pick()) for _ in range(4)]


SCHEMAS = (
    "fn long, src long, dst long", "fn long, place long, slot long", "fn long, slot long", "site long, fn long, callee long, place long, slot long",
    "site long, fn long, callee long, slot long", "fn long, slot long", "fn long, slot long",
)


def hits(spark, made, limit):
    out = flow.sink_hits(*(frame(spark, rows, s) for rows, s in zip(made, SCHEMAS)), limit=limit).collect()
    return {(r.source_fn, r.source, r.sink_fn, r.sink, r.depth, tuple(r.path)) for r in out}


@pytest.mark.parametrize("limit", [1, 3])
def test_hits_equal_walked_paths(spark, limit):
    """Several programs at once, with recursion; functions of different programs don't meet."""
    rng, whole, want = random.Random(limit), [[] for _ in SCHEMAS], set()
    for k in range(30):
        one = program(rng)
        base = 100 * k
        shift = lambda r, fns: tuple(v + base if i in fns else v for i, v in enumerate(r))
        moved = [[shift(r, fns) for r in rows] for rows, fns in zip(one, ((0,), (0,), (0,), (0, 1, 2), (0, 1, 2), (0,), (0,)))]
        want |= walked(moved, limit)
        for all_, mine in zip(whole, moved):
            all_ += mine
    assert len(want) > 15 and len({w[4] for w in want}) > 1
    assert hits(spark, whole, limit) == want


def test_hits_edges(spark):
    assert hits(spark, [[]] * 7, 2) == set()
    # a source that is the sink; a value returned by a callee; a callee that passes its argument on; nulls
    made = [[(2, 0, 9), (None, 1, 2)], [(2, 0, 0), (3, None, 0)], [(2, 9), (5, 1)], [(7, 1, 2, 0, 4)], [(7, 1, 2, 6), (8, 1, 5, 3)], [(1, 4), (5, 1), (5, None)], [(1, 6), (1, 4), (1, 3), (2, 9)]]
    assert hits(spark, made, 2) == {(1, 4, 1, 4, 0, (1,)), (1, 4, 1, 6, 0, (1,)), (1, 4, 2, 9, 1, (1, 2)), (5, 1, 1, 3, 1, (5, 1))}


def test_a_long_function_takes_no_rounds(spark, monkeypatch):
    """A value that passes 40 slots inside a function costs as many intermediate tables as one that passes none."""
    cuts, cut = [], flow._cut
    monkeypatch.setattr(flow, "_cut", lambda df: cuts.append(1) or cut(df))
    chain = [(1, i, i + 1) for i in range(40)]
    # the call of itself is a link that a level adds, so the function is solved again
    made = (chain, [(1, 0, 0)], [(1, 40)], [(7, 1, 1, 0, 20)], [(7, 1, 1, 20)], [(1, 0)], [(1, 40)])
    assert hits(spark, made, 1) == walked(made, 1) == {(1, 0, 1, 40, 0, (1,))}
    assert len(cuts) <= 8
