"""Strong components of long and of random graphs; baselines with a key that most rows share."""

import random

from palisade.operators import graphs, matching, scratch


def reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        n = todo.pop()
        for b in edges.get(n, ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def components(pairs):
    edges = {}
    for a, b in pairs:
        if a != b:
            edges.setdefault(a, set()).add(b)
    reached = {n: reach(edges, n) for n in edges}
    out = {}
    for n in edges:
        same = {m for m in reached[n] if n in reached.get(m, ())}
        if len(same) > 1:
            out[n] = max(same)
    return out


def found(spark, pairs, schema="src long, dst long"):
    rows = graphs.strong_components(spark.createDataFrame(pairs, schema)).collect()
    out = {r.node: r.component for r in rows}
    assert len(out) == len(rows)
    return out


def test_random_graphs(spark):
    rng = random.Random(8)
    pairs = []
    for g in range(40):
        n = rng.randint(2, 12)
        pairs += [(100 * g + rng.randrange(n), 100 * g + rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))]
    pairs += [(None, 1), (1, None)]
    want = components([p for p in pairs if None not in p])
    assert len(want) > 30, len(want)
    assert found(spark, pairs) == want


def test_long_paths_and_cycles_take_few_rounds(spark, monkeypatch):
    """A path of 10,000 nodes, a cycle of 5,000, and two cycles joined by a path: rounds grow with the logarithm of the length."""
    counts = []
    keep = scratch.Scratch.keep
    monkeypatch.setattr(scratch.Scratch, "keep", lambda *a, **b: counts.append(1) or keep(*a, **b))
    cycle = lambda lo, n: [(lo + i, lo + (i + 1) % n) for i in range(n)]
    pairs = [(i, i + 1) for i in range(10_000)] + cycle(20_000, 5_000) + cycle(30_000, 3) + cycle(40_000, 700) + [(30_000, 50_000), (50_000, 50_001), (50_001, 40_000)]
    want = dict.fromkeys(range(20_000, 25_000), 24_999) | dict.fromkeys(range(30_000, 30_003), 30_002) | dict.fromkeys(range(40_000, 40_700), 40_699)
    assert found(spark, pairs) == want
    assert len(counts) < 60


def test_baseline_with_a_shape_that_most_rows_share(spark):
    findings = [(f"n{i}", f"fp{i}", "hot", f"p{i}", 1) for i in range(400)] + [("m", "fm", "rare", "new.py", 1), ("r", "fr", "other", "same.py", 2)]
    known = [(f"e{i}", f"old{i}", "hot", f"q{i}", 1) for i in range(400)] + [("em", "oldm", "rare", "gone.py", 1), ("er", "oldr", "other", "same.py", 1)]
    paths = lambda rows: spark.createDataFrame([(r,) for r in rows], "path string")
    out = matching.baseline(
        spark.createDataFrame(findings, "finding_id string, fingerprint string, loose string, path string, rule_version int"),
        spark.createDataFrame(known, "entry_id string, fingerprint string, loose string, path string, rule_version int"), paths(["q1", "same.py"]), paths(["same.py", "new.py"]),
    ).collect()
    status = {(r.finding_id, r.entry_id): r.status for r in out}
    assert status["m", "em"] == "moved" and status["r", "er"] == "review" and status["n1", None] == "new" and status[None, "e1"] == "resolved" and status[None, "e2"] == "unobserved"
    assert len(out) == 802


def test_reach_gives_a_tile_s_pairs_once(spark):
    """Tiles of any size give the fewest steps; a dense step makes no row for each node in between."""
    rng = random.Random(11)
    for name in (lambda n: n, lambda n: f"n{n}"):
        kind = "long" if name(1) == 1 else "string"
        pairs = [(name(rng.randrange(40)), name(rng.randrange(40))) for _ in range(90)]
        want = {}
        for s in {a for a, _ in pairs}:
            front = {s}
            for d in range(1, 5):
                front = {b for a, b in pairs if a in front}
                for b in front:
                    want.setdefault((s, b), d)
        edges = spark.createDataFrame([*pairs, (None, name(1)), (name(1), None)], f"src {kind}, dst {kind}")
        for block in (3, 1024):
            rows = graphs.reach(edges, edges.select(edges.src.alias("node")), 4, block).collect()
            assert len(rows) == len(want) and {(r.start, r.node): r.depth for r in rows} == want
    import numpy as np

    start, node = graphs._onward(np.array([1, 1, 2, 3]), np.array([7, 8, 8, 9]), np.array([7, 7, 8]), np.array([4, 5, 5]))
    assert list(zip(start.tolist(), node.tolist())) == [(1, 4), (1, 5), (2, 5)]
    full = [(a, b) for a in range(60) for b in range(60)]
    edges = spark.createDataFrame(full, "src long, dst long")
    assert graphs.reach(edges, edges.select(edges.src.alias("node")), 3, 16).where("depth = 1").count() == 3600


def test_reach_keeps_bits_not_rows(spark):
    """What is written on the way is far below a byte for each reached pair, in tiles of any size; each source is a start."""
    import os

    from palisade.operators.scratch import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(folder) for n in names)
    n, jumps = 700, (1, 5, 23, 101, 149, 260)
    steps = {(a, b): 1 for a in range(n) for b in ((a + j) % n for j in jumps)}
    ways = {a: [b for b in ((a + j) % n for j in jumps)] for a in range(n)}
    front = list(steps)
    for d in (2, 3):
        front = [p for p in {(a, c) for a, b in front for c in ways[b]} if p not in steps]
        steps |= dict.fromkeys(front, d)
    edges = spark.createDataFrame([(a, b) for a, out in ways.items() for b in out], "src long, dst long")
    before = size()
    out = graphs.reach(edges, edges.select(edges.src.alias("node")).distinct())
    got = {(r.start, r.node): r.depth for r in out.collect()}
    assert got == steps and len(got) > 40_000
    assert size() - before < 2 * len(got)
    rows = graphs.reach(edges, block=300).collect()
    assert len(rows) == len(steps) and {(r.start, r.node): r.depth for r in rows} == steps


def test_tiles_keep_their_bits():
    import numpy as np

    rng = np.random.default_rng(5)
    for block in (3, 64, 100):
        wide = -(-block // 8)
        for part in (0, 0.001, 0.03, 0.5, 1):
            bits = np.packbits(rng.random((8 * wide, 8 * wide)) < part, axis=1, bitorder="little")
            assert (graphs._bits(graphs._coded(bits), block) == bits).all()
