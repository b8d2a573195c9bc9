import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import ann, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("rank", F.lit("clash")).withColumn("score", F.lit("clash"))


def brute(rows, convert, zero, k=20, every=20):
    ok = [(n, i, convert(np.asarray(v, np.float32).astype(float))) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    ok = [(n, i, v) for n, i, v in ok if zero or np.any(v != 0)]
    out = []
    for n, i, v in ok:
        if i % every == 0:
            near = sorted(((-float((w * v).sum()), j) for m, j, w in ok if m != n and len(w) == len(v)))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def rows_of(n, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=dim).astype(np.float32).tolist()) for i in range(n)]


ODD = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [None] + [1.0] * 7), (1080, [float("inf")] * 8), (1100, [1.0, 2.0]), (1101, [2.0, 1.0]), (None, [1.0] * 8), (1120, [])]
SAME = [(2000 + i, [0.5] * 8) for i in range(60)]


def test_exact_search_equals_brute_force(spark):
    rows = rows_of(700) + ODD + SAME
    got = sorted((r.query_id, r["rank"], r.vec_id, float(r.score)) for r in topk.top_k(table(spark, rows)).collect())
    assert got == brute(rows, lambda v: np.floor(64 * v), True)


def test_integers_of_any_size(spark):
    """Components whose products leave 53 and 64 bits, in queries, in rows and in both."""
    rng = np.random.default_rng(5)
    big = [(i, (rng.choice([1.0, 1e6, 1e9, 3e16], size=8) * rng.normal(size=8)).tolist()) for i in range(60)]
    rows = big + [(100 + i, v) for i, v in rows_of(80)] + [(400, [1e300] * 8), (401, [-1e300] * 8)]
    ints = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows)]
    want = []
    for n, i, v in ints:
        if i % 20 == 0:
            near = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(1 << 63)), (1 << 63) - 1), j) for m, j, w in ints if m != n)[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df).collect()) == sorted(want)


def test_wider_groups_change_nothing(spark, monkeypatch):
    rows = rows_of(900) + SAME
    monkeypatch.setattr(vectors, "DATA_ROWS", 16)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 8)
    for wider in (1, 8):
        monkeypatch.setattr(vectors, "WIDER", wider)
        got = sorted((r.query_id, r["rank"], r.vec_id, float(r.score)) for r in topk.top_k(table(spark, rows)).collect())
        assert got == brute(rows, lambda v: np.floor(64 * v), True)


def test_recall_on_the_tables(spark):
    """The index as it is in use against brute force, on the embeddings of the small tables."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in df.collect()]
    want = brute(rows, lambda v: v, False)
    found = {(r.query_id, r.vec_id) for r in ann.nearest(df).collect()}
    assert len(found & {(q, v) for q, _, v, _ in want}) / len(want) >= 0.9


def test_few_rows_and_none(spark):
    for n in (0, 1, 2, 5):
        rows = rows_of(n)
        assert sorted((r.query_id, r["rank"], r.vec_id, float(r.score)) for r in topk.top_k(table(spark, rows)).collect()) == brute(rows, lambda v: np.floor(64 * v), True)
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(table(spark, rows)).collect())
        assert got == [x[:3] for x in brute(rows, lambda v: v, False)]


def test_repeated_rows_are_rows(spark):
    rows = [(0, [1.0, 0.0])] * 2 + [(1, [1.0, 0.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in topk.top_k(table(spark, rows)).collect())
    assert got == [(0, 1, 0), (0, 1, 0), (0, 2, 1), (0, 2, 1)]


def test_recall_and_scores(spark):
    rows = rows_of(6000, 16, 3) + ODD + [(3000 * 20 + i, [0.25] * 16) for i in range(40)]
    want = brute(rows, lambda v: v, False)
    got = ann.nearest(table(spark, rows)).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found & {(q, v) for q, _, v, _ in want}) / len(want) >= 0.9
    known = {i: np.asarray(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v}
    for r in got[::97]:
        assert r.score == pytest.approx(float(known[r.query_id] @ known[r.vec_id]), rel=1e-12, abs=1e-12)


def test_cover_tree_covers():
    data = np.random.default_rng(1).normal(size=(3000, 6))
    stack = [topk.tree(data)]
    while stack:
        node = stack.pop()
        assert np.sqrt(((data[node.points] - node.center) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
        stack.extend(node.children)
