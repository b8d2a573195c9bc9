"""Hash trees of snapshots: order, proofs, and differences by descent."""

import hashlib
import random

from pyspark.sql import functions as F

from palisade.operators import snapshots
from palisade.sources import files as sources


def frame(spark, rows, n=3):
    return spark.createDataFrame(rows, "path string, text string").repartition(n)


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(files, depth):
    """{(level, prefix): digest} by hand."""
    entries = {digest(p): digest(t or "") for p, t in files.items()}
    out, level = {}, {}
    for place, d in entries.items():
        level.setdefault(place[:depth], []).append((place, d))
    for at in range(depth, -1, -1):
        named = {p: digest("\n".join(f"{a}:{b}" for a, b in sorted(v))) for p, v in level.items()}
        out |= {(at, p): d for p, d in named.items()}
        level = {}
        for p, d in named.items():
            level.setdefault(p[: at - 1] if at else "", []).append((p, d))
    return out


def test_tree_equals_plain_hashing_in_any_order(spark):
    rng = random.Random(1)
    rows = [(f"dir{i % 7}/f{i}.py", rng.choice((None, "", f"text {i}"))) for i in range(400)]
    for depth in (1, 2, 3):
        got = {(r.level, r.prefix): r.digest for r in snapshots.tree(frame(spark, rows), depth).collect()}
        assert got == plain(dict(rows), depth)
    rng.shuffle(rows)
    assert {(r.level, r.prefix): r.digest for r in snapshots.tree(frame(spark, rows + rows[:50] + [(None, "x")], 5), 2).collect()} == plain(dict(rows), 2)


def test_difference_descends_into_differing_nodes(spark):
    rows = {f"f{i}": f"text {i}" for i in range(500)}
    after = {k: v for k, v in rows.items() if k not in ("f1", "f2")} | {"f3": "other", "new": "n"}
    a, b = frame(spark, list(rows.items())), frame(spark, list(after.items()))
    ta, tb = snapshots.tree(a, 2).cache(), snapshots.tree(b, 2).cache()
    got = {(r.path, r.change) for r in snapshots.difference(a, b, ta, tb, 2).collect()}
    assert got == {("f1", "removed"), ("f2", "removed"), ("f3", "changed"), ("new", "added")}
    assert snapshots.difference(a, a, ta, ta, 2).count() == 0
    none = a.limit(0)
    assert snapshots.difference(none, a, snapshots.tree(none, 2), ta, 2).count() == 500


def test_proofs(spark):
    rows = [(f"f{i}", f"text {i}") for i in range(300)]
    df = frame(spark, rows)
    root = snapshots.tree(df, 2).where("level = 0").first().digest
    asked = spark.createDataFrame([("f7",), ("f8",), ("absent",)], "path string")
    made = snapshots.proofs(df, asked, 2).cache()
    ok = lambda d: {r.path: r.ok for r in made.select("path", snapshots.proven(F.col("path"), d, F.col("proof"), F.lit(root)).alias("ok")).collect()}
    assert ok(F.col("digest")) == {"f7": True, "f8": True}
    assert ok(F.sha2(F.lit("forged"), 256)) == {"f7": False, "f8": False}
    assert {r.ok for r in made.select(snapshots.proven(F.lit("f9"), F.col("digest"), F.col("proof"), F.lit(root)).alias("ok")).collect()} == {False}
    longest = made.select(F.max(F.aggregate("proof", F.lit(0), lambda m, x: F.greatest(m, F.size(x))))).first()[0]
    assert longest <= 3 * snapshots.BUCKET


def test_code_digest_is_the_root(spark):
    rows = [(f"f{i}", f"text {i}") for i in range(40)]
    one, other = (sources.code_digest(frame(spark, r)).first() for r in (rows, rows[::-1]))
    assert one.files == 40 and one == other and one.digest == plain(dict(rows), 1)[0, ""][:16]
    assert sources.code_digest(frame(spark, rows[1:])).first().digest != one.digest
    assert snapshots.depth_for(0) == snapshots.depth_for(1024) == 1 and snapshots.depth_for(1025) == 2 and snapshots.depth_for(10**9) == 6


def test_plan_of_a_difference_grows_with_levels_and_no_faster(spark):
    rows = [(f"p{i}", f"t{i}") for i in range(50)]
    old, new = spark.createDataFrame(rows, "path string, text string"), spark.createDataFrame([*rows[1:], ("q", "t")], "path string, text string")
    sizes = []
    for depth in (2, 6):
        out = snapshots.difference(old, new, snapshots.tree(old, depth), snapshots.tree(new, depth), depth)
        sizes.append(len(out._jdf.queryExecution().analyzed().toString()))
        assert {(r.path, r.change) for r in out.collect()} == {("p0", "removed"), ("q", "added")}
    assert sizes[1] < 2 * sizes[0]
