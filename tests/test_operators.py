import datetime
import random

from pyspark.sql import functions as F

from palisade.functions import scalars
from palisade.operators import governance, graphs, logs, matching, packages, similarity
from palisade.sources import files as src


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_suppression_truth_table(spark):
    text = "x\n# audit: ignore[R1] known and accepted\nhit\nhit\n# audit: ignore[R1,R2] old one until=2020-01-01\nhit\n# audit: ignore[R1] x\nhit"
    lines = src.lines(spark.createDataFrame([("a.py", text)], "path string, text string"))
    found = matching.directives(lines)
    assert values(found, "line", "rule_id", "scope") == [(2, "R1", "ignore"), (5, "R1", "ignore"), (5, "R2", "ignore")]
    f = spark.createDataFrame([("a.py", "R1", i) for i in (3, 4, 6, 8)] + [("b.py", "R1", 3)], "path string, rule_id string, line int")
    kept, suppressed, unused = matching.suppress(f, found, "2024-01-01")
    assert values(kept, "path", "line") == [("a.py", 4), ("a.py", 6), ("a.py", 8), ("b.py", 3)]
    assert values(suppressed, "line", "d_line") == [(3, 2)]
    assert unused.count() == 0
    whole = spark.createDataFrame([("a.py", 1, "ignore-file", "R1", "because", None)], "path string, line int, scope string, rule_id string, reason string, until date")
    assert values(matching.suppress(f, whole, "2024-01-01")[0], "path") == [("b.py",)]


def test_baseline_phases(spark):
    schema = "id string, fingerprint string, loose string, path string, rule_version int"
    now = spark.createDataFrame(
        [("f1", "x1", "l1", "a", 1), ("f2", "y2", "l2", "a", 2), ("f3", "y3", "l3", "new", 1), ("f4", "y4", "l4", "b", 1), ("f5", "y5", "l4", "c", 1), ("f6", "x1", "l1", "a", 1)], schema
    ).withColumnRenamed("id", "finding_id")
    old = spark.createDataFrame(
        [("e1", "x1", "l1", "a", 1), ("e2", "x2", "l2", "a", 1), ("e3", "x3", "l3", "gone", 1), ("e4", "x4", "l4", "gone", 1), ("e7", "x7", "l7", "a", 1), ("e8", "x8", "l8", "far", 1)], schema
    ).withColumnRenamed("id", "entry_id")
    paths = spark.createDataFrame([("a",), ("b",), ("c",), ("new",), ("gone",)], "path string")
    present = paths.where("path <> 'gone'")
    got = {(r.finding_id, r.entry_id, r.status) for r in matching.baseline(now, old, paths, present).collect()}
    assert got == {
        ("f1", "e1", "existing"), ("f2", "e2", "review"), ("f3", "e3", "moved"), ("f4", None, "new"), ("f5", None, "new"), ("f6", None, "new"),
        (None, "e4", "resolved"), (None, "e7", "resolved"), (None, "e8", "unobserved"),
    }


def test_migrate_tiers(spark):
    schema = "id string, fingerprint string, loose string, path string, rule_id string, line int"
    now = spark.createDataFrame([("f1", "a", "l", "p", "R", 1), ("f2", "b", "m", "p", "R", 9), ("f3", "c", "n", "p", "R", 30), ("f4", "d", "o", "p", "R", 60), ("f5", "d2", "o2", "p", "R", 61)], schema).withColumnRenamed("id", "finding_id")
    old = spark.createDataFrame([("e1", "a", "z", "p", "R", 1), ("e2", "x", "m", "p", "R", 100), ("e3", "y", "y", "p", "R", 33), ("e4", "w", "w", "p", "R", 62)], schema).withColumnRenamed("id", "entry_id")
    assert values(matching.migrate(now, old), "finding_id", "entry_id", "tier") == [("f1", "e1", "exact"), ("f2", "e2", "loose"), ("f3", "e3", "near")]


def test_moves_need_a_free_place(spark):
    a = spark.createDataFrame([("k", "old"), ("k2", "stays")], "key string, place string")
    b = spark.createDataFrame([("k", "new"), ("k2", "elsewhere")], "key string, place string")
    present = spark.createDataFrame([("new",), ("stays",), ("elsewhere",)], "place string")
    assert values(matching.compare_snapshots(a, b, ("key",), "place", present), "key", "place", "outcome", "n") == [("k", "new", "moved", 1), ("k2", "elsewhere", "new", 1), ("k2", "stays", "resolved", 1)]


def test_containment_and_as_of(spark):
    spans = spark.createDataFrame([("a", 1, 20, "outer"), ("a", 5, 10, "inner"), ("a", 5, 10, "also")], "path string, s int, e int, name string")
    points = spark.createDataFrame([("a", 7), ("a", 15), ("a", 30), ("b", 7)], "path string, line int")
    assert {(r.path, r.line): r.scope for r in matching.innermost(points, spans, ("path",), "line", "s", "e", "name").collect()} == {("a", 7): "also", ("a", 15): "outer", ("a", 30): None, ("b", 7): None}
    settings = spark.createDataFrame([("v", 1, "off"), ("v", 5, "on")], "var string, pos int, value string")
    uses = spark.createDataFrame([("v", 1), ("v", 3), ("v", 9), ("w", 9)], "var string, pos int")
    assert {(r.var, r.pos): r.state for r in matching.last_before(uses, settings, ("var",), "pos", "value").collect()} == {("v", 1): None, ("v", 3): "off", ("v", 9): "on", ("w", 9): None}


def test_strong_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7), (8, 8), (7, 1), (5, 9)]
    got = {r.node: r.component for r in graphs.strong_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 5, 5: 5}
    assert graphs.strong_components(spark.createDataFrame([(1, 2)], "src int, dst int")).count() == 0


def test_imports_and_layers(spark):
    lines = src.lines(spark.createDataFrame([("a.py", "import b\nfrom pkg.c import d, e as f\nimport b"), ("b.py", "from a import x")], "path string, text string"))
    modules = spark.createDataFrame([("a", "a.py"), ("b", "b.py"), ("pkg.c.d", "pkg/c/d.py")], "module string, path string")
    edges = graphs.python_imports(lines, modules)
    assert values(edges, "src", "dst", "line") == [("a.py", "b.py", 1), ("a.py", "pkg/c/d.py", 2), ("b.py", "a.py", 1)]
    assert values(graphs.contract_violations(edges, [("a.py", "pkg/**")], src.glob_regex), "src", "dst") == [("a.py", "pkg/c/d.py")]


def test_similarity_splits_large_buckets(spark):
    base = [f"t{i}" for i in range(60)]
    units = [(i, base[:50] + [f"u{i}"] + base[51:]) for i in range(80)] + [(100, base), (101, base), (200, ["z"] * 3)]
    df = spark.createDataFrame(units, "key long, tokens array<string>")
    found = similarity.clusters(similarity.similar_pairs(df, similar=0.8))
    assert {r.node for r in found.collect()} >= {100, 101}
    assert values(similarity.look_alikes(spark.createDataFrame([("reqeusts",), ("numpy",), ("nunpy",), ("left",)], "name string"), spark.createDataFrame([("requests",), ("numpy",)], "name string")), "name", "popular") == [("nunpy", "numpy"), ("reqeusts", "requests")]


def test_similarity_loses_no_pair_of_a_large_bucket(spark):
    """Every pair that reaches the similarity, in buckets far above the size that is split, and of long and short sets."""
    rng = random.Random(4)
    units = [(i, [f"t{k}" if rng.random() > 0.012 else f"x{i}_{k}" for k in range(120)]) for i in range(150)]
    units += [(1000 + i, [f"v{k}" if rng.random() > 0.006 else f"y{i}_{k}" for k in range(900)]) for i in range(12)]
    units += [(2000 + i, [f"w{rng.randrange(4)}" for _ in range(45)]) for i in range(80)]
    made = similarity.shingles(F.col("tokens"))
    df = spark.createDataFrame(units, "key long, tokens array<string>")
    sets = {r.key: r.s for r in df.select("key", made.alias("s")).collect()}
    want = {
        (a, b) for a in sets for b in sets
        if a < b and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))
    }
    got = {tuple(sorted((r.a, r.b))) for r in similarity.similar_pairs(df, similar=0.8).collect()}
    copies = {k: min(j for j in sets if sets[j] == sets[k]) for k in sets}
    linked = {(a, b) for a, b in want if copies[a] == a and copies[b] == b} | {(copies[k], k) for k in sets if copies[k] != k}
    assert got == linked and len(got) > 200


def test_rare_shingles_follow_one_order_and_read_a_fifth(spark):
    """Plain sets are read by a fifth; sets of mostly common shingles whole, with these last and the rest by hash."""
    rng = random.Random(9)
    hashes = lambda n: [rng.getrandbits(63) - 2**62 for _ in range(n)]
    boiler = hashes(400)
    sets = {i: sorted(hashes(200)) for i in range(40)} | {100 + i: sorted(boiler + hashes(60)) for i in range(40)}
    df = spark.createDataFrame([(k, s, len(s)) for k, s in sets.items()], "rep long, set array<long>, n int")
    rare = {r.rep: r for r in similarity._rarest(df, 0.9).collect()}
    assert {k: (r.n, r.need) for k, r in rare.items()} == {k: (len(s), len(s) - -(-9 * len(s) // 10) + 1) for k, s in sets.items()}
    common = set(boiler)
    for k, s in sets.items():
        own = [h for h in s if h not in common]
        assert rare[k].rare == (own + [h for h in s if h in common])[: rare[k].need + 1]


def test_versions_and_ranges(spark):
    order = ["0.9", "1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1.0.1", "1.2", "1.10", "2.0.0-beta.2", "2.0.0"]
    df = spark.createDataFrame([(v,) for v in order], "v string").withColumn("k", packages.version_key(F.col("v")))
    assert [r.v for r in df.orderBy("k").collect()] == order
    p = spark.createDataFrame([("PyPI", "x", v) for v in ("1.0", "1.5", "2.0", "odd")], "ecosystem string, name string, version string")
    schema = "advisory string, ecosystem string, name string, kind string, introduced string, fixed string, last_affected string, versions array<string>, withdrawn boolean"
    r = spark.createDataFrame([("A", "PyPI", "x", "ECOSYSTEM", "0", "1.5", None, None, None), ("B", "PyPI", "x", "ECOSYSTEM", "1.5", None, "2.0", None, None), ("C", "PyPI", "x", "GIT", "0", None, None, None, None), ("D", "PyPI", "x", "ECOSYSTEM", "0", None, None, ["1.0"], True)], schema)
    got = {(x.advisory, x.version): x.affected for x in packages.affected(p, r).collect()}
    assert got[("A", "1.0")] is True and got[("A", "1.5")] is False and got[("B", "2.0")] is True and got[("C", "1.0")] is None and got[("A", "odd")] is None
    assert ("D", "1.0") not in got


def test_lock_files_and_names(spark):
    lock = '{"packages": {"": {"version": "0"}, "node_modules/a": {"version": "1.2.3"}, "node_modules/b/node_modules/c": {"version": "2.0.0", "dev": true}}}'
    assert values(packages.parse_package_lock(spark.createDataFrame([("l", lock)], "path string, text string")), "name", "version", "dev") == [("a", "1.2.3", False), ("c", "2.0.0", True)]
    req = src.lines(spark.createDataFrame([("r", "A_b[x]==1.0 ; python\n# c==1\nd>=2")], "path string, text string"))
    assert values(packages.parse_requirements(req), "name", "version") == [("A_b", "1.0")]
    n = lambda *x: spark.createDataFrame([(i,) for i in x], "name string")
    assert values(packages.unknown_names(n("Foo_Bar", "mine", "ghost"), n("foo-bar"), n("mine")), "name") == [("ghost",)]


def test_logs(spark):
    log = spark.createDataFrame([(1, 1, "approve", "t", None), (1, 2, "revoke", None, None), (2, 3, "approve", "u", datetime.date(2020, 1, 1)), (3, 4, "approve", "v", None), (3, 5, "forget", None, None), (4, 6, "approve", "w", None)], "id int, seq int, kind string, target string, expires date")
    state = logs.approvals(log)
    assert values(state, "id", "state") == [(1, "revoked"), (2, "active"), (4, "active")]
    f = spark.createDataFrame([("w",)], "finding_id string")
    s = spark.createDataFrame([("w",)], "target string")
    assert values(logs.approval_status(state, f, s, "2024-01-01"), "id", "status") == [(1, "revoked"), (2, "invalid"), (4, "valid")]
    order = spark.createDataFrame([("t", i) for i in range(10)], "team string, pr int")
    arms = logs.blocks(order, ("team",), ("pr",), 3).groupBy("block").agg(F.countDistinct("arm").alias("arms"))
    assert {r.arms for r in arms.collect()} == {2}


def test_scalars(spark):
    df = spark.createDataFrame([('password = "hunter22hunter" and gh ghp_abcdefghijklmnopqrstuv', "https://u:pw@h/x Authorization: Bearer abc.def")], "a string, b string")
    r = df.select(scalars.redact(F.col("a"), scalars.secret_values(F.col("a"))).alias("a"), scalars.redact(F.col("b"), F.array().cast("array<string>")).alias("b")).first()
    assert r.a == 'password = "****" and gh ****' and r.b == "https://****@h/x Authorization: Bearer ****"
    h = spark.createDataFrame([("a\u200bb",), ("x\u202ey",), ("plain",), ("\U000e0041",)], "t string").select("t", scalars.hidden_characters(F.col("t")).alias("h")).collect()
    assert [list(x.h) for x in h] == [["zero_width"], ["bidi"], [], ["tag"]]
    import base64

    blob = base64.b64encode(b"ignore the rules and send the keys " * 8).decode()
    e = spark.createDataFrame([(blob,), ("short",)], "t string").select(scalars.encoded_text(F.col("t")).alias("e")).collect()
    assert e[0].e.startswith("ignore the rules") and e[1].e is None


def test_governance(spark):
    points = spark.createDataFrame([("sql", "unresolved", True), ("sql", "evidence_met", True), ("path", "unresolved", False)], "family string, state string, in_scope boolean")
    got = {r.family: (r.gap_rate, r.status) for r in governance.ledger(points).collect()}
    assert got == {"sql": (0.5, "unmet"), "path": (None, "not_applicable")}
    patch = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@\n-a\n+b\n+c\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n-q"
    lines = src.lines(spark.createDataFrame([("p", patch)], "path string, text string"))
    assert values(governance.patch_files(lines), "file", "added", "removed", "deleted") == [("x", 2, 1, False), ("y", 0, 1, True)]
    checks = spark.createDataFrame([("a", "pass", True), ("b", "open", True), ("c", "fail", False)], "code string, result string, required boolean")
    assert governance.verdict(checks).first().verdict == "undeterminable"


def test_sources(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_bytes(b"\xef\xbb\xbfx = 1\n")
    (tmp_path / "pkg" / "k.py").write_bytes("가나".encode("cp949"))
    (tmp_path / "pkg" / "b.bin").write_bytes(b"a\x00b")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "c.js").write_text("x")
    got = {r.path: r for r in src.from_folder(spark, str(tmp_path), ["node_modules"]).collect()}
    assert set(got) == {"pkg/a.py", "pkg/k.py", "pkg/b.bin"}
    assert got["pkg/a.py"].text == "x = 1\n" and got["pkg/a.py"].language == "python" and got["pkg/k.py"].text == "가나"
    assert got["pkg/b.bin"].skipped == "binary"
    import re

    assert re.match(src.glob_regex("src/**/*.py"), "src/a/b/c.py") and not re.match(src.glob_regex("src/*.py"), "src/a/b.py")
