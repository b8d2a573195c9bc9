"""Names and calls against a plain look-up over all files."""

import random

from palisade.operators import resolve


def names(path):
    parts = path.rsplit(".", 1)[0].split("/")
    parts = parts[:-1] if parts[-1] in ("__init__", "index") else parts
    return {".".join(parts[i:]) for i in range(len(parts))} - {""}


def module(origin, name, files):
    found = [f for f in sorted(set(files)) if name in names(f)]
    shared = lambda f: next((i for i, (a, b) in enumerate(zip(origin.split("/"), f.split("/"))) if a != b), min(len(origin.split("/")), len(f.split("/"))))
    top = [f for f in found if shared(f) == max(map(shared, found))]
    return (top[0], "found") if len(top) == 1 else (None, "ambiguous" if top else "missing")


def call(path, callee, argc, imports, files, functions):
    parts = callee.split(".")
    for k in range(len(parts), 0, -1):
        mine = sorted((-(line or 0), m, member or "") for p, line, local, m, member in imports if (p, local) == (path, ".".join(parts[:k])))
        if mine:
            _, owner, member = mine[0]
            break
    else:
        return None, None, "unbound"
    if member and k == len(parts):
        function = member
    elif k == len(parts):
        return None, None, "unbound"
    else:
        owner, function = ".".join([owner, *([member] if member else []), *parts[k:-1]]), parts[-1]
    target, state = module(path, owner, files)
    if state != "found":
        return None, None, state
    return (target, function, "found") if (target, function, argc) in functions else (None, None, "no_function")


def test_calls_equal_a_plain_look_up(spark):
    rng = random.Random(6)
    words, names_of = ["a", "b", "c", "util"], lambda n: "/".join(rng.choice(["a", "b", "c", "util"]) for _ in range(n))
    files = sorted({names_of(rng.randint(1, 4)) + rng.choice((".py", ".py", "/__init__.py")) for _ in range(60)}) + ["__init__.py"]
    functions = [(rng.choice(files), rng.choice("fgh"), rng.randint(0, 1)) for _ in range(160)]
    imports, calls = [], []
    for f in files:
        for _ in range(5):
            local = ".".join(rng.choice(words) for _ in range(rng.choice((1, 1, 2))))
            imports.append((f, rng.choice((1, 2, 3)), local, ".".join(rng.choice(words) for _ in range(rng.randint(1, 3))), rng.choice((None, None, "f", "util"))))
        for _ in range(8):
            calls.append((f, ".".join([*(rng.choice(words) for _ in range(rng.randint(0, 3))), rng.choice("fgh")]), rng.randint(0, 1)))
        calls += [(f, local, 0) for p, _, local, _, _ in imports if p == f]
    got = resolve.resolve_calls(
        spark.createDataFrame(calls * 2, "path string, callee string, argc int"), spark.createDataFrame(imports, "path string, line int, local string, module string, member string"),
        spark.createDataFrame([(f,) for f in files * 2] + [(None,)], "path string"), spark.createDataFrame(functions, "path string, name string, argc int"),
    ).collect()
    want = {(p, c, n, *call(p, c, n, imports, files, set(functions))) for p, c, n in calls}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {w[5] for w in want} == {"found", "no_function", "ambiguous", "missing", "unbound"}


def test_many_files_of_one_name_make_no_pairs(spark):
    """300 files answer to `util`: the index has one row for a prefix, and a question is as many rows as its path has parts."""
    files = spark.createDataFrame([(f"p{i}/util.py",) for i in range(300)], "path string")
    index = resolve.module_index(files)
    assert index.where("name = 'util' AND head = ''").first().files == 300
    asked = spark.createDataFrame([("p7/main.py", "util"), ("q/main.py", "util"), ("q/main.py", "p9.util")], "path string, module string")
    out = {(r.path, r.module): (r.target, r.state) for r in resolve.resolve_modules(asked, files).collect()}
    assert out == {("p7/main.py", "util"): ("p7/util.py", "found"), ("q/main.py", "util"): (None, "ambiguous"), ("q/main.py", "p9.util"): ("p9/util.py", "found")}


def test_calls_of_plain_imports_are_dealt_once(spark):
    """Binding deals each side out once and makes no row for each part of a name; without dotted imports nothing follows."""
    calls = spark.createDataFrame([(f"p{i % 7}.py", f"m{i % 5}.a.b.run", i % 2) for i in range(200)], "path string, callee string, argc int")
    imports = spark.createDataFrame([(f"p{i}.py", 1, f"m{k}", "x.y", None) for i in range(7) for k in range(4)], "path string, line int, local string, module string, member string")
    began = max([-1, *spark.sparkContext.statusTracker().getJobIdsForGroup("bound")])
    spark.sparkContext.setJobGroup("bound", "bound")
    out = resolve.bound(calls, imports)
    rows = {tuple(r) for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rows == {(f"p{i % 7}.py", f"m{i % 5}.a.b.run", i % 2, "x.y.a.b" if i % 5 < 4 else None, "run" if i % 5 < 4 else None) for i in range(200)}
    assert "Exchange" not in plan and "Generate" not in plan
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("bound") if j > began for s in tracker.getJobInfo(j).stageIds if (info := tracker.getStageInfo(s)) and info.numCompletedTasks}
    assert len(stages) <= 6  # each side dealt, joined and written, looked at for dotted ones, and read


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    calls = spark.createDataFrame([("a.py", "x.f", 1)], "path string, callee string, argc int")
    imports, files, functions = none("path string, line int, local string, module string, member string"), none("path string"), none("path string, name string, argc int")
    assert [r.state for r in resolve.resolve_calls(calls, imports, files, functions).collect()] == ["unbound"]
    assert resolve.resolve_calls(calls.limit(0), imports, files, functions).count() == 0


def test_no_side_that_grows_is_broadcast(spark, monkeypatch):
    """A driver would have to hold it: only functions of a counted number of rows are, and the result is the same with many."""
    from palisade.operators import scratch
    from palisade.plans.catalog import QUERIES

    plans, keep = [], scratch.Scratch.keep
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(scratch.Scratch, "keep", lambda self, df, *a, **b: plans.append(plan(df)) or keep(self, df, *a, **b))
    few = QUERIES["resolved_part_calls"](spark, "/root/testdata/sf0.001")
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]
    assert plan(few).count("BroadcastHashJoin") == 1
    monkeypatch.setattr(resolve, "FEW", 0)
    many = QUERIES["resolved_part_calls"](spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in plan(many) and not [p for p in plans if "BroadcastHashJoin" in p]
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) != []
