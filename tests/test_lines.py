"""Line maps give the new text back byte for byte; renames against a plain count."""

import random
from collections import Counter

from pyspark.sql import functions as F

from palisade.operators import lines


def edited(rng, old):
    out = list(old)
    for _ in range(rng.randint(0, 6)):
        at, kind = rng.randint(0, len(out)), rng.random()
        if kind < 0.4:
            out.insert(at, rng.choice(["new", "}", "", f"line {rng.randint(0, 99)}"]))
        elif out and kind < 0.7:
            del out[at % len(out)]
        elif out:
            out.insert(at, out.pop(at % len(out)))
    return out


def longest(values):
    best = []
    for v in values:
        best.append(1 + max((b for b, w in zip(best, values) if w < v), default=0))
    return max(best, default=0)


def test_map_is_a_pairing_with_the_longest_run_of_anchors():
    rng = random.Random(2)
    for _ in range(300):
        old = [rng.choice(["}", "", f"line {i}", f"line {i}"]) for i in range(rng.randint(0, 25))]
        new = edited(rng, old)
        rows = lines.matched(old, new)
        count = Counter(k for k, _, _ in rows)
        assert sorted(i for _, i, _ in rows if i) == list(range(1, len(old) + 1)) and sorted(j for _, _, j in rows if j) == list(range(1, len(new) + 1))
        assert all(old[i - 1] == new[j - 1] for k, i, j in rows if k in ("same", "moved"))
        same = sorted((i, j) for k, i, j in rows if k == "same")
        assert all(a < c and b < d for (a, b), (c, d) in zip(same, same[1:]))
        once = {x for x in old if old.count(x) == 1 and new.count(x) == 1}
        assert sum(old[i - 1] in once for i, _ in same) >= longest([new.index(x) for x in old if x in once])
        if old == new:
            assert set(count) <= {"same"}


def test_patches_rebuild_every_text(spark):
    rng, rows, texts = random.Random(3), [], {}
    for p in range(60):
        old = [rng.choice(["}", "", f"line {i}", "é\t", "x\r"]) for i in range(rng.randint(0, 40))]
        new = edited(rng, old) if p % 7 else []
        texts[p] = new
        rows += [(p, "old", i + 1, t) for i, t in enumerate(old)] + [(p, "new", i + 1, t) for i, t in enumerate(new)]
    df = spark.createDataFrame(rows, "pair long, side string, line int, text string").withColumn("kind", F.lit("clash"))
    made = lines.patch(df.drop("kind"))
    assert made.where("kind <> 'added' AND text IS NOT NULL").count() == 0
    got = {}
    for r in lines.apply_patch(df.where("side = 'old'"), made).collect():
        got.setdefault(r.pair, []).append((r.line, r.text))
    assert {p: [t for _, t in sorted(v)] for p, v in got.items()} == {p: t for p, t in texts.items() if t}


def test_map_edges(spark):
    df = spark.createDataFrame([(1, "old", 1, None), (1, "new", 1, ""), (2, "new", 1, "a"), (3, "old", 1, "b")], "pair long, side string, line int, text string")
    assert {(r.pair, r.kind) for r in lines.line_map(df).collect()} == {(1, "same"), (2, "added"), (3, "removed")}
    assert lines.line_map(df.limit(0)).count() == 0


def test_renames(spark):
    body = lambda k, n: "\n".join(f"statement {k} of file number {i}" for i in range(n))
    old = [("a.py", body("a", 10)), ("b.py", body("b", 10)), ("same.py", body("s", 4)), ("gone.py", "short\n}"), (None, "x"), ("null.py", None)]
    new = [("lib/a.py", body("a", 8) + "\nsomething entirely new here"), ("c.py", body("c", 10) + "\n" + body("b", 2)), ("same.py", body("q", 4)), ("copy1.py", body("b", 10))]
    frame = lambda rows: spark.createDataFrame(rows, "path string, text string")
    got = {(r.old_path, r.new_path, r.shared) for r in lines.renames(frame(old), frame(new)).collect()}
    assert got == {("a.py", "lib/a.py", 8), ("b.py", "copy1.py", 8)}  # two of b's lines stand in c.py as well
    assert lines.renames(frame(old[:0]), frame(new)).count() == 0


def test_renames_are_found_once_for_a_patch(spark):
    """Each use of the renamed pairs ran the search for them again, and moved every line's text for it."""
    from palisade.plans.catalog import QUERIES

    plan = QUERIES["patched_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "posexplode(" in plan and " explode(" not in plan
