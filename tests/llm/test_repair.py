import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from palisade.llm import repair
from palisade.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
TEXTS = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "Yes.", "two. parts", "é😀.", "end. \n"]
ROLES = ["system", "user", "assistant", "tool", None, "user", "assistant", "umpire", ""]


def cheapest(rows, faults):
    """(cost, letters, lines) of the cheapest repair, least letters first: shortest paths over (row, roles so far)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, at, state, lines = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", {"": "", "s": "s", "u": "su", "a": "sua"}[state]):
            return cost, letters, lines
        turn = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[turn]
        heapq.heappush(heap, (cost + 2, letters + "I", at, turn, (*lines, f"{name}:")))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 3, letters + "D", at + 1, state, lines))
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "truncated"
                heapq.heappush(heap, (cost + 2 + more, letters + "R", at + 1, turn, (*lines, f"{name}:{text}")))
                if role[:1] and role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[state]:
                    heapq.heappush(heap, (cost + more, letters + "K", at + 1, role[0], (*lines, f"{role}:{text}")))


def expected(rows):
    """All columns by conversation, from damaged rows (conv_id, turn, role, text)."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in mine:
            said = text.rstrip(SPACE)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, letters, lines = cheapest([r[1:] for r in mine], faults)
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = " " if text is None else text
        role = "user" if kind == 4 else " " if role is None else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("clash") for c in ("part", "edit", "cost", "whole", "n")})


def table(df):
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in columns) for r in rows}
    assert len(out) == len(rows)
    return out


def some(seed, n=150, most=9):
    rng, out = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(1, most)):
            out.append((c if c else None, rng.choice((t, t, t, None, 0)), rng.choice(ROLES), rng.choice(TEXTS)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_shortest_paths(spark, seed):
    rows = some(seed)
    assert table(repair.digests(repair.repair(frame(spark, rows)))) == expected(rows)


def test_one_conversation_over_many_partitions(spark):
    """A conversation that holds nearly all rows, with copies, is cut into portions and gives what it gives in one piece."""
    rng = random.Random(5)
    rows = [(7, rng.randint(0, 400), rng.choice(ROLES[:4]), rng.choice(["Yes.", "cut", "x " * rng.randint(1, 60) + rng.choice(".,")])) for _ in range(1200)]
    rows += [(7, 50, "user", "Again.")] * 40 + [(6, 1, "user", "Hi."), (8, None, None, None)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edits = repair.repair(frame(spark, rows)).cache()
        assert edits.where("conv_id = 7").select("part").distinct().count() > 8
        assert table(repair.digests(edits)) == expected(rows)
        assert edits.where("edit <> 'I'").count() == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_portions_of_every_length_agree():
    """Costs between states chain to the whole's cost, and the traced states to the whole's letters, wherever it is cut."""
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.randrange(4), rng.randrange(4), rng.choice((0, 0, 1))) for _ in range(rng.randint(2, 14))]
        whole, _ = repair.trace(rows, repair.START, None)
        at = rng.randrange(1, len(rows))
        behind = repair.between(rows[at:])
        ends = [min(c + e for c, e in zip(row, [0, 4, 2, 0]) if c is not None) for row in behind]
        first, state = repair.trace(rows[:at], repair.START, ends)
        second, _ = repair.trace(rows[at:], state, None)
        assert "".join(first + second) == "".join(whole)


def test_edges(spark):
    assert repair.digests(repair.repair(frame(spark, []))).count() == 0
    rows = [(None, None, None, None), (1, 5, "user", "Hello " * 100_000 + "."), (1, 6, "assistant", "Yes."), (2, 1, "system", "Only."), (3, (1 << 63) - 1, "user", "a."), (3, -(1 << 63), "user", "b.")]
    got, want = table(repair.digests(repair.repair(frame(spark, rows)))), expected(rows)
    assert got[3][0] == (1 << 63) - 1 < want[3][0]  # beyond a long, the largest
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()} and got[1] == want[1] and got[1][6] == "KK"


def test_registered_query(spark, tmp_path):
    rows = some(9, 120) + [(1000 + i, 0, "user", "Hi.") for i in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = dict.fromkeys({r[0] for r in rows}, nothing) | expected(damaged(rows))
    assert nothing in want.values()
    assert table(QUERIES["op11_repair"](spark, str(tmp_path))) == want


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert table(QUERIES["op11_repair"](spark, folder)) == dict.fromkeys({r[0] for r in rows}, nothing) | expected(damaged(rows))
