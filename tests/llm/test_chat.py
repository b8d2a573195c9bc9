import hashlib
import random

import regex
from pyspark.sql import functions as F

from palisade.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "back\\slash \\. \\\\", "<|>", "<<SYS>>\n<</SYS>>", "", None, "line\nline", "é😀 <s>"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit("clash")).withColumn("window", F.lit("clash"))


def rows_of(seed, n=12):
    rng, out = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(1, 40)):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]
            out.append((c, t, role, rng.choice(NASTY) if rng.random() < 0.4 else "word " * rng.randint(0, 120)))
    return out


def test_round_trip_and_loss(spark):
    rows = rows_of(1) + [(99, 0, None, None), (99, 0, None, None), (None, 1, "user", "x"), (98, None, "assistant", "first")]
    formatted = chat.windows(frame(spark, rows), budget=200, history=2)
    turns = formatted.select("*")
    got = {}
    for r in chat.read_turns(turns).orderBy("conv_id", "window", "place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    want = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c, t, role, text in sorted(rows, key=key):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == want
    loss = {}
    for r in formatted.withColumn("m", chat.masked(F.col("text"), F.col("loss"))).orderBy("conv_id", "window").collect():
        loss.setdefault(r.conv_id, []).extend(r.m)
    assert loss == {c: [x for role, x in v if role == "assistant"] for c, v in want.items()}


def test_windows_keep_system_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, ("assistant", "user")[t % 2], f"turn {t} " + "w " * 50) for t in range(1, 30)]
    out = chat.windows(frame(spark, rows), budget=200, history=2).orderBy("window").collect()
    assert len(out) > 3
    for r in out[1:]:
        assert r.text.startswith("<|system|>\nbe kind<|end|>\n") and r.repeated == 1
        assert all(s.start >= r.text.index("turn", 40) for s in r.loss)


def test_escape_is_reversible_and_hides_control(spark):
    df = spark.createDataFrame([(t,) for t in NASTY if t is not None] + [("<<|>>|>[INST][/INST]<</SYS>>",)], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not any(x in r.e for x in ("<s>", "</s>", "[INST]", "[/INST]", "<|", "|>", "<<SYS>>", "<</SYS>>"))


def test_empty_and_digest(spark):
    assert chat.windows(frame(spark, [])).count() == 0
    r = chat.windows(frame(spark, [(1, 0, "assistant", "ok")])).first()
    assert hashlib.sha256(r.text[r.loss[0].start : r.loss[0].end].encode()).hexdigest() == hashlib.sha256(b"ok").hexdigest()


def test_windows_keep_the_budget(spark):
    """System turn and history are charged; only a single turn above the room goes beyond, alone and without history."""
    rng, rows = random.Random(6), [(c, 0, "system", "s " * (5 * c)) for c in range(8)]
    rows += [(c, t, ("assistant", "user")[t % 2], "w " * rng.choice((1, 10, 40, 90, 150))) for c in range(8) for t in range(1, 80)]
    rows += [(9, t, "user", "w " * n) for t, n in enumerate((10, 5000, 20, 300, 20_000, 5))]
    count = lambda text: len(regex.findall(chat.TOKEN, text)) + chat.TURN_TOKENS
    windows = chat.windows(frame(spark, rows), budget=400, history=3).collect()
    for r in windows:
        turns = regex.findall(chat.TURN, r.text)
        tokens = [count(t) for _, t in turns]
        room = max(400 - 100 - (tokens[0] if turns[0][0] == "system" else 0), 100)
        assert sum(tokens) <= 400 or r.turns - r.repeated == 1 and tokens[-1] > room and r.repeated <= (turns[0][0] == "system")
    assert sum(r.turns - r.repeated for r in windows) == len(rows) and max(r.repeated for r in windows) >= 3
    assert sum(r.turns - r.repeated for r in windows if r.conv_id < 8) > 2.5 * sum(r.conv_id < 8 for r in windows)


def test_one_very_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(3000)] + [(2, 0, "assistant", "x y " * 40_000)]
    out = chat.windows(frame(spark, rows), budget=64, history=1)
    got = [(r.role, r.text) for r in chat.read_turns(out).where("conv_id = 1").orderBy("window", "place").collect()]
    assert got == [(r, t) for _, _, r, t in rows[:-1]]
    (long,) = out.where("conv_id = 2").collect()
    assert long.text[long.loss[0].start : long.loss[0].end] == rows[-1][3]
