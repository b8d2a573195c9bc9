"""Chat formatting in budgeted windows. DataFrame operations only.

Each turn becomes `<|role|>`, a line break, its escaped text, `<|end|>`, a line break. Control strings of common
templates can't survive in a text: behind the first character of each a backslash and a dot are put, and a backslash is
doubled, which `unescape` reverses exactly.

Prefix sums of the turns' tokens choose the windows, which begin and end at turns; a turn is never split. A window after
the first repeats the conversation's system turn, and as many of the last `history` turns of the window before it as a
quarter of the budget holds. Both are charged: what a window has room for is the budget without that quarter and the
system turn, a quarter of the budget at least. The room divides the prefix sums into cells. The turns that lie in a cell
are a window; the turn that crosses its end joins them if it fits the room, and else is a window of its own. So a window
has at most `budget` tokens, unless a single turn has more than the room (it is alone then, with the system turn but no
history) or the system turn has more than half of the budget. Repeated turns come first in a window, are counted in its
`repeated` column, and never carry loss, so each assistant text is a target exactly once.

Prefix sums are taken in blocks of `BLOCK` turn numbers and over the blocks' totals, so a very long conversation is
spread over tasks (turns of one number aren't); nothing but a window's turns is ever collected. Reading whole
conversations back, as digests of them need, gathers a conversation in one task and is left to those who need it.

Defined cases: null texts and roles are empty; a null conversation is a conversation; turns order by number (null
first), role, text; repeated rows are turns of their own; other columns are ignored; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.llm.common import cut

BUDGET, HISTORY, BLOCK = 1024, 2, 64
#: Tokens of a text, by rule: runs of letters, runs of digits and single other marks; and those that mark a turn.
TOKEN, TURN_TOKENS = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]", 4
#: Control strings that a text must not hold: fixed values of common templates.
CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|<\||\|>"
END = "<|end|>\n"
TURN = r"(?s)<\|(.*?)\|>\n(.*?)<\|end\|>\n"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, rf"(?=({CONTROL}))(.)", r"$2\\.")


def unescape(text: Column) -> Column:
    # a backslash is either doubled or followed by the dot that was put in
    return F.regexp_replace(text, r"\\(?:(\\)|\.)", "$1")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, names: tuple = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """(conv_id, window, text, repeated, turns, loss): loss is an array of (start, end), code points of text."""
    conv, turn, role, text = names
    rows = conversations.select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("tokens", (F.regexp_count("text", F.lit(TOKEN)) + TURN_TOKENS).cast("long")).withColumn(
        "block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("long")
    )
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = rows.groupBy("conv", "block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    kept = budget // 4  # for history
    first = rows.where("role = 'system'").groupBy(F.col("conv").alias("conv1")).agg(F.min(F.struct("turn", "text", "tokens")).alias("s"))
    room = F.greatest(F.lit(budget - kept) - F.coalesce("s.tokens", F.lit(0)), F.lit(max(1, kept))).cast("long")
    offsets = blocks.select(
        F.col("conv").alias("conv0"), F.col("block").alias("block0"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
    ).join(first, F.col("conv0").eqNullSafe(F.col("conv1")), "left").select("conv0", "block0", "t0", "n0", room.alias("room"))
    placed = (
        rows.withColumn("at", F.sum("tokens").over(upto) - F.col("tokens")).withColumn("place", F.count("*").over(upto))
        .join(offsets, F.col("conv").eqNullSafe(F.col("conv0")) & (F.col("block") == F.col("block0")))
        .select("conv", "role", "text", "tokens", "room", (F.col("n0") + F.col("place")).alias("place"), (F.col("t0") + F.col("at")).alias("before"))
        .withColumn("cell", F.floor(F.col("before") / F.col("room")))
        .withColumn("crosses", F.col("before") + F.col("tokens") > (F.col("cell") + 1) * F.col("room"))
    )
    placed = cut(placed)  # read several times below
    filled = placed.where("NOT crosses").groupBy(F.col("conv").alias("c"), F.col("cell").alias("l")).agg(F.sum("tokens").alias("filled"))
    # a cell has one turn at most that crosses its end
    crossing = placed.where("crosses").join(filled, F.col("conv").eqNullSafe(F.col("c")) & (F.col("cell") == F.col("l")), "left")
    alone = F.coalesce("filled", F.lit(0)) + F.col("tokens") > F.col("room")
    names_ = ["conv", "role", "text", "tokens", "place"]
    placed = (
        placed.where("NOT crosses").select(*names_, (2 * F.col("cell")).alias("window"), F.lit(False).alias("big"))
        .unionByName(crossing.select(*names_, (2 * F.col("cell") + alone.cast("long")).alias("window"), (F.col("tokens") > F.col("room")).alias("big")))
    )
    placed = cut(placed)
    spans = placed.groupBy("conv", "window").agg(F.max("place").alias("last"), F.max("big").alias("big"))
    after = Window.partitionBy("conv").orderBy("window")
    spans = spans.withColumn("next", F.lead("window").over(after)).withColumn("full", F.lead("big").over(after))
    latest = Window.partitionBy("conv", "window").orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    history_ = (
        placed.join(
            spans.where("next IS NOT NULL AND NOT full").select(F.col("conv").alias("c"), F.col("window").alias("w"), "last", "next"),
            F.col("conv").eqNullSafe(F.col("c")) & (F.col("window") == F.col("w")),
        )
        .where(F.col("place") > F.col("last") - history)  # at most `history` turns of each window
        .withColumn("upto", F.sum("tokens").over(latest)).where(F.col("upto") <= kept)
        .select("conv", F.col("next").alias("window"), "place", "role", "text")
    )
    systems = placed.where("role = 'system'").groupBy("conv").agg(F.min(F.struct("place", "window", "role", "text")).alias("s"))
    retained = (
        spans.select(F.col("conv").alias("c"), F.col("window").alias("w"))
        .join(systems, F.col("c").eqNullSafe(F.col("conv")) & (F.col("w") > F.col("s.window")))
        .select(F.col("c").alias("conv"), F.col("w").alias("window"), "s.place", "s.role", "s.text")
    )
    again = history_.unionByName(retained).distinct().withColumn("fresh", F.lit(False))
    full = placed.select("conv", "window", "place", "role", "text").withColumn("fresh", F.lit(True)).unionByName(again)
    grouped = full.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("fresh", "place", "role", "text"))).alias("t"))

    head = lambda t: F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>\n"))
    parts = F.transform("t", lambda t: F.struct(t["fresh"].alias("fresh"), (t["role"] == "assistant").alias("target"), head(t).alias("head"), escape(t["text"]).alias("body")))

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + len(END)).alias("at"),
            F.when(p["fresh"] & p["target"], F.concat(state["loss"], span)).otherwise(state["loss"]).alias("loss"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    return (
        grouped.withColumn("p", parts)
        .select(
            F.col("conv").alias("conv_id"),
            "window",
            F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("text"),
            F.size(F.filter("p", lambda p: ~p["fresh"])).alias("repeated"),
            F.size("p").alias("turns"),
            F.aggregate("p", start, step, lambda s: s["loss"]).alias("loss"),
        )
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, place, role, text): the turns that windows hold for the first time, read from their text."""
    turns = F.arrays_zip(F.regexp_extract_all("text", F.lit(TURN), F.lit(1)).alias("role"), F.regexp_extract_all("text", F.lit(TURN), F.lit(2)).alias("text"))
    fresh = F.slice(turns, F.col("repeated") + 1, F.greatest(F.col("turns") - F.col("repeated"), F.lit(0)))
    return formatted.select("conv_id", "window", F.posexplode(fresh).alias("place", "t")).select(
        "conv_id", "window", "place", unescape(F.col("t")["role"]).alias("role"), unescape(F.col("t")["text"]).alias("text")
    )


def masked(text: Column, loss: Column) -> Column:
    """The texts under the mask, unescaped, one for each span."""
    return F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["end"] - s["start"])))
