"""Repair of conversations: the cheapest edits that make the roles follow `(s?(ua)+)?`, by layers of cost.

Edits: a row is kept (K, 0), given the role user or assistant (R, 2) or deleted (D, 3; blank rows and duplicates have to
be), and empty turns of user or assistant are inserted anywhere (I, 2). A truncated row that isn't deleted adds 1. Roles
count by their initial; the role that an edit gives is fixed by the grammar's state, so the letters tell the whole repair.

Method: for every turn there is one bitset of grammar states for each cost: the states from which what follows can be
accepted at that cost or less. The layers ahead of a row come from those behind it by bit operations, one cost after the
other (`_before`); layers are kept relative to the lowest that isn't empty, so few distinct ones exist and each step is
remembered in a table. At the front the first layer that holds the start state is the cost. The trace then goes forward and
takes at each step the letter that comes first in ASCII among those that the layers still allow.

Conversations of any length are spread: rows are ranged by (conversation, turn) over partitions, and a conversation
that lies in several is a chain of portions. A portion first yields the cost between each two states (layers again, from each
state at its end); at most two portions of a partition have neighbours, so what the driver chains is bounded by the number
of partitions. It hands each such portion the costs behind it, then the state in which it is entered. Exact copies are counted
before anything is ranged and come back as rows in the result.

Defined cases: null roles and texts are one space (such a text is blank, such a role can't be kept); null turns come first;
a null id is a conversation of its own; rows with one turn are ordered by role, then by the text's first 64 characters,
then by its SHA-256; a role without an initial can't be kept; repeated rows are duplicates; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm.common import cut, ship, shuffle_width

#: Grammar states: nothing yet, after s, after u, after a. A conversation may end with nothing or after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = 1 << START | 1 << AFTER_A
#: Where an inserted turn or a new role leads, and where a kept one does, by the role's initial.
GIVEN = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
KEPT = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
INITIALS = ("s", "u", "a", "")
TRUNCATED, BLANK, DUPLICATE = 1, 2, 3
FAULTS = ("", "truncated", "blank", "duplicate")
DELETE, GIVE, INSERT, UNENDED = 3, 2, 2, 1
LEGAL = ("su", "ua", "au")
BATCH_ROWS, BATCH_CHARS, BLOCK = 2048, 1 << 22, 1 << 20


def damage(conversations: DataFrame) -> DataFrame:
    """conversations with faults put in by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes its `[.!?]`,
    3 repeats it, 4 makes it a user's. Nulls are one space, but for ids and turns themselves."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind, text = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20, space("text")
    read = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("__kind"),
    )
    copies = F.when(F.col("__kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return read.where("__kind <> 0").withColumn("__copy", F.explode(copies)).drop("__kind", "__copy")


# --- layers --------------------------------------------------------------------------------------------------------


def _pre(step: dict[int, int]) -> list[int]:
    """For each set of states, the states that `step` leads into it."""
    return [sum(1 << a for a, b in step.items() if x >> b & 1) for x in range(16)]


_GIVEN, _KEPT = _pre(GIVEN), [_pre(KEPT.get(i, {})) for i in INITIALS]


def _layers(at, count: int) -> tuple[int, tuple[int, ...]]:
    """(lowest cost that holds a state, layers from there on); the last layer holds for all higher costs.

    at: the states that each cost gives without an insertion.
    """
    out: list[int] = []
    for c in range(count + 4 * INSERT):
        out.append(at(c) | (_GIVEN[out[c - INSERT]] if c >= INSERT else 0) | (out[-1] if out else 0))
    low = next(c for c, x in enumerate(out) if x)
    high = next(c for c, x in enumerate(out) if x == out[-1])
    return low, tuple(out[low : high + 1])


@functools.cache  # there are few layers, as costs are relative
def _before(behind: tuple[int, ...], initial: int, fault: int) -> tuple[int, tuple[int, ...]]:
    """(cost added, layers ahead of a row) from the layers behind it."""
    get = lambda c: behind[min(c, len(behind) - 1)] if c >= 0 else 0
    more = UNENDED if fault == TRUNCATED else 0

    def at(c: int) -> int:
        stays = 0 if fault in (BLANK, DUPLICATE) else _KEPT[initial][get(c - more)] | _GIVEN[get(c - more - GIVE)]
        return get(c - DELETE) | stays

    return _layers(at, len(behind) + DELETE + 1)


@functools.cache
def _costs(layers: tuple[int, ...]) -> tuple[int | None, ...]:
    """The least cost of each state, relative to the first layer."""
    return tuple(next((c for c, x in enumerate(layers) if x >> s & 1), None) for s in range(4))


def _of_costs(costs: list[int]) -> tuple[int, tuple[int, ...]]:
    least = min(costs)
    _, layers = _layers(lambda c: sum(1 << s for s, v in enumerate(costs) if v - least <= c), max(costs) - least + 1)
    return least, layers


END = _layers(lambda c: ENDS, 1)


def _initial(role: str) -> int:
    return INITIALS.index(role[0]) if role[:1] in ("s", "u", "a") else 3


def between(rows: list[tuple[int, int, int]]) -> list[list[int | None]]:
    """The cost from each state ahead of the rows (initial, fault, copies behind) to each state behind them."""
    columns = []
    for end in range(4):
        base, layers = _layers(lambda c: 1 << end, 1)
        for initial, fault, copies in reversed(rows):
            more, layers = _before(layers, initial, fault)
            base += more + DELETE * copies
        columns.append([None if c is None else base + c for c in _costs(layers)])
    return [[columns[e][s] for e in range(4)] for s in range(4)]


def trace(rows: list[tuple[int, int, int]], state: int, behind: list[int] | None) -> tuple[list[str], int]:
    """(the letters that each row takes, the last ones after all rows; the state at the end).

    behind: the costs from each state after these rows, None if the conversation ends there. A row's copies behind it
    are always deleted at once, as no letter comes before D, and aren't listed.
    """
    base, layers = END if behind is None else _of_costs(behind)
    steps = [(base, layers)]
    for initial, fault, copies in reversed(rows):
        base += DELETE * copies
        steps.append((base, layers))  # right behind the row
        more, layers = _before(layers, initial, fault)
        base += more
        steps.append((base, layers))
    steps.reverse()
    cost = lambda k, s: steps[k][0] + _costs(steps[k][1])[s]
    out = []
    for i, (initial, fault, _) in enumerate(rows):
        letters, left = "", cost(2 * i, state)
        while cost(2 * i + 1, state) + DELETE != left and cost(2 * i, GIVEN[state]) + INSERT == left:
            letters, state, left = letters + "I", GIVEN[state], left - INSERT
        to = KEPT.get(INITIALS[initial], {}).get(state)
        if cost(2 * i + 1, state) + DELETE == left:
            letters += "D"
        elif to is not None and cost(2 * i + 1, to) + (fault == TRUNCATED) * UNENDED == left:
            letters, state = letters + "K", to
        else:
            letters, state = letters + "R", GIVEN[state]
        out.append(letters)
    last = ""
    while behind is None and not ENDS >> state & 1:
        last, state = last + "I", GIVEN[state]
    return [*out, last], state


# --- portions ------------------------------------------------------------------------------------------------------

_READ = ("__conv", "__turn", "__role", "__text", "__n", "__fault", "__part")
_EDGES = "part int, last boolean, conv_id long, costs array<long>, first_role string, last_role string, last_turn long, leave array<int>"
_EDITS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("whole", pa.bool_()), ("edit", pa.string()), ("fault", pa.string()),
    ("illegal", pa.bool_()), ("new_turn", pa.bool_()), ("turn", pa.int64()), ("was", pa.string()), ("role", pa.string()), ("text", pa.string()), ("cost", pa.int64()),
])
EDITS = (
    "conv_id long, part int, place long, whole boolean, edit string, fault string, illegal boolean, new_turn boolean, turn long, was string, role string, text string, cost long"
)


def _portions(batches: Iterator[pa.RecordBatch], texts: bool = True) -> Iterator[tuple]:
    """(part, conversation, its rows in this partition, whether it is the first here, whether it is the last)."""
    held, conv, part, first = [], None, None, True
    for batch in batches:
        columns = [batch.column(c).to_pylist() if texts or c != "__text" else [None] * batch.num_rows for c in _READ]
        for row in zip(*columns):
            if held and row[0] != conv:
                yield part, conv, held, first, False
                held, first = [], False
            conv, part = row[0], row[6]
            held.append(row)
    if held:
        yield part, conv, held, first, True


def _codes(rows: list[tuple]) -> list[tuple[int, int, int]]:
    return [(_initial(r[2]), r[5], r[4] - 1) for r in rows]


def _edges(behind: dict | None):
    """A partition's first and last portion as one row each: with `behind` how each state goes through, else the costs."""

    def one(part, conv, rows, last):
        codes = _codes(rows)
        flat = [c for row in between(codes) for c in row] if behind is None else None
        leave = None
        if behind is not None and (part, last) in behind:
            leave = [trace(codes, s, behind[part, last])[1] for s in range(4)]
        return part, last, conv, flat, rows[0][2], rows[-1][2], rows[-1][1], leave

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for part, conv, rows, first, last in _portions(batches, texts=False):
            if first or last:
                out.append(one(part, conv, rows, last))
        if out:
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()))
            names = ("part", "last", "conv_id", "costs", "first_role", "last_role", "last_turn", "leave")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=list(names))

    return run


def _chains(edges: list) -> list[list]:
    """Runs of portions of one conversation, in order; only those of two or more."""
    runs: list[list] = []
    for e in sorted(edges, key=lambda e: (e["part"], e["last"])):
        if runs and runs[-1][-1]["conv_id"] == e["conv_id"] and runs[-1][-1]["part"] != e["part"]:
            runs[-1].append(e)
        else:
            runs.append([e])
    return [r for r in runs if len(r) > 1]


def _costs_behind(chains: list[list]) -> dict:
    """(part, last) -> the costs behind a portion, None at the end of a conversation."""
    out = {}
    for run in chains:
        end, layers = END
        costs = [end + c for c in _costs(layers)]
        for e in reversed(run):
            out[e["part"], e["last"]] = None if e is run[-1] else costs
            through = [e["costs"][4 * s : 4 * s + 4] for s in range(4)]
            costs = [min(c + costs[k] for k, c in enumerate(row) if c is not None) for row in through]
    return out


def _entries(chains: list[list], leave: dict) -> dict:
    """(part, last) -> (state, role and turn ahead) with which a portion is entered."""
    out = {}
    for run in chains:
        state, role, turn = START, None, None
        for e in run:
            out[e["part"], e["last"]] = (state, role, turn)
            state, role, turn = leave[e["part"], e["last"]][state], e["last_role"], e["last_turn"]
    return out


def _edits(behind: dict, entries: dict):
    def of_portion(part, conv, rows, key) -> Iterator[tuple]:
        state, role, turn = entries.get(key, (START, None, None))
        whole, place = key not in entries, 0
        letters, _ = trace(_codes(rows), state, behind.get(key))

        def row(edit, fault, was, now, text, at, cost):
            nonlocal place, role, turn
            pair = None if role is None else role[:1] + (was or "")[:1]
            new = at is not None and at != turn
            if edit != "I":
                role, turn = was, at if at is not None else turn
            place += 1
            return (
                conv, part, place, whole, edit, FAULTS[fault], edit != "I" and pair is not None and pair not in LEGAL, edit != "I" and new, at, was, now, text, cost
            )

        def given() -> str:
            nonlocal state
            state = GIVEN[state]
            return "user" if state == AFTER_U else "assistant"

        for r, mine in zip(rows, letters):
            for _ in mine[:-1]:
                yield row("I", 0, None, given(), "", None, INSERT)
            more = UNENDED if r[5] == TRUNCATED else 0
            if mine[-1] == "D":
                yield row("D", r[5], r[2], None, r[3], r[1], DELETE)
            elif mine[-1] == "R":
                yield row("R", r[5], r[2], given(), r[3], r[1], GIVE + more)
            else:
                state = KEPT[r[2][0]][state]
                yield row("K", r[5], r[2], r[2], r[3], r[1], more)
            for _ in range(r[4] - 1):
                yield row("D", BLANK if r[5] == BLANK else DUPLICATE, r[2], None, r[3], r[1], DELETE)
        for _ in letters[-1]:
            yield row("I", 0, None, given(), "", None, INSERT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _EDITS)], schema=_EDITS)
        for part, conv, rows, first, last in _portions(batches):
            for edit in of_portion(part, conv, rows, (part, last) if first or last else None):
                out.append(edit)
                chars += len(edit[11])
                if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield flush()
                    out, chars = [], 0
        if out:
            yield flush()

    return run


def _fault(text: Column) -> Column:
    said = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(said == "", BLANK).when(F.substring(said, -1, 1).isin(".", "!", "?"), 0).otherwise(TRUNCATED)


def repair(conversations: DataFrame) -> DataFrame:
    """One row for each edit, in order by (conv_id, part, place): `EDITS` are its columns.

    edit is K, R, D or I; fault is '', truncated, blank or duplicate; role is the role after the edit, null for a deleted row;
    was is the role before, null for an inserted one; illegal says that the row's role can't follow the one before; new_turn
    that its turn number is the conversation's first of that number; whole that the conversation lies in one part.
    """
    spark = conversations.sparkSession
    ship(spark)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    read = conversations.select(
        F.col("conv_id").cast("long").alias("__conv"), F.col("turn").cast("long").alias("__turn"), space("role").alias("__role"), space("text").alias("__text")
    )
    counted = read.groupBy(*read.columns).agg(F.count("*").alias("__n")).withColumn("__sha", F.sha2("__text", 256))
    turn = F.struct(F.col("__turn").isNotNull().alias("known"), F.col("__turn").alias("turn"))
    repeated = (
        counted.groupBy(F.col("__conv").alias("c"), F.col("__role").alias("r"), F.col("__sha").alias("s"))
        .agg(F.min(turn).alias("__first"), F.count("*").alias("__turns")).where("__turns > 1")
    )
    same = F.col("__conv").eqNullSafe(F.col("c")) & (F.col("__role") == F.col("r")) & (F.col("__sha") == F.col("s"))
    later = F.coalesce(~F.col("__first").eqNullSafe(turn), F.lit(False)) & F.col("__first").isNotNull()
    fault = _fault(F.col("__text"))
    order = [F.col("__conv"), F.col("__turn"), F.col("__role"), F.substring("__text", 1, 64), F.col("__sha")]
    ranged = cut(
        counted.join(repeated, same, "left")
        .withColumn("__fault", F.when(fault == BLANK, BLANK).when(later, DUPLICATE).otherwise(fault).cast("int"))
        .repartitionByRange(shuffle_width(spark), *(c.asc_nulls_first() for c in order)).sortWithinPartitions(*(c.asc_nulls_first() for c in order))
        .withColumn("__part", F.spark_partition_id()).select(*_READ)
    )
    # two rows a partition at most
    chains = _chains(ranged.mapInArrow(_edges(None), _EDGES).collect())
    behind = _costs_behind(chains)
    entries = {}
    if chains:
        leave = {(e["part"], e["last"]): e["leave"] for e in ranged.mapInArrow(_edges(behind), _EDGES).collect()}
        entries = _entries(chains, leave)
    return ranged.mapInArrow(_edits(behind, entries), EDITS)


# --- digests -------------------------------------------------------------------------------------------------------

_COUNTS = ("low", "high", "blank", "duplicate", "truncated", "illegal", "new_turns", "cost")
_PIECES = "conv_id long, part int, piece int, audit string, sha256 string, lines binary, " + ", ".join(f"{c} long" for c in _COUNTS)


class _Portion:
    """What is gathered of one portion: letters, counts, and its repaired lines or their digest."""

    def __init__(self, conv, part, whole):
        self.conv, self.part, self.whole, self.piece = conv, part, whole, 0
        self.digest, self.some = hashlib.sha256(), False
        self.clear()

    def clear(self) -> None:
        self.letters, self.lines, self.size, self.low, self.high, self.counts = [], [], 0, None, None, [0] * 6

    def add(self, edit, fault, illegal, new_turn, turn, role, text, cost) -> None:
        self.letters.append(edit)
        for k, more in enumerate((fault == "blank", fault == "duplicate", fault == "truncated", illegal, new_turn, cost)):
            self.counts[k] += more
        if turn is not None:
            self.low, self.high = min(turn, turn if self.low is None else self.low), max(turn, turn if self.high is None else self.high)
        if edit != "D":
            line = f"{role}:{text}".encode()
            if self.whole:
                self.digest.update(b"\n" + line if self.some else line)
            else:
                self.lines.append(line)
                self.size += len(line)
            self.some = True

    def row(self) -> tuple:
        lines = b"\n".join(self.lines) if self.lines else None
        out = (self.conv, self.part, self.piece, "".join(self.letters), self.digest.hexdigest() if self.whole else None, lines, self.low, self.high, *self.counts)
        self.piece += 1
        self.clear()
        return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each portion's letters and counts, with the digest of its repaired lines where it is whole, else these lines in blocks."""
    names = ("conv_id", "part", "piece", "audit", "sha256", "lines", *_COUNTS)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary(), *(pa.int64(),) * len(_COUNTS))
    flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=list(names))
    out: list[tuple] = []
    now = None
    for batch in batches:
        for conv, part, whole, *edit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "whole", *_SEEN))):
            if now is None or (conv, part) != (now.conv, now.part):
                if now is not None:
                    out.append(now.row())
                now = _Portion(conv, part, whole)
            now.add(*edit)
            if not whole and (now.size >= BLOCK or len(now.letters) >= BLOCK):
                out.append(now.row())
                yield flush(out)
                out = []
        if len(out) >= BATCH_ROWS:
            yield flush(out)
            out = []
    if now is not None:
        out.append(now.row())
    if out:
        yield flush(out)


_SEEN = ("edit", "fault", "illegal", "new_turn", "turn", "role", "text", "cost")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's blocks, which come in order; one block is held at a time."""
    done, conv, digest, some = [], None, None, False
    for batch in batches:
        for c, lines in zip(batch.column("conv_id"), batch.column("lines")):
            c = c.as_py()
            if digest is None or c != conv:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest, some = c, hashlib.sha256(), False
            if lines.is_valid:
                digest.update(b"\n" if some else b"")
                digest.update(lines.as_buffer())
                some = True
    if digest is not None:
        done.append((conv, digest.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.string()))], names=["conv_id", "sha256"])


def digests(edits: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of `repair`'s result.

    Counts are sums. The digest of a conversation that lies in several parts needs its lines in order: they pass
    through one task in blocks, and only one block of them is held.
    """
    pieces = cut(edits.mapInArrow(_pieces, _PIECES))
    width = shuffle_width(edits.sparkSession)
    split = pieces.where("sha256 IS NULL").repartition(width, "conv_id").sortWithinPartitions("conv_id", "part", "piece")
    hashed = split.mapInArrow(_hashed, "conv_id long, sha256 string").select(F.col("conv_id").alias("c"), F.col("sha256").alias("hashed"))
    sums = ("blank", "duplicate", "truncated", "illegal", "new_turns", "cost")
    found = pieces.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "piece", "audit"))).alias("a"), F.max("sha256").alias("sha256"),
        F.min("low").alias("low"), F.max("high").alias("high"), *(F.sum(c).alias(c) for c in sums),
    )
    span = F.coalesce(F.col("high").cast("decimal(20,0)") - F.col("low") + 1 - F.col("new_turns"), F.lit(0))
    gaps = F.least(span, F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long")
    return found.join(hashed, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", gaps.alias("gaps"), *sums[:4], "cost", F.array_join(F.transform("a", lambda x: x["audit"]), "").alias("audit"),
        F.coalesce("sha256", "hashed").alias("repaired_sha256"),
    )
