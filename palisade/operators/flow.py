"""Data flow as relations: definitions that reach uses through loops, and values that pass functions on their way to a sink.

Units of a few rows, as most functions are, are one row each and solved many at a time, after one shuffle. Larger ones are
fixpoints over edge tables in which a round joins only what the round before found, and is checkpointed. Straight runs of
their nodes become blocks first, by doubling jumps, so rounds follow the branches of a unit and not its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from palisade.operators.graphs import _cut
from palisade.operators.runs import blocks
from palisade.operators.scratch import Scratch
from palisade.sources.package import ship

#: Steps, definitions and uses of a unit that is solved as one row, at most; its definitions are the bits of a word.
SMALL, BITS = 256, 64


def _codes(*columns) -> np.ndarray:
    """Whole numbers that are equal where all columns are; of the size of the columns."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        each = c if isinstance(c, np.ndarray) else c.dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64) + 1
        out = np.unique(out * (int(each.max(initial=0)) + 1) + each, return_inverse=True)[1].astype(np.int64)
    return out


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, node, var, def) of rows (unit, rows): the sets of definitions at all nodes of a batch's units, as words of bits."""
    for batch in batches:
        rows = batch.column("rows")
        unit = rows.value_parent_indices().to_numpy().astype(np.int64)
        kind, a, b, var, sure = (rows.flatten().field(k) for k in ("kind", "a", "b", "var", "sure"))
        kind, sure = kind.to_numpy(zero_copy_only=False), sure.to_numpy(zero_copy_only=False).astype(bool)
        step, made, used = (np.flatnonzero(kind == k) for k in range(3))
        ends = pa.concat_arrays([a, b.take(pa.array(step))])
        node = _codes(np.concatenate([unit, unit[step]]), ends)
        src, dst = node[step], node[len(unit):]
        name = _codes(unit, var)
        # each definition once, in the order of units; its bit counts from its unit's first
        _, first, again = np.unique(np.stack([unit[made], node[made], name[made]]), axis=1, return_index=True, return_inverse=True)
        one, certain = made[first], np.zeros(len(first), bool)
        np.logical_or.at(certain, again.reshape(-1), sure[made])
        begin = np.searchsorted(unit[one], np.arange(len(rows)))
        bit = np.uint64(1) << (np.arange(len(one)) - begin[unit[one]]).astype(np.uint64)
        gen, kill, kept = np.zeros(node.max(initial=0) + 1, np.uint64), np.zeros(node.max(initial=0) + 1, np.uint64), np.zeros(name.max(initial=0) + 1, np.uint64)
        np.bitwise_or.at(gen, node[one], bit)
        np.bitwise_or.at(kept, name[one], bit)
        np.bitwise_or.at(kill, node[one][certain], kept[name[one][certain]])
        at, was = np.zeros_like(gen), None
        while was is None or (at != was).any():
            was = at.copy()
            np.bitwise_or.at(at, dst, (gen | (was & ~kill))[src])
        used = used[np.unique(np.stack([node[used], name[used]]), axis=1, return_index=True)[1]]
        word = at[node[used]] & kept[name[used]]
        hits = [(k, np.flatnonzero(word >> np.uint64(k) & np.uint64(1))) for k in range(BITS)]
        use = np.concatenate([used[i] for _, i in hits])
        of = np.concatenate([one[begin[unit[used[i]]] + k] for k, i in hits])
        yield pa.RecordBatch.from_arrays([batch.column("unit").take(pa.array(unit[use])), a.take(pa.array(use)), var.take(pa.array(use)), a.take(pa.array(of))], ["unit", "node", "var", "def"])


def reaching_definitions(steps: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """(unit, node, var, def): the definitions of a variable that may hold where it is used.

    steps: (unit, src, dst), with branches and loops; defs: (unit, node, var, sure), where a sure definition ends those before
    it and another (of a part, or on a condition) leaves them; uses: (unit, node, var). A use comes before a definition of the
    same node. Nulls in any column join with nothing; repeated rows change nothing (of a definition, sure counts).
    """
    steps, uses = steps.select("unit", "src", "dst").dropna(), uses.select("unit", "node", "var").dropna()
    defs = defs.select("unit", "node", "var", F.coalesce("sure", F.lit(False)).alias("sure")).dropna()
    row = lambda df, kind, a, b, var, sure: df.select("unit", F.lit(kind).cast("byte").alias("kind"), F.col(a).alias("a"), b.alias("b"), var.alias("var"), sure.alias("sure"))
    null, no = F.lit(None), F.lit(False)
    rows = row(steps, 0, "src", F.col("dst"), null, no).union(row(defs, 1, "node", null, F.col("var"), F.col("sure"))).union(row(uses, 2, "node", null, F.col("var"), no))
    rows = Scratch(steps.sparkSession).keep(rows)
    many = _cut(rows.groupBy("unit").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == 1).alias("d")).where((F.col("n") > SMALL) | (F.col("d") > BITS)).select("unit"))
    some = not many.isEmpty()
    few = rows.join(many, "unit", "left_anti") if some else rows
    packed = few.groupBy("unit").agg(F.collect_list(F.struct("kind", "a", "b", "var", "sure")).alias("rows"))
    ship(steps.sparkSession)
    kinds = {f.name: f.dataType for f in rows.schema}
    found = packed.mapInArrow(_solved, StructType([StructField(n, kinds[k]) for n, k in (("unit", "unit"), ("node", "a"), ("var", "var"), ("def", "a"))]))
    if not some:
        return found
    return found.union(_by_blocks(*(t.join(many, "unit", "left_semi") for t in (steps, defs, uses))))


def _by_blocks(steps: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """The same for units of any size, without nulls: runs of nodes as blocks, then deltas over the edges of blocks."""
    steps = steps.select("unit", "src", "dst").distinct()
    defs = defs.groupBy("unit", "node", "var").agg(F.max("sure").alias("sure"))
    uses = uses.distinct()
    ends = steps.select("unit", F.col("src").alias("node")).union(steps.select("unit", F.col("dst").alias("node")))
    nodes = _cut(ends.union(defs.select("unit", "node")).union(uses.select("unit", "node")).distinct())
    at = _cut(blocks(steps, nodes))
    # a run's uses and definitions of a variable in order; each sure definition begins a stretch
    events = defs.select("unit", "node", "var", "sure", F.lit(1).alias("kind")).unionByName(uses.select("unit", "node", "var", F.lit(False).alias("sure"), F.lit(0).alias("kind")))
    run = Window.partitionBy("unit", "block", "var").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("unit", "block", "var")
    placed = _cut(
        events.join(at, ["unit", "node"]).withColumn("stretch", F.sum(F.col("sure").cast("long")).over(run)).withColumn("last", F.sum(F.col("sure").cast("long")).over(whole))
    )
    made = placed.where("kind = 1").select("unit", "block", "var", "stretch", "last", F.col("node").alias("def"), F.col("place").alias("from"))
    used = placed.where("kind = 0").select("unit", "block", "var", "stretch", "node", "place")
    near = used.join(made.drop("last"), ["unit", "block", "var", "stretch"]).where("from < place").select("unit", "node", "var", "def")
    # between runs: what leaves a block, what it ends, and deltas over the edges of blocks
    gen = made.where("stretch = last").select("unit", "block", "var", "def")
    kill = placed.where("last > 0").select("unit", "block", "var").distinct()
    head = at.where("place = 0").select("unit", F.col("node").alias("dst"), F.col("block").alias("next"))
    edges = _cut(steps.join(head, ["unit", "dst"]).join(at.select("unit", F.col("node").alias("src"), "block"), ["unit", "src"]).select("unit", "block", "next").distinct())
    onward = lambda facts: facts.join(edges, ["unit", "block"]).select("unit", F.col("next").alias("block"), "var", "def").distinct()
    seen = delta = _cut(onward(gen))
    while not delta.isEmpty():
        delta = _cut(onward(delta.join(kill, ["unit", "block", "var"], "left_anti")).join(seen, ["unit", "block", "var", "def"], "left_anti"))
        seen = seen.union(delta)
    far = used.where("stretch = 0").join(seen, ["unit", "block", "var"]).select("unit", "node", "var", "def")
    return near.union(far).distinct()


# --- values through functions --------------------------------------------------------------------------------------


def _inside(origins: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fn, a, b): the wanted slots b that the origins (fn, slot) reach along the edges (fn, x, y), and the origins themselves."""
    steps = edges.select(F.col("fn").alias("unit"), F.col("x").alias("src"), F.col("y").alias("dst"))
    every = F.lit(0).alias("var")
    at = origins.select(F.col("fn").alias("unit"), F.col("slot").alias("node"), every)
    ends = wanted.select(F.col("fn").alias("unit"), F.col("slot").alias("node"), every)
    met = reaching_definitions(steps, at.withColumn("sure", F.lit(False)), ends).where("node <> def")
    return met.select(F.col("unit").alias("fn"), F.col("def").alias("a"), F.col("node").alias("b")).union(origins.select("fn", F.col("slot").alias("a"), F.col("slot").alias("b")))


def passes(flows: DataFrame, params: DataFrame, returns: DataFrame, args: DataFrame, results: DataFrame, sources: DataFrame, sinks: DataFrame, limit: int = 4) -> DataFrame:
    """(fn, a, b): the slots b of a function that get a value of slot a, for parameters, sources and results of calls.

    Of the slots b, a itself, returns, arguments and sinks are told, as values are asked for at no others.

    Calls inside count by their summary: a callee that passes a parameter to its return links the argument to the result.
    Each level adds the links of summaries that the level before found, and only functions that get one are solved again;
    `limit` levels see calls nested that deep, and recursion ends as soon as a level adds nothing.
    """
    scratch = Scratch(flows.sparkSession)
    slots = [t.select("fn", "slot") for t in (params, sources, results)]
    origins = scratch.keep(slots[0].union(slots[1]).union(slots[2]).dropna().distinct())
    wanted = returns.select("fn", "slot").union(args.select("fn", "slot")).union(sinks.select("fn", "slot"))
    edges = flows.select("fn", F.col("src").alias("x"), F.col("dst").alias("y")).dropna()
    found = fresh = scratch.keep(_inside(origins, edges, wanted))
    ends = returns.select("fn", F.col("slot").alias("b")).dropna().distinct()
    enters = params.select("fn", "place", F.col("slot").alias("a")).dropna().distinct()
    through = fresh.join(ends, ["fn", "b"]).join(enters, ["fn", "a"]).select(F.col("fn").alias("callee"), "place").distinct()
    links = args.select("site", "fn", "callee", "place", F.col("slot").alias("x")).join(results.select("site", F.col("slot").alias("y")), "site")
    links = scratch.keep(links.select("fn", "callee", "place", "x", "y").dropna().distinct())
    for _ in range(limit):
        new = scratch.keep(links.join(through, ["callee", "place"]).select("fn", "x", "y").distinct().join(edges, ["fn", "x", "y"], "left_anti"))
        if new.isEmpty():
            break
        edges, again = edges.union(new), new.select("fn").distinct()
        own = lambda t: t.join(again, "fn", "left_semi")
        fresh = scratch.keep(_inside(own(origins), own(edges), own(wanted)).join(own(found), ["fn", "a", "b"], "left_anti"))
        found = found.union(fresh)
        through = fresh.join(ends, ["fn", "b"]).join(enters, ["fn", "a"]).select(F.col("fn").alias("callee"), "place").distinct()
    return found


def sink_hits(
    flows: DataFrame, params: DataFrame, returns: DataFrame, args: DataFrame, results: DataFrame, sources: DataFrame, sinks: DataFrame, limit: int = 4
) -> DataFrame:
    """(source_fn, source, sink_fn, sink, depth, path): which sources reach which sinks, over how many functions.

    flows: (fn, src, dst) inside a function; params: (fn, place, slot); returns, sources, sinks: (fn, slot); args: (site, fn, callee,
    place, slot); results: (site, fn, callee, slot). A value may be returned to callers, then be handed to callees; calls
    that return before that count by their summary. depth is the number of functions entered so, at most `limit`; path names
    them from the source's on; of several ways the one with the least depth, then the least path. Nulls join with nothing.
    """
    inside = passes(flows, params, returns, args, results, sources, sinks, limit)
    reach = inside.select("fn", F.col("a").alias("slot"), F.col("b"))
    up = reach.join(returns.select("fn", F.col("slot").alias("b")).distinct(), ["fn", "b"]).join(
        results.select(F.col("callee").alias("fn"), F.col("fn").alias("to"), F.col("slot").alias("at")), "fn"
    )
    down = reach.join(args.select("fn", "callee", "place", F.col("slot").alias("b")), ["fn", "b"]).join(
        params.select(F.col("fn").alias("callee"), "place", F.col("slot").alias("at")), ["callee", "place"]
    )
    up = _cut(up.select("fn", "slot", "to", "at").distinct())
    down = _cut(down.select("fn", "slot", F.col("callee").alias("to"), "at").distinct())
    here = sources.select("fn", "slot").dropna().distinct()
    state = ["source_fn", "source", "fn", "slot", "rising"]
    front = _cut(here.select(F.col("fn").alias("source_fn"), F.col("slot").alias("source"), "fn", "slot", F.lit(True).alias("rising"), F.array("fn").alias("path")))
    seen = front.withColumn("depth", F.lit(0))
    for depth in range(1, limit + 1):
        moved = lambda by, rows, rising: rows.join(by, ["fn", "slot"]).select(
            "source_fn", "source", F.col("to").alias("fn"), F.col("at").alias("slot"), F.lit(rising).alias("rising"), F.concat("path", F.array("to")).alias("path")
        )
        step = moved(up, front.where("rising"), True).union(moved(down, front, False)).groupBy(*state).agg(F.min("path").alias("path"))
        front = _cut(step.join(seen, state, "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    at = reach.join(sinks.select("fn", F.col("slot").alias("b")).distinct(), ["fn", "b"])
    hits = seen.join(at, ["fn", "slot"]).groupBy("source_fn", "source", F.col("fn").alias("sink_fn"), F.col("b").alias("sink"))
    return hits.agg(F.min(F.struct("depth", "path")).alias("w")).select("source_fn", "source", "sink_fn", "sink", "w.depth", "w.path")
