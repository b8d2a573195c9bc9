"""Graph operators on edge tables: degrees, hubs, bounded reach, strong components, layers, imports."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palisade.operators.runs import blocks
from palisade.operators.scratch import Scratch


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; a folder of its own only for a local session that names none."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or f"{tempfile.gettempdir()}/palisade-{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, fan_in, fan_out): distinct neighbours. Edges are made distinct once, and then plainly counted."""
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct()
    one = lambda c: F.when(F.col(c).isNotNull(), 1).otherwise(0)
    both = e.select(F.col("s").alias("node"), one("d").alias("o"), F.lit(0).alias("i")).unionAll(e.select(F.col("d").alias("node"), F.lit(0).alias("o"), one("s").alias("i")))
    return both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def hubs(edges: DataFrame, k: int = 5, src: str = "src", dst: str = "dst") -> DataFrame:
    """The k nodes with the largest fan_in * fan_out."""
    return degrees(edges, src, dst).withColumn("product", F.col("fan_in") * F.col("fan_out")).orderBy(F.col("product").desc(), "node").limit(k)


#: Nodes of a block of `reach`, at most. A tile is a bit for each pair of a node of one block and a node of another.
BLOCK = 4096


def _coded(bits: np.ndarray) -> bytes:
    """A tile's rows of bits, compressed: the gaps between its pairs where these are few, else the bits themselves."""
    flat = bits.reshape(-1)
    some = np.flatnonzero(flat)
    at, bit = np.nonzero(np.unpackbits(flat[some][:, None], axis=1, bitorder="little")) if 4 * len(some) < len(flat) else (None, None)
    if at is None or 4 * len(at) >= len(flat):
        return b"b" + zlib.compress(flat.tobytes(), 1)
    return b"g" + zlib.compress(np.diff(some[at] * 8 + bit, prepend=0).astype("<u4").tobytes(), 1)


def _bits(tile: bytes, block: int) -> np.ndarray:
    """What `_coded` was given."""
    wide, data = -(-block // 8), zlib.decompress(tile[1:])
    if tile[:1] == b"b":
        return np.frombuffer(data, np.uint8).reshape(-1, wide)
    flat, at = np.zeros(8 * wide * wide, np.uint8), np.cumsum(np.frombuffer(data, "<u4"), dtype=np.int64)
    np.bitwise_or.at(flat, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return flat.reshape(-1, wide)


def _unite(into: np.ndarray, front: np.ndarray, edges: np.ndarray) -> None:
    """Adds to each start's row of bits the rows of its nodes; of eight nodes all 256 unions are made once."""
    turned = np.ascontiguousarray(front.T)
    for g in np.flatnonzero(turned.any(axis=1)):
        rows = edges[8 * g : 8 * g + 8]
        if not rows.any():
            continue
        unions = np.zeros((256, edges.shape[1]), np.uint8)
        for j in range(len(rows)):
            unions[1 << j : 2 << j] = unions[: 1 << j] | rows[j]
        own = np.flatnonzero(turned[g])
        into[own] |= unions[turned[g, own]]


def _onward(starts: np.ndarray, nodes: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (start, dst) of a tile whose nodes are given by name."""
    rows, columns, names = np.unique(src), np.unique(dst), np.unique(starts)
    packed = lambda r, c, m, n: np.packbits(np.bincount(r * n + c, minlength=m * n).reshape(m, n) > 0, axis=1, bitorder="little")
    known = np.isin(nodes, rows)
    front = packed(np.searchsorted(names, starts[known]), np.searchsorted(rows, nodes[known]), len(names), len(rows))
    edges = packed(np.searchsorted(rows, src), np.searchsorted(columns, dst), len(rows), len(columns))
    into = np.zeros((len(names), edges.shape[1]), np.uint8)
    _unite(into, front, edges)
    start, node = np.nonzero(np.unpackbits(into, axis=1, count=len(columns), bitorder="little"))
    return names[start], columns[node]


def _drawn(pairs: DataFrame, block: int, parts: int) -> DataFrame:
    """(via, to, tile) of pairs (via, to, pair), pair being the bit's place; a task holds one tile at a time."""
    bits = (-(-block // 8) * 8) ** 2

    def draw(batches):
        flat, at = np.zeros(bits, bool), None
        done = lambda: pd.DataFrame({"via": [at[0]], "to": [at[1]], "tile": [_coded(np.packbits(flat, bitorder="little").reshape(-1, -(-block // 8)))]})
        for b in batches:
            via, to, pair = (b[c].to_numpy() for c in ("via", "to", "pair"))
            ends = [*np.flatnonzero((via[1:] != via[:-1]) | (to[1:] != to[:-1])) + 1, len(b)] if len(b) else []
            for lo, hi in zip([0, *ends], ends):
                if at != (via[lo], to[lo]):
                    if at is not None:
                        yield done()
                        flat[:] = False
                    at = via[lo], to[lo]
                flat[pair[lo:hi]] = True
        if at is not None:
            yield done()

    return pairs.repartition(parts, "via", "to").sortWithinPartitions("via", "to").mapInPandas(draw, "via long, to long, tile binary")


def _advance(rows: DataFrame, block: int, parts: int) -> DataFrame:
    """(own, to, tile) of new pairs. rows: (own, to, via, kind, tile), kind being 0 for pairs known of (own, to), 1 for those of
    (own, via) that the last step found, and 2 for edges of (via, to). A task holds the tiles of one way at a time."""

    def advance(batches):
        at = front = known = new = None

        def done():
            fresh = new if known is None else new & ~known
            if fresh.any():
                yield pd.DataFrame({"own": [at[0]], "to": [at[1]], "tile": [_coded(fresh)]})

        for b in batches:
            for own, to, via, kind, tile in b.itertuples(index=False, name=None):
                if at != (own, to):
                    if new is not None:
                        yield from done()
                    at, front, known, new = (own, to), None, None, None
                bits = _bits(tile, block)
                if kind == 0:
                    known = bits if known is None else known | bits
                elif kind == 1:
                    front = via, bits
                elif front is not None and front[0] == via:
                    new = np.zeros_like(bits) if new is None else new
                    _unite(new, front[1], bits)
        if new is not None:
            yield from done()

    return rows.repartition(parts, "own", "to").sortWithinPartitions("own", "to", "via", "kind").mapInPandas(advance, "own long, to long, tile binary")


def _listed(batches, block: int):
    """(start, node, depth) of each pair of (depth, starts, nodes, tile), by some rows of a tile at a time."""
    for b in batches:
        for i in range(b.num_rows):
            depth, tile = (b.column(c)[i].as_py() for c in ("depth", "tile"))
            starts, nodes = (b.column(c)[i].values for c in ("starts", "nodes"))
            bits = _bits(tile, block)
            for lo in range(0, len(starts), 128):
                start, node = np.nonzero(np.unpackbits(bits[lo : lo + 128], axis=1, bitorder="little"))
                if len(start):
                    yield pa.RecordBatch.from_arrays([starts.take(pa.array(start + lo)), nodes.take(pa.array(node)), pa.array(np.full(len(start), depth, np.int32))], ["start", "node", "depth"])


def reach(edges: DataFrame, starts: DataFrame | None = None, depth: int = 3, block: int = BLOCK) -> DataFrame:
    """(start, node, depth): what each start (each source, if none are given) reaches in at most `depth` steps, with the fewest steps.

    Nodes are dealt to blocks in their order, and pairs are kept as tiles of bits between two blocks, as rows of pairs would
    fill the disk. A step takes only the tiles of pairs that the step before found first, joined with tiles of edges; a task
    holds a few tiles, however many pairs there are. Pairs become rows when the result is read. Nulls join with nothing.
    """
    scratch, side = Scratch(edges.sparkSession), -(-block // 8) * 8
    e = scratch.keep(edges.select("src", "dst").dropna())
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    many = max(1, -(-nodes.count() * 5 // (4 * block)))
    parts = min(many * many, max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), edges.sparkSession.sparkContext.defaultParallelism))
    row = F.monotonically_increasing_id()
    # ranges are of about equal size; what a range holds above a block's size is a block of its own
    dealt = nodes.repartitionByRange(many, "node").select("node", F.shiftright(row, 33).alias("range"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    at, off = (F.shiftleft("range", 31) + F.floor(F.col("row") / block)).alias("at"), (F.col("row") % block).cast("int").alias("off")
    dealt = scratch.keep(dealt.select("node", at, off))
    end = lambda name, at, off: dealt.select(F.col("node").alias(name), F.col("at").alias(at), F.col("off").alias(off))
    placed = lambda df: df.join(end("src", "via", "a"), "src").join(end("dst", "to", "b"), "dst").select("via", "to", (F.col("a") * side + F.col("b")).alias("pair"))
    tiles = scratch.keep(_drawn(placed(e), block, parts))
    front = tiles
    if starts is not None:
        front = scratch.keep(_drawn(placed(e.join(starts.select(F.col("node").alias("src")), "src", "left_semi")), block, parts))
    front = front.select(F.col("via").alias("own"), "to", "tile")
    found, ways = [front], tiles.select("via", "to")
    for _ in range(2, depth + 1):
        last = front.select("own", F.col("to").alias("via"), "tile")
        known = [f.select("own", "to", F.lit(-1).cast("long").alias("via"), F.lit(0).alias("kind"), "tile") for f in found]
        left = last.join(ways, "via").select("own", "to", "via", F.lit(1).alias("kind"), "tile")
        right = last.select("own", "via").join(tiles, "via").select("own", "to", "via", F.lit(2).alias("kind"), "tile")
        front = scratch.keep(_advance(reduce(DataFrame.union, [*known, left, right]), block, parts))
        if front.isEmpty():
            break
        found.append(front)
    names = dealt.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("off", "node"))), lambda x: x["node"]).alias("names"))
    each = reduce(DataFrame.union, [f.withColumn("depth", F.lit(d)) for d, f in enumerate(found, 1)])
    for end_of, name in (("own", "starts"), ("to", "nodes")):
        each = each.join(names.select(F.col("at").alias(end_of), F.col("names").alias(name)), end_of)
    kind = dealt.schema["node"].dataType.simpleString()
    pairs = each.repartition(parts, "own", "to").select("depth", "starts", "nodes", "tile").mapInArrow(lambda batches: _listed(batches, block), f"start {kind}, node {kind}, depth int")
    first = dict(edges.dtypes)["src"] if starts is None else dict(starts.dtypes)["node"]
    return pairs.select(F.col("start").cast(first), F.col("node").cast(dict(edges.dtypes)["dst"]), "depth")


def strong_components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, component) of all strongly connected components of two nodes or more; component is the largest member.

    Straight runs of nodes become one node first, by jumps of doubling length, so long paths and long cycles take few rounds.
    A run that leads back to itself is a component. The rest is colouring: nodes without a predecessor or successor are
    trimmed; the largest id that reaches a node colours it; nodes of one colour that reach the node which gave it are
    one component, and leave the graph. Every step is a join and an aggregation, and written to the shared folder, so the graph
    may be larger than any machine.
    """
    scratch = Scratch(edges.sparkSession)
    whole = scratch.keep(edges.select("src", "dst").dropna().where("src <> dst").distinct())
    nodes = whole.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    zero = F.lit(0).alias("unit")
    runs = scratch.keep(blocks(whole.select(zero, "src", "dst"), nodes.select(zero, "node")).select("node", "block", "place"))
    heads = runs.where("place = 0").select(F.col("node").alias("dst"), F.col("block").alias("to"))
    short = whole.join(heads, "dst").join(runs.select(F.col("node").alias("src"), F.col("block").alias("from")), "src").select(F.col("from").alias("src"), F.col("to").alias("dst")).distinct()
    short = scratch.keep(short)
    closed = short.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("color"))
    found = _coloured(scratch, short.where("src <> dst"), rounds)
    found = closed if found is None else found.unionByName(closed.join(found, "node", "left_anti"))
    members = scratch.keep(runs.join(found.withColumnRenamed("node", "block"), "block").select("node", "color"))
    named = members.groupBy("color").agg(F.max("node").alias("component"))
    return members.join(named, "color").select("node", "component")


def _coloured(scratch: Scratch, edges: DataFrame, rounds: int) -> DataFrame | None:
    """(node, color) of the components of two nodes or more; None without any."""
    left, out = scratch.keep(edges), None
    ends = lambda side, name: left.select(F.col(side).alias(name)).distinct()
    for _ in range(rounds):
        # trim, until nothing falls off
        n = left.count()
        while n:
            left = scratch.keep(left.join(ends("dst", "src"), "src", "left_semi").join(ends("src", "dst"), "dst", "left_semi").select("src", "dst"), instead_of=left)
            m = left.count()
            if m == n:
                break
            n = m
        if not n:
            break
        color = scratch.keep(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("color", F.col("node")).withColumn("moved", F.lit(True)))
        while not color.where("moved").isEmpty():
            sent = left.join(color, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("to")).agg(F.max("color").alias("got"))
            got = F.coalesce("got", "color")
            color = scratch.keep(
                color.join(sent, F.col("node") == F.col("to"), "left").select("node", F.greatest("color", got).alias("color"), (got > F.col("color")).alias("moved")), instead_of=color
            )
        one, two = color.select(F.col("node").alias("src"), F.col("color").alias("c1")), color.select(F.col("node").alias("dst"), F.col("color").alias("c2"))
        same = scratch.keep(left.join(one, "src").join(two, "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("color")))
        member = new = scratch.keep(color.where("node = color").select("node", "color"))
        while not new.isEmpty():
            back = same.join(new.select(F.col("node").alias("dst"), "color"), ["dst", "color"]).select(F.col("src").alias("node"), "color").distinct()
            new = scratch.keep(back.join(member, ["node", "color"], "left_anti"))
            member = member.unionByName(new)
        out = member if out is None else out.unionByName(member)
        gone = member.select("node")
        left = scratch.keep(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if out is None:
        return None
    sized = out.groupBy("color").agg(F.count("*").alias("n")).where("n > 1").select("color")
    return scratch.keep(out.join(sized, "color", "left_semi"))


def layer_violations(edges: DataFrame, layers: DataFrame, skips: bool = False) -> DataFrame:
    """Edges from a lower into a higher layer (a larger rank may not use a smaller one); skips: also over a layer."""
    a = layers.select(F.col("node").alias("src"), F.col("rank").alias("src_rank"))
    b = layers.select(F.col("node").alias("dst"), F.col("rank").alias("dst_rank"))
    kind = F.when(F.col("src_rank") > F.col("dst_rank"), "upward")
    if skips:
        kind = kind.when(F.col("dst_rank") - F.col("src_rank") > 1, "skips")
    return edges.join(a, "src").join(b, "dst").withColumn("kind", kind).where("kind IS NOT NULL").select("src", "dst", "src_rank", "dst_rank", "kind")


def contract_violations(edges: DataFrame, forbidden: list[tuple[str, str]], regex) -> DataFrame:
    """Edges that match a forbidden pair of globs. regex: turns a glob into a regular expression."""
    hit: Column = F.lit(None).cast("string")
    for a, b in forbidden:
        hit = F.coalesce(hit, F.when(F.col("src").rlike(regex(a)) & F.col("dst").rlike(regex(b)), F.lit(f"{a} -> {b}")))
    return edges.withColumn("forbidden", hit).where("forbidden IS NOT NULL")


def python_imports(lines: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst, line): the first line on which a file imports a module of the corpus.

    lines: (path, line, text); modules: (module, path). `from a.b import c` imports a.b.c if there is such a module.
    """
    plain = F.regexp_extract("text", r"^\s*import\s+([A-Za-z_][\w.]*)", 1)
    base = F.regexp_extract("text", r"^\s*from\s+([A-Za-z_][\w.]*)\s+import\s", 1)
    names = F.split(F.regexp_replace(F.regexp_extract("text", r"^\s*from\s+[A-Za-z_][\w.]*\s+import\s+\(?([^#)]*)", 1), r"\s+as\s+\w+|\s", ""), ",")
    wanted = F.when(plain != "", F.array(plain)).when(base != "", F.concat(F.transform(names, lambda n: F.concat(base, F.lit("."), n)), F.array(base)))
    asked = lines.where(F.col("text").rlike(r"^\s*(?:import|from)\s")).select("path", "line", F.posexplode(wanted).alias("at", "module"))
    found = asked.join(modules.select("module", F.col("path").alias("dst")), "module")
    return found.where("path <> dst").groupBy(F.col("path").alias("src"), "dst").agg(F.min("line").alias("line"))
