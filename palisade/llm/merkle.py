"""Merkle manifest of a dataset: a binary hash tree over each group's rows, a tree over the groups' roots, and proofs.

A leaf is the SHA-256 of a row's fields. In a group leaves ascend by id; while several nodes remain, each two consecutive ones
become the hash of their digests' hex texts, and a last one alone becomes the hash of its own. The groups' roots, in the
order of the groups' UTF-8 bytes and null first, give the root of the dataset in the same way.

Rows are reduced to (group, id, leaf) before anything moves and get their places in a group by ranging: a group that lies in
several partitions is counted by partition, and only a partition's first group can have rows before it, so the driver adds up
one number a partition. Then aligned blocks of 2 ** `LEVELS` leaves are dealt to tasks by (group, block), which splits groups
of any size. Going up, a block gives its root, and blocks of roots theirs, until each group has one; each tier is a
small part of the one below. Going down, a block receives the proof of its own root as a row that comes before its
leaves, and a fractal traversal emits the leaves' authentication paths one after the other: for each band of `BAND`
levels it holds the subtree over the current leaf and the next one, which two steps of hashing a leaf complete just in time. The
upper proof is appended to each path, so paths are never shuffled.

A proof is an array of one string a level, from leaf to root: `<` and the digest of the node to the left, `>` and that
to the right, or `=` where a node is alone.

Defined cases: a null field is `-`; a null id comes first, a null group is a group of its own; rows with one id are ordered by
leaf, and rows alike in both have the places next to one another, in any order; an empty table gives an empty
result; other columns are ignored unless named in `keep`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm.common import cut, ship, shuffle_width

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels in a block, and in a subtree of the traversal.
LEVELS, BAND = 12, 4
BATCH_ROWS = 1024
SEED = 11


def encoded(value: Column) -> Column:
    """`-` for a null, else the number of UTF-8 bytes, `:` and the value."""
    said = value.cast("string")
    return F.when(said.isNull(), "-").otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def folded(proof: Column, digest: Column) -> Column:
    """The root that a leaf and its proof give."""

    def step(node: Column, at: Column) -> Column:
        other, side = F.substring(at, 2, 64), F.substring(at, 1, 1)
        return F.sha2(F.when(side == "<", F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(proof, digest, step)


def siblings(proof: Column) -> Column:
    """The digests of a proof, one after the other."""
    return F.array_join(F.transform(proof, lambda x: F.substring(x, 2, 64)), "")


# --- trees of a block ----------------------------------------------------------------------------------------------


def _node(left: str | None, right: str | None) -> str | None:
    if left is None:
        return None
    return hashlib.sha256((left + (right or "")).encode()).hexdigest()


def _height(block: int, leaves: int, levels: int) -> int:
    """The levels of a block's tree: all, but in a group's only block."""
    return levels if block else (leaves - 1).bit_length()


def block_root(digests: list[str], height: int) -> str:
    for _ in range(height):
        digests = [_node(digests[i], digests[i + 1] if i + 1 < len(digests) else None) for i in range(0, len(digests), 2)]
    return digests[0]


class _Subtree:
    """The nodes of levels [low, top) below the node (top, index), built by a stack that hashes leaves in order."""

    def __init__(self, digests: list[str], low: int, top: int, index: int):
        self.digests, self.low, self.top = digests, low, top
        self.next, self.end = index << top, index + 1 << top
        self.stack: list[tuple[int, int, str | None]] = []
        self.nodes: dict[tuple[int, int], str | None] = {}

    def step(self) -> bool:
        """Push a leaf or join the two nodes on top; False once the subtree is complete."""
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            _, _, right = stack.pop()
            level, index, left = stack.pop()
            made = (level + 1, index >> 1, _node(left, right))
        elif self.next < self.end:
            made = (0, self.next, self.digests[self.next] if self.next < len(self.digests) else None)
            self.next += 1
        else:
            return False
        if made[0] == self.top:
            self.next = self.end
            return False
        stack.append(made)
        if made[0] >= self.low:
            self.nodes[made[0], made[1]] = made[2]
        return True


def paths(digests: list[str], height: int) -> Iterator[list[str]]:
    """The authentication paths of the leaves of one block, in order (fractal traversal)."""
    bands = [(low, min(low + BAND, height)) for low in range(0, height, BAND)]
    existing = []
    for low, top in bands:
        tree = _Subtree(digests, low, top, 0)
        while tree.step():
            pass
        existing.append(tree.nodes)
    desired = [_Subtree(digests, low, top, 1) for low, top in bands]
    for t in range(len(digests)):
        path = []
        for level in range(height):
            at = t >> level
            other = existing[level // BAND][level, at ^ 1]
            path.append("=" if other is None else ("<" if at & 1 else ">") + other)
        yield path
        for k, (low, top) in enumerate(bands[:-1]):  # the last band holds the block's root and never moves on
            tree = desired[k]
            if tree.step():
                tree.step()
            if (t + 1) % (1 << top) == 0:
                existing[k] = tree.nodes
                desired[k] = _Subtree(digests, low, top, (t + 1 >> top) + 1)


# --- blocks in tasks -----------------------------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list | None, str | None, pa.Table]]:
    """(group, block, its proof, its note, its nodes) for each block of a partition; rows come sorted."""
    key, lead, held = None, (None, None), []
    for batch in batches:
        groups, blocks = batch.column("g").to_pylist(), batch.column("block").to_pylist()
        leads = batch.column("lead").to_pylist() if "lead" in batch.schema.names else None
        start = 0
        for i, now in enumerate(zip(groups, blocks)):
            if now != key:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if key is not None:
                    yield *key, *lead, pa.Table.from_batches(held)
                key, lead, held, start = now, (None, None), [], i
            if leads is not None and leads[i]:
                lead, start = (batch.column("proof")[i].as_py(), batch.column("note")[i].as_py()), i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if key is not None:
        yield *key, *lead, pa.Table.from_batches(held)


def _roots(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for group, block, _, _, nodes in _blocks(batches):
            digests = nodes.column("digest").to_pylist()
            out.append((group, block, block_root(digests, _height(block, len(digests), levels))))
            if len(out) == BATCH_ROWS:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], names=["g", "at", "digest"])


def _proofs(keep: list[str], levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "at", "digest", *keep]
        for _, block, above, note, nodes in _blocks(batches):
            digests = nodes.column("digest").to_pylist()
            made = paths(digests, _height(block, len(digests), levels))
            for start in range(0, len(digests), BATCH_ROWS):
                some = nodes.select(names).slice(start, BATCH_ROWS)
                proof = pa.array([next(made) + above for _ in range(some.num_rows)], pa.list_(pa.string()))
                full = some.append_column("proof", proof).append_column("note", pa.array([note] * some.num_rows, pa.string()))
                yield from full.combine_chunks().to_batches()

    return run


def _numbered(offsets: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, began = None, 0, False
        for batch in batches:
            runs = pc.run_end_encode(batch.column("g"))
            places, start = [], 0
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if not began or value != group:
                    at = 0 if began else offsets.get(batch.column("part")[0].as_py(), 0)
                    group, began = value, True
                places.append(np.arange(at, at + end - start))
                at, start = at + end - start, end
            rows = batch.drop_columns(["part"])
            yield rows.append_column("at", pa.array(np.concatenate(places) if places else np.array([], np.int64), pa.int64()))

    return run


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (g, digest, ...) with `at`, a row's place in its group by `order`, then by digest."""
    by = [F.col("g").asc(), *order, F.col("digest").asc(), F.col("tie").asc()]
    ranged = cut(
        rows.withColumn("tie", F.rand(SEED)).repartitionByRange(shuffle_width(rows.sparkSession), *by).sortWithinPartitions(*by).drop("tie")
        .withColumn("part", F.spark_partition_id())
    )
    each = ranged.groupBy("part", "g").agg(F.count("*").alias("n"))
    edges = each.groupBy("part").agg(
        F.min("g").alias("first"), F.max("g").alias("last"), F.min_by("n", "g").alias("n_first"), F.max_by("n", "g").alias("n_last")
    )
    offsets, group, before = {}, None, 0
    for e in sorted(edges.collect(), key=lambda e: e["part"]):  # one row a partition
        offsets[e["part"]] = before if e["first"] == group else 0
        before = e["n_last"] + (offsets[e["part"]] if e["first"] == e["last"] else 0)
        group = e["last"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return cut(ranged.mapInArrow(_numbered(offsets), f"{kinds}, at long"))


def _dealt(nodes: DataFrame) -> DataFrame:
    """Blocks together, in order, each in one task."""
    sort = ["g", "block", *(["lead"] if "lead" in nodes.columns else []), "at"]
    return nodes.repartition(shuffle_width(nodes.sparkSession), "g", "block").sortWithinPartitions(*(F.desc(c) if c == "lead" else F.asc(c) for c in sort))


def _block(levels: int) -> Column:
    return F.shiftright("at", levels).alias("block")


def _climbed(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes of each tier of blocks, from the leaves to one node a group."""
    tiers = [nodes]
    while True:
        up = cut(_dealt(tiers[-1].select("g", "at", "digest", _block(levels))).mapInArrow(_roots(levels), "g string, at long, digest string"))
        tiers.append(up)
        if not up.agg(F.max("at")).first()[0]:
            return tiers


def _descended(tiers: list[DataFrame], top: DataFrame, keep: list[str], levels: int) -> DataFrame:
    """The leaves with `proof` and `note`, from those of each group's root: top (g, proof, note)."""
    above = top.select("g", F.lit(0).cast("long").alias("at"), "proof", "note")
    for k in range(len(tiers) - 2, -1, -1):
        held = ["g", "at", "digest", *(keep if k == 0 else [])]
        kinds = dict(tiers[k].dtypes)
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in held), "proof array<string>", "note string"])
        nodes = tiers[k].select(*held, _block(levels), F.lit(False).alias("lead"))
        leads = above.select("g", F.col("at").alias("block"), F.lit(True).alias("lead"), "proof", "note")
        above = _dealt(nodes.unionByName(leads, allowMissingColumns=True)).mapInArrow(_proofs(held[3:], levels), schema)
        if k:
            above = cut(above)
    return above


def manifest(
    rows: DataFrame, fields: Sequence[str] = FIELDS, group_col: str = "lang", id_col: str = "doc_id", keep: Sequence[str] = (), levels: int = LEVELS
) -> DataFrame:
    """(id, group, *keep, place, leaf, subroot, root, proof) for each row; blocks have 2 ** levels leaves."""
    spark = rows.sparkSession
    ship(spark)
    group = F.col(group_col).cast("string")
    kept = [f"k{i}" for i in range(len(keep))]
    leaves = rows.select(
        F.when(group.isNull(), "0").otherwise(F.concat(F.lit("1"), group)).alias("g"), F.col(id_col).alias("id"),
        leaf([F.col(c) for c in fields]).alias("digest"), *(F.col(c).alias(k) for c, k in zip(keep, kept)),
    )
    placed = _placed(leaves, [F.col("id").asc_nulls_first()])
    tiers = _climbed(placed, levels)
    subroots = tiers[-1].select(F.lit("").alias("g"), "digest", F.col("g").alias("name"))
    upper = _climbed(_placed(subroots, [F.col("name").asc()]), levels)
    top = upper[-1].select("g", F.array().cast("array<string>").alias("proof"), F.col("digest").alias("note"))
    # as many rows as there are groups; note is the root
    groups = cut(_descended(upper, top, ["name"], levels).select(F.col("name").alias("g"), "proof", F.concat_ws(":", "digest", "note").alias("note")))
    found = _descended(tiers, groups, ["id", *kept], levels)
    return found.select(
        F.col("id").alias(id_col), F.when(F.col("g") != "0", F.expr("substring(g, 2)")).alias(group_col), *(F.col(k).alias(c) for c, k in zip(keep, kept)),
        F.col("at").alias("place"), F.col("digest").alias("leaf"), F.substring("note", 1, 64).alias("subroot"), F.substring("note", 66, 64).alias("root"), "proof",
    )
