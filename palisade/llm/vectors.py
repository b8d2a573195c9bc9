"""Blocks of vectors: how the searches lay out a query set against all rows.

`blocks` reads vectors once, drops those that take no part, and packs the rows of each task into blocks of bounded
size, in single precision where that loses nothing. `against` deals blocks into groups and brings every group of queries
together with every group of rows, in tasks of equal and bounded size. So what is moved grows with queries times rows,
divided by a group's size: a group has `DATA_ROWS` rows and `QUERY_ROWS` queries, and up to `WIDER` times as many once
there are more groups than the session has tasks for. What a task returns is at most k rows a query, so the last step,
the k best of each query over all groups, moves little.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palisade.llm.common import cut, ship, shuffle_width

DATA_ROWS, QUERY_ROWS, WIDER = 8192, 4096, 8
_BLOCK = "block long, dim int, rows long, asked long, ids binary, numbers binary, values binary, extra binary"
FOUND = "query long, query_id long, vec_id long, score {}"


def _packed(values: np.ndarray) -> bytes:
    """Vectors as bytes: single precision where it holds every component exactly. `Rows` sees by the length."""
    with np.errstate(over="ignore"):
        narrow = values.astype(np.float32)
    return (narrow if np.array_equal(narrow, values) else values).tobytes()


def blocks(vectors: DataFrame, id_col: str, vector_col: str, every: int, convert, extra=None) -> DataFrame:
    """Packed rows. convert: an array of vectors to what is compared, with a mask of the rows that take part.

    Vectors of different lengths go to different blocks. A null id takes no part. extra: of the converted array, kept
    beside it.
    """
    ship(vectors.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        base, row, block = TaskContext.get().partitionId() << 32, 0, 0
        held: dict[int, list] = {}

        def packed(dim: int):
            nonlocal block
            parts = held.pop(dim)
            ids, numbers, values = (np.concatenate([p[i] for p in parts]) for i in range(3))
            for at in range(0, len(ids), DATA_ROWS):
                part = slice(at, at + DATA_ROWS)
                asked = int((ids[part] % every == 0).sum())
                more = extra(values[part]).tobytes() if extra else b""
                columns = (base + block, dim, len(ids[part]), asked, ids[part].tobytes(), numbers[part].tobytes(), _packed(values[part]), more)
                block += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c], t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4))],
                    names=["block", "dim", "rows", "asked", "ids", "numbers", "values", "extra"],
                )

        for got in batches:
            ids, lists = got.column(0), got.column(1)
            number = base + row + np.arange(len(ids))
            row += len(ids)
            sizes = np.array([len(x) if x.is_valid and i.is_valid else -1 for i, x in zip(ids, lists)])
            for dim in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == dim)
                flat = lists.take(pa.array(at)).flatten()
                value = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # a null becomes a nan
                value, good = convert(value)
                held.setdefault(dim, []).append((ids.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64)[good], number[at][good], value[good]))
                if sum(len(p[0]) for p in held[dim]) >= DATA_ROWS:
                    yield from packed(dim)
        for dim in list(held):
            yield from packed(dim)

    read = vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
    return cut(read.mapInArrow(run, _BLOCK).where("rows > 0"))


class Rows:
    """The rows of some blocks, unpacked; queries: only those that are asked for."""

    def __init__(self, packed: list[dict], every: int = 0, width: int = 0):
        dim = packed[0]["dim"]
        self.ids = np.concatenate([np.frombuffer(p["ids"], np.int64) for p in packed])
        self.numbers = np.concatenate([np.frombuffer(p["numbers"], np.int64) for p in packed])
        kind = lambda p: np.float64 if len(p["values"]) == 8 * dim * p["rows"] else np.float32
        self.values = np.concatenate([np.frombuffer(p["values"], kind(p)).astype(np.float64).reshape(-1, dim) for p in packed])
        self.extra = np.concatenate([np.frombuffer(p["extra"], np.uint8).reshape(-1, width) for p in packed]) if width else None
        if every:
            keep = self.ids % every == 0
            self.ids, self.numbers, self.values = self.ids[keep], self.numbers[keep], self.values[keep]


def against(packed: DataFrame, every: int, k: int, search, width: int = 0, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): search(queries, rows) on each pair of groups, then each query's k best.

    exact: scores are whole numbers.
    """
    total = packed.agg(F.sum("rows")).first()[0] or 0
    wider = min(WIDER, max(1, int(total / (4 * shuffle_width(packed.sparkSession) * DATA_ROWS))))
    one = Window.partitionBy("dim").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    groups = cut(
        packed.select("block", "dim", "rows", "asked")
        .withColumn("g", F.floor(F.coalesce(F.sum("rows").over(one), F.lit(0)) / (wider * DATA_ROWS)).cast("int"))
        .withColumn("q", F.floor(F.coalesce(F.sum("asked").over(one), F.lit(0)) / (wider * QUERY_ROWS)).cast("int"))
        .select("block", "g", "q", F.max("g").over(Window.partitionBy("dim")).alias("gs"), F.max("q").over(Window.partitionBy("dim")).alias("qs"))
    )
    all_ = packed.join(groups, "block")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c)))
    body = ["dim", "rows", "ids", "numbers", "values"]
    rows = all_.select("g", upto("qs").alias("q"), F.lit(False).alias("asks"), *body, "extra")
    queries = all_.where("asked > 0").select(upto("gs").alias("g"), "q", F.lit(True).alias("asks"), *body, F.lit(None).cast("binary").alias("extra"))

    def run(table: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        both = table.to_pylist()
        left, right = [r for r in both if r["asks"]], [r for r in both if not r["asks"]]
        if left and right:
            asked, data = Rows(left, every), Rows(right, width=width)
            for at in range(0, len(asked.ids), QUERY_ROWS):
                part = slice(at, at + QUERY_ROWS)
                q, r, score = search(asked.values[part], asked.numbers[part], data)
                out = [
                    np.concatenate([a, b]) if len(a) else b
                    for a, b in zip(out, (asked.numbers[part][q], asked.ids[part][q], data.ids[r], score.astype(np.int64 if exact else np.float64)))
                ]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query", "query_id", "vec_id", "score"), out, (pa.int64(), pa.int64(), pa.int64(), pa.int64() if exact else pa.float64()))})

    found = queries.unionByName(rows).groupBy("dim", "g", "q").applyInArrow(run, FOUND.format("long" if exact else "double"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


