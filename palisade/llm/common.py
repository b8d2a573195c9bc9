"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, for the operators that run Python there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, os.path.join(top.name, path.relative_to(top)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; set one only in a local session that names none."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"{tempfile.gettempdir()}/palisade-checkpoints-{uuid.uuid4().hex}"
    context.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage, so lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """The parallelism that the session is sized for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def components(edges: DataFrame, low: str = "a", high: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components by alternating large-star and small-star steps, all of it distributed.

    edges: two long columns naming the ends. Returns (node, root) for each node that has an edge; root is the
    smallest node of its component. Each round is a checkpoint; the number of edges never grows. An empty input
    gives an empty result; self-loops and repeated edges change nothing.
    """

    def step(links: DataFrame, small: bool) -> DataFrame:
        v, u = F.col("v"), F.col("u")
        both = links.select(F.col("x").alias("v"), F.col("y").alias("u"))
        if not small:
            both = both.union(links.select(F.col("y").alias("v"), F.col("x").alias("u")))
        # in a small-star each node looks at its smaller neighbours only: links are kept with x > y
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("w"), F.least("w", "m").alias("m"))
        joined = both.join(least, v == F.col("w"))
        if small:
            moved = joined.select(u.alias("x"), F.col("m").alias("y")).union(least.select(F.col("w").alias("x"), F.col("m").alias("y")))
        else:
            moved = joined.where(u > v).select(u.alias("x"), F.col("m").alias("y"))
        return moved.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()

    def mark(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())

    links = cut(
        edges.select(F.greatest(low, high).alias("x"), F.least(low, high).alias("y")).where("x <> y").distinct()
    )
    seen = mark(links)
    for _ in range(rounds):
        if not seen[0]:
            break
        links = cut(step(step(links, small=False), small=True))
        now = mark(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
    return links.select(F.col("x").alias("node"), F.col("y").alias("root")).union(roots)
