"""Straight runs of a graph, contracted by jumps of doubling length."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palisade.operators.scratch import Scratch


def _jumped(nodes: DataFrame, above: DataFrame, longest: int, scratch: Scratch) -> DataFrame:
    """(unit, node, jump, dist, low, done): the head of each node's run by jumps of doubling length.

    low is the least node passed. What isn't done when a jump is longer than a unit lies on a closed run without a head.
    """
    at = nodes.join(above, ["unit", "node"], "left").select(
        "unit", "node", F.coalesce("above", "node").alias("jump"), F.col("above").isNotNull().cast("long").alias("dist"),
        F.least("node", F.coalesce("above", "node")).alias("low"), F.col("above").isNull().alias("done"),
    )
    at, length = scratch.keep(at), 1
    while length <= longest:
        if at.where("NOT done").isEmpty():
            break
        ahead = at.select("unit", F.col("node").alias("jump"), F.col("jump").alias("j"), F.col("dist").alias("d"), F.col("low").alias("l"), F.col("done").alias("z"))
        further = at.join(ahead, ["unit", "jump"]).select(
            "unit", "node", F.when(F.col("done"), F.col("jump")).otherwise(F.col("j")).alias("jump"),
            F.when(F.col("done"), F.col("dist")).otherwise(F.col("dist") + F.col("d")).alias("dist"), F.least("low", "l").alias("low"), (F.col("done") | F.col("z")).alias("done"),
        )
        at = scratch.keep(further, instead_of=at)
        length *= 2
    return at


def blocks(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(unit, node, block, place): runs of nodes that are left and entered in one way only, named by their first node.

    steps: (unit, src, dst), loops allowed; nodes: (unit, node), each once. A closed run that nothing enters begins at its least node.
    """
    scratch = Scratch(steps.sparkSession)
    steps = steps.select("unit", "src", "dst").distinct()
    leaves = steps.groupBy("unit", "src").agg(F.count("*").alias("n")).where("n = 1").select("unit", "src")
    enters = steps.groupBy("unit", "dst").agg(F.count("*").alias("n")).where("n = 1").select("unit", "dst")
    inner = steps.where("src <> dst").join(leaves, ["unit", "src"]).join(enters, ["unit", "dst"])
    above = scratch.keep(inner.select("unit", F.col("dst").alias("node"), F.col("src").alias("above")))
    longest = nodes.groupBy("unit").count().agg(F.max("count")).first()[0] or 0
    at = _jumped(nodes.select("unit", "node"), above, longest, scratch)
    out = at.where("done").select("unit", "node", F.col("jump").alias("block"), F.col("dist").alias("place"))
    closed = at.where("NOT done").select("unit", "node", "low")
    if not closed.isEmpty():
        rest = closed.join(above, ["unit", "node"]).where("node <> low").select("unit", "node", "above")
        again = _jumped(closed.select("unit", "node"), scratch.keep(rest), longest, scratch)
        out = out.unionByName(again.select("unit", "node", F.col("jump").alias("block"), F.col("dist").alias("place")))
    return out
