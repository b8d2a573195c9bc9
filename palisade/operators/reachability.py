"""Which root brings a vulnerable package in, over what path, and what that says of it (VEX).

Paths are shortest ones from many roots at once. The graph is first cut to what leads to a target, by deltas from the targets
back; then each round carries the newly reached (root, package) pairs one edge on, with the path that reached them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.operators.scratch import Scratch


def leading_to(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(scope, name): the targets and all that leads to one."""
    scratch = Scratch(edges.sparkSession)
    back = edges.select("scope", F.col("child").alias("name"), "parent")
    seen = delta = scratch.keep(targets.select("scope", "name").dropna().distinct())
    while not delta.isEmpty():
        step = delta.join(back, ["scope", "name"]).select("scope", F.col("parent").alias("name")).distinct()
        delta = scratch.keep(step.join(seen, ["scope", "name"], "left_anti"))
        seen = seen.union(delta)
    return seen


def _paths(edges: DataFrame, roots: DataFrame, targets: DataFrame) -> DataFrame:
    """(scope, root, name, k, depth, path): as `dependency_paths`, for paths of several classes in one loop.

    edges have k, and a path has the largest of its edges'. For each k there is the shortest path of that class, unless one of
    a lower class is shorter; so what holds for the edges up to a class is found without a loop of its own.
    """
    scratch = Scratch(edges.sparkSession)
    edges = scratch.keep(edges.dropna(subset=["scope", "parent", "child"]).groupBy("scope", "parent", "child").agg(F.min("k").alias("k")))
    targets = targets.select("scope", "name").dropna().distinct()
    useful = leading_to(edges, targets)
    on = scratch.keep(edges.join(useful.withColumnRenamed("name", "child"), ["scope", "child"], "left_semi").select("scope", F.col("parent").alias("name"), "child", F.col("k").alias("own")))
    start = roots.select("scope", "name").dropna().distinct().join(useful, ["scope", "name"], "left_semi")
    front = scratch.keep(start.select("scope", F.col("name").alias("root"), "name", F.lit(0).alias("k"), F.lit(0).alias("depth"), F.array("name").alias("path")))
    seen, key = front, ["scope", "root", "name"]
    while not front.isEmpty():
        step = front.join(on, ["scope", "name"]).select("scope", "root", F.col("child").alias("name"), F.greatest("k", "own").alias("k"), F.concat("path", F.array("child")).alias("path"))
        earlier = seen.groupBy(*key).agg(F.min("k").alias("least"))
        new = step.join(earlier, key, "left").where("least IS NULL OR least > k")
        best = new.groupBy(*key, "k").agg(F.min("path").alias("path"))
        front = scratch.keep(best.select(*key, "k", (F.size("path") - 1).alias("depth"), "path"))
        seen = seen.unionByName(front)
    return seen.join(targets, ["scope", "name"], "left_semi").select("scope", "root", "name", "k", "depth", "path")


def dependency_paths(edges: DataFrame, roots: DataFrame, targets: DataFrame) -> DataFrame:
    """(scope, root, name, depth, path): the shortest path from each root to each target it reaches, of several the least.

    edges: (scope, parent, child), cycles allowed; roots, targets: (scope, name); scope is a lock file or project. path holds the
    names from the root on; a root that is a target has depth 0. Nulls join with nothing; an empty table gives an empty result.
    """
    return _paths(edges.select("scope", "parent", "child", F.lit(0).alias("k")), roots, targets).drop("k")


def vex(affected: Column, shipped: Column) -> Column:
    """affected: whether the version is, null if that can't be told; shipped: whether a path of shipped dependencies leads to it.

    A package that isn't affected or isn't shipped is not_affected; one of which either can't be told is under_investigation.
    """
    no = (affected == F.lit(False)) | (shipped == F.lit(False))
    return F.when(F.coalesce(no, F.lit(False)), "not_affected").when(affected & shipped, "affected").otherwise("under_investigation")


def vex_statements(packages: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(scope, name, root, depth, path, status) for each package that is affected or may be.

    packages: (scope, name, affected), several rows of one package fold to true before null before false; edges: (scope, parent,
    child, dev): a path over a dev edge isn't shipped, and a null in dev leaves that open. root, depth and path are those
    of the shortest shipped path, else of the shortest of all (then the least root); null for a package no root reaches.
    """
    told = packages.groupBy("scope", "name").agg(F.max("affected").alias("yes"), F.count("*").alias("n"), F.count("affected").alias("known"))
    asked = Scratch(packages.sparkSession).keep(
        told.select("scope", "name", F.when(F.col("yes"), True).when(F.col("known") == F.col("n"), False).alias("affected")).where("affected IS NULL OR affected")
    )
    kind = F.when(~F.col("dev"), 0).when(F.col("dev"), 2).otherwise(1)
    kinds = _paths(edges.select("scope", "parent", "child", kind.alias("k")), roots, asked)
    best = kinds.groupBy("scope", "name").agg(F.min(F.struct("k", "depth", "root", "path")).alias("b"))
    shipped = F.when(F.col("b.k") == 0, True).when(F.coalesce(F.col("b.k"), F.lit(2)) == 2, False)
    return asked.join(best, ["scope", "name"], "left").select("scope", "name", "b.root", "b.depth", "b.path", vex(F.col("affected"), shipped).alias("status"))
