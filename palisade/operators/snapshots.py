"""Snapshots as hash trees over the digests of paths: roots, differences by descent, proofs of single files.

A file's place is the SHA-256 of its path; the first `depth` hexadecimal digits name its bucket, and each digit less the
node above, with sixteen children. The tree depends on its files alone, not on their order, and two snapshots of one depth
are compared from the root down, along differing nodes only. Levels are aggregations; a bucket holds some `BUCKET` files
whatever the number of files, as places are hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.operators.graphs import _cut

BUCKET = 64


def depth_for(files: int) -> int:
    """Digits that give buckets of about BUCKET files, 1 at least."""
    depth = 1
    while files > BUCKET * 16**depth:
        depth += 1
    return depth


def _entries(files: DataFrame) -> DataFrame:
    """(place, digest) of each file, once for each path: (path, text); repeated paths count with the least digest."""
    each = files.where("path IS NOT NULL").select(F.col("path").cast("string").alias("path"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("digest"))
    return each.groupBy("path").agg(F.min("digest").alias("digest")).select("path", F.sha2("path", 256).alias("place"), "digest")


def _hash(items: Column) -> Column:
    """The hash of an array of (name, digest), in the order of names."""
    return F.sha2(F.array_join(F.transform(F.array_sort(items), lambda x: F.concat_ws(":", x["name"], x["digest"])), "\n"), 256)


def tree(files: DataFrame, depth: int) -> DataFrame:
    """(level, prefix, digest, files): all nodes, level 0 the root; an empty table has none.

    files: (path, text); a null text is an empty file, null paths are left out.
    """
    items = lambda name: F.collect_list(F.struct(F.col(name).alias("name"), "digest"))
    entries = _entries(files)
    level = entries.groupBy(F.substring("place", 1, depth).alias("prefix")).agg(_hash(items("place")).alias("digest"), F.count("*").alias("files"))
    out = level.withColumn("level", F.lit(depth))
    for d in range(depth - 1, -1, -1):
        level = level.groupBy(F.substring("prefix", 1, d).alias("up")).agg(_hash(items("prefix")).alias("digest"), F.sum("files").alias("files")).withColumnRenamed("up", "prefix")
        out = out.unionByName(level.withColumn("level", F.lit(d)))
    return out.select("level", "prefix", "digest", "files")


def difference(old: DataFrame, new: DataFrame, old_tree: DataFrame, new_tree: DataFrame, depth: int) -> DataFrame:
    """(path, change): added, removed or changed files of two snapshots, found below differing nodes only.

    old_tree and new_tree are both of `depth`; a level joins the children of the nodes that differed on the one above. Trees and
    levels are written once: a level names the one above twice, so an uncut plan doubles with each level.
    """
    old_tree, new_tree = _cut(old_tree), _cut(new_tree)
    side = lambda nodes, name, d: nodes.where(F.col("level") == d).select("prefix", F.col("digest").alias(name))
    open_ = None
    for d in range(depth + 1):
        a, b = side(old_tree, "old", d), side(new_tree, "new", d)
        if open_ is not None:
            parent = open_.withColumnRenamed("prefix", "parent")
            a, b = (x.join(parent, F.substring("prefix", 1, d - 1) == F.col("parent"), "left_semi") for x in (a, b))
        open_ = a.join(b, "prefix", "full").where(~F.col("old").eqNullSafe(F.col("new"))).select("prefix")
        open_ = _cut(open_)
    below = lambda files, name: _entries(files).join(open_, F.substring("place", 1, depth) == F.col("prefix"), "left_semi").select("path", F.col("digest").alias(name))
    both = below(old, "old").join(below(new, "new"), "path", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def proofs(files: DataFrame, paths: DataFrame, depth: int) -> DataFrame:
    """(path, digest, proof): for each asked path that the snapshot holds, the members of its bucket, then the children of
    each node above, root last: array<array<struct<name, digest>>>, `depth` + 1 lists of some BUCKET or 16 members."""
    entries = _entries(files)
    asked = entries.join(paths.select(F.col("path").cast("string").alias("path")).distinct(), "path", "left_semi")
    members = lambda rows, name, d: rows.groupBy(F.substring(name, 1, d).alias("at")).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), "digest"))).alias("m"))
    nodes = tree(files, depth)
    out = asked.withColumn("proof", F.array().cast("array<array<struct<name:string,digest:string>>>"))
    for d in range(depth, -1, -1):
        level = members(entries, "place", d) if d == depth else members(nodes.where(F.col("level") == d + 1), "prefix", d)
        out = out.join(level, F.substring("place", 1, d) == F.col("at")).withColumn("proof", F.concat("proof", F.array("m"))).drop("at", "m")
    return out.select("path", "digest", "proof")


def proven(path: Column, digest: Column, proof: Column, root: Column) -> Column:
    """Whether a proof leads from a file to the root: each list holds what the one below hashes to, the last gives the root."""
    place, depth = F.sha2(path, 256), F.size(proof) - 1
    holds = lambda members, name, d: F.exists(members, lambda m: (m["name"] == name) & (m["digest"] == d))
    begin = F.struct(digest.alias("digest"), F.lit(True).alias("ok"), F.lit(0).alias("at"))

    def step(s: Column, members: Column) -> Column:
        name = F.when(s["at"] == 0, place).otherwise(F.substring(place, 1, depth - s["at"] + 1))
        return F.struct(_hash(members).alias("digest"), (s["ok"] & holds(members, name, s["digest"])).alias("ok"), (s["at"] + 1).alias("at"))

    return F.aggregate(proof, begin, step, lambda s: s["ok"] & (s["digest"] == root))
