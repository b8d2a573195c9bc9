"""Names to files and functions: an index of path suffixes by directory prefix, and calls resolved over it.

A file answers to every dotted suffix of its path (`a/b/c.py` to `a.b.c`, `b.c` and `c`). Of several files that answer, the one
that shares most leading directories with the asking file is meant; if two share equally many, none is. The index holds
one row for each (suffix, directory prefix), with the number of files and one of them, so a question is a few lookups along
the asking file's own prefixes, however many files answer to a name: nothing compares all files with all questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.operators.scratch import Scratch


#: Rows of a table of functions that every task may hold; more are dealt out like the calls.
FEW = 100_000


def _large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: written tables are far smaller on disk than in the memory of a driver that
    would broadcast them, so their files' size says nothing."""
    return df.hint("merge")


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def _heads(parts: Column) -> Column:
    """All leading stretches, from none to all parts."""
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def names(path: Column) -> Column:
    """The dotted names that a file answers to; a package's own file answers to the package's names."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), r"(^|/)(?:__init__|index)$", "")
    parts = F.filter(_parts(bare), lambda p: p != "")
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return F.filter(each, lambda n: n != "")


def module_index(files: DataFrame) -> DataFrame:
    """(name, head, files, target): how many files below a directory prefix answer to a name, and the first of them."""
    own = files.select("path").where("path IS NOT NULL").distinct()
    # a plain explode has its arrays tested for each row before these are made distinct
    each = own.select("path", F.explode_outer(_heads(_parts(F.col("path")))).alias("head"), names(F.col("path")).alias("names"))
    return each.select("path", "head", F.explode_outer("names").alias("name")).where("name IS NOT NULL").groupBy("name", "head").agg(F.count("*").alias("files"), F.min("path").alias("target"))


def resolve_modules(asked: DataFrame, files: DataFrame) -> DataFrame:
    """asked (path, module), each once, with target and state: found, ambiguous or missing (target is null but for the first)."""
    asked = Scratch(asked.sparkSession).keep(asked.select("path", "module").distinct())
    head = F.expr("substring_index(path, '/', shared)")
    each = asked.select("path", "module", F.explode(F.sequence(F.lit(0), F.size(_parts(F.col("path"))))).alias("shared"))
    index = module_index(files).select(F.col("name").alias("module"), "head", F.struct("files", "target").alias("b"))
    # the longest prefix first, as a number alone; what lies below it is looked up once
    best = each.withColumn("head", head).join(_large(index.drop("b")), ["module", "head"]).groupBy("path", "module").agg(F.max("shared").alias("shared"))
    met = best.withColumn("head", head).join(_large(index), ["module", "head"]).select("path", "module", "b")
    out = asked.join(_large(met), ["path", "module"], "left")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("b.files") > 1, "ambiguous").otherwise("found")
    return out.select("path", "module", F.when(state == "found", F.col("b.target")).alias("target"), state.alias("state"))


def _root(name: Column | str) -> Column:
    return F.substring_index(name, ".", 1)


def _meant(k: Column, i: Column) -> tuple[Column, Column]:
    """(module, function) that a callee means of which k parts are bound by the import i (module, member)."""
    parts = F.split("callee", r"\.")
    n = F.size(parts)
    # what lies between the bound part and the function's name
    rest = F.slice(parts, F.least(k + 1, n), F.greatest(n - k - 1, F.lit(0)))
    whole = i["member"].isNotNull() & (n == k)
    owner = F.concat(F.array(i["module"]), F.when(i["member"].isNotNull(), F.array(i["member"])).otherwise(F.array().cast("array<string>")), rest)
    module = F.when(whole, i["module"]).when(n > k, F.array_join(owner, "."))
    return module.alias("module"), F.when(whole, i["member"]).when(n > k, F.element_at(parts, -1)).alias("function")


def bound(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """calls (path, callee, argc), each once, with the module and the function that the file's imports bind the callee to.

    imports: (path, line, local, module, member); member is null where the module itself is bound. The longest leading part
    of the callee that is bound counts, and of several imports of it that on the last line (then the least module and member).
    Unbound calls have null in both.

    All that can bind a callee begins with its first part, so both sides are dealt once, by the file and that part, and then
    made distinct and joined where they lie. Only callees whose first part begins a dotted import of the file as well are
    looked up part by part. The result is written once, as it is read several times.
    """
    scratch = Scratch(calls.sparkSession)
    key, same = F.xxhash64("path", "root").alias("key"), ["key", "path", "root"]  # sorted by a number before any text
    dealt = calls.select("path", "callee", "argc", _root("callee").alias("root")).select("*", key).repartition(*same).distinct()
    known = imports.select("path", _root("local").alias("root"), "line", "local", "module", "member").select("*", key).repartition(*same)
    meant, order, plain = F.struct("module", "member"), F.struct(-F.coalesce("line", F.lit(0)), "module", "member"), F.col("local") == F.col("root")
    firsts = known.groupBy(*same).agg(F.min_by(meant, F.when(plain, order)).alias("i"), F.max(~plain).alias("dotted"))
    dotted = F.coalesce("dotted", F.lit(False)) & F.contains("callee", F.lit("."))
    met = scratch.keep(dealt.join(_large(firsts), same, "left").select("path", "callee", "argc", *_meant(F.when(F.col("i").isNotNull(), 1), F.col("i")), dotted.alias("dotted")))
    again = met.where("dotted").select("path", "callee", "argc")
    if again.isEmpty():
        return met.drop("dotted")
    parts = F.split("callee", r"\.")
    heads = again.select("path", "callee").distinct().select("path", "callee", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("k", "local"))
    last = imports.groupBy("path", "local").agg(F.min_by(meant, order).alias("i"))
    found = heads.join(_large(last), ["path", "local"]).groupBy("path", "callee").agg(F.max_by(F.struct(F.col("k"), F.col("i")), "k").alias("b"))
    joined = again.join(_large(found), ["path", "callee"], "left").select("path", "callee", "argc", *_meant(F.col("b.k") + 1, F.col("b.i")))
    return met.where("NOT dotted").drop("dotted").unionByName(scratch.keep(joined))


def resolve_calls(calls: DataFrame, imports: DataFrame, files: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, callee, argc, target, function, state) for each distinct call.

    functions: (path, name, argc), those of a file's top level. state is found, no_function (the file has none of that name and
    number of arguments), ambiguous or missing (the module), or unbound; target and function are null but where found.
    """
    named = bound(calls, imports)
    modules = resolve_modules(named.where("module IS NOT NULL").select("path", "module"), files)
    own = functions.select(F.col("path").alias("at"), F.col("name").alias("function"), "argc").distinct().withColumn("has", F.lit(True))
    own = Scratch(calls.sparkSession).keep(own)
    own = F.broadcast(own) if own.count() <= FEW else _large(own)
    # calls without a target are spread over the files that make them; their state is told before a function is looked at
    keyed = lambda df: df.withColumn("key", F.xxhash64("path", "module"))
    out = keyed(named).join(_large(keyed(modules)), ["key", "path", "module"], "left").withColumn("at", F.coalesce("target", "path")).join(own, ["at", "function", "argc"], "left")
    state = F.when(F.col("module").isNull(), "unbound").when(F.col("state") != "found", F.col("state")).when(F.col("has").isNull(), "no_function").otherwise("found")
    hit = state == "found"
    return out.select("path", "callee", "argc", F.when(hit, F.col("target")).alias("target"), F.when(hit, F.col("function")).alias("function"), state.alias("state"))
