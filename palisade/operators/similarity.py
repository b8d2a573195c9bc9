"""Similar functions and names: token shingles, exact Jaccard by rarest shingles, clusters, look-alike names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions import scalars
from palisade.operators.graphs import _cut

SHINGLE, SIMILAR, LEAST_TOKENS, BUCKET = 5, 0.9, 40, 60
#: Shingles of more sets than COMMON come late in the order; so many shingles are read beyond twice what a set needs.
COMMON, SPARE = 16, 8
#: Rows of a smaller side that are sent to every task, at most; each is one to three numbers.
BROADCAST = 1_000_000


def shingles(tokens: Column, n: int = SHINGLE) -> Column:
    """Sorted distinct hashes of the runs of n tokens, as whole numbers of 64 bits."""
    firsts = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
    # past the end is null, which the hash leaves out
    return F.sort_array(F.array_distinct(F.transform(firsts, lambda t, i: F.xxhash64(t, *(F.get(tokens, i + k) for k in range(1, n))))))


def _few(keys: DataFrame) -> DataFrame:
    """keys, sent to every task if a count says that they are few: what is looked for in a large table is then not shuffled."""
    keys = _cut(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys


def _rarest(reps: DataFrame, similar: float) -> DataFrame:
    """(rep, n, need, rare): the first need + 1 shingles of each set (all, if fewer) in one order of all shingles.

    Any order that is the same for all sets finds every pair; this one has the shingles of many sets last, by steps of powers
    of two, and else goes by hash. So a set is read from its smallest hashes on, and what is counted and moved is a fifth of
    it: twice as many as are needed, as those of many sets among them are passed over. Sets that then have too few are read
    whole and the counts made again. After that the order is fixed, and sets that have too few in it are read whole as well.
    """
    need = (F.col("n") - F.ceil(similar * F.col("n") - 1e-9) + 1).cast("int")
    reps = reps.select("rep", "n", need.alias("need"), "set")
    read = _cut(reps.select("rep", "n", "need", F.slice("set", F.lit(1), 2 * F.col("need") + SPARE).alias("read")))
    level = F.floor(F.log2(F.col("sets") / COMMON)).cast("int")
    for counted in (True, True, False):
        held = read.select("rep", F.explode("read").alias("h"))
        if counted:
            common = _cut(held.groupBy("h").agg(F.count("*").alias("sets")).where(F.col("sets") > COMMON).select("h", level.alias("level")))
        late = held.join(common, "h").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("level", "h"))).alias("late"))
        late = read.join(late, "rep", "left").withColumn("late", F.coalesce(F.col("late.h"), F.array().cast("array<bigint>")))
        known = _cut(late.select("rep", "n", "need", "late", F.array_except("read", "late").alias("early"), (F.size("read") == F.col("n")).alias("whole")))
        few = _few(known.where((F.size("early") <= F.col("need")) & ~F.col("whole")).select("rep"))
        if few.isEmpty():
            break
        more = reps.join(few, "rep", "left_semi").select("rep", "n", "need", F.col("set").alias("read"))
        read = _cut(read.join(few, "rep", "left_anti").unionByName(more))
    return known.select("rep", "n", "need", F.slice(F.concat("early", "late"), F.lit(1), F.col("need") + 1).alias("rare"))


def similar_pairs(units: DataFrame, key: str = "key", tokens: str = "tokens", least: int = LEAST_TOKENS, similar: float = SIMILAR) -> DataFrame:
    """(a, b, similarity) of all units whose shingle sets reach the similarity.

    Units with the same set are one representative while pairs are made (`copies`), so a large group of copies makes
    no pairs inside. Two sets that reach the similarity share one of the first n - ceil(similar * n) + 1 shingles of
    either, n being the set's size, in an order of all shingles that has the common ones last (`_rarest`), so pairs meet in
    the buckets of these.
    In a bucket of many sets, more than `BUCKET` and than the longest list of rarest shingles in it, pairs have to share
    two: without the bucket's shingle the same holds for the rest. So no pair is lost, and a hot bucket is spread over
    many keys. The similarity is above 0.5, as two different sets that share one shingle alone never reach it then.
    """
    if not 0.5 < similar <= 1:
        raise ValueError("the similarity has to be above 0.5 and at most 1")
    # short ones are left out after the table is cut: before, a filter would make all tokens a second time
    sets = units.select(F.col(key).alias("key"), F.when(F.size(tokens) >= least, shingles(F.col(tokens))).alias("set"))
    sets = _cut(sets.withColumn("d", F.struct(F.size("set").alias("n"), F.xxhash64("set").alias("x"), F.xxhash64(F.reverse("set")).alias("y")))).where("set IS NOT NULL")
    reps = _cut(sets.groupBy("d").agg(F.min("key").alias("rep"), F.first("set").alias("set")).withColumn("n", F.size("set")))
    ranked = _cut(_rarest(reps, similar))
    posted = ranked.select("rep", "n", "need", F.explode(F.slice("rare", 1, F.col("need"))).alias("h"))
    buckets = posted.groupBy("h").agg(F.count("*").alias("in_bucket"), F.max("need").alias("longest")).where("in_bucket > 1")
    posted = posted.join(buckets, "h")
    many = (F.col("in_bucket") > BUCKET) & (F.col("in_bucket") > F.col("longest"))
    small = posted.where(~many).select("rep", "n", "h", F.lit(None).cast("long").alias("h2"))
    rest = F.slice(F.array_remove("rare", F.col("h")), 1, F.col("need"))
    large = posted.where(many).select("rep", "n", "h").join(ranked.select("rep", "need", "rare"), "rep").select("rep", "n", "h", F.explode(rest).alias("h2"))
    posted = small.unionByName(large).withColumn("h2", F.coalesce("h2", "h"))
    a, b = posted.alias("a"), posted.alias("b")
    fits = (F.col("a.n") >= similar * F.col("b.n") - 1e-9) & (F.col("b.n") >= similar * F.col("a.n") - 1e-9)
    near = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.h2") == F.col("b.h2")) & (F.col("a.rep") < F.col("b.rep")) & fits)
    pairs = _cut(near.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct())
    met = reps.join(_few(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()), "rep", "left_semi")  # sets without a pair stay where they are
    full = pairs.join(met.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a").join(met.select(F.col("rep").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = full.withColumn("similarity", common / (F.size("sa") + F.size("sb") - common)).where(F.col("similarity") >= similar).select("a", "b", "similarity")
    copies = sets.join(reps.select("d", "rep"), "d").where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("similarity"))
    return links.unionByName(copies)


def clusters(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, cluster): connected components by least labels with jumps over labels; cluster is the least member."""
    both = _cut(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    label = _cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")))
    for _ in range(rounds):
        seen = both.join(label.select(F.col("node").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("m"))
        low = label.join(seen, F.col("node") == F.col("x")).select("node", F.least("label", "m").alias("low"), F.col("label").alias("was"))
        jump = label.select(F.col("node").alias("j"), F.col("label").alias("jl"))
        new = _cut(low.join(jump, F.col("low") == F.col("j"), "left").select("node", F.least("low", F.coalesce("jl", "low")).alias("label"), "was"))
        label = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return label.withColumnRenamed("label", "cluster")
    raise RuntimeError("labels did not settle")


def look_alikes(names: DataFrame, popular: DataFrame, least: int = 5) -> DataFrame:
    """(name, popular): names one edit from a popular name that aren't popular themselves; the smallest such name.

    Names are compared in buckets, not with all: a name one edit away shares a signature with one character left out
    (or is equal to it), so the join is an equi-join on those signatures.
    """

    def signatures(c: str) -> Column:
        cuts = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(F.col(c)))))
        return F.array_distinct(F.concat(F.array(F.col(c)), cuts))

    n = names.select("name").distinct().where(F.length("name") >= least)
    p = popular.select(F.col("name").alias("popular")).distinct().where(F.length("popular") >= least)
    n = n.join(p, F.col("name") == F.col("popular"), "left_anti")
    pairs = n.select("name", F.explode(signatures("name")).alias("s")).join(p.select("popular", F.explode(signatures("popular")).alias("s")), "s").select("name", "popular").distinct()
    # swapping two neighbours leaves both names with a common signature as well
    return pairs.where(scalars.one_edit_apart(F.col("name"), F.col("popular"))).groupBy("name").agg(F.min("popular").alias("popular"))


def name_families(functions: DataFrame, files: int = 3) -> DataFrame:
    """(name, n_files, n): names of functions that `files` files or more define."""
    return functions.groupBy("name").agg(F.countDistinct("path").alias("n_files"), F.count("*").alias("n")).where(F.col("n_files") >= files)


def shared_runs(units: DataFrame, items: DataFrame, unit: str, item: str, words: str, n: int = 8) -> DataFrame:
    """(unit, item, shared): how many distinct runs of n words a unit shares with an item.

    Runs are 96 bits of hashes over the array of words, so no run is ever a string. The items' runs are broadcast if a
    count says that they are few; else both sides are shuffled by hash, behind the engine's own runtime filter.
    """

    def runs(df: DataFrame, key: str) -> DataFrame:
        w = df.where(F.size(words) >= n)
        at = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.struct(F.xxhash64(F.slice(words, i, n)).alias("h"), F.hash(F.element_at(words, i), F.element_at(words, i + n - 1)).alias("c")))
        return w.select(key, F.inline(at))

    few = _cut(runs(items, item).distinct())
    side = F.broadcast(few) if few.count() <= BROADCAST else few
    met = runs(units, unit).join(side, ["h", "c"])
    return met.groupBy(unit, item).agg(F.count_distinct("h", "c").alias("shared"))
