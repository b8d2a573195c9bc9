"""Fragments of secrets in a text's other places: unions of intervals, and a join by eight-character grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

GRAM, MASK = 8, "***"


def union_of(intervals: DataFrame, *keys: str) -> DataFrame:
    """(keys, start, end): overlapping and touching half-open intervals of a key become one, by running maxima.

    Empty intervals and those with a null bound are left out.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    rows = intervals.where("start < end").select(*keys, "start", "end").distinct()
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = rows.withColumn("opens", F.coalesce((F.col("start") > before).cast("long"), F.lit(1)))
    island = opens.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _grams(text: Column) -> Column:
    """(place from 0, gram) of each stretch of GRAM characters."""
    places = F.when(F.length(text) >= GRAM, F.sequence(F.lit(0), F.length(text) - GRAM)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.substring(text, i + 1, F.lit(GRAM)).alias("gram")))


def fragments(texts: DataFrame, secrets: DataFrame, key: str = "path") -> DataFrame:
    """(key, start, end): all stretches of a text, in code points, that are made of GRAM-character pieces of its own secrets.

    texts: (key, text); secrets: (key, secret). Only texts that have a secret are taken apart; a secret shorter than GRAM has
    no fragments; whole secrets are fragments too.
    """
    parts = secrets.select(key, F.explode(_grams(F.col("secret"))).alias("g")).select(key, "g.gram").distinct()
    own = texts.select(key, "text").join(parts.select(key).distinct(), key, "left_semi")
    places = own.select(key, F.explode(_grams(F.col("text"))).alias("g")).select(key, "g.at", "g.gram")
    hits = places.join(parts, [key, "gram"]).select(key, F.col("at").alias("start"), (F.col("at") + GRAM).alias("end"))
    return union_of(hits, key)


def masked(texts: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """texts with each fragment replaced by the mask; texts without one stay as they are."""
    spans = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    text, spans_ = F.col("text"), F.col("spans")
    ends = F.concat(F.array(F.lit(0)), F.transform(spans_, lambda s: s["end"]))
    starts = F.concat(F.transform(spans_, lambda s: s["start"]), F.array(F.length(text)))
    between = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda z: F.substring(text, z["a"] + 1, z["b"] - z["a"]))
    out = texts.join(spans, key, "left")
    return out.withColumn("text", F.when(spans_.isNull(), text).otherwise(F.array_join(between, MASK))).select(*texts.columns)
