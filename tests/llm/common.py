"""Small tables that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import functions as F

LONG = "word " * 30_000 + "1" * 5_000 + " end"
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it again"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from it again"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from it again"),
    (3, None),
    (None, "text without an id, é😀 a@b.co"),
    (None, None),
    (4, ""),
    (5, "   \n\t "),
    (6, LONG),
    (7, "two words"),
    (7, "two words"),
    (8, "<|endoftext|> it's 12 ½ 　x\x1cy \x01 z"),
]


def documents(spark, rows=None, clashing=True):
    df = spark.createDataFrame(TEXTS if rows is None else rows, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    if clashing:
        for name in ("size", "key", "n", "score", "ids", "member", "shard", "start", "tier", "kind", "spans", "root", "trie", "probe"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return documents(spark, [])
