"""Contiguous shards of equal bytes, from prefix sums over per-partition totals. DataFrame operations only.

Rows are reduced to (id, size, checksum) before anything moves, ranged by id over the session's partitions and
checkpointed, so that partitions stay what they are. Each partition's total of bytes and rows is one row; prefix sums
over these few rows give every partition its offset, and a running sum inside a partition gives every row its place in
the whole order. Equal targets cut that order: a row belongs to the shard in which its middle byte lies, so a cut lies
at the row boundary nearest its target, and shards differ by less than the rows at their two ends.

An id that a third of all rows carry is spread by the checksum, a hash of the text and the row's place in the input,
which all follow the id in the order.

Defined cases: a null text has no bytes and checksum 0; a null id comes first; repeated rows get slots of their own;
with fewer rows than shards some shards stay empty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from palisade.llm.common import cut, shuffle_width

#: Bytes that each row takes besides its text.
ROW_BYTES = 8


def shard_by_bytes(documents: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row of documents."""
    text = F.col(text_col).cast("string")
    order = ["__id", "__crc", "__hash", "__row"]
    narrow = documents.select(
        F.col(id_col).cast("long").alias("__id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("__size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("__crc"),
        F.xxhash64(text).alias("__hash"),
        F.monotonically_increasing_id().alias("__row"),
    )
    ranged = cut(
        narrow.repartitionByRange(shuffle_width(documents.sparkSession), *(F.col(c).asc_nulls_first() for c in order))
        .withColumn("__part", F.spark_partition_id())
    )
    totals = ranged.groupBy("__part").agg(F.sum("__size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    whole = Window.partitionBy()
    offsets = totals.select(
        "__part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("__bytes0"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__rows0"),
        F.sum("bytes").over(whole).alias("__all"),
    )
    inside = Window.partitionBy("__part").orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.join(F.broadcast(offsets), "__part")  # as many rows as there are partitions
        .withColumn("__end", F.col("__bytes0") + F.sum("__size").over(inside))
        .withColumn("__at", F.col("__rows0") + F.count("*").over(inside) - 1)
        # the middle byte's place among `shards` equal parts, in whole numbers
        .withColumn("__shard", F.expr(f"cast(((2 * __end - __size) * {int(shards)}) div (2 * __all) as int)"))
    )
    placed = cut(placed.select("__id", "__size", "__crc", F.least("__shard", F.lit(shards - 1)).alias("__shard"), "__at"))
    first = placed.groupBy("__shard").agg(F.min("__at").alias("__first"))
    return placed.join(F.broadcast(first), "__shard").select(  # as many rows as there are shards
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"),
        (F.col("__at") - F.col("__first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
