"""A corpus pipeline of four stages over `documents`.

toxicity drops the documents that score 0.5 or more, the n-gram Jaccard join keeps of each group of near copies the
document with the smallest id, personal data is redacted, and what is left is packed into training sequences. Each stage
takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
`documents`. Nulls, repeated rows, empty tables and other columns behave as the operators define.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.llm import jaccard, packing, pii, toxicity
from palisade.llm.common import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5; labels teach the classifier under the rule of op4, and decide nothing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = toxicity.learn(docs, labels)
    return toxicity.score(docs.select(*COLUMNS), model, score_col="__toxicity").where("__toxicity < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.75 or more connect: the one with the smallest id.

    Rows are told apart by id and text, so rows that share an id but not a text are documents of their own; of several
    with the smallest id one stays. Ids that are null come last.
    """
    named = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("__key"))
    found = jaccard.jaccard_components(named, id_col="__key").select(F.col("doc_id").alias("__key"), "component_id").distinct()
    counted = named.groupBy("__key", "doc_id").agg(F.count("*").alias("__n"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__key")
    kept = found.join(counted, "__key").groupBy("component_id").agg(F.min_by(F.struct("__key", "__n"), order).alias("k"))
    left = named.join(kept.select(F.col("k.__key").alias("__kept"), F.col("k.__n").alias("__n")), F.col("__key") == F.col("__kept"))
    again = left.where("__n > 1").dropDuplicates(["__key", "doc_id", "text"])  # repeated rows
    return left.where("__n = 1").select(*COLUMNS).unionByName(again.select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by its kind and n_chars counted anew."""
    return pii.redact(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: The stages train, link and tokenise, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written to the shared folder and read again.

    A stage's result is removed as soon as its successor's is written. What the last stage reads stays, as the result
    may be read again.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                _remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
