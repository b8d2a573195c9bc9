"""Intermediate tables in the shared folder that the session's checkpoints use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one of its own only for a local session that names none."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or f"{tempfile.gettempdir()}/palisade-{uuid.uuid4().hex}")
    return context.getCheckpointDir()


class Scratch:
    """Tables written and read again, for loops in which a table is joined with itself.

    A checkpoint keeps the estimated size of the plan that it cuts, and a self-join squares it: after some twenty rounds
    the planner multiplies numbers of millions of digits. A table that is read again has the size of its files.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
        """df, written and read again; the table that it replaces is removed."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        old = getattr(instead_of, "scratch_path", None)
        if old:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return out
