"""Small intermediate results as written tables.

A result that many tables read is written once and read back: its lineage ends there, a lost executor costs
nothing but the rest of the running stage, and the planner knows its size (so it decides on broadcasts by
the real number of bytes). The folder is the one the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named
    # Only a local session may fall back to a folder of its own machine.
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spendscope-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set(CHECKPOINT_DIR, own)
    return own


class Workspace:
    """Written intermediate tables of one analysis."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder: str | None = None

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        if self.folder is None:
            self.folder = f"{shared_folder(self.spark)}/spendscope-{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Delete the tables of this analysis."""
        if self.folder is not None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.folder = None
