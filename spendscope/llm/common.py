"""What the operators share: batches, table access, the shared folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.functions.tables import shared_folder

#: Rows and bytes of one Arrow batch sent to Python; the first is kept low for tables with very long texts.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20
#: Spark's own removal of an action's shuffle files when it ends; else they stay until the driver collects its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def workspace_path(spark: SparkSession, name: str) -> str:
    """A new folder for one run's intermediate files, in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def brief_shuffles(spark: SparkSession):
    """Actions in this block leave no shuffle files on the disks. A frame must not be collected in it and once more later."""
    before = spark.conf.get(FILE_CLEANUP)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, before)


def settle(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder, in folders ``by`` a last column, and read it back; its lineage ends there."""
    path = workspace_path(df.sparkSession, name)
    with brief_shuffles(df.sparkSession):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    settled = df.sparkSession.read.schema(df.schema).parquet(path)
    settled.settled_at = path
    return settled


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``settle`` returned; nothing that is still to be computed may read them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.settled_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def whole_groups(batches, key: str, least_bytes: int):
    """Tables of whole groups of one key, of rows sorted by key; at least so many bytes each but the last. A group must be bounded."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= least_bytes:
            t = pa.Table.from_batches(held).combine_chunks()
            keys = t[key].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield t.slice(0, cut)
            held, size = t.slice(cut).to_batches(), 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)
