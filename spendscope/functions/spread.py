"""Input that comes in too few pieces for the cores that are to parse it.

A gzip log is one task however large it is, and so is a Parquet file of one row group. What follows the scan here (JSON
parsing, fingerprints, pricing) costs far more than the scan, so such input is dealt out to all cores before it. Input in
at least as many splits as there are cores, which is what large tables are, keeps its splits and is not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Smaller input is not worth an exchange.
LEAST_BYTES = 1 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame reads."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan, in at least as many partitions as there are cores, unless it is small.

    Files are looked up only if there are fewer splits than cores, and a split holds a bounded number of files. Rows keep
    their values, so ids and positions have to be columns already; the order of rows is not kept.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores or input_bytes(df) < LEAST_BYTES:
        return df
    return df.repartition(cores)
