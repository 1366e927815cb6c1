"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: HotSpot never compiles a larger method: generated code beyond it would be interpreted, several times slower.
HUGE_METHOD_BYTES = 8000

#: Once both sides of a join are shuffled, and every partition of one is known to be smaller, Spark hashes it instead of
#: sorting both sides.
HASHED_SIDE_BYTES = 64 << 20

#: Rows and bytes of one Arrow batch sent to Python. Spark's own 10,000 rows are hundreds of MB of prompts, held by each of
#: an executor's workers several times over (Arrow, Python strings, results).
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Hour-of-day, dates and timestamp casts are defined in UTC; wide rows (export parsing) run operator by operator
    where their stage would be one method too large to be compiled."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(HUGE_METHOD_BYTES))
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", str(HASHED_SIDE_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: str = "8", shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """Session for tests and the local bench; on a cluster, pass the session you have."""
    return prepared(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spendscope")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
