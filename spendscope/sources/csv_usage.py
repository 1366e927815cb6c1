"""Normalised CSV files: the usage table as text, with optional columns, each file by its own header."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.functions import json_values as js
from spendscope.functions.identity import vendor_of
from spendscope.schema import TOKEN_COLUMNS, USAGE_COLUMNS, as_usage

REQUIRED = ["timestamp", "model", "uncached_input_tokens", "output_tokens"]
# Sequence numbers of CSV rows start here, so they never meet those of request-log lines.
SEQ_OFFSET = 1 << 61
# Of files with another header the numbers start so much higher; a monotonic id stays below 2**53 for 2**20 partitions.
SEQ_STEP = 1 << 53


def files_by_header(spark: SparkSession, paths: str | list[str]) -> list[list[str]]:
    """Paths of the files, those with one header together. A line and a path of each file reach the driver, which
    lists the files anyway."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("seq"))
    headers = lines.groupBy("path").agg(F.min_by("value", "seq").alias("header"))
    groups: dict[str, list[str]] = {}
    for row in headers.orderBy("path").collect():
        groups.setdefault(row["header"], []).append(row["path"])
    return list(groups.values())


def read_usage_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Blank cells arrive as NULL; only missing columns get the defaults."""

    def cells(files: list[str], offset: int) -> DataFrame:
        raw = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(files)
        placed = raw.select(
            "*",
            F.col("_metadata.file_name").alias("__source"),
            (F.monotonically_increasing_id() + F.lit(SEQ_OFFSET + offset)).alias("__seq"),
        )
        return usage_from_cells(placed.drop("source", "seq").withColumnsRenamed({"__source": "source", "__seq": "seq"}))

    groups = files_by_header(spark, paths)
    return reduce(DataFrame.unionByName, [cells(files, k * SEQ_STEP) for k, files in enumerate(groups)])


def usage_from_cells(cells: DataFrame) -> DataFrame:
    """String columns named like the usage table -> usage rows."""
    missing = [c for c in REQUIRED if c not in cells.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    whole = [*TOKEN_COLUMNS, "reasoning_tokens", "web_search_requests"]
    typed = {}
    for name, (dtype, _) in USAGE_COLUMNS.items():
        if name not in cells.columns or dtype.startswith("array"):
            continue
        if name == "timestamp":
            typed[name] = js.moment(F.col("timestamp"))
        elif name in whole:
            typed[name] = js.whole(F.col(name), name)
        elif dtype == "bigint":
            typed[name] = F.when(F.col(name).isNotNull(), js.whole(F.col(name), name))
        else:
            typed[name] = F.col(name).try_cast(dtype)
    rows = cells.withColumns(typed).drop("prefix_hashes", "prefix_chars")
    given = lambda name: F.col(name) if name in cells.columns else F.lit(None).cast("string")
    rows = rows.withColumns(
        {
            "vendor": F.coalesce(given("vendor"), vendor_of("model")),
            "granularity": F.coalesce(given("granularity"), F.lit("bucket")),
        }
    )
    if "status" in cells.columns:
        number = F.col("status").try_cast("double").isNotNull()
        rows = rows.withColumn("status_type", F.when(number, "number").when(F.col("status").isNotNull(), "string"))
    return as_usage(rows)
