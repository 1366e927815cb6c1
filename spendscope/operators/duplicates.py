"""Exact repeats of a request within 24 hours, and paid failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.functions.identity import is_failed
from spendscope.operators.cells import start_us
from spendscope.operators.pricing import priced_usage
from spendscope.operators.recency import moment, slice_edges, slice_of

# Fixed value: how long after a request an identical one counts as a repeat.
DUPLICATE_WINDOW_SECONDS = 24 * 3600
SLICE_SECONDS = 3600

_KEYS = ["model_key", "request_hash"]


def _first_repeats() -> Column:
    """The first request of a slice repeats the slice before it when that one is recent enough."""
    gap = F.col("first_us") - F.col("prev_us")
    return F.coalesce(gap <= F.lit(DUPLICATE_WINDOW_SECONDS * 1_000_000), F.lit(False))


def _hashable(spark: SparkSession, usage: DataFrame) -> DataFrame:
    requests = usage.filter(F.col("granularity") == "request")
    priced = priced_usage(spark, requests).filter("priced").withColumn("at_us", start_us())
    known = F.col("request_hash").isNotNull()
    return priced.withColumns(
        {"slice": F.when(known, slice_of("at_us", SLICE_SECONDS)), "moment": F.when(known, moment())}
    )


def duplicate_calls(spark: SparkSession, usage: DataFrame) -> DataFrame:
    """The repeated requests themselves."""
    rows = _hashable(spark, usage).filter(F.col("request_hash").isNotNull())
    rows = rows.select(*_KEYS, "slice", "at_us", "moment", "source", "seq", "timestamp", "cost_usd")
    edges = slice_edges(rows, _KEYS).select(*_KEYS, "slice", "first_moment", _first_repeats().alias("first_repeats"))
    # Not the first of its slice, or the first and recent enough. A hot (hash, slice) is split by AQE.
    return (
        rows.join(edges, [*_KEYS, "slice"])
        .filter((F.col("moment") != F.col("first_moment")) | F.col("first_repeats"))
        .select(*_KEYS, "source", "seq", "timestamp", "cost_usd")
    )


def duplicate_rates(spark: SparkSession, usage: DataFrame) -> DataFrame:
    """Per model: spend share of repeats and of failed calls that are not repeats.

    No row is joined back: a (model, hash, slice) group keeps its sums and the amounts of its first request,
    and every other request of the group is a repeat. Requests without a hash are one group per model,
    folded away by partial aggregation before the shuffle.
    """
    rows = _hashable(spark, usage).select(
        *_KEYS,
        "slice",
        F.when(F.col("request_hash").isNotNull(), F.col("at_us")).alias("at_us"),
        "moment",
        "cost_usd",
        F.when(is_failed(), F.col("cost_usd")).otherwise(F.lit(0.0)).alias("failed_cost"),
    )
    groups = slice_edges(
        rows,
        _KEYS,
        F.sum("cost_usd").alias("cost"),
        F.sum("failed_cost").alias("failed"),
        F.min_by("cost_usd", "moment").alias("first_cost"),
        F.min_by("failed_cost", "moment").alias("first_failed"),
    )
    repeats, hashed = _first_repeats(), F.col("request_hash").isNotNull()
    dup = F.when(~hashed, F.lit(0.0)).when(repeats, F.col("cost")).otherwise(F.col("cost") - F.col("first_cost"))
    failed = F.when(~hashed, F.col("failed")).when(repeats, F.lit(0.0)).otherwise(F.col("first_failed"))
    return (
        groups.select("model_key", "cost", dup.alias("dup_cost"), failed.alias("fail_cost"))
        .groupBy("model_key")
        .agg(F.sum("cost").alias("cost_usd"), F.sum("dup_cost").alias("dup"), F.sum("fail_cost").alias("fail"))
        .filter(F.col("cost_usd") > 0)
        .select(
            "model_key",
            "cost_usd",
            (F.col("dup") / F.col("cost_usd")).alias("dup_rate"),
            (F.col("fail") / F.col("cost_usd")).alias("fail_rate"),
        )
    )


def failed_calls(usage: DataFrame) -> DataFrame:
    return usage.filter((F.col("granularity") == "request") & is_failed())
