"""The usage rollup every breakdown and most levers read.

One pass over the rows (map-side partial aggregation, one small shuffle) reduces the table to one row per
(source, granularity, vendor, workload, model, product, tier, hour of day). A source's 30-day factor is
constant within a cell, so it is applied to the cells and never to the rows: no row is shuffled for it.

A cost is linear in the weighted tokens of rows that share model, tier, region and side of the long-context
limits. So rows are only told apart and summed up; the sums are priced, on the current and the next cheaper
model too, and then rolled up to cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.operators.pricing import add_costs, long_prompts, repriced_costs, with_targets
from spendscope.functions.joins import checked_broadcast
from spendscope.schema import INPUT_COLUMNS, TOKEN_COLUMNS, total_input

CELL_KEYS = ["source", "granularity", "vendor", "workload", "model_key", "product", "service_tier", "hour"]
DAY_US = 86_400_000_000

# What counts as a short, classification-like call.
SHORT_OUTPUT_TOKENS = 120
SHORT_INPUT_TOKENS = 4000


def start_us() -> Column:
    return F.unix_micros("timestamp")


def end_us() -> Column:
    return F.unix_micros("timestamp") + F.col("bucket_seconds") * F.lit(1_000_000)


def visible_output() -> Column:
    return F.col("output_tokens") - F.col("reasoning_tokens")


def is_short_call() -> Column:
    return (visible_output() <= SHORT_OUTPUT_TOKENS) & (total_input() <= SHORT_INPUT_TOKENS)


def has_fingerprint() -> Column:
    return F.coalesce(F.size("prefix_hashes") > 0, F.lit(False))


def usage_traffic(spark: SparkSession, usage: DataFrame) -> DataFrame:
    """Sums of rows that are priced alike: the only aggregation that sees rows. Token columns hold weighted sums."""
    alike = {**long_prompts(), "is_short": is_short_call(), "has_fp": has_fingerprint()}
    rows = with_targets(spark, usage).withColumns({**alike, "hour": F.hour("timestamp")})
    weight = F.col("weight")
    return rows.groupBy(*CELL_KEYS, "inference_geo", *alike).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(start_us()).alias("first_us"),
        F.max(end_us()).alias("last_us"),
        F.max("bucket_seconds").alias("widest_bucket"),
        F.sum("weight").alias("n_weight"),
        F.sum("requests").alias("n_requests"),
        F.sum(total_input()).alias("n_input"),
        *[F.sum(c).alias(f"n_{c}") for c in INPUT_COLUMNS],
        F.sum(F.col("requests") * weight).alias("w_requests"),
        F.sum(total_input() * weight).alias("w_input"),
        F.sum(F.col("reasoning_tokens") * weight).alias("w_reasoning"),
        *[F.sum(F.col(c) * weight).alias(c) for c in (*TOKEN_COLUMNS, "web_search_requests")],
    )


def usage_cells(spark: SparkSession, usage: DataFrame) -> DataFrame:
    traffic = usage_traffic(spark, usage).withColumn("weight", F.lit(1.0))
    rows = add_costs(with_targets(spark, traffic), told=True).withColumns(repriced_costs(told=True))

    def if_fp(name: str) -> Column:
        return F.sum(F.when(F.col("has_fp"), F.col(name)).otherwise(F.lit(0)))

    return rows.groupBy(*CELL_KEYS).agg(
        F.sum("n_rows").alias("n_rows"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.max("widest_bucket").alias("widest_bucket"),
        F.bool_and("priced").alias("priced"),
        F.sum("cost_uncached").alias("cost_uncached"),
        F.sum("cost_cache_read").alias("cost_cache_read"),
        F.sum("cost_cache_write").alias("cost_cache_write"),
        F.sum("cost_output").alias("cost_output"),
        F.sum("cost_other").alias("cost_other"),
        F.sum("cost_input").alias("cost_input"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum("cost_on_current").alias("cost_on_current"),
        F.sum("cost_on_cheaper").alias("cost_on_cheaper"),
        F.sum(F.when(F.col("is_short"), F.col("cost_usd")).otherwise(F.lit(0.0))).alias("short_cost"),
        F.sum("n_weight").alias("weight"),
        F.sum("w_requests").alias("w_requests"),
        F.sum("w_input").alias("w_input"),
        F.sum("cache_read_tokens").alias("w_cached"),
        F.sum("output_tokens").alias("w_output"),
        F.sum("w_reasoning").alias("w_reasoning"),
        F.sum("n_requests").alias("requests"),
        *[F.sum(f"n_{c}").alias(c) for c in INPUT_COLUMNS],
        if_fp("n_rows").alias("fp_rows"),
        if_fp("cost_input").alias("fp_cost_input"),
        if_fp("cost_usd").alias("fp_cost_usd"),
        if_fp("n_cache_read_tokens").alias("fp_cache_read"),
        if_fp("n_input").alias("fp_input"),
    )


def period_days(first_us: Column, last_us: Column) -> Column:
    return F.greatest((last_us - first_us) / F.lit(float(DAY_US)), F.lit(1.0) / F.lit(24.0))


def source_periods(cells: DataFrame) -> DataFrame:
    """Covered days and 30-day factor of every source."""
    return (
        cells.groupBy("source")
        .agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
        .withColumn("days", period_days(F.col("first_us"), F.col("last_us")))
        .withColumn("monthly_factor", F.lit(30.0) / F.col("days"))
    )


def with_monthly_factor(cells: DataFrame) -> DataFrame:
    return cells.join(source_periods(cells).select("source", "monthly_factor"), "source")


def monthly(column: str) -> Column:
    """30-day sum of a cell column."""
    return F.sum(F.col(column) * F.col("monthly_factor"))


def spend_of_record(rows: DataFrame, vendors: DataFrame | None = None) -> DataFrame:
    """Bucket rows, plus request rows of the vendors that have no bucket rows.

    Works on usage rows and on cells. The bucket vendors are a few names, so request rows are not shuffled on them:
    they are counted and broadcast. ``vendors`` gives them where they are known already.
    """
    if vendors is None:
        vendors = checked_broadcast(bucket_vendors(rows))
    buckets = rows.filter(F.col("granularity") == "bucket")
    logs = rows.filter(F.col("granularity") == "request").join(vendors, "vendor", "left_anti")
    return buckets.unionByName(logs.select(*buckets.columns))


def bucket_vendors(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("granularity") == "bucket").select("vendor").distinct()


def chat_only(rows: DataFrame) -> DataFrame:
    """Rows the levers look at: everything but embeddings (a NULL product counts as chat)."""
    return rows.filter(~F.col("product").eqNullSafe(F.lit("embedding")))
