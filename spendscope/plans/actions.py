"""Action tables: what to change, per lever, filled from the usage that produced the number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendscope.plans.levers import model_targets, priced_only, request_cells, token_quantiles

# Thresholds of the action tables.
MIN_SAVING_USD = 1.0
MIN_CACHE_SAVING_USD = 50.0
# Workloads named beside a model; the tables themselves have all rows, with a rank.
WORKLOADS_SHOWN = 2
ROUTE_FROM_SHORT_SHARE = 0.2
MAX_TOKENS_HEADROOM = 1.1
MAX_TOKENS_MIN_REQUESTS = 20
CACHE_TTL_PARAMETER = {"5 min": "5m", "1 h": "1h"}


def _of(detail: DataFrame, lever: str) -> DataFrame:
    return detail.filter(F.col("lever") == lever)


def _lever_pays(totals: DataFrame, lever: str) -> Column:
    """True when the lever's base saving reaches the threshold (seven rows: a scalar subquery)."""
    return totals.filter(F.col("lever") == lever).select("base").scalar() >= MIN_SAVING_USD


def costliest_workloads(spend: DataFrame, n: int = WORKLOADS_SHOWN) -> DataFrame:
    """Per model: names of its n costliest workloads, without the catch-all one."""
    ranked = Window.partitionBy("model_key").orderBy(F.desc("cost"), "workload")
    named = F.when((F.col("workload") != "") & (F.col("workload") != "all"), F.col("workload"))
    return (
        spend.filter(F.col("workload").isNotNull())
        .groupBy("model_key", "workload")
        .agg(F.sum("cost_usd").alias("cost"))
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= n)
        .groupBy("model_key")
        .agg(*[F.max(F.when(F.col("rank") == i, named)).alias(f"workload_{i}") for i in range(1, n + 1)])
    )


def _ranked(rows: DataFrame, first: int | None) -> DataFrame:
    """Rows by saving, with their rank; ``first`` cuts the table after so many (a row per priced model at most)."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("saving_base"), "model_key")))
    return ranked if first is None else ranked.filter(F.col("rank") <= first)


def plan_migration(detail: DataFrame, spend: DataFrame, first: int | None = None) -> DataFrame:
    rows = (
        _of(detail, "migration")
        .filter(F.col("base") >= MIN_SAVING_USD)
        .select(F.col("subject").alias("model_key"), F.col("target").alias("successor"), F.col("base").alias("saving_base"))
    )
    names = [f"workload_{i}" for i in range(1, WORKLOADS_SHOWN + 1)]
    return _ranked(rows, first).join(costliest_workloads(spend), "model_key", "left").select(
        "rank", "model_key", "successor", "saving_base", F.concat_ws(", ", *names).alias("workloads")
    )


def plan_routing(spark: SparkSession, totals: DataFrame, cells: DataFrame) -> DataFrame:
    """(workload, model) pairs whose logged spend is short calls to a good part."""
    return (
        priced_only(request_cells(cells))
        .filter(F.col("workload").isNotNull())
        .groupBy("workload", "model_key")
        .agg(F.sum("short_cost").alias("short_cost"), F.sum("cost_usd").alias("cost_usd"))
        .filter(F.col("cost_usd") > 0)
        .withColumn("short_share", F.col("short_cost") / F.col("cost_usd"))
        .filter(F.col("short_share") >= ROUTE_FROM_SHORT_SHARE)
        .join(model_targets(spark), "model_key")
        .filter(F.col("cheaper_model").isNotNull() & _lever_pays(totals, "routing"))
        .select("workload", "model_key", "cheaper_model", "short_share")
    )


def cache_key_slug(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(name, "^proj_", ""), "^wrkspc_", "")
    return F.translate(bare, "_", "-")


def plan_cache(detail: DataFrame, rates: DataFrame, prefixes: DataFrame, spend: DataFrame) -> DataFrame:
    saved = (
        _of(detail, "caching")
        .filter(F.col("base") >= MIN_CACHE_SAVING_USD)
        .select(F.col("subject").alias("model_key"), F.col("base").alias("saving_base"))
    )
    rows = (
        saved.join(rates.select("model_key", "vendor", "ttl"), "model_key")
        .join(prefixes.select("model_key", "prefix_chars"), "model_key", "left")
        .join(costliest_workloads(spend), "model_key", "left")
    )
    parameter = F.create_map(*[F.lit(x) for pair in CACHE_TTL_PARAMETER.items() for x in pair])
    anthropic = F.col("vendor") == "anthropic"
    names = [f"workload_{i}" for i in range(1, WORKLOADS_SHOWN + 1)]
    return rows.select(
        "model_key",
        "vendor",
        "ttl",
        F.when(anthropic, F.coalesce(F.try_element_at(parameter, F.col("ttl")), F.lit("5m"))).alias("ttl_parameter"),
        "prefix_chars",
        F.when(~anthropic, cache_key_slug(F.coalesce(*names, "model_key"))).alias("cache_key"),
        "saving_base",
    )


def plan_batch(detail: DataFrame) -> DataFrame:
    return (
        _of(detail, "batch")
        .filter(F.col("base") >= MIN_SAVING_USD)
        .select("vendor", F.col("subject").alias("workload"), F.col("base").alias("saving_base"))
    )


def plan_max_tokens(totals: DataFrame, requests: DataFrame) -> DataFrame:
    """Output limit per workload: p95 of all output tokens with headroom, rounded up."""
    limit = F.ceil(F.col("quantiles")[0] * MAX_TOKENS_HEADROOM).cast("bigint")
    return (
        token_quantiles(requests, F.col("output_tokens"), [0.95])
        .filter((F.col("n_requests") >= MAX_TOKENS_MIN_REQUESTS) & _lever_pays(totals, "output"))
        .select("workload", limit.alias("max_tokens"))
        .filter(F.col("max_tokens") > 0)
    )


def plan_duplicates(detail: DataFrame, first: int | None = None) -> DataFrame:
    rows = _of(detail, "duplicates").filter(F.col("base") >= MIN_SAVING_USD)
    return _ranked(rows.select(F.col("subject").alias("model_key"), F.col("base").alias("saving_base")), first).select(
        "rank", "model_key", "saving_base"
    )


def plan_fast(totals: DataFrame, spend: DataFrame) -> DataFrame:
    fast = priced_only(spend).filter((F.col("service_tier") == "fast") & _lever_pays(totals, "fast_mode"))
    return fast.select("model_key").distinct().orderBy("model_key")
