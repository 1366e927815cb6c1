"""Pricing: one broadcast join against the price dimension, then column arithmetic.

Everything here is narrow. Repricing on the current and on the next cheaper model happens in the same
pass, because both targets follow from the row's model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.functions.identity import with_model_key
from spendscope.price_dim import (
    US_GEO_MULTIPLIER,
    WEB_SEARCH_USD_PER_1K,
    migration_book,
    price_book,
)
from spendscope.schema import total_input

COST_PARTS = ["cost_uncached", "cost_cache_read", "cost_cache_write", "cost_output"]


def tier_multiplier(tier: Column, prefix: str = "") -> Column:
    """Price multiplier of a service tier; tiers without a verified multiplier cost the standard price."""
    fast = F.col(f"{prefix}fast_mult")
    return (
        F.when(tier == "batch", F.col(f"{prefix}batch_mult"))
        .when((tier == "flex") & (F.col(f"{prefix}price_vendor") == "openai"), F.col(f"{prefix}batch_mult"))
        .when((tier == "fast") & fast.isNotNull(), fast)
        .otherwise(F.lit(1.0))
    )


def tier_is_unverified(tier: Column, prefix: str = "") -> Column:
    known = (
        F.coalesce(tier, F.lit("standard")).isin("standard", "batch")
        | ((tier == "flex") & (F.col(f"{prefix}price_vendor") == "openai"))
        | ((tier == "fast") & F.col(f"{prefix}fast_mult").isNotNull())
    )
    return ~F.coalesce(known, F.lit(False))


def is_long_prompt(prefix: str = "", token_scale: Column | None = None) -> Column:
    """Only a request row knows its own prompt size; a NULL threshold never matches."""
    scale = F.lit(1.0) if token_scale is None else token_scale
    return (F.col("granularity") == "request") & (total_input() * scale > F.col(f"{prefix}long_threshold"))


def long_prompts() -> dict[str, Column]:
    """Per price prefix, what ``told`` below reads: whether a row's prompt is long for that model."""
    scales = {"": None, "cur_": F.col("cur_ratio"), "cheap_": F.col("cheap_ratio")}
    return {f"{prefix}long_prompt": is_long_prompt(prefix, scale) for prefix, scale in scales.items()}


def row_scales(prefix: str = "", token_scale: Column | None = None, told: bool = False) -> tuple[Column, Column]:
    """(input, output) multipliers of a row: tier x sample weight x US geo x long context.

    Sums of rows have no prompt size; where the rows were told apart before (``told``), a column says what they were.
    """
    geo = F.when(F.col("inference_geo") == "us", F.lit(US_GEO_MULTIPLIER)).otherwise(F.lit(1.0))
    base = tier_multiplier(F.col("service_tier"), prefix) * F.col("weight") * geo
    long_prompt = F.col(f"{prefix}long_prompt") if told else is_long_prompt(prefix, token_scale)
    return (
        base * F.when(long_prompt, F.col(f"{prefix}long_in")).otherwise(F.lit(1.0)),
        base * F.when(long_prompt, F.col(f"{prefix}long_out")).otherwise(F.lit(1.0)),
    )


def cost_parts(prefix: str = "", token_scale: Column | None = None, told: bool = False) -> dict[str, Column]:
    in_scale, out_scale = row_scales(prefix, token_scale, told)
    unit = (F.lit(1.0) if token_scale is None else token_scale) / F.lit(1e6)

    def p(name: str) -> Column:
        return F.col(f"{prefix}{name}")

    writes = F.col("cache_write_tokens") * p("p_write") + F.col("cache_write_1h_tokens") * F.coalesce(
        p("p_write_1h"), p("p_write")
    )
    return {
        "cost_uncached": F.col("uncached_input_tokens") * p("p_input") * unit * in_scale,
        "cost_cache_read": F.col("cache_read_tokens") * p("p_cached") * unit * in_scale,
        "cost_cache_write": writes * unit * in_scale,
        "cost_output": F.col("output_tokens") * p("p_output") * unit * out_scale,
    }


def keyed(usage: DataFrame) -> DataFrame:
    return usage if "model_key" in usage.columns else with_model_key(usage)


def with_prices(spark: SparkSession, usage: DataFrame) -> DataFrame:
    """Usage rows with the price columns of their own model (NULL when the model is unknown)."""
    return keyed(usage).join(F.broadcast(price_book(spark)), "model_key", "left")


def with_targets(spark: SparkSession, usage: DataFrame) -> DataFrame:
    """Usage rows with the prices of their own, of the current and of the next cheaper model."""
    return keyed(usage).join(F.broadcast(migration_book(spark)), "model_key", "left")


def add_costs(df: DataFrame, told: bool = False) -> DataFrame:
    """Cost columns for rows that already carry their price columns."""
    zero = F.lit(0.0)
    parts = {name: F.coalesce(col, zero) for name, col in cost_parts(told=told).items()}
    other = F.col("web_search_requests") * F.col("weight") * F.lit(WEB_SEARCH_USD_PER_1K) / F.lit(1000)
    return (
        df.withColumns({**parts, "cost_other": other, "priced": F.col("p_input").isNotNull()})
        .withColumn("cost_input", F.col("cost_uncached") + F.col("cost_cache_read") + F.col("cost_cache_write"))
        .withColumn("cost_usd", F.col("cost_input") + F.col("cost_output") + F.col("cost_other"))
    )


def priced_usage(spark: SparkSession, usage: DataFrame) -> DataFrame:
    """Every row priced; unknown models stay with token costs of 0 and ``priced = false``."""
    return add_costs(with_prices(spark, usage))


def repriced_costs(told: bool = False) -> dict[str, Column]:
    """Input + output cost of the same traffic on the current and on the next cheaper model."""
    out = {}
    for name, prefix in (("cost_on_current", "cur_"), ("cost_on_cheaper", "cheap_")):
        parts = cost_parts(prefix, F.col(f"{prefix}ratio"), told)
        out[name] = (
            parts["cost_uncached"] + parts["cost_cache_read"] + parts["cost_cache_write"] + parts["cost_output"]
        )
    return out


def repriced(spark: SparkSession, usage: DataFrame) -> DataFrame:
    return with_targets(spark, usage).withColumns(repriced_costs())
