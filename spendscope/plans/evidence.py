"""The facts behind every lever, as (lever, subject, metric, value) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.plans import levers as lv

# From which share on repeats, failures or a cache saving are worth a line.
DUPLICATE_NOTE_SHARE = 0.005
CACHE_NOTE_SHARE = 0.01


def facts(df: DataFrame, lever: str, subject: str, metrics: dict[str, Column]) -> DataFrame:
    """Unpivot: one row per metric that is not NULL."""
    pairs = F.array(
        *[F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in metrics.items()]
    )
    return (
        df.select(F.lit(lever).alias("lever"), F.col(subject).alias("subject"), F.inline(pairs))
        .filter(F.col("value").isNotNull())
    )


def migration_facts(options: DataFrame) -> DataFrame:
    metrics = {"monthly_now": "cost_now", "monthly_after": "on_current", "token_ratio": "cur_ratio", "pays": "pays"}
    return facts(options, "migration", "model_key", {m: F.col(c) for m, c in metrics.items()})


def routing_facts(options: DataFrame) -> DataFrame:
    share, few = F.col("routed_share"), F.col("routed_share") < lv.ROUTING_FEW_SHORT
    return facts(
        options, "routing", "model_key", {"short_call_share": F.when(~few, share), "few_short_calls": F.when(few, share)}
    )


def caching_facts(spend: DataFrame, rates: DataFrame, scenario: DataFrame) -> DataFrame:
    low = F.col("saving_rate") < CACHE_NOTE_SHARE
    measured = facts(
        rates,
        "caching",
        "model_key",
        {
            "below_cache_minimum": F.when(low, F.col("min_cacheable")),
            "cache_hit_today": F.when(~low, F.col("hit_today")),
            "measured_saving_rate": F.when(~low, F.col("saving_rate")),
        },
    )
    assumed = scenario.filter("too_short").join(rates.select("model_key"), "model_key", "left_anti")
    return measured.unionByName(
        facts(assumed, "caching", "model_key", {"average_prompt_tokens": F.col("average_prompt")})
    )


def batch_facts(options: DataFrame, what_if: DataFrame, batchable: list[str]) -> DataFrame:
    if batchable:
        confirmed = options.filter(F.col("workload").isin(batchable)).select("workload").distinct()
        return facts(confirmed, "batch", "workload", {"confirmed_non_interactive": F.lit(1)})
    busy = options.filter(F.col("busy_share") >= lv.BATCH_CONCENTRATION)
    return facts(busy, "batch", "workload", {"busiest_3h_share": F.col("busy_share")}).unionByName(
        facts(what_if, "batch", "workload", {"what_if_saving": F.col("saving_if_batched")})
    )


def output_facts(contributions: DataFrame, reasoning: DataFrame, quantiles: DataFrame) -> DataFrame:
    billed = contributions.filter(F.col("lever") == "output").select(F.col("subject").alias("model_key"))
    heavy = reasoning.filter(F.col("reasoning_share") >= lv.REASONING_HEAVY_SHARE).join(billed, "model_key", "left_semi")
    return facts(heavy, "output", "model_key", {"reasoning_share": F.col("reasoning_share")}).unionByName(
        facts(quantiles, "output", "workload", {"visible_p50": F.col("p50"), "visible_p95": F.col("p95")})
    )


def duplicate_facts(rates: DataFrame) -> DataFrame:
    worth = rates.filter((F.col("dup_rate") > DUPLICATE_NOTE_SHARE) | (F.col("fail_rate") > DUPLICATE_NOTE_SHARE))
    return facts(
        worth, "duplicates", "model_key", {"repeat_share": F.col("dup_rate"), "failed_share": F.col("fail_rate")}
    )


def fast_facts(contributions: DataFrame) -> DataFrame:
    fast = contributions.filter(F.col("lever") == "fast_mode")
    return facts(fast, "fast_mode", "subject", {"monthly_cost_in_fast_mode": F.col("monthly_cost")})


def all_facts(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
