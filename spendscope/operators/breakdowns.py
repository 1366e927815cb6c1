"""Where the money goes: breakdowns of the spend of record, and the check against the invoice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.operators.cells import bucket_vendors, monthly
from spendscope.operators.pricing import priced_usage

TOKEN_TYPES = {
    "Uncached input": "cost_uncached",
    "Cache reads": "cost_cache_read",
    "Cache writes": "cost_cache_write",
    "Output (incl. reasoning)": "cost_output",
    "Web search": "cost_other",
}


def total_spend(spend: DataFrame) -> DataFrame:
    return spend.agg(F.coalesce(monthly("cost_usd"), F.lit(0.0)).alias("monthly_spend"))


def _with_share(groups: DataFrame, spend: DataFrame) -> DataFrame:
    # The total is one row: a scalar subquery, not a join of two tables.
    total = total_spend(spend).scalar()
    return groups.withColumn("share", F.coalesce(F.col("monthly_cost") / F.nullif(total, F.lit(0.0)), F.lit(0.0)))


def by_model(spend: DataFrame) -> DataFrame:
    groups = (
        spend.filter(F.col("vendor").isNotNull() & F.col("model_key").isNotNull())
        .groupBy("vendor", "model_key")
        .agg(
            monthly("cost_usd").alias("monthly_cost"),
            monthly("w_requests").alias("requests"),
            monthly("w_input").alias("input_tokens"),
            monthly("w_cached").alias("cached_tokens"),
            monthly("w_output").alias("output_tokens"),
            F.bool_and("priced").alias("priced"),
        )
    )
    return (
        _with_share(groups, spend)
        .withColumn("cache_hit", F.col("cached_tokens") / F.nullif(F.col("input_tokens"), F.lit(0.0)))
        .orderBy(F.desc("monthly_cost"), "vendor", "model_key")
    )


def by_workload(spend: DataFrame) -> DataFrame:
    """Monthly cost and costliest model per workload: model grain first, then ``max_by`` over it."""
    per_model = (
        spend.filter(F.col("vendor").isNotNull() & F.col("workload").isNotNull())
        .groupBy("vendor", "workload", "model_key")
        .agg(monthly("cost_usd").alias("cost"))
    )
    groups = per_model.groupBy("vendor", "workload").agg(
        F.sum("cost").alias("monthly_cost"),
        F.max_by("model_key", F.struct("cost", "model_key")).alias("model_key"),
    )
    return _with_share(groups, spend).orderBy(F.desc("monthly_cost"), "vendor", "workload")


def top_workloads(spend: DataFrame, n: int = 10) -> DataFrame:
    return by_workload(spend).limit(n)


def by_token_type(spend: DataFrame) -> DataFrame:
    sums = spend.agg(*[F.coalesce(monthly(c), F.lit(0.0)).alias(c) for c in TOKEN_TYPES.values()])
    pairs = [F.struct(F.lit(label).alias("token_type"), F.col(c).alias("monthly_cost")) for label, c in TOKEN_TYPES.items()]
    return sums.select(F.inline(F.array(*pairs)))


def embedding_spend(spend: DataFrame) -> DataFrame:
    return (
        spend.filter(F.col("product") == "embedding").groupBy("model_key").agg(monthly("cost_usd").alias("monthly_cost"))
    )


def daily_costs(spark: SparkSession, usage: DataFrame) -> DataFrame:
    """Modelled cost per (vendor, granularity, UTC day): the only grain the invoice check needs."""
    return (
        priced_usage(spark, usage)
        .groupBy("vendor", "granularity", F.to_date("timestamp").alias("date"))
        .agg(F.sum("cost_usd").alias("cost_usd"))
    )


def reconcile(daily: DataFrame, invoice: DataFrame) -> DataFrame:
    """Invoice against modelled spend of record, on the invoiced days only, un-normalised."""
    record = daily.join(bucket_vendors(daily).withColumn("has_buckets", F.lit(True)), "vendor", "left").filter(
        (F.col("granularity") == "bucket") | F.col("has_buckets").isNull()
    )
    modelled_days = record.groupBy("vendor", "date").agg(F.sum("cost_usd").alias("modelled"))
    invoiced_days = invoice.groupBy("vendor", "date").agg(F.sum("amount_usd").alias("invoiced"))
    return (
        invoiced_days.join(modelled_days, ["vendor", "date"], "left")
        .groupBy("vendor")
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.sum("invoiced").alias("invoiced"),
            F.coalesce(F.sum("modelled"), F.lit(0.0)).alias("modelled"),
        )
        .withColumn("diff_pct", (F.col("modelled") - F.col("invoiced")) / F.nullif(F.col("invoiced"), F.lit(0.0)))
    )
