"""Data-quality notes as (code, source, subject, n) rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.functions.tables import Workspace
from spendscope.operators.pricing import keyed, tier_is_unverified, with_prices
from spendscope.price_dim import PRICES_MAX_AGE_DAYS, PRICES_VERIFIED_ON, values_frame

EXPORT_KINDS = ["openai_usage", "openai_embeddings", "openai_costs", "anthropic_usage", "anthropic_costs"]
NOTE_FIELDS = [("code", "string"), ("source", "string"), ("subject", "string"), ("n", "bigint")]


def no_notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in NOTE_FIELDS))


def note(df: DataFrame, code: str, *, n: Column, source: Column | None = None, subject: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(code).alias("code"),
        (none if source is None else source).alias("source"),
        (none if subject is None else subject).alias("subject"),
        n.cast("bigint").alias("n"),
    )


def skipped_results(counts: DataFrame) -> DataFrame:
    return note(counts, "skipped_result", source=F.col("source"), subject=F.col("object"), n=F.col("n"))


def long_context(counts: DataFrame) -> DataFrame:
    return note(counts, "long_context_window", source=F.col("source"), n=F.col("n"))


def empty_exports(kinds: DataFrame) -> DataFrame:
    return note(kinds.filter(F.col("kind") == "empty"), "empty_export", source=F.col("source"), n=F.lit(1))


def unusable_lines(counts: DataFrame) -> DataFrame:
    source = F.col("source")
    missing = note(counts, "log_line_without_usage", source=source, n=F.col("without_usage"))
    broken = note(counts, "invalid_json", source=source, n=F.col("invalid_json"))
    return missing.unionByName(broken).filter(F.col("n") > 0)


def usage_notes(spark: SparkSession, usage: DataFrame, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Rows without a model, models without a price, tiers without a verified multiplier, hidden request rows.

    One narrow pass and one aggregation to (source, model, tier) grain feed all of them: ``keep`` writes that small
    table, so the usage is read once.
    """
    keep = keep or Workspace(spark).settle
    groups = (
        keyed(usage)
        .groupBy("source", "model", "model_key", "service_tier", "product", "vendor", "granularity")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    priced = with_prices(spark, keep(groups, "note-groups"))
    known = F.col("p_input").isNotNull()
    nameless = (
        priced.filter(F.col("model") == "unknown").groupBy("source").agg(F.sum("n").alias("n"))
    )
    unpriced = (
        priced.filter(~known & (F.col("model_key") != "unknown")).groupBy("model_key").agg(F.sum("n").alias("n"))
    )
    tiers = (
        priced.filter(known & tier_is_unverified(F.col("service_tier")))
        .groupBy("model_key", "service_tier")
        .agg(F.sum("n").alias("n"))
    )
    # Embedding buckets make their vendor a bucket vendor and so keep its request rows out of the spend.
    bucket = F.col("granularity") == "bucket"
    hidden = (
        priced.groupBy("vendor")
        .agg(
            F.bool_or(bucket).alias("has_buckets"),
            F.bool_and(~bucket | (F.col("product") == "embedding")).alias("only_embeddings"),
            F.sum(F.when(~bucket, F.col("n")).otherwise(F.lit(0))).alias("n"),
        )
        .filter(F.col("has_buckets") & F.col("only_embeddings") & (F.col("n") > 0))
    )
    return (
        note(nameless, "rows_without_model", source=F.col("source"), n=F.col("n"))
        .unionByName(note(unpriced, "unknown_model", subject=F.col("model_key"), n=F.col("n")))
        .unionByName(
            note(tiers, "unverified_tier", subject=F.concat_ws(":", "model_key", "service_tier"), n=F.col("n"))
        )
        .unionByName(note(hidden, "requests_hidden_by_embeddings", subject=F.col("vendor"), n=F.col("n")))
    )


def cases_without_checks(cases: DataFrame) -> DataFrame:
    empty = cases.filter(F.coalesce(F.size("checks"), F.lit(0)) <= 0).agg(F.count(F.lit(1)).alias("n"))
    return note(empty.filter(F.col("n") > 0), "eval_case_without_checks", n=F.col("n"))


def price_age_days(as_of: dt.date) -> int:
    return (as_of - PRICES_VERIFIED_ON).days


def prices_are_stale(as_of: dt.date) -> bool:
    return price_age_days(as_of) > PRICES_MAX_AGE_DAYS


def stale_prices(spark: SparkSession, as_of: dt.date) -> DataFrame:
    if not prices_are_stale(as_of):
        return no_notes(spark)
    record = {"code": "stale_prices", "source": None, "subject": PRICES_VERIFIED_ON.isoformat(), "n": price_age_days(as_of)}
    return values_frame(spark, NOTE_FIELDS, [record])


def price_date(spark: SparkSession, as_of: dt.date) -> DataFrame:
    fields = [("verified_on", "string"), ("age_days", "bigint"), ("stale", "boolean")]
    record = {"verified_on": PRICES_VERIFIED_ON.isoformat(), "age_days": price_age_days(as_of), "stale": prices_are_stale(as_of)}
    return values_frame(spark, fields, [record])
