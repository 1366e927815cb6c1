"""Vendor usage and cost exports: pages of time buckets of results.

``pages`` frames have (source, path, page_seq, data); ``results`` frames have one result per row with its
bucket bounds and its position, so everything after the reader is a narrow projection. The path tells files apart;
the source, a bare name, only groups rows into periods. Numbers arrive as their JSON texts and are read by
``json_values``, which stops at what it can't read; a file that is not JSON stops the reader.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.functions import json_values as js
from spendscope.functions.identity import anthropic_tier, openai_tier
from spendscope.schema import as_invoice, as_usage, first_non_blank

# Every field the exports carry, as one type: pages are parsed once, straight into columns. ``amount`` is an
# object in one export and a text in the other; as STRING it holds either.
RESULT_FIELDS = {
    **dict.fromkeys(
        (
            "object model project_id api_key_id user_id workspace_id num_model_requests service_tier speed inference_geo "
            "context_window input_tokens input_cached_tokens input_cache_write_tokens input_uncached_tokens output_tokens "
            "uncached_input_tokens cache_read_input_tokens amount currency line_item description"
        ).split(),
        "string",
    ),
    "batch": "boolean",
    "cache_creation": "struct<ephemeral_5m_input_tokens:string,ephemeral_1h_input_tokens:string>",
    "server_tool_use": "struct<web_search_requests:string>",
}


BOUNDS = ["start_time", "end_time", "starting_at", "ending_at"]


def buckets_type(fields: Iterable[str] = RESULT_FIELDS, bounds: Iterable[str] = BOUNDS) -> str:
    result = ",".join(f"{name}:{RESULT_FIELDS[name]}" for name in fields)
    return f"array<struct<{''.join(f'{name}:string,' for name in bounds)}results:array<struct<{result}>>>>"


# Result kinds of the exports.
OPENAI_COMPLETIONS = "organization.usage.completions.result"
OPENAI_EMBEDDINGS = "organization.usage.embeddings.result"
OPENAI_COSTS = "organization.costs.result"
OPENAI_USAGE_FAMILY = "organization.usage."
LONG_CONTEXT_WINDOW = "200k-1M"
KINDS = ["openai_costs", "openai_embeddings", "openai_usage", "anthropic_usage", "anthropic_costs", "unknown"]
#: The fields of a result that tell the kind of its file, and those that the notes are about.
KIND_FIELDS = ["object", "uncached_input_tokens", "amount", "currency"]
SKIPPED_FIELDS = ["object"]
LONG_CONTEXT_FIELDS = ["context_window"]


def read_pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JSON export files: one page object, or a list of pages, per file."""
    raw = spark.read.schema(f"data {buckets_type()}").option("multiLine", True).option("mode", "FAILFAST").json(paths)
    return raw.select(
        F.col("_metadata.file_name").alias("source"),
        F.col("_metadata.file_path").alias("path"),
        F.monotonically_increasing_id().alias("page_seq"),
        "data",
    )


def pages_from_text(texts: DataFrame, fields: Iterable[str] = RESULT_FIELDS, bounds: Iterable[str] = BOUNDS) -> DataFrame:
    """(source, path, page_seq, page) with the page as JSON text -> pages. Without a path, the source is the file.

    ``fields`` and ``bounds`` are those that the readers of results and buckets use: each one costs time, numbers most of
    all, since their texts are kept.
    """
    path = "path" if "path" in texts.columns else "source"
    data = F.from_json("page", f"struct<data:{buckets_type(fields, bounds)}>", {"mode": "FAILFAST"})["data"]
    return texts.select("source", F.col(path).alias("path"), "page_seq", data.alias("data"))


def results(pages: DataFrame) -> DataFrame:
    """One row per result. The outer form of explode keeps the planner from adding a filter on the array,
    which would parse every page a second time."""
    bounds = [c for c in BOUNDS if c in pages.schema["data"].dataType.elementType.names]
    buckets = pages.select("source", "path", "page_seq", F.posexplode_outer("data").alias("bucket_no", "bucket"))
    return buckets.select(
        "source",
        "path",
        "page_seq",
        "bucket_no",
        *[F.col(f"bucket.{c}").alias(c) for c in bounds],
        F.posexplode_outer("bucket.results").alias("result_no", "v"),
    ).filter(F.col("v").isNotNull())


def _v(path: str) -> Column:
    return F.col(f"v.{path}")


def _n(path: str) -> Column:
    return js.whole(_v(path), path)


def _object() -> Column:
    return F.coalesce(_v("object"), F.lit(""))


def _first_result() -> Column:
    """The first result of a page; NULL where it has none."""
    listed = F.transform("data", lambda bucket: F.coalesce(bucket["results"], F.array()))
    return F.get(F.filter(F.flatten(listed), lambda v: v.isNotNull()), F.lit(0))


def detect_kind(pages: DataFrame) -> DataFrame:
    """Kind of every file, from its first result: one pass, and one minimum per file, combined map-side.

    Kinds are numbers until the end: a text can't be updated in place, so its minimum would have every page sorted.
    """
    code = {name: F.lit(i) for i, name in enumerate(KINDS, 1)}
    kind = (
        F.when(_object() == OPENAI_COSTS, code["openai_costs"])
        .when(_object() == OPENAI_EMBEDDINGS, code["openai_embeddings"])
        .when(_object().startswith(OPENAI_USAGE_FAMILY), code["openai_usage"])
        .when(_v("uncached_input_tokens").isNotNull(), code["anthropic_usage"])
        .when(_v("amount").isNotNull() & _v("currency").isNotNull(), code["anthropic_costs"])
        .otherwise(code["unknown"])
    )
    heads = pages.select("path", "source", "page_seq", _first_result().alias("v"))
    found = F.col("v").isNotNull()
    kinds = heads.groupBy("path", "source").agg(
        F.count(F.lit(1)).alias("n_pages"), F.min_by(F.when(found, kind), F.when(found, F.col("page_seq"))).alias("code")
    )
    name = F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("code") - 1)
    return kinds.select("path", "source", "n_pages", F.coalesce(name, F.lit("empty")).alias("kind"))


def _openai_bucket() -> list[Column]:
    return [
        js.moment(F.col("start_time")).alias("timestamp"),
        (F.unix_timestamp(js.moment(F.col("end_time"))) - F.unix_timestamp(js.moment(F.col("start_time")))).alias("bucket_seconds"),
        F.lit("bucket").alias("granularity"),
        F.lit("openai").alias("vendor"),
        first_non_blank(_v("model"), default="unknown").alias("model"),
        first_non_blank(
            _v("project_id"), _v("api_key_id"), _v("user_id"), default="all"
        ).alias("workload"),
        _n("num_model_requests").alias("requests"),
        "source",
        F.col("page_seq").alias("seq"),
    ]


def openai_usage(found: DataFrame) -> DataFrame:
    """Completions usage; ``input_tokens`` includes cached and cache-write tokens."""
    cached, written = _n("input_cached_tokens"), _n("input_cache_write_tokens")
    left = F.greatest(_n("input_tokens") - cached - written, F.lit(0))
    return as_usage(
        found.filter(_object() == OPENAI_COMPLETIONS).select(
            *_openai_bucket(),
            openai_tier(_v("batch"), _v("service_tier")).alias("service_tier"),
            F.when(_v("input_uncached_tokens").isNull(), left).otherwise(_n("input_uncached_tokens")).alias("uncached_input_tokens"),
            cached.alias("cache_read_tokens"),
            written.alias("cache_write_tokens"),
            _n("output_tokens").alias("output_tokens"),
        )
    )


def openai_embeddings(found: DataFrame) -> DataFrame:
    return as_usage(
        found.filter(_object() == OPENAI_EMBEDDINGS).select(
            *_openai_bucket(),
            F.lit("embedding").alias("product"),
            _n("input_tokens").alias("uncached_input_tokens"),
        )
    )


def openai_costs(found: DataFrame) -> DataFrame:
    return as_invoice(
        found.select(
            F.to_date(js.moment(F.col("start_time"))).alias("date"),
            F.lit("openai").alias("vendor"),
            _v("line_item").alias("line_item"),
            js.real(F.get_json_object(_v("amount"), "$.value"), "amount").alias("amount_usd"),
            "source",
        )
    )


def anthropic_usage(found: DataFrame) -> DataFrame:
    """Messages usage; input tokens exclude cache reads and writes."""
    start, end = js.moment(F.col("starting_at")), js.moment(F.col("ending_at"))
    return as_usage(
        found.select(
            start.alias("timestamp"),
            (F.unix_timestamp(end) - F.unix_timestamp(start)).alias("bucket_seconds"),
            F.lit("bucket").alias("granularity"),
            F.lit("anthropic").alias("vendor"),
            first_non_blank(_v("model"), default="unknown").alias("model"),
            first_non_blank(_v("workspace_id"), _v("api_key_id"), default="default").alias("workload"),
            anthropic_tier(_v("service_tier"), _v("speed")).alias("service_tier"),
            _v("inference_geo").alias("inference_geo"),
            _n("uncached_input_tokens").alias("uncached_input_tokens"),
            _n("cache_read_input_tokens").alias("cache_read_tokens"),
            _n("cache_creation.ephemeral_5m_input_tokens").alias("cache_write_tokens"),
            _n("cache_creation.ephemeral_1h_input_tokens").alias("cache_write_1h_tokens"),
            _n("output_tokens").alias("output_tokens"),
            _n("server_tool_use.web_search_requests").alias("web_search_requests"),
            "source",
            F.col("page_seq").alias("seq"),
        )
    )


def anthropic_costs(found: DataFrame) -> DataFrame:
    """Cost report; amounts are decimal strings in cents."""
    cents = js.real(_v("amount"), "amount")
    return as_invoice(
        found.select(
            F.to_date(js.moment(F.col("starting_at"))).alias("date"),
            F.lit("anthropic").alias("vendor"),
            _v("description").alias("line_item"),
            (cents / F.lit(100.0)).alias("amount_usd"),
            "source",
        )
    )


def skipped_results(found: DataFrame) -> DataFrame:
    """Results of other kinds inside completions exports, per source and kind."""
    return (
        found.filter(_object() != OPENAI_COMPLETIONS)
        .groupBy("source", _object().alias("object"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def long_context_rows(found: DataFrame) -> DataFrame:
    """Rows on the long context window, which are priced at standard rates."""
    flagged = _v("context_window") == LONG_CONTEXT_WINDOW
    return found.filter(flagged).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
