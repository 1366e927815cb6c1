"""The given test tables read as usage data.

``events`` becomes a request log, ``lineitem`` becomes hourly usage buckets. Every row of a table becomes
a usage row: nothing is filtered, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.functions.spread import spread
from spendscope.schema import as_usage

LOG_MODELS = [
    "gpt-5.4-2026-03-05",
    "gpt-4o-2024-08-06",
    "gpt-5-mini-2025-08-07",
    "gpt-6-astra",
    "claude-sonnet-4-5-20250929",
    "claude-opus-4-1-20250805",
    "anthropic.claude-haiku-4-5-20251001-v1:0",
    "my-finetune",
]
BUCKET_MODELS = [
    "gpt-5.4-2026-03-05",
    "gpt-4o-2024-08-06",
    "gpt-5.6",
    "claude-opus-4-1-20250805",
    "claude-sonnet-4-5-20250929",
    "claude-opus-5",
    "text-embedding-3-small",
    "my-finetune",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def pick(values: list[str], index: str) -> str:
    """SQL text: the element of a constant list at a row's index."""
    listed = ", ".join("'" + v + "'" for v in values)
    return f"element_at(array({listed}), CAST({index} AS INT) + 1)"


def request_log(events: DataFrame) -> DataFrame:
    """``events`` as request rows. The gateway model keeps an explicit vendor, the rest infer theirs."""
    base = events.selectExpr("*", "user_id % 8 AS slot", "20 + CAST(floor(value * 4) AS BIGINT) AS out_tokens")
    return as_usage(
        base.selectExpr(
            "CAST(ts AS TIMESTAMP) AS timestamp",
            "'request' AS granularity",
            "CASE WHEN slot IN (4, 5) THEN 'anthropic' WHEN slot = 6 THEN 'bedrock' ELSE 'openai' END AS vendor",
            f"{pick(LOG_MODELS, 'slot')} AS model",
            "event_type AS workload",
            "CASE event_id % 20 WHEN 0 THEN 'batch' WHEN 1 THEN 'fast' WHEN 2 THEN 'priority' ELSE 'standard' END"
            " AS service_tier",
            "CASE WHEN slot = 4 AND event_id % 7 = 0 THEN 'us' END AS inference_geo",
            "1 AS requests",
            "CAST(floor(value * CASE WHEN event_type = 'signup' THEN 20 ELSE 1000 END) AS BIGINT) AS uncached_input_tokens",
            "CASE WHEN event_id % 3 = 0 THEN CAST(floor(value * 50) AS BIGINT) ELSE 0 END AS cache_read_tokens",
            "CASE WHEN event_id % 5 = 0 THEN CAST(floor(value * 20) AS BIGINT) ELSE 0 END AS cache_write_tokens",
            "CASE WHEN slot = 5 THEN CAST(floor(value * 10) AS BIGINT) ELSE 0 END AS cache_write_1h_tokens",
            "out_tokens AS output_tokens",
            "CAST(floor(out_tokens * (event_id % 10) / 10.0D) AS BIGINT) AS reasoning_tokens",
            "CASE WHEN event_id % 50 = 0 THEN 3 ELSE 0 END AS web_search_requests",
            "CASE WHEN user_id % 2 = 0 THEN 1.0D ELSE 2.0D END AS weight",
            "concat(user_id, '-', event_id % 10) AS request_hash",
            "array('sys', concat('sys/', event_type), concat('sys/', event_type, '/', user_id),"
            " CAST(event_id AS STRING)) AS prefix_hashes",
            "array(8000L, 12000L, 16000L, 20000L) AS prefix_chars",
            "CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN '500' ELSE '200' END AS status",
            "'number' AS status_type",
            "'events' AS source",
            "event_id AS seq",
        )
    )


def usage_buckets(lineitem: DataFrame) -> DataFrame:
    """``lineitem`` as hourly buckets: workload ws_0 runs in two hours of the day, the others all day."""
    base = lineitem.selectExpr("*", "l_partkey % 8 AS slot", "CAST(l_quantity AS BIGINT) AS quantity")
    return as_usage(
        base.selectExpr(
            "CAST(l_shipdate AS TIMESTAMP) + make_interval(0, 0, 0, 0, CAST(CASE WHEN l_suppkey % 4 = 0"
            " THEN 1 + l_linenumber % 2 ELSE l_orderkey % 24 END AS INT)) AS timestamp",
            "3600 AS bucket_seconds",
            "'bucket' AS granularity",
            "CASE WHEN slot IN (3, 4, 5) THEN 'anthropic' ELSE 'openai' END AS vendor",
            f"{pick(BUCKET_MODELS, 'slot')} AS model",
            "concat('ws_', l_suppkey % 4) AS workload",
            "CASE WHEN slot = 6 THEN 'embedding' ELSE 'chat' END AS product",
            "CASE l_orderkey % 20 WHEN 0 THEN 'batch' WHEN 1 THEN 'fast' ELSE 'standard' END AS service_tier",
            "CASE WHEN slot IN (3, 4, 5) THEN NULL ELSE l_linenumber * 10 END AS requests",
            "quantity * 100000 AS uncached_input_tokens",
            "CASE WHEN slot <> 6 AND l_linenumber = 2 THEN quantity * 20000 ELSE 0 END AS cache_read_tokens",
            "CASE WHEN slot = 6 THEN 0 ELSE quantity * 5000 END AS output_tokens",
            "'lineitem' AS source",
        )
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources in one normalised table."""
    return request_log(table(spark, sf_dir, "events")).unionByName(usage_buckets(table(spark, sf_dir, "lineitem")))

