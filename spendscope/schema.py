"""The one normalised usage table every source maps into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_COLUMNS = [
    "uncached_input_tokens",
    "cache_read_tokens",
    "cache_write_tokens",
    "cache_write_1h_tokens",
    "output_tokens",
]
INPUT_COLUMNS = TOKEN_COLUMNS[:4]

# column -> (Spark SQL type, SQL text of the value used when a source does not carry the column)
USAGE_COLUMNS: dict[str, tuple[str, str]] = {
    "timestamp": ("timestamp", "NULL"),
    "bucket_seconds": ("bigint", "0"),
    "granularity": ("string", "NULL"),
    "vendor": ("string", "NULL"),
    "model": ("string", "NULL"),
    "workload": ("string", "'all'"),
    "product": ("string", "'chat'"),
    "service_tier": ("string", "'standard'"),
    "inference_geo": ("string", "NULL"),
    "requests": ("bigint", "NULL"),
    **{name: ("bigint", "0") for name in TOKEN_COLUMNS},
    "reasoning_tokens": ("bigint", "0"),
    "web_search_requests": ("bigint", "0"),
    "weight": ("double", "1.0"),
    "request_hash": ("string", "NULL"),
    "prefix_hashes": ("array<string>", "NULL"),
    "prefix_chars": ("array<bigint>", "NULL"),
    "status": ("string", "NULL"),
    "status_type": ("string", "NULL"),
    "source": ("string", "NULL"),
    "seq": ("bigint", "NULL"),
}

INVOICE_COLUMNS = {
    "date": "date",
    "vendor": "string",
    "line_item": "string",
    "amount_usd": "double",
    "source": "string",
}


def as_usage(df: DataFrame) -> DataFrame:
    """Project onto the normalised columns: cast what is there, fill defaults for what is missing."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in present else F.expr(default)).cast(dtype).alias(name)
            for name, (dtype, default) in USAGE_COLUMNS.items()
        ]
    )


def as_invoice(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(name).cast(dtype).alias(name) for name, dtype in INVOICE_COLUMNS.items()])


def empty_usage(spark) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, (t, _) in USAGE_COLUMNS.items()))


def empty_invoice(spark) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in INVOICE_COLUMNS.items()))


def total_input() -> Column:
    return sum((F.col(c) for c in INPUT_COLUMNS[1:]), F.col(INPUT_COLUMNS[0]))


def first_non_blank(*cols: Column | str, default: str | None = None) -> Column:
    """First value that is neither NULL nor an empty string (the falsy-skipping fallback chains)."""
    parts = [F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)
