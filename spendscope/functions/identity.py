"""Model ids, vendors, service tiers and call status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.price_dim import ALIASES

# Gateway prefixes and snapshot suffixes of model ids, and the tier renames.
VENDOR_PREFIX = r"^(openai|anthropic|us\.anthropic|eu\.anthropic|global\.anthropic)[./]"
SNAPSHOT_SUFFIXES = r"(-\d{4}-\d{2}-\d{2}|-\d{8}|@\d{8}|-v\d+(:\d+)?)+$"
OPENAI_TIERS = {"default": "standard", "auto": "standard", "priority": "fast"}
ANTHROPIC_TIERS = {"priority_on_demand": "priority", "flex_discount": "flex"}
FAILED_STATUS = ["error", "failed", "timeout", "cancelled"]


def _renamed(value: Column, names: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, value), value)


_BLANKS = " \t\n\r\f\x0b"


def _trimmed(raw: Column) -> Column:
    return F.btrim(F.lower(raw), F.lit(_BLANKS))


def _unrouted(bare: Column) -> Column:
    routed = bare.contains("openai") | bare.contains("anthropic")
    return F.when(routed, F.regexp_replace(bare, VENDOR_PREFIX, "")).otherwise(bare)


def _undated(bare: Column) -> Column:
    # A snapshot suffix is a version or ends in a two-digit day.
    digits = F.translate(F.right(bare, F.lit(2)), "0123456789", "0000000000") == "00"
    return F.when(digits | bare.contains("-v"), F.regexp_replace(bare, SNAPSHOT_SUFFIXES, "")).otherwise(bare)


def model_key(model: Column | str) -> Column:
    """Raw model id (snapshot, gateway or cloud id) -> key of the price dimension.

    The two patterns cost more than pricing the row, so plain string tests decide whether a row needs them.
    """
    raw = F.col(model) if isinstance(model, str) else model
    return _renamed(_undated(_unrouted(_trimmed(raw))), ALIASES)


def with_model_key(rows: DataFrame) -> DataFrame:
    """``model_key`` of ``model``, step by step: every step names its input several times, and in one expression each
    mention would be computed again, patterns included."""
    bare = F.col("model_key")
    rows = rows.withColumn("model_key", _trimmed(F.col("model")))
    rows = rows.withColumn("model_key", _unrouted(bare)).withColumn("model_key", _undated(bare))
    return rows.withColumn("model_key", _renamed(bare, ALIASES))


def vendor_of(model: Column | str) -> Column:
    raw = F.col(model) if isinstance(model, str) else model
    return F.when(F.lower(raw).startswith("claude"), F.lit("anthropic")).otherwise(F.lit("openai"))


def _tier_text(tier: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(tier, F.lit("")), F.lit("standard")))


def openai_tier(batch: Column, tier: Column) -> Column:
    return F.when(F.coalesce(batch, F.lit(False)), F.lit("batch")).otherwise(_renamed(_tier_text(tier), OPENAI_TIERS))


def anthropic_tier(tier: Column, speed: Column) -> Column:
    return F.when(F.lower(F.coalesce(speed, F.lit(""))) == "fast", F.lit("fast")).otherwise(
        _renamed(_tier_text(tier), ANTHROPIC_TIERS)
    )


def is_failed(status: str = "status", status_type: str = "status_type") -> Column:
    """Numeric status >= 400, or one of the failure words. The string "500" is not a number."""
    numeric = (F.col(status_type) == "number") & (F.col(status).try_cast("double") >= 400)
    worded = (F.col(status_type) == "string") & F.lower(F.col(status)).isin(FAILED_STATUS)
    return F.coalesce(numeric | worded, F.lit(False))
