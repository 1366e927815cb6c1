"""Prompt-prefix reuse: replay of the request log under ideal caching, and the stable prefix.

A request hits the cache with its deepest prefix used within the TTL before it, and is worth a cache write
for its deepest prefix that a later request uses within the TTL. Both TTL options of a model come out of one
pass: the slices are no longer than the shortest TTL, and the gaps across slices serve every TTL.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.operators.cells import has_fingerprint, start_us
from spendscope.operators.pricing import priced_usage, row_scales
from spendscope.operators.recency import moment, slice_edges, slice_of
from spendscope.price_dim import HOUR_SECONDS, price_book, price_rows
from spendscope.schema import total_input

# What share of a model's requests a stable prefix must cover, and how many it needs.
STABLE_PREFIX_SHARE = 0.5
STABLE_PREFIX_MIN_REQUESTS = 5

_PREFIX = ["model_key", "prefix_hash"]
_OPTIONS = {"own": "p_write", "hour": "p_write_1h"}  # the model's own TTL; the 1-hour cache where it exists


def fingerprinted_requests(spark: SparkSession, usage: DataFrame) -> DataFrame:
    """Priced request rows that carry a fingerprint."""
    requests = usage.filter((F.col("granularity") == "request") & has_fingerprint())
    return priced_usage(spark, requests).filter("priced").withColumn("at_us", start_us())


def shortest_ttl() -> int:
    return min(HOUR_SECONDS, *(r["ttl_seconds"] for r in price_rows()))


def cache_replay(spark: SparkSession, usage: DataFrame) -> DataFrame:
    """Per request: hit, reuse and write tokens and ideal input cost, under the own and the 1-hour TTL."""
    totals = total_input().cast("double")
    in_scale, _ = row_scales()
    per_char = F.coalesce(totals / F.nullif(F.element_at("prefix_chars", -1), F.lit(0)), F.lit(0.0))
    # What a request's blocks share is computed before they are taken apart, and so are the arrays: a generator would
    # interpret an expression, and the outer form keeps the planner from adding a filter that builds them twice. A hash
    # repeated in one request has the same edges at each position, so its deepest one wins without being looked for.
    calls = fingerprinted_requests(spark, usage).select(
        "model_key",
        "at_us",
        "source",
        "seq",
        slice_of("at_us", shortest_ttl()).alias("slice"),
        moment().alias("moment"),
        per_char.alias("per_char"),
        totals.alias("total"),
        in_scale.alias("in_scale"),
        "prefix_hashes",
        F.arrays_zip(F.col("prefix_hashes").alias("prefix_hash"), F.col("prefix_chars").alias("chars")).alias("zipped"),
    )
    uses = calls.select("model_key", "slice", "at_us", "moment", F.explode_outer("prefix_hashes").alias("prefix_hash"))
    edges = slice_edges(uses, _PREFIX).select(*_PREFIX, "slice", "first_moment", "last_moment", "prev_us", "next_us")
    blocks = calls.select("*", F.posexplode_outer("zipped").alias("pos", "block")).select(
        "model_key",
        F.col("block.prefix_hash").alias("prefix_hash"),
        "at_us",
        "source",
        "seq",
        "slice",
        "moment",
        "pos",
        (F.coalesce("block.chars", F.lit(0)) * F.col("per_char")).alias("tokens"),
        "total",
        "in_scale",
    )
    book = price_book(spark)
    ttls = book.select(
        "model_key",
        (F.col("ttl_seconds") * 1_000_000).alias("ttl_own"),
        F.when(F.col("p_write_1h").isNotNull(), F.lit(HOUR_SECONDS * 1_000_000)).alias("ttl_hour"),
    )
    # The only full-size join: hot (prefix, slice) partitions are split by adaptive execution.
    seen = blocks.join(edges, [*_PREFIX, "slice"]).join(F.broadcast(ttls), "model_key")
    seen = seen.withColumns(
        {
            "gap_hit": F.when(F.col("moment") == F.col("first_moment"), F.col("at_us") - F.col("prev_us")).otherwise(0),
            "gap_reuse": F.when(F.col("moment") == F.col("last_moment"), F.col("next_us") - F.col("at_us")).otherwise(0),
        }
    )
    # A block that was used neither before nor after in time says nothing; each request keeps one row, its first block.
    used = reduce(or_, [F.col(f"gap_{kind}") <= F.col(f"ttl_{o}") for kind in ("hit", "reuse") for o in _OPTIONS])
    seen = seen.filter((F.col("pos") == 0) | F.coalesce(used, F.lit(False)))
    calls = seen.groupBy("model_key", "source", "seq").agg(
        *[F.max(c).alias(c) for c in ("at_us", "total", "in_scale")],
        *[
            F.max_by("tokens", F.when(F.col(f"gap_{kind}") <= F.col(f"ttl_{option}"), F.col("pos"))).alias(
                f"{kind}_{option}"
            )
            for option in _OPTIONS
            for kind in ("hit", "reuse")
        ],
    )
    prices = book.select("model_key", "min_cacheable", "p_input", "p_cached", "p_write", "p_write_1h")
    calls = calls.join(F.broadcast(prices), "model_key")
    for option, write_price in _OPTIONS.items():
        # The deepest prefix counts only when it reaches the minimum; a shorter one is not tried.
        enough = {
            f"{kind}_{option}": F.when(F.col(f"{kind}_{option}") >= F.col("min_cacheable"), F.col(f"{kind}_{option}"))
            for kind in ("hit", "reuse")
        }
        calls = calls.withColumns({name: F.coalesce(col, F.lit(0.0)) for name, col in enough.items()})
        hit, reuse, write = (F.col(f"{kind}_{option}") for kind in ("hit", "reuse", "write"))
        calls = calls.withColumn(
            f"write_{option}", F.least(F.greatest(reuse - hit, F.lit(0.0)), F.col("total") - hit)
        )
        ideal = hit * F.col("p_cached") + write * F.col(write_price) + (F.col("total") - hit - write) * F.col("p_input")
        calls = calls.withColumn(f"cost_{option}", ideal / F.lit(1e6) * F.col("in_scale"))
    figures = [f"{kind}_{option}" for option in _OPTIONS for kind in ("hit", "reuse", "write", "cost")]
    return calls.select("model_key", "source", "seq", F.timestamp_micros("at_us").alias("timestamp"), "total", *figures)


def stable_prefix(spark: SparkSession, usage: DataFrame) -> DataFrame:
    """Per model: deepest block position shared by at least half of the requests, and its median length."""
    paired = (F.size("prefix_hashes") == F.size("prefix_chars")) & has_fingerprint()
    requests = fingerprinted_requests(spark, usage).filter(paired)
    counts = requests.groupBy("model_key").agg(F.count(F.lit(1)).alias("n_requests"))
    blocks = requests.select(
        "model_key", moment().alias("moment"), F.posexplode(F.arrays_zip("prefix_hashes", "prefix_chars")).alias("pos", "b")
    )
    # Lengths are counted, not collected: the median works on (length, count) pairs.
    lengths = blocks.groupBy(
        "model_key", "pos", F.col("b.prefix_hashes").alias("prefix_hash"), F.col("b.prefix_chars").alias("chars")
    ).agg(F.count(F.lit(1)).alias("n"), F.min("moment").alias("first_moment"))
    prefixes = lengths.groupBy("model_key", "pos", "prefix_hash").agg(
        F.sum("n").alias("n"),
        F.min("first_moment").alias("first_moment"),
        F.percentile("chars", F.lit(0.5), F.col("n")).alias("median_chars"),
    )
    # Most used prefix per depth; on equal counts the one that appeared first.
    rank = F.struct(F.col("n"), (-F.col("first_moment")).alias("earliest"))
    depths = (
        prefixes.groupBy("model_key", "pos")
        .agg(F.max_by(F.struct("n", "median_chars"), rank).alias("top"))
        .join(counts, "model_key")
        .filter(F.col("n_requests") >= STABLE_PREFIX_MIN_REQUESTS)
        .withColumn("covers", F.col("top.n") / F.col("n_requests") >= STABLE_PREFIX_SHARE)
    )
    # The first depth that falls short ends the prefix; deeper ones do not count.
    first_miss = depths.groupBy("model_key").agg(F.min(F.when(~F.col("covers"), F.col("pos"))).alias("miss"))
    return (
        depths.join(first_miss, "model_key")
        .filter(F.col("miss").isNull() | (F.col("pos") < F.col("miss")))
        .groupBy("model_key")
        .agg(
            F.max("pos").alias("pos"),
            F.max_by(F.floor("top.median_chars").cast("bigint"), "pos").alias("prefix_chars"),
            F.max("n_requests").alias("n_requests"),
        )
    )
