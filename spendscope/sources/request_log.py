"""Request logs: one JSON object per line, in any of three usage shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendscope.functions import json_values as js
from spendscope.functions.identity import anthropic_tier, openai_tier, vendor_of
from spendscope.functions.joins import checked_broadcast
from spendscope.operators.fingerprint import fingerprint
from spendscope.schema import as_usage, first_non_blank


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source, path, seq, split_start, line); ``seq`` is unique over all files and ordered within a file."""
    raw = spark.read.text(paths)
    return raw.select(
        F.col("_metadata.file_name").alias("source"),
        F.col("_metadata.file_path").alias("path"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.col("value").alias("line"),
    )


def _file(lines: DataFrame) -> str:
    """Column that tells files apart; tables of lines without a path have one file a source."""
    return "path" if "path" in lines.columns else "source"


def parsed(lines: DataFrame) -> DataFrame:
    """Add ``rec`` (VARIANT, NULL when the line is not JSON); blank lines are dropped.

    The one-element explode is a fence: filters on ``rec`` stay above it, where a plain projection would let
    the optimizer copy the parsing into every filter.
    """
    once = F.explode(F.array(F.try_parse_json("line")))
    return lines.filter(F.trim("line") != "").withColumn("rec", once)


def eval_files(lines: DataFrame) -> DataFrame:
    """Files whose first line is an eval case or an eval output rather than a call. Only first lines are parsed."""
    file = _file(lines)
    first = lines.filter(F.trim("line") != "").groupBy(file).agg(F.min_by("line", "seq").alias("line"))
    rec = F.try_parse_json("line")
    looks_like_eval = js.has_key(rec, "checks") | (js.has_key(rec, "output") & ~js.has_key(rec, "usage"))
    return first.filter(F.coalesce(looks_like_eval, F.lit(False))).select(file)


def without_eval_files(lines: DataFrame, evals: DataFrame | None = None) -> DataFrame:
    """Unparsed lines of the files that are logs; ``evals`` gives the others' paths where they are written already."""
    # One path per eval file: broadcast only after counting them.
    evals = eval_files(lines) if evals is None else evals
    return lines.join(checked_broadcast(evals), _file(lines), "left_anti")


def has_usage(rec: Column) -> Column:
    return js.get(rec, "usage", "map<string,variant>").isNotNull()


# All three usage shapes as one type; a usage object is cast once and its fields are read from the struct.
USAGE = """struct<
    prompt_tokens:string, completion_tokens:string, input_tokens:string, output_tokens:string,
    prompt_tokens_details:struct<cached_tokens:string,cache_write_tokens:string>,
    completion_tokens_details:struct<reasoning_tokens:string>,
    input_tokens_details:struct<cached_tokens:string,cache_write_tokens:string>,
    output_tokens_details:struct<reasoning_tokens:string,thinking_tokens:string>,
    cache_read_input_tokens:string, cache_creation_input_tokens:string,
    cache_creation:struct<ephemeral_5m_input_tokens:string,ephemeral_1h_input_tokens:string>,
    server_tool_use:struct<web_search_requests:string>>""".replace("\n", " ").replace("  ", "")


def usage_tokens(typed: Column, usage: Column, vendor: Column) -> dict[str, Column]:
    """Token columns out of a Chat Completions, Messages or Responses usage object.

    ``typed`` is the object cast to ``USAGE``. The key ``prompt_tokens`` selects the first shape whatever the
    vendor (even when it is null, so the untyped object is asked); the vendor decides the rest.
    """

    def n(path: str) -> Column:
        value = typed
        for name in path.split("."):
            value = value[name]
        return js.whole(value, path)

    chat = js.has_key(usage, "prompt_tokens")
    messages = vendor == "anthropic"
    chat_cached, chat_written = n("prompt_tokens_details.cached_tokens"), n("prompt_tokens_details.cache_write_tokens")
    cached, written = n("input_tokens_details.cached_tokens"), n("input_tokens_details.cache_write_tokens")
    has_split = F.coalesce(F.size(js.get(usage, "cache_creation", "map<string,variant>")) > 0, F.lit(False))
    write_5m = F.when(has_split, n("cache_creation.ephemeral_5m_input_tokens")).otherwise(
        n("cache_creation_input_tokens")
    )
    write_1h = F.when(has_split, n("cache_creation.ephemeral_1h_input_tokens")).otherwise(F.lit(0))

    def choose(chat_value: Column, messages_value: Column, responses_value: Column) -> Column:
        return F.when(chat, chat_value).when(messages, messages_value).otherwise(responses_value)

    zero = F.lit(0).cast("bigint")
    return {
        "uncached_input_tokens": choose(
            F.greatest(n("prompt_tokens") - chat_cached - chat_written, zero),
            n("input_tokens"),
            F.greatest(n("input_tokens") - cached - written, zero),
        ),
        "cache_read_tokens": choose(chat_cached, n("cache_read_input_tokens"), cached),
        "cache_write_tokens": choose(chat_written, write_5m, written),
        "cache_write_1h_tokens": choose(zero, write_1h, zero),
        "output_tokens": choose(n("completion_tokens"), n("output_tokens"), n("output_tokens")),
        "reasoning_tokens": choose(
            n("completion_tokens_details.reasoning_tokens"),
            n("output_tokens_details.thinking_tokens"),
            n("output_tokens_details.reasoning_tokens"),
        ),
        "web_search_requests": choose(zero, n("server_tool_use.web_search_requests"), zero),
    }


def request_rows(records: DataFrame, salt: bytes | None = None) -> DataFrame:
    """Parsed lines -> usage rows. Raw request bodies are fingerprinted when a salt is given."""
    rec = F.col("rec")
    usage = js.get(rec, "usage", "variant")
    model = first_non_blank(js.text(rec, "model"), default="unknown")
    rows = records.filter(has_usage(rec)).withColumns(
        {"usage": usage, "tokens": js.get(rec, "usage", USAGE), "model": model}
    )
    rows = rows.withColumn("vendor", F.coalesce(F.nullif(js.text(rec, "vendor"), F.lit("")), vendor_of("model")))
    given = js.get(rec, "fingerprint", "variant")
    is_given = given.isNotNull() & ~F.is_variant_null(given)
    if salt is not None:
        request = F.when(~F.coalesce(is_given, F.lit(False)), js.get(rec, "request", "variant"))
        rows = rows.withColumn("fp", fingerprint(request, salt))
    else:
        rows = rows.withColumn(
            "fp",
            F.lit(None).cast("struct<prefix_hashes:array<string>,prefix_chars:array<bigint>,request_hash:string>"),
        )
    tier = first_non_blank(js.text(rec, "service_tier"), js.text(F.col("usage"), "service_tier"))
    rate = F.coalesce(F.nullif(js.get(rec, "sample_rate", "double"), F.lit(0.0)), F.lit(1.0))
    status = js.get(rec, "status", "variant")
    return as_usage(
        rows.select(
            js.instant(js.get(rec, "timestamp", "variant")).alias("timestamp"),
            F.lit("request").alias("granularity"),
            "vendor",
            "model",
            first_non_blank(js.text(rec, "workload"), js.text(rec, "feature"), default="all").alias("workload"),
            F.when(F.col("vendor") == "openai", openai_tier(js.get(rec, "batch", "boolean"), tier))
            .otherwise(anthropic_tier(tier, js.text(rec, "speed")))
            .alias("service_tier"),
            js.text(F.col("usage"), "inference_geo").alias("inference_geo"),
            F.lit(1).alias("requests"),
            (F.lit(1.0) / rate).alias("weight"),
            F.coalesce(js.text(rec, "fingerprint.request_hash"), "fp.request_hash").alias("request_hash"),
            F.coalesce(js.get(rec, "fingerprint.prefix_hashes", "array<string>"), "fp.prefix_hashes").alias(
                "prefix_hashes"
            ),
            F.coalesce(js.get(rec, "fingerprint.prefix_chars", "array<bigint>"), "fp.prefix_chars").alias(
                "prefix_chars"
            ),
            F.try_variant_get(status, "$", "string").alias("status"),
            js.kind_of(status).alias("status_type"),
            *[col.alias(name) for name, col in usage_tokens(F.col("tokens"), F.col("usage"), F.col("vendor")).items()],
            "source",
            "seq",
        )
    )


def lines_without_usage(records: DataFrame) -> DataFrame:
    """Per source: lines that are JSON but carry no usage object, and lines that are not JSON."""
    rec = F.col("rec")
    return (
        records.groupBy("source")
        .agg(
            F.count_if(rec.isNotNull() & ~has_usage(rec)).alias("without_usage"),
            F.count_if(rec.isNull()).alias("invalid_json"),
        )
        .filter((F.col("without_usage") > 0) | (F.col("invalid_json") > 0))
    )


def numbered_bad_lines(lines: DataFrame) -> DataFrame:
    """Lines that are not JSON, as (source, line_no), with the path where there is one.

    Line numbers come from per-split counts: no file is pulled through one task. ``lines`` needs
    (source, split_start, seq, line) with ``seq`` consecutive inside a split, blank lines included.
    """
    file = _file(lines)
    splits = lines.groupBy(file, "split_start").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    earlier = Window.partitionBy(file).orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    bad = lines.filter((F.trim("line") != "") & F.try_parse_json("line").isNull())
    return bad.join(offsets, [file, "split_start"]).select(
        *dict.fromkeys(("source", file)), (F.col("before") + F.col("seq") - F.col("first_seq") + 1).alias("line_no")
    )
