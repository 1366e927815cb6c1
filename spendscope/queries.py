"""Registered queries: every operator over the given tables, with stable column names and rounding.

Sums of doubles depend on the order of addition, so results are rounded where they leave the library.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope import adapters, raw_adapters as raw
from spendscope.functions import identity
from spendscope.functions import json_values as js
from spendscope.operators import breakdowns, cells as cl, duplicates, evals, fingerprint, pricing, quality, reuse
from spendscope.plans import levers as lv
from spendscope.plans.analysis import Analysis
from spendscope.price_dim import migration_book, price_book, price_violations
from spendscope.schema import TOKEN_COLUMNS, USAGE_COLUMNS, first_non_blank, total_input
from spendscope.session import prepared
from spendscope.sources import csv_usage, exports, request_log

Query = Callable[[SparkSession, str], DataFrame]

MONEY = 4
RATE = 8
ROW = 10
#: A day on which the price list is too old.
STALE_ON = dt.date(2027, 3, 1)
SALT = b"fixed salt for repeatable checks"

_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepared(spark), sf_dir)

    _REGISTRY[fn.__name__] = run
    return fn


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def tidy(df: DataFrame, default: int = MONEY, **digits: int) -> DataFrame:
    """Round doubles, and give timestamps without a zone."""
    out = []
    for field in df.schema.fields:
        col = F.col(field.name)
        kind = field.dataType.typeName()
        if kind == "double":
            col = F.round(col, digits.get(field.name, default))
        elif kind == "timestamp":
            col = col.cast("timestamp_ntz")
        out.append(col.alias(field.name))
    return df.select(*out)


def analysis(spark: SparkSession, sf_dir: str, **kw) -> Analysis:
    return Analysis(spark, adapters.usage(spark, sf_dir), **kw)


USAGE_OUT = [c for c in USAGE_COLUMNS if c not in ("prefix_hashes", "prefix_chars", "seq")]


# ---- sources


@query
def src_openai_usage(spark, sf_dir):
    pages = exports.pages_from_text(raw.openai_usage_pages(spark, sf_dir))
    usage = exports.openai_usage(exports.results(pages))
    return tidy(usage.select("timestamp", "bucket_seconds", "vendor", "model", "workload", "service_tier", "requests", *TOKEN_COLUMNS, "source"))


@query
def src_openai_embeddings(spark, sf_dir):
    pages = exports.pages_from_text(raw.openai_usage_pages(spark, sf_dir))
    usage = exports.openai_embeddings(exports.results(pages))
    return tidy(usage.select("timestamp", "model", "workload", "product", "requests", "uncached_input_tokens", "source"))


@query
def src_openai_costs(spark, sf_dir):
    pages = exports.pages_from_text(raw.openai_cost_pages(spark, sf_dir))
    return tidy(exports.openai_costs(exports.results(pages)))


@query
def src_anthropic_usage(spark, sf_dir):
    pages = exports.pages_from_text(raw.anthropic_usage_pages(spark, sf_dir))
    usage = exports.anthropic_usage(exports.results(pages))
    return tidy(
        usage.select(
            "timestamp", "bucket_seconds", "vendor", "model", "workload", "service_tier", "inference_geo", "requests",
            *TOKEN_COLUMNS, "web_search_requests",
        )
    )


@query
def src_anthropic_costs(spark, sf_dir):
    pages = exports.pages_from_text(raw.anthropic_cost_pages(spark, sf_dir))
    return tidy(exports.anthropic_costs(exports.results(pages)))


def _file_kinds(spark, sf_dir):
    return exports.detect_kind(exports.pages_from_text(raw.mixed_pages(spark, sf_dir), exports.KIND_FIELDS, []))


@query
def detect_kind(spark, sf_dir):
    return _file_kinds(spark, sf_dir).select("source", "n_pages", "kind")


def _log_records(spark, sf_dir):
    return request_log.parsed(raw.log_lines(spark, sf_dir))


@query
def src_request_log(spark, sf_dir):
    rows = request_log.request_rows(_log_records(spark, sf_dir))
    out = [c for c in USAGE_OUT if c not in ("bucket_seconds", "product")]
    return tidy(rows.select("seq", *out, F.size("prefix_hashes").alias("n_blocks")))


@query
def usage_shape_map(spark, sf_dir):
    records = _log_records(spark, sf_dir).filter(request_log.has_usage(F.col("rec")))
    vendor = identity.vendor_of(js.text(F.col("rec"), "model"))
    usage = js.get(F.col("rec"), "usage", "variant")
    records = records.withColumns({"vendor": vendor, "usage": usage, "typed": js.get(F.col("rec"), "usage", request_log.USAGE)})
    tokens = request_log.usage_tokens(F.col("typed"), F.col("usage"), F.col("vendor"))
    return records.select("seq", *[c.alias(n) for n, c in tokens.items()])


@query
def src_normalised_csv(spark, sf_dir):
    return tidy(csv_usage.usage_from_cells(raw.csv_cells(spark, sf_dir)).select("seq", *USAGE_OUT))


@query
def skip_eval_files(spark, sf_dir):
    kept = request_log.parsed(request_log.without_eval_files(raw.mixed_lines(spark, sf_dir)))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n_lines"), F.min("seq").alias("first_seq"))


@query
def normalised_union(spark, sf_dir):
    usage = pricing.keyed(adapters.usage(spark, sf_dir))
    sums = [F.sum(c).alias(c) for c in ["requests", *TOKEN_COLUMNS, "reasoning_tokens", "web_search_requests"]]
    return usage.groupBy("source", "granularity", "vendor", "model_key", "workload").agg(
        F.count(F.lit(1)).alias("n_rows"), *sums
    )


@query
def eval_bad_lines(spark, sf_dir):
    return request_log.numbered_bad_lines(raw.turn_lines(spark, sf_dir))


# ---- scalar functions and pricing


@query
def ts_parse(spark, sf_dir):
    rec = F.col("rec")
    records = _log_records(spark, sf_dir)
    return tidy(records.select("seq", js.instant(js.get(rec, "timestamp", "variant")).alias("timestamp")))


@query
def tier_normalise(spark, sf_dir):
    rec = F.col("rec")
    tier, batch, speed = js.text(rec, "service_tier"), js.get(rec, "batch", "boolean"), js.text(rec, "speed")
    return _log_records(spark, sf_dir).groupBy(
        identity.openai_tier(batch, tier).alias("openai_tier"), identity.anthropic_tier(tier, speed).alias("anthropic_tier")
    ).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def workload_fallback(spark, sf_dir):
    rec = F.col("rec")
    name = first_non_blank(js.text(rec, "workload"), js.text(rec, "feature"), default="all")
    return _log_records(spark, sf_dir).groupBy(name.alias("workload")).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def vendor_infer(spark, sf_dir):
    usage = adapters.usage(spark, sf_dir)
    return usage.groupBy("model", identity.vendor_of("model").alias("vendor")).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def model_normalise(spark, sf_dir):
    usage = pricing.keyed(adapters.usage(spark, sf_dir))
    return usage.groupBy("model", "model_key").agg(F.count(F.lit(1)).alias("n_rows"))


_ROW_KEYS = ["source", "granularity", "vendor", "workload", "model_key", "service_tier", "timestamp"]


@query
def priced_usage(spark, sf_dir):
    costs = [*pricing.COST_PARTS, "cost_other", "cost_input", "cost_usd"]
    rows = pricing.priced_usage(spark, adapters.usage(spark, sf_dir))
    return tidy(rows.select(*_ROW_KEYS, total_input().alias("total_input"), "priced", *costs), ROW)


@query
def tier_multiplier(spark, sf_dir):
    rows = pricing.with_prices(spark, adapters.usage(spark, sf_dir)).filter(F.col("p_input").isNotNull())
    tier = F.col("service_tier")
    return rows.groupBy(
        "model_key",
        "service_tier",
        pricing.tier_multiplier(tier).alias("multiplier"),
        pricing.tier_is_unverified(tier).alias("unverified"),
    ).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def row_scales(spark, sf_dir):
    rows = pricing.with_prices(spark, adapters.usage(spark, sf_dir)).filter(F.col("p_input").isNotNull())
    in_scale, out_scale = pricing.row_scales()
    return tidy(rows.groupBy("model_key", "granularity", F.round(in_scale, RATE).alias("in_scale"), F.round(out_scale, RATE).alias("out_scale")).agg(
        F.count(F.lit(1)).alias("n_rows")
    ), RATE)


@query
def reprice(spark, sf_dir):
    rows = pricing.repriced(spark, adapters.usage(spark, sf_dir)).filter(F.col("p_input").isNotNull())
    return tidy(rows.select(*_ROW_KEYS, "current_model", "cheaper_model", "cost_on_current", "cost_on_cheaper"), ROW)


@query
def token_ratio(spark, sf_dir):
    """Output tokens as the tokenizers of the target models would count them."""
    rows = pricing.with_targets(spark, adapters.usage(spark, sf_dir)).filter(F.col("p_input").isNotNull())
    ratio = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    sums = rows.groupBy("model_key", "current_model", "cheaper_model", "cur_ratio", "cheap_ratio").agg(
        F.sum("output_tokens").alias("output_tokens")
    )
    return tidy(
        sums.withColumns(
            {"on_current": F.col("output_tokens") * ratio("cur_ratio"), "on_cheaper": F.col("output_tokens") * ratio("cheap_ratio")}
        ).withColumns({"cur_ratio": ratio("cur_ratio"), "cheap_ratio": ratio("cheap_ratio")}),
        2, cur_ratio=RATE, cheap_ratio=RATE,
    )


@query
def successor_closure(spark, sf_dir):
    book = F.broadcast(migration_book(spark).select("model_key", "successor", "current_model", "cheaper_model"))
    usage = pricing.keyed(adapters.usage(spark, sf_dir)).groupBy("model_key").agg(F.count(F.lit(1)).alias("n_rows"))
    return usage.join(book, "model_key", "left")


@query
def price_dim_checks(spark, sf_dir):
    """Broken price rules of the models that occur in the usage (none expected)."""
    usage = pricing.keyed(adapters.usage(spark, sf_dir)).groupBy("model_key").agg(F.count(F.lit(1)).alias("n_rows"))
    return price_violations(price_book(spark)).join(usage, "model_key").select("model_key", "rule", "n_rows")


@query
def failed_calls(spark, sf_dir):
    failed = duplicates.failed_calls(request_log.request_rows(_log_records(spark, sf_dir)))
    return tidy(failed.select("seq", "timestamp", "model", "status", "status_type"))


# ---- spend of record, breakdowns


@query
def spend_of_record(spark, sf_dir):
    rows = pricing.priced_usage(spark, adapters.usage(spark, sf_dir))
    record = cl.spend_of_record(rows.select(*_ROW_KEYS, "cost_usd"))
    return tidy(record, ROW)


@query
def chat_only_spend(spark, sf_dir):
    rows = pricing.priced_usage(spark, adapters.usage(spark, sf_dir))
    return tidy(cl.chat_only(rows).select(*_ROW_KEYS, "product", "cost_usd"), ROW)


@query
def source_period(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return tidy(a.periods, RATE)


@query
def by_model(spark, sf_dir):
    return tidy(analysis(spark, sf_dir).by_model, MONEY, share=RATE, cache_hit=RATE, input_tokens=2, cached_tokens=2, output_tokens=2)


@query
def by_workload(spark, sf_dir):
    return tidy(analysis(spark, sf_dir).by_workload, MONEY, share=RATE)


@query
def top_workloads(spark, sf_dir):
    return tidy(analysis(spark, sf_dir).top_workloads, MONEY, share=RATE)


@query
def by_token_type(spark, sf_dir):
    return tidy(analysis(spark, sf_dir).by_token_type)


@query
def embedding_spend(spark, sf_dir):
    return tidy(analysis(spark, sf_dir).embedding_spend)


@query
def reconcile(spark, sf_dir):
    usage = adapters.usage(spark, sf_dir)
    daily = breakdowns.daily_costs(spark, usage)
    return tidy(breakdowns.reconcile(daily, raw.invoice(spark, sf_dir)), MONEY, diff_pct=RATE)


@query
def data_quality(spark, sf_dir):
    usage = adapters.usage(spark, sf_dir)
    results = exports.results(exports.pages_from_text(raw.openai_usage_pages(spark, sf_dir), exports.SKIPPED_FIELDS, []))
    report = exports.results(exports.pages_from_text(raw.anthropic_usage_pages(spark, sf_dir), exports.LONG_CONTEXT_FIELDS, []))
    parts = [
        quality.usage_notes(spark, usage),
        quality.skipped_results(exports.skipped_results(results)),
        quality.long_context(exports.long_context_rows(report)),
        quality.empty_exports(_file_kinds(spark, sf_dir)),
        quality.unusable_lines(request_log.lines_without_usage(_log_records(spark, sf_dir))),
        quality.stale_prices(spark, STALE_ON),
    ]
    return lv.all_contributions(parts)


# ---- log operators


@query
def duplicate_calls(spark, sf_dir):
    found = duplicates.duplicate_calls(spark, adapters.usage(spark, sf_dir))
    return tidy(found.select("model_key", "request_hash", "seq", "timestamp", "cost_usd"), ROW)


@query
def duplicate_rates(spark, sf_dir):
    return tidy(analysis(spark, sf_dir).duplicate_rates, MONEY, dup_rate=RATE, fail_rate=RATE)


@query
def cache_replay(spark, sf_dir):
    replay = reuse.cache_replay(spark, adapters.usage(spark, sf_dir))
    return tidy(replay.drop("source"), MONEY, cost_own=12, cost_hour=12)


@query
def stable_prefix(spark, sf_dir):
    return analysis(spark, sf_dir).stable_prefix


@query
def cache_rates(spark, sf_dir):
    rates = analysis(spark, sf_dir).cache_rates
    return tidy(rates.drop("rates", "min_cacheable"), RATE)


@query
def cache_scenario(spark, sf_dir):
    found = analysis(spark, sf_dir).cache_scenario
    triple = [F.col("scenario")[i].alias(n) for i, n in enumerate(lv.SCENARIOS)]
    return tidy(found.select("model_key", "total", "average_prompt", "too_short", *triple))


@query
def apply_rates(spark, sf_dir):
    """Measured rates on the spend without any scenario: models without logs drop out."""
    a = analysis(spark, sf_dir)
    rows = lv.apply_rates(a.chat_spend, "caching", a.cache_rates)
    return tidy(rows.select("subject", "monthly_cost", *lv.SCENARIOS, "measured", "listed"))


@query
def routing_candidates(spark, sf_dir):
    return tidy(lv.routing_candidates(analysis(spark, sf_dir).chat_cells), RATE)


@query
def hour_concentration(spark, sf_dir):
    return tidy(lv.hour_concentration(analysis(spark, sf_dir).chat_cells), RATE)


@query
def reasoning_share(spark, sf_dir):
    return tidy(lv.reasoning_share(analysis(spark, sf_dir).chat_cells), RATE)


@query
def output_quantiles(spark, sf_dir):
    return tidy(analysis(spark, sf_dir).output_quantiles)


# ---- levers

_DETAIL = ["vendor", "subject", "target", "monthly_cost", "after", *lv.SCENARIOS, "measured", "listed"]


def _lever(name: str) -> Query:
    attribute = name.removeprefix("lever_")

    def run(spark, sf_dir):
        return tidy(getattr(analysis(spark, sf_dir), attribute).select(*_DETAIL))

    run.__name__ = name
    return query(run)


for _name in ("migration", "routing", "caching", "batch", "output", "duplicates", "fast_mode"):
    _lever(f"lever_{_name}")


@query
def batch_what_if(spark, sf_dir):
    return tidy(analysis(spark, sf_dir).batch_what_if)


@query
def batch_confirmed(spark, sf_dir):
    """The batch lever when a workload is confirmed as non-interactive."""
    return tidy(analysis(spark, sf_dir, batchable=["ws_1"]).batch.select(*_DETAIL))


@query
def levers(spark, sf_dir):
    return tidy(analysis(spark, sf_dir).levers.drop("title"))


@query
def top_lever_rows(spark, sf_dir):
    return tidy(analysis(spark, sf_dir).top_lever_rows.select("lever", "rank", "vendor", "subject", "target", *lv.SCENARIOS))


@query
def summary_levers(spark, sf_dir):
    return tidy(analysis(spark, sf_dir).summary_levers.drop("title"))


@query
def combined_savings(spark, sf_dir):
    return tidy(analysis(spark, sf_dir).combined)


@query
def lever_evidence(spark, sf_dir):
    return tidy(analysis(spark, sf_dir).lever_evidence)


@query
def summary(spark, sf_dir):
    return tidy(analysis(spark, sf_dir).summary, MONEY, days=RATE, base_share=RATE)


# ---- action tables

for _name in ("migration", "routing", "cache", "batch", "max_tokens", "duplicates", "fast"):

    def _plan(spark, sf_dir, _attribute=f"plan_{_name}"):
        return tidy(getattr(analysis(spark, sf_dir), _attribute), MONEY, short_share=RATE)

    _plan.__name__ = f"plan_{_name}"
    query(_plan)


# ---- eval gate


def _items(spark, sf_dir):
    cases = raw.eval_cases(spark, sf_dir)
    base = evals.eval_items(cases, raw.baseline_outputs(spark, sf_dir))
    return base, evals.eval_items(cases, raw.candidate_outputs(spark, sf_dir))


@query
def eval_checks(spark, sf_dir):
    return evals.eval_checks(raw.eval_cases(spark, sf_dir), raw.candidate_outputs(spark, sf_dir))


@query
def eval_items(spark, sf_dir):
    _, candidate = _items(spark, sf_dir)
    return candidate.select(
        "id", "workload", "passed", "missing", F.size("failed_checks").alias("n_failed"),
        F.md5(F.concat_ws("|", "failed_checks")).alias("failed_md5"), "model",
    )


@query
def eval_score(spark, sf_dir):
    _, candidate = _items(spark, sf_dir)
    return tidy(evals.eval_score(candidate), RATE)


@query
def eval_models(spark, sf_dir):
    return evals.eval_models(*_items(spark, sf_dir))


@query
def eval_gate(spark, sf_dir):
    return tidy(evals.eval_gate(*_items(spark, sf_dir)), RATE)


@query
def eval_regressions(spark, sf_dir):
    return evals.eval_regressions(*_items(spark, sf_dir)).select("id", "workload", "missing", "model")


@query
def eval_by_workload(spark, sf_dir):
    return tidy(evals.eval_by_workload(*_items(spark, sf_dir)), RATE)


@query
def eval_init(spark, sf_dir):
    return evals.eval_skeleton(analysis(spark, sf_dir).cells).select("rank", "id", "workload", "input")


# ---- prompt fingerprints


def _request():
    return js.get(F.col("rec"), "request", "variant")


@query
def fp_blocks(spark, sf_dir):
    blocks = raw.prompts(spark, sf_dir).select("source", F.posexplode(fingerprint.prompt_blocks(_request())).alias("block_no", "block"))
    return blocks.select("source", "block_no", F.char_length("block").alias("n_chars"), F.md5("block").alias("block_md5"))


def _stamped(spark, sf_dir):
    return raw.prompts(spark, sf_dir).select("source", fingerprint.fingerprint(_request(), SALT).alias("fp"))


@query
def fp_prefixes(spark, sf_dir):
    zipped = F.arrays_zip("fp.prefix_hashes", "fp.prefix_chars")
    blocks = _stamped(spark, sf_dir).select("source", F.posexplode(zipped).alias("block_no", "b"))
    return blocks.select("source", "block_no", F.col("b.prefix_hashes").alias("prefix_hash"), F.col("b.prefix_chars").alias("prefix_chars"))


@query
def fp_request_hash(spark, sf_dir):
    return _stamped(spark, sf_dir).select("source", F.col("fp.request_hash").alias("request_hash"))


@query
def fp_redact(spark, sf_dir):
    line = fingerprint.redacted_lines(raw.prompts(spark, sf_dir), SALT).withColumn("rec", F.parse_json("line"))
    keys = F.array_sort(F.map_keys(F.try_variant_get("rec", "$", "map<string,variant>")))
    return line.select(
        "source",
        F.array_join(keys, ",").alias("fields"),
        js.text(F.col("rec"), "fingerprint.request_hash").alias("request_hash"),
        F.size(js.get(F.col("rec"), "fingerprint.prefix_hashes", "array<string>")).alias("n_blocks"),
    )
