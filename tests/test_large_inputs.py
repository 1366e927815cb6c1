"""What keeps the time and memory of large inputs down, checked on plans and small tables."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendscope import raw_adapters as raw
from spendscope.functions import identity
from spendscope.operators import cells, duplicates, pricing, reuse
from spendscope.queries import queries
from spendscope.schema import as_usage
from spendscope.sources import exports

SMALLEST = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- export pages


def test_notes_parse_only_what_they_are_about(spark, monkeypatch):
    parsed, parse = [], exports.pages_from_text
    monkeypatch.setattr(exports, "pages_from_text", lambda *given: parsed.append(parse(*given)) or parsed[-1])
    queries()["data_quality"](spark, SMALLEST)
    kinds = sorted(p.schema["data"].simpleString() for p in parsed)
    assert kinds == [
        "data:array<struct<results:array<struct<context_window:string>>>>",
        "data:array<struct<results:array<struct<object:string,uncached_input_tokens:string,amount:string,currency:string>>>>",
        "data:array<struct<results:array<struct<object:string>>>>",
    ]


def test_a_page_that_is_not_json_stops_every_reader(spark):
    texts = spark.createDataFrame([("a.json", 1, '{"data":[{"results":[{"object":"x","output_tokens":1}')], "source string, page_seq bigint, page string")
    for fields in (exports.SKIPPED_FIELDS, exports.LONG_CONTEXT_FIELDS, exports.KIND_FIELDS):
        with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING"):
            exports.results(exports.pages_from_text(texts, fields, [])).collect()


def test_kinds_are_found_without_a_sort(spark):
    costs, usage = {"object": exports.OPENAI_COSTS}, {"uncached_input_tokens": 3}
    pages = [
        ("a", 2, [[usage]]), ("a", 1, [None, [], [None, costs, usage]]), ("b", 5, None), ("b", 6, [[]]), ("b", 7, [[usage], [costs]]),
        ("c", 1, [[], None]), ("d", 1, [[{"amount": "1", "currency": "USD"}]]), ("e", 1, [[{"amount": "1"}]]),
    ]
    rows = [(s, n, json.dumps({"data": d and [{"results": r} for r in d]})) for s, n, d in pages]
    texts = spark.createDataFrame(rows, "source string, page_seq bigint, page string")
    for more in ((), (exports.KIND_FIELDS, [])):
        kinds = exports.detect_kind(exports.pages_from_text(texts, *more))
        assert "SortAggregate" not in plan_of(kinds)
        assert {r.source: (r.n_pages, r.kind) for r in kinds.collect()} == {
            "a": (2, "openai_costs"), "b": (3, "anthropic_usage"), "c": (1, "empty"), "d": (1, "anthropic_costs"), "e": (1, "unknown")
        }


def test_no_stage_is_one_method_too_large_to_be_compiled(spark):
    queries()["src_openai_usage"](spark, SMALLEST)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


# ---- action tables


@pytest.mark.parametrize("name", ["plan_migration", "plan_batch", "plan_fast", "plan_max_tokens"])
def test_a_plan_computes_no_lever_but_its_own(spark, monkeypatch, name):
    def refused(*_):
        raise AssertionError("the replay or the duplicate check is not needed here")

    monkeypatch.setattr(reuse, "cache_replay", refused)
    monkeypatch.setattr(duplicates, "duplicate_rates", refused)
    queries()[name](spark, SMALLEST).collect()


def test_a_plan_of_caching_checks_no_duplicates(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "duplicate_rates", None)
    queries()["plan_cache"](spark, SMALLEST).collect()


# ---- fingerprints


@pytest.mark.parametrize("name", ["fp_request_hash", "fp_redact"])
def test_python_gets_small_batches_of_prompts(spark, name):
    for size in ("Records", "Bytes"):
        spark.conf.unset(f"spark.sql.execution.arrow.max{size}PerBatch")
    queries()[name](spark, SMALLEST)
    seen = F.pandas_udf(lambda texts: pd.Series([[len(texts), sum(map(len, texts))]] * len(texts)), "array<bigint>")

    def largest(rows):
        sizes = rows.coalesce(1).select(seen("text").alias("s")).agg(F.max(F.col("s")[0]), F.max(F.col("s")[1]))
        return sizes.first()

    assert largest(spark.range(2000).select(F.lit("x").alias("text")))[0] <= 512
    assert largest(spark.range(40).select(F.repeat(F.lit("x"), 1 << 20).alias("text")))[1] <= 20 << 20


# ---- model keys


def test_the_patterns_of_a_model_id_run_once_a_row(spark):
    ids = ["gpt-5.4-2026-03-05", " GPT-4o-2024-08-06", "anthropic.claude-haiku-4-5-20251001-v1:0", "us.anthropic.claude-opus-5", "x-v", "", None]
    rows = spark.createDataFrame([(i,) for i in ids], "model string").repartition(2)
    keys = pricing.keyed(rows)
    assert plan_of(keys).count("regexp_replace") == 2
    assert keys.filter(~F.col("model_key").eqNullSafe(identity.model_key("model"))).count() == 0 and keys.count() == len(ids)


# ---- cells


def mixed_calls(spark):
    """Request rows of one cell that differ in all that prices depend on, and rows without a price or a request."""
    rows = [
        (i, "request" if i % 7 else "bucket", ["gpt-5.4", "claude-sonnet-4-5", "gpt-4o", "nobody"][i % 4], ["us", None][i % 2], 1.0 + i % 3,
         [100, 5_000, 190_000, 600_000][i // 4 % 4] + i, 40 * i, 3 * i, i % 5, 60 + 9 * i, ["a"] if i % 3 else None, i % 2)
        for i in range(160)
    ]
    frame = spark.createDataFrame(
        rows,
        "seq bigint, granularity string, model string, inference_geo string, weight double, uncached_input_tokens bigint, cache_read_tokens bigint,"
        " cache_write_tokens bigint, cache_write_1h_tokens bigint, output_tokens bigint, prefix_hashes array<string>, web_search_requests bigint",
    )
    more = {"timestamp": F.timestamp_seconds(F.lit(1_700_000_000)), "vendor": F.lit("v"), "source": F.lit("s"), "requests": F.lit(2)}
    return as_usage(frame.withColumns({**more, "service_tier": F.element_at(F.array(F.lit("batch"), F.lit("fast")), (F.col("seq") % 2 + 1).cast("int"))}))


def test_cells_price_sums_of_rows_as_rows(spark):
    usage = mixed_calls(spark)
    rows = pricing.add_costs(pricing.with_targets(spark, usage)).withColumns(pricing.repriced_costs())
    assert rows.select(pricing.is_long_prompt().alias("long")).distinct().count() > 2
    sums = ["cost_uncached", "cost_cache_read", "cost_cache_write", "cost_output", "cost_other", "cost_usd", "cost_on_current", "cost_on_cheaper"]
    slow = {"short_cost": F.when(cells.is_short_call(), F.col("cost_usd")).otherwise(0.0), "fp_cost_usd": F.when(cells.has_fingerprint(), F.col("cost_usd")).otherwise(0.0)}
    keys = ["granularity", "model_key", "service_tier"]
    expected = rows.withColumns(slow).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in [*sums, *slow]], F.count(F.lit(1)).alias("n_rows"))
    found = {tuple(r[k] for k in keys): r for r in cells.usage_cells(spark, usage).collect()}
    assert len(found) == expected.count()
    for r in expected.collect():
        cell = found[tuple(r[k] for k in keys)]
        for name in [*sums, *slow, "n_rows"]:
            assert cell[name] == pytest.approx(r[name]), (name, r)


def test_rows_are_summed_before_they_are_priced(spark):
    usage = mixed_calls(spark)
    traffic = cells.usage_traffic(spark, usage)
    assert "p_output" not in plan_of(traffic) and "p_input" not in plan_of(traffic)
    assert plan_of(cells.usage_cells(spark, usage)).count("HashAggregate") == 2 * plan_of(traffic).count("HashAggregate")


# ---- replay


def test_the_replay_builds_no_block_by_an_interpreted_function(spark):
    plan = plan_of(reuse.cache_replay(spark, mixed_calls(spark)))
    assert "lambdafunction" not in plan and "explode(arrays_zip" not in plan
