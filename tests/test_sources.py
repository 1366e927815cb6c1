import pytest
from conftest import MONDAY, claude_row, hours_file, report_file, tokens_row, vectors_row
from pyspark.sql import functions as F

from spendscope.functions import json_values as js
from spendscope.operators.pricing import priced_usage
from spendscope.plans.analysis import Analysis
from spendscope.sources import csv_usage, exports, request_log
from spendscope.sources.load import load_usage

CALL = {"timestamp": "2026-08-03T07:00:00Z", "model": "gpt-4.1-mini", "usage": {"prompt_tokens": 40, "completion_tokens": 6}}


def priced(spark, loaded):
    return priced_usage(spark, loaded.usage).collect()


def notes(loaded):
    return {(r.code, r.subject): r.n for r in loaded.notes.collect()}


# -- exports -----------------------------------------------------------------------------------------


def test_cached_input_is_taken_out_of_the_total(spark, put):
    loaded = load_usage(spark, put("x.json", hours_file(tokens_row("gpt-4o", 7_700, 430, hits=2_500, writes=200), hours=6)))
    (row,) = priced(spark, loaded)
    assert (row.uncached_input_tokens, row.cache_read_tokens, row.cache_write_tokens) == (5_000, 2_500, 200)
    assert (row.bucket_seconds, row.granularity, row.source, row.vendor) == (21_600, "bucket", "x.json", "openai")
    loaded.release()


def test_a_stated_uncached_count_is_kept(spark, put):
    row = tokens_row("gpt-4o", 900, hits=500, input_uncached_tokens=333)
    (got,) = load_usage(spark, put("x.json", [hours_file(row)])).usage.collect()
    assert (got.uncached_input_tokens, got.cache_read_tokens) == (333, 500)


def test_batch_costs_half(spark, put):
    rows = [tokens_row("gpt-4.1-mini", 800_000, batch=flag, project_id=str(flag)) for flag in (True, False)]
    cost = {r.service_tier: r.cost_usd for r in priced(spark, load_usage(spark, put("x.json", hours_file(*rows))))}
    assert 2 * cost["batch"] == pytest.approx(cost["standard"])


def test_foreign_results_in_a_usage_file_are_counted(spark, put):
    loaded = load_usage(spark, put("x.json", hours_file(tokens_row("gpt-4o", 3), vectors_row(8), vectors_row(9))))
    assert loaded.usage.count() == 1 and notes(loaded) == {("skipped_result", "organization.usage.embeddings.result"): 2}


def test_report_rows_price_cache_apart(spark, put):
    row = claude_row("claude-sonnet-4-5", 2_000, 300, cache_read_input_tokens=40_000, cache_creation={"ephemeral_1h_input_tokens": 5_000}, api_key_id="k9")
    (got,) = priced(spark, load_usage(spark, put("r.json", report_file(row, hours=2))))
    assert got.cost_usd == pytest.approx((2_000 * 3 + 40_000 * 0.3 + 5_000 * 6 + 300 * 15) / 1e6)
    assert (got.workload, got.bucket_seconds, got.requests) == ("k9", 7_200, 0) or got.requests is None


def test_us_rows_cost_a_tenth_more(spark, put):
    rows = [claude_row("claude-opus-5", 600_000, workspace_id=g, inference_geo=g) for g in ("us", "eu")]
    cost = {r.workload: r.cost_usd for r in priced(spark, load_usage(spark, put("r.json", report_file(*rows))))}
    assert cost["us"] / cost["eu"] == pytest.approx(1.1)


def test_long_context_and_searches(spark, put):
    rows = [claude_row("claude-opus-5", 0, context_window="200k-1M"), claude_row("claude-opus-5", 0, server_tool_use={"web_search_requests": 7})]
    loaded = load_usage(spark, put("r.json", report_file(*rows)))
    assert notes(loaded)[("long_context_window", None)] == 1
    assert sorted(r.cost_usd for r in priced(spark, loaded)) == pytest.approx([0, 0.07])


def test_invoices_in_dollars_and_in_cents(spark, put):
    files = [
        put("u.json", hours_file(tokens_row("gpt-4o", 1))),
        put("d.json", hours_file({"object": "organization.costs.result", "amount": {"value": "8.25", "currency": "usd"}, "line_item": "tokens"})),
        put("c.json", report_file({"amount": "61050.5", "currency": "USD", "description": "tokens"}, after=24)),
    ]
    invoice = {r.vendor: (str(r.date), r.amount_usd) for r in load_usage(spark, files).invoice.collect()}
    assert invoice == {"openai": ("2026-08-03", pytest.approx(8.25)), "anthropic": ("2026-08-04", pytest.approx(610.505))}


def test_embeddings_are_spend_but_no_lever_looks_at_them(spark, put):
    text, vectors = put("t.json", hours_file(tokens_row("gpt-4o", 4_000_000))), put("v.json", hours_file(vectors_row(90_000_000)))
    alone, both = (Analysis(spark, load_usage(spark, files).usage) for files in ([text], [text, vectors]))
    per_month = 90 * 0.13 * 30
    assert both.monthly_spend.first()[0] - alone.monthly_spend.first()[0] == pytest.approx(per_month)
    assert both.embedding_spend.first()["monthly_cost"] == pytest.approx(per_month)
    bases = [{r.lever: pytest.approx(r.base) for r in a.levers.collect()} for a in (alone, both)]
    assert bases[0] == bases[1]


def test_kind_goes_by_file_not_by_name(spark, put):
    """Files with one name in two folders: each is read as what it is, whichever is larger."""
    a = put("a/usage.json", hours_file(*[tokens_row("gpt-4o", 10)] * 3))
    b = put("b/usage.json", report_file(claude_row("claude-opus-5", 20)))
    got = load_usage(spark, [a, b])
    assert sorted((r.vendor, r.uncached_input_tokens) for r in got.usage.collect()) == [("anthropic", 20)] + [("openai", 10)] * 3
    assert notes(got) == {}
    kinds = exports.detect_kind(exports.read_pages(spark, [a, b])).collect()
    assert sorted((r.path.split("/")[-2], r.source, r.kind) for r in kinds) == [("a", "usage.json", "openai_usage"), ("b", "usage.json", "anthropic_usage")]


def test_kinds(spark, put):
    files = {
        "none.json": ({"data": []}, "empty"),
        "vectors.json": ([hours_file(), hours_file(vectors_row(1), tokens_row("gpt-4o", 1))], "openai_embeddings"),
        "bill.json": (report_file({"amount": "1", "currency": "USD"}), "anthropic_costs"),
        "what.json": (report_file({"colour": "red"}), "unknown"),
    }
    pages = exports.read_pages(spark, [put(n, c) for n, (c, _) in files.items()])
    assert {r.source: r.kind for r in exports.detect_kind(pages).collect()} == {n: k for n, (_, k) in files.items()}
    with pytest.raises(ValueError, match="what.json"):
        load_usage(spark, put("what.json", files["what.json"][0]))
    with pytest.raises(ValueError, match="No usage rows"):
        load_usage(spark, put("none.json", {"data": []}))


# -- nothing is read as 0 or NULL without a word ------------------------------------------------------


@pytest.mark.parametrize("written", [1000, 1000.0, "1000", "1000.0", 1e3])
def test_whole_numbers_in_any_spelling(spark, put, written):
    rows = tokens_row("gpt-4o", written), claude_row("claude-opus-5", written)
    files = [put("o.json", hours_file(rows[0])), put("r.json", report_file(rows[1]))]
    line = CALL | {"usage": {"prompt_tokens": written, "completion_tokens": written}}
    got = load_usage(spark, files, logs_jsonl=put("l.jsonl", [line])).usage.collect()
    assert [r.uncached_input_tokens for r in got] == [1000] * 3


@pytest.mark.parametrize("written", ["n/a", "12 tokens", "NaN", [3], {"n": 3}])
def test_unreadable_numbers_stop_the_load(spark, put, written):
    with pytest.raises(Exception, match="unreadable number"):
        load_usage(spark, put("o.json", hours_file(tokens_row("gpt-4o", 5, out=written))))
    with pytest.raises(Exception, match="unreadable number"):
        load_usage(spark, logs_jsonl=put("l.jsonl", [CALL | {"usage": {"prompt_tokens": 1, "completion_tokens": written}}]))


def test_unreadable_amounts_stop_the_load(spark, put):
    use, bad = put("u.json", hours_file(tokens_row("gpt-4o", 1))), put("c.json", report_file({"amount": "ten", "currency": "USD"}))
    with pytest.raises(Exception, match="unreadable amount"):
        load_usage(spark, [use, bad]).invoice.collect()


@pytest.mark.parametrize("when", ["yesterday", "", None, {"at": 1}])
def test_unreadable_timestamps_stop_the_load(spark, put, when):
    with pytest.raises(Exception, match="unreadable timestamp"):
        load_usage(spark, logs_jsonl=put("l.jsonl", [CALL, CALL | {"timestamp": when}]))


def test_a_broken_export_stops_the_load(spark, put):
    good, page = put("a.json", hours_file(tokens_row("gpt-4o", 1))), '{"data": [{"start_time": 1786000000, "end_'
    with pytest.raises(Exception, match="(?i)malformed"):
        load_usage(spark, [good, put("broken.json", page)]).usage.collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        texts = spark.createDataFrame([("s", 1, page)], "source string, page_seq long, page string")
        exports.results(exports.pages_from_text(texts)).collect()


def test_moments_and_numbers(spark):
    df = spark.createDataFrame([("1785715200",), ("2026-08-03T02:00:00+02:00",), ("1785715200.25",)], "t string")
    seconds = [r[0] for r in df.select(js.moment(F.col("t")).cast("double")).collect()]
    assert seconds == [MONDAY.timestamp(), MONDAY.timestamp(), MONDAY.timestamp() + 0.25]
    texts = spark.createDataFrame([("",), (None,), ("9007199254740993",), ("-2",)], "t string")
    assert [r[0] for r in texts.select(js.whole(F.col("t"), "x")).collect()] == [0, 0, 9007199254740993, -2]


# -- request logs ------------------------------------------------------------------------------------


def test_a_log_line_counts_by_its_sample_rate(spark, put):
    lines = [CALL | {"sample_rate": 0.25}, "   ", CALL | {"timestamp": MONDAY.timestamp() + 11, "status": 429, "sample_rate": 0}, {"model": "gpt-4o"}, "no JSON {"]
    loaded = load_usage(spark, logs_jsonl=put("l.jsonl", lines))
    first, second = sorted(priced(spark, loaded), key=lambda r: r.seq)
    assert first.cost_usd == pytest.approx(4 * second.cost_usd) and (first.weight, second.weight) == (4, 1)
    assert (second.status, second.status_type, second.timestamp.second) == ("429", "number", 11)
    assert notes(loaded) == {("log_line_without_usage", None): 1, ("invalid_json", None): 1}


def test_long_prompts_cost_more(spark, put):
    lines = [CALL | {"model": "gpt-5.4", "usage": {"prompt_tokens": n, "completion_tokens": 2_000}} for n in (100_000, 400_000)]
    short, long = sorted(r.cost_usd for r in priced(spark, load_usage(spark, logs_jsonl=put("l.jsonl", lines))))
    assert short == pytest.approx((100_000 * 2.5 + 2_000 * 15) / 1e6) and long == pytest.approx((400_000 * 5 + 2_000 * 22.5) / 1e6)


SHAPES = {
    "chat": ({"prompt_tokens": 911, "completion_tokens": 77, "prompt_tokens_details": {"cached_tokens": 640, "cache_write_tokens": 11},
              "completion_tokens_details": {"reasoning_tokens": 30}}, (260, 640, 11, 0, 77, 30)),
    "responses": ({"input_tokens": 815, "output_tokens": 64, "input_tokens_details": {"cached_tokens": 900}, "output_tokens_details": {"reasoning_tokens": 9}},
                  (0, 900, 0, 0, 64, 9)),
    "anthropic": ({"input_tokens": 17, "output_tokens": 23, "cache_read_input_tokens": 410, "cache_creation_input_tokens": 99,
                   "cache_creation": {"ephemeral_5m_input_tokens": 60, "ephemeral_1h_input_tokens": 39}, "output_tokens_details": {"thinking_tokens": 4}},
                  (17, 410, 60, 39, 23, 4)),
    "anthropic_sum": ({"input_tokens": 17, "cache_creation_input_tokens": 99, "cache_creation": {}}, (17, 0, 99, 0, 0, 0)),
    "null_key": ({"prompt_tokens": None, "input_tokens": 55, "completion_tokens": 3}, (0, 0, 0, 0, 3, 0)),
}


def test_usage_shapes(spark, put):
    lines = [{"timestamp": 1, "workload": n, "model": "claude-opus-5" if n.startswith("anth") else "gpt-4o", "usage": u} for n, (u, _) in SHAPES.items()]
    columns = ["uncached_input_tokens", "cache_read_tokens", "cache_write_tokens", "cache_write_1h_tokens", "output_tokens", "reasoning_tokens"]
    got = load_usage(spark, logs_jsonl=put("l.jsonl", lines)).usage.select("workload", *columns).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {n: want for n, (_, want) in SHAPES.items()}


def test_eval_files_are_told_by_their_path(spark, put):
    """A log and an eval file with one name: the log stays, in whichever order they come."""
    many = [{"id": i, "checks": []} for i in range(9)]
    for first, second in (("l1", "l2"), ("l2", "l1")):
        paths = [put(f"{first}/part-0.jsonl", many), put(f"{second}/part-0.jsonl", [CALL, "oops"]), put("out.jsonl", ["", {"id": 1, "output": "x"}, CALL])]
        loaded = load_usage(spark, logs_jsonl=paths)
        assert loaded.usage.count() == 1 and notes(loaded) == {("invalid_json", None): 1}


def test_bad_lines_are_numbered_by_file(spark, put):
    a, b = put("a/e.jsonl", ["{}", "", "{x", "{}", "y"]), put("b/e.jsonl", ["z", "{}"])
    got = request_log.numbered_bad_lines(request_log.read_lines(spark, [a, b])).collect()
    assert sorted((r.path.split("/")[-2], r.source, r.line_no) for r in got) == [("a", "e.jsonl", 3), ("a", "e.jsonl", 5), ("b", "e.jsonl", 1)]


def test_bad_line_numbers_across_splits(spark, put):
    path = put("big.jsonl", ["?" if i % 41 == 0 else '{"filler": "' + "f" * 150 + '"}' for i in range(1, 500)])
    settings = {"spark.sql.files.maxPartitionBytes": "9000", "spark.sql.files.openCostInBytes": "500"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        lines = request_log.read_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 3
        assert sorted(r.line_no for r in request_log.numbered_bad_lines(lines).collect()) == list(range(41, 500, 41))
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_models_without_a_price(spark, put):
    loaded = load_usage(spark, put("x.json", hours_file(tokens_row("in-house-7b", 10), tokens_row(None, 10), tokens_row("", 10))))
    assert not any(r.priced for r in priced(spark, loaded))
    assert notes(loaded) == {("unknown_model", "in-house-7b"): 1, ("rows_without_model", None): 2}


# -- CSV ---------------------------------------------------------------------------------------------


def test_csv_files_are_read_by_their_own_headers(spark, put):
    one = put("m/1.csv", "timestamp,model,uncached_input_tokens,output_tokens\n2026-08-03T00:00:00Z,gpt-4o,700,30\n")
    two = put("m/2.csv", "model,output_tokens,timestamp,uncached_input_tokens,vendor\nclaude-opus-5,4,2026-08-04,50,\ngpt-4o,1e1,1785801600,,azure\n")
    rows = load_usage(spark, usage_csv=[one, two]).usage.collect()
    assert sorted((r.model, r.vendor, r.uncached_input_tokens, r.output_tokens) for r in rows) == [
        ("claude-opus-5", "anthropic", 50, 4), ("gpt-4o", "azure", 0, 10), ("gpt-4o", "openai", 700, 30),
    ]
    assert len({r.seq for r in rows}) == 3 and {str(r.timestamp) for r in rows} == {"2026-08-03 00:00:00", "2026-08-04 00:00:00"}
    assert {(r.granularity, r.workload, r.weight) for r in rows} == {("bucket", "all", 1.0)}


def test_csv_errors(spark, put):
    with pytest.raises(ValueError, match="uncached_input_tokens"):
        csv_usage.read_usage_csv(spark, put("short.csv", "timestamp,model,output_tokens\n"))
    for cell, what in (("later,gpt-4o,1,1", "unreadable timestamp"), ("2026-08-03,gpt-4o,many,1", "unreadable number")):
        with pytest.raises(Exception, match=what):
            load_usage(spark, usage_csv=put("bad.csv", f"timestamp,model,uncached_input_tokens,output_tokens\n{cell}\n"))


def test_lines_are_parsed_once(spark, put):
    """The usage table is written once; what reads it doesn't see a line of the log again."""
    loaded = load_usage(spark, logs_jsonl=put("l.jsonl", [CALL] * 3))
    plan = loaded.usage._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "parse_json" not in plan and "Python" not in plan
    loaded.release()
