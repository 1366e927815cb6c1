"""The given tables as raw input: vendor export pages, log lines, CSV cells, prompts and eval sets.

One page per ``lineitem`` row, one line per ``events`` row, one prompt per document or turn: narrow
projections over whole tables and whole texts, so nothing is collected into groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.adapters import LOG_MODELS, pick, table
from spendscope.operators.evals import CHECK_TYPE

EXPORT_MODELS = ["gpt-4o-2024-08-06", "gpt-5.4-2026-03-05", ""]
CLAUDE_MODELS = ["claude-opus-5", "claude-sonnet-4-5-20250929", "claude-opus-4-1-20250805"]


def struct_json(fields: dict[str, str]) -> str:
    """SQL text: a JSON object; NULL fields are left out."""
    return "to_json(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + "))"


def joined(*parts: str) -> str:
    """SQL text: literals (in backticks-free quotes) and expressions glued together."""
    return "concat(" + ", ".join(parts) + ")"


def _openai_page(*found: str) -> str:
    head = joined("'{\"data\":[{\"start_time\":'", "start_s", "',\"end_time\":'", "start_s + 3600", "',\"results\":['")
    body = ", ',', ".join(found)
    return joined(head, body, "']}]}'")


def _report_page(*found: str) -> str:
    head = joined("'{\"data\":[{\"starting_at\":\"'", "iso_start", "'\",\"ending_at\":\"'", "iso_end", "'\",\"results\":['")
    return joined(head, ", ',', ".join(found), "']}]}'")


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = "yyyy-MM-dd''T''HH:mm:ss''Z''"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "*",
        "CAST(l_quantity AS BIGINT) AS quantity",
        "unix_timestamp(CAST(l_shipdate AS TIMESTAMP)) AS start_s",
        f"date_format(l_shipdate, '{iso}') AS iso_start",
        f"date_format(l_shipdate + INTERVAL '1' HOUR, '{iso}') AS iso_end",
    )


def _completion() -> str:
    return struct_json(
        {
            "object": "'organization.usage.completions.result'",
            "input_tokens": "quantity * 1000",
            "input_cached_tokens": "CASE WHEN l_linenumber >= 2 THEN quantity * 300 END",
            "input_cache_write_tokens": "CASE WHEN l_linenumber >= 3 THEN quantity * 100 END",
            "input_uncached_tokens": "CASE WHEN l_linenumber >= 4 THEN quantity * 550 END",
            "output_tokens": "quantity * 10",
            "num_model_requests": "l_linenumber",
            "model": pick(EXPORT_MODELS, "l_partkey % 3"),
            "project_id": "CASE l_suppkey % 4 WHEN 0 THEN concat('proj_', l_suppkey) WHEN 1 THEN '' END",
            "api_key_id": "CASE WHEN l_suppkey % 4 = 2 THEN concat('key_', l_suppkey) END",
            "user_id": "CASE WHEN l_suppkey % 4 = 1 THEN concat('user_', l_suppkey) END",
            "batch": "l_returnflag = 'R'",
            "service_tier": "CASE l_linenumber WHEN 1 THEN 'default' WHEN 2 THEN 'auto' WHEN 3 THEN 'Priority'"
            " WHEN 4 THEN 'flex' END",
        }
    )


def _embedding() -> str:
    return struct_json(
        {
            "object": "'organization.usage.embeddings.result'",
            "input_tokens": "quantity * 7",
            "num_model_requests": "1",
            "model": "'text-embedding-3-small'",
            "project_id": "CASE WHEN l_suppkey % 4 = 0 THEN concat('proj_', l_suppkey) END",
        }
    )


def _openai_cost() -> str:
    amount = "named_struct('value', l_extendedprice, 'currency', 'usd')"
    return struct_json({"object": "'organization.costs.result'", "amount": amount, "line_item": "l_linestatus"})


def _message_usage() -> str:
    return struct_json(
        {
            "uncached_input_tokens": "quantity * 1000",
            "cache_read_input_tokens": "quantity * 200",
            "cache_creation": "named_struct('ephemeral_5m_input_tokens', quantity * 30,"
            " 'ephemeral_1h_input_tokens', quantity * 5)",
            "output_tokens": "quantity * 20",
            "server_tool_use": "CASE WHEN l_linenumber = 2 THEN named_struct('web_search_requests', l_linenumber) END",
            "model": pick(CLAUDE_MODELS, "l_partkey % 3"),
            "workspace_id": "CASE l_suppkey % 3 WHEN 0 THEN concat('wrkspc_', l_suppkey) WHEN 1 THEN '' END",
            "api_key_id": "CASE WHEN l_suppkey % 3 = 1 THEN concat('key_', l_suppkey) END",
            "service_tier": "CASE l_linenumber WHEN 1 THEN 'priority_on_demand' WHEN 3 THEN 'flex_discount' WHEN 4"
            " THEN 'Batch' END",
            "speed": "CASE WHEN l_returnflag = 'R' THEN 'fast' END",
            "context_window": "CASE WHEN l_quantity > 40 THEN '200k-1M' ELSE '0-200k' END",
            "inference_geo": "CASE WHEN l_linestatus = 'O' THEN 'us' ELSE 'global' END",
        }
    )


def _claude_cost() -> str:
    cents = "CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS STRING)"
    return struct_json({"amount": cents, "currency": "'USD'", "description": "l_returnflag"})


def _pages(items: DataFrame, source: str, page: str) -> DataFrame:
    return items.selectExpr(f"{source} AS source", "l_orderkey AS page_seq", f"{page} AS page")


def openai_usage_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(_line_items(spark, sf_dir), "'openai_usage.json'", _openai_page(_completion(), _embedding()))


def openai_cost_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(_line_items(spark, sf_dir), "'openai_costs.json'", _openai_page(_openai_cost()))


def anthropic_usage_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(_line_items(spark, sf_dir), "'anthropic_usage.json'", _report_page(_message_usage()))


def anthropic_cost_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(_line_items(spark, sf_dir), "'anthropic_costs.json'", _report_page(_claude_cost()))


def mixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per supplier, of every kind; some sources and some pages hold no results."""
    other = """'{"other":1}'"""
    page = f"""CASE
        WHEN l_linenumber = 1 OR l_suppkey % 7 = 0 THEN '{{"data":[]}}'
        WHEN l_suppkey % 7 = 1 THEN {_openai_page(_completion(), _embedding())}
        WHEN l_suppkey % 7 = 2 THEN {_openai_page(_embedding(), _completion())}
        WHEN l_suppkey % 7 = 3 THEN {_openai_page(_openai_cost())}
        WHEN l_suppkey % 7 = 4 THEN {_report_page(_message_usage())}
        WHEN l_suppkey % 7 = 5 THEN {_report_page(_claude_cost())}
        ELSE {_openai_page(other)} END"""
    return _pages(_line_items(spark, sf_dir), "concat('file_', l_suppkey, '.json')", page)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, seq, line) from ``events``: three usage shapes, errors without usage, mixed status types."""
    base = table(spark, sf_dir, "events").selectExpr(
        "*", "user_id % 8 AS slot", "CAST(floor(value * 100) AS BIGINT) AS tokens", "CAST(ts AS TIMESTAMP) AS at"
    )
    chat = struct_json(
        {
            "prompt_tokens": "tokens",
            "completion_tokens": "CAST(floor(value) AS BIGINT)",
            "prompt_tokens_details": "named_struct('cached_tokens', tokens DIV 2, 'cache_write_tokens', tokens DIV 10)",
            "completion_tokens_details": "named_struct('reasoning_tokens', CAST(floor(value / 2) AS BIGINT))",
        }
    )
    messages = struct_json(
        {
            "input_tokens": "tokens",
            "output_tokens": "CAST(floor(value) AS BIGINT)",
            "cache_read_input_tokens": "tokens DIV 4",
            "cache_creation_input_tokens": "tokens DIV 5",
            "cache_creation": "CASE WHEN event_id % 2 = 0 THEN named_struct('ephemeral_5m_input_tokens', tokens DIV 8,"
            " 'ephemeral_1h_input_tokens', tokens DIV 16) END",
            "output_tokens_details": "named_struct('thinking_tokens', 3)",
            "server_tool_use": "named_struct('web_search_requests', event_id % 3)",
            "inference_geo": "CASE WHEN event_id % 7 = 0 THEN 'us' END",
            "service_tier": "'standard'",
        }
    )
    responses = struct_json(
        {
            "input_tokens": "tokens",
            "output_tokens": "CAST(floor(value) AS BIGINT)",
            "input_tokens_details": "named_struct('cached_tokens', tokens * 2)",
            "output_tokens_details": "named_struct('reasoning_tokens', 1)",
        }
    )
    # The shape follows the model: slots 4 and 5 are Messages, even slots Chat Completions, the rest Responses.
    usage = f"CASE WHEN slot IN (4, 5) THEN {messages} WHEN slot % 2 = 0 THEN {chat} ELSE {responses} END"
    instant = "CASE WHEN event_id % 2 = 0 THEN concat('\"', date_format(at, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), 'Z\"')"
    instant += " ELSE CAST(unix_timestamp(at) AS STRING) END"
    status = "CASE event_id % 5 WHEN 0 THEN '500' WHEN 1 THEN '\"500\"' WHEN 2 THEN '\"Timeout\"' WHEN 3 THEN '200' ELSE 'null' END"
    rest = struct_json(
        {
            "model": pick(LOG_MODELS, "slot"),
            "vendor": "CASE WHEN slot = 6 THEN 'bedrock' END",
            "workload": "CASE WHEN event_type = 'view' THEN '' ELSE event_type END",
            "feature": "CASE WHEN event_type = 'view' THEN 'browse' END",
            "service_tier": "CASE WHEN event_id % 20 < 3 THEN 'priority' END",
            "batch": "event_id % 11 = 0",
            "speed": "CASE WHEN event_id % 13 = 0 THEN 'fast' END",
            "sample_rate": "CASE WHEN user_id % 2 = 0 THEN 0.5D END",
            "fingerprint": "named_struct('request_hash', concat(user_id, '-', event_id % 10),"
            " 'prefix_hashes', array('sys', concat('sys/', event_type)), 'prefix_chars', array(8000L, 12000L))",
        }
    )
    head = joined("'{\"timestamp\":'", instant, "',\"status\":'", status)
    tail = joined("','", f"substr({rest}, 2)")
    with_usage = joined(head, "',\"usage\":'", usage, tail)
    line = f"CASE WHEN event_type = 'error' THEN {joined(head, tail)} ELSE {with_usage} END"
    return base.selectExpr("'log.jsonl' AS source", "event_id AS seq", f"{line} AS line")


def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as CSV text cells: blank vendors, granularities and token counts, no other columns."""
    return table(spark, sf_dir, "events").selectExpr(
        'date_format(ts, "yyyy-MM-dd\'T\'HH:mm:ss.SSSSSS") AS timestamp',
        f"{pick(LOG_MODELS, 'user_id % 8')} AS model",
        "CASE WHEN event_type <> 'view' THEN CAST(CAST(floor(value) AS BIGINT) AS STRING) END AS uncached_input_tokens",
        "CAST(event_id AS STRING) AS output_tokens",
        "CASE WHEN event_type = 'click' THEN 'azure' END AS vendor",
        "CASE WHEN event_type = 'signup' THEN 'request' END AS granularity",
        "CASE WHEN event_type <> 'signup' THEN 'Flex' END AS service_tier",
        "CASE WHEN event_type = 'error' THEN 'failed' ELSE '200' END AS status",
        "'usage.csv' AS source",
        "event_id AS seq",
    )


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of the files named by ``source``; the language decides what a line looks like."""
    line = """CASE lang
        WHEN 'en' THEN concat('{"usage":{"prompt_tokens":', n_chars, '}}')
        WHEN 'de' THEN to_json(named_struct('id', doc_id, 'output', text))
        WHEN 'fr' THEN to_json(named_struct('id', doc_id, 'input', text, 'checks', array()))
        ELSE to_json(named_struct('output', text, 'usage', named_struct('prompt_tokens', n_chars))) END"""
    return table(spark, sf_dir, "documents").selectExpr("source", "doc_id AS seq", f"{line} AS line")


def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation files: turns are lines, and a system turn is written as bare text."""
    line = "CASE WHEN role = 'system' THEN text ELSE to_json(named_struct('id', turn, 'output', text)) END"
    return table(spark, sf_dir, "conversations").selectExpr(
        "CAST(conv_id AS STRING) AS source", "0L AS split_start", "turn AS seq", f"{line} AS line"
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, seq, rec) log records with a raw request body.

    A document becomes a Messages request whose user content has one part per line; a turn becomes a
    Responses request with a plain string input.
    """
    documents = table(spark, sf_dir, "documents").selectExpr(
        "concat('doc_', doc_id) AS source",
        "doc_id AS seq",
        """to_json(named_struct(
            'timestamp', '2024-01-01T00:00:00Z', 'response', text, 'usage', named_struct('input_tokens', n_chars),
            'request', named_struct(
                'model', 'claude-opus-5', 'stream', true, 'metadata', named_struct('doc', doc_id),
                'tools', array(named_struct('name', concat('lookup_', lang))),
                'system', array(named_struct('text', concat('Policy of ', source), 'type', 'text')),
                'messages', array(named_struct('role', 'user', 'content',
                    transform(split(text, '\\n'), t -> named_struct('text', t, 'type', 'text'))))))) AS line""",
    )
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "concat('turn_', conv_id, '_', turn) AS source",
        "turn AS seq",
        """to_json(named_struct(
            'timestamp', '2024-01-01T00:00:00Z', 'output', text,
            'request', named_struct('model', 'gpt-5.4', 'user', role, 'instructions', concat('You answer a ', role),
                'input', text))) AS line""",
    )
    return documents.unionByName(turns).withColumn("rec", F.parse_json("line"))


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per document, over its whole text; the five check kinds take turns."""
    words, spaced = "split(text, ' ')", "concat('  ', replace(text, ' ', '   '), ' ')"
    check = f"""CASE doc_id % 5
        WHEN 0 THEN named_struct('kind', 'exact', 'field', NULL, 'value', {spaced}, 'values', array({spaced}))
        WHEN 1 THEN named_struct('kind', 'contains', 'field', NULL, 'value', element_at({words}, -1),
            'values', array(element_at({words}, -1)))
        WHEN 2 THEN named_struct('kind', 'contains_all', 'field', NULL, 'value', NULL,
            'values', array({words}[0], element_at({words}, -1)))
        WHEN 3 THEN named_struct('kind', 'one_of', 'field', NULL, 'value', NULL, 'values', array('other', text))
        ELSE named_struct('kind', 'json_field', 'field', 'source', 'value', source, 'values', array(source)) END"""
    return table(spark, sf_dir, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS id", "lang AS workload", "doc_id AS seq", f"CAST(array({check}) AS {CHECK_TYPE}) AS checks"
    )


def baseline_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = "CASE WHEN doc_id % 5 = 4 THEN to_json(named_struct('source', source, 'text', text)) ELSE text END"
    return table(spark, sf_dir, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS id", f"{output} AS output", "'gpt-4o' AS model", "doc_id AS seq"
    )


def candidate_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate refuses toxic documents and gets low-quality ones wrong."""
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    output = """CASE
        WHEN quality = 0 AND doc_id % 5 = 4 THEN '{"source":"other"}'
        WHEN quality = 0 THEN reverse(text)
        WHEN doc_id % 5 = 4 THEN to_json(named_struct('source', source, 'text', text)) ELSE text END"""
    return labelled.filter("coalesce(toxic, 0) <> 1").selectExpr(
        "CAST(doc_id AS STRING) AS id", f"{output} AS output", "'gpt-6.1-sol' AS model", "doc_id AS seq"
    )


def invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines out of ``orders``, independent of the usage: days that usage lacks, usage days that it lacks, a
    vendor without usage, and one that is invoiced nothing."""
    vendor = "CASE o_orderkey % 5 WHEN 3 THEN 'mistral' WHEN 4 THEN 'anthropic' ELSE 'openai' END"
    lines = table(spark, sf_dir, "orders").filter("day(o_orderdate) <> 13").selectExpr(
        "CAST(o_orderdate AS DATE) AS date", f"{vendor} AS vendor", "o_orderpriority AS line_item", "o_totalprice / 1000 AS amount_usd", "'invoice' AS source"
    )
    return lines.unionByName(lines.selectExpr("date", "'cohere' AS vendor", "line_item", "0D AS amount_usd", "source"))
