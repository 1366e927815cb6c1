"""Reference results in plain SQL: shared sub-selects, and one statement per registered query."""

from __future__ import annotations

import re

from oracle.price_list import TOKENIZER_SCALE, price_values

SALT = b"fixed salt for repeatable checks"


def _scale_values() -> str:
    rows = ", ".join(f"('{n}', CAST({s} AS DOUBLE))" for n, s in TOKENIZER_SCALE.items())
    return f"SELECT * FROM (VALUES {rows}) AS v(tokenizer, token_scale)"


LOG_MODEL = """CASE user_id % 8 WHEN 0 THEN 'gpt-5.4-2026-03-05' WHEN 1 THEN 'gpt-4o-2024-08-06'
  WHEN 2 THEN 'gpt-5-mini-2025-08-07' WHEN 3 THEN 'gpt-6-astra' WHEN 4 THEN 'claude-sonnet-4-5-20250929'
  WHEN 5 THEN 'claude-opus-4-1-20250805' WHEN 6 THEN 'anthropic.claude-haiku-4-5-20251001-v1:0' ELSE 'my-finetune' END"""
INFERRED_VENDOR = "CASE WHEN lower(model) LIKE 'claude%' THEN 'anthropic' ELSE 'openai' END"
OPENAI_TIER = """CASE WHEN {batch} THEN 'batch' ELSE CASE lower(coalesce(nullif({tier}, ''), 'standard'))
  WHEN 'default' THEN 'standard' WHEN 'auto' THEN 'standard' WHEN 'priority' THEN 'fast'
  ELSE lower(coalesce(nullif({tier}, ''), 'standard')) END END"""
ANTHROPIC_TIER = """CASE WHEN lower(coalesce({speed}, '')) = 'fast' THEN 'fast' ELSE
  CASE lower(coalesce(nullif({tier}, ''), 'standard')) WHEN 'priority_on_demand' THEN 'priority'
  WHEN 'flex_discount' THEN 'flex' ELSE lower(coalesce(nullif({tier}, ''), 'standard')) END END"""


def _costs(p: str, ratio: str) -> str:
    """Four cost parts on the price columns of alias ``p`` (input, read, write, output)."""
    tier = (
        f"(CASE WHEN r.service_tier = 'batch' THEN {p}.batch_mult WHEN r.service_tier = 'flex' AND {p}.price_vendor = 'openai'"
        f" THEN {p}.batch_mult WHEN r.service_tier = 'fast' AND {p}.fast_mult IS NOT NULL THEN {p}.fast_mult ELSE 1.0::DOUBLE END)"
    )
    base = f"({tier} * r.weight * CASE WHEN r.inference_geo = 'us' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END)"
    long = f"(r.granularity = 'request' AND r.total_input * {ratio} > {p}.long_threshold)"
    in_s = f"({base} * CASE WHEN {long} THEN {p}.long_in ELSE 1.0::DOUBLE END)"
    out_s = f"({base} * CASE WHEN {long} THEN {p}.long_out ELSE 1.0::DOUBLE END)"
    unit = f"({ratio} / 1e6::DOUBLE)"
    return f"""
  r.uncached_input_tokens * {p}.p_input * {unit} * {in_s} AS c_uncached,
  r.cache_read_tokens * {p}.p_cached * {unit} * {in_s} AS c_read,
  (r.cache_write_tokens * {p}.p_write + r.cache_write_1h_tokens * coalesce({p}.p_write_1h, {p}.p_write)) * {unit} * {in_s} AS c_write,
  r.output_tokens * {p}.p_output * {unit} * {out_s} AS c_output, {in_s} AS in_scale, {out_s} AS out_scale"""


CTES: dict[str, str] = {
    "prices": price_values(),
    "scales": _scale_values(),
    # successor chains, followed one hop at a time
    "chain": """SELECT model_key, model_key AS at_model, 0 AS hops FROM prices
      UNION ALL SELECT c.model_key, p.successor, c.hops + 1 FROM chain c JOIN prices p ON p.model_key = c.at_model
      WHERE p.successor IS NOT NULL AND c.hops < 20""",
    "targets": """SELECT p.model_key, p.successor, cur.model_key AS current_model, cheap.model_key AS cheaper_model,
        sc.token_scale / sp.token_scale AS cur_ratio, sh.token_scale / sp.token_scale AS cheap_ratio
      FROM prices p JOIN (SELECT model_key, arg_max(at_model, hops) AS last FROM chain GROUP BY 1) e USING (model_key)
      JOIN prices cur ON cur.model_key = e.last LEFT JOIN prices cheap ON cheap.model_key = cur.cheaper_tier
      JOIN scales sp ON sp.tokenizer = p.tokenizer JOIN scales sc ON sc.tokenizer = cur.tokenizer
      LEFT JOIN scales sh ON sh.tokenizer = cheap.tokenizer""",
    "log_rows": f"""SELECT ts AS timestamp, 0::BIGINT AS bucket_seconds, 'request' AS granularity,
        CASE user_id % 8 WHEN 4 THEN 'anthropic' WHEN 5 THEN 'anthropic' WHEN 6 THEN 'bedrock' ELSE 'openai' END AS vendor,
        {LOG_MODEL} AS model, event_type AS workload, 'chat' AS product,
        CASE event_id % 20 WHEN 0 THEN 'batch' WHEN 1 THEN 'fast' WHEN 2 THEN 'priority' ELSE 'standard' END AS service_tier,
        CASE WHEN user_id % 8 = 4 AND event_id % 7 = 0 THEN 'us' END AS inference_geo, 1::BIGINT AS requests,
        CAST(floor(value * CASE WHEN event_type = 'signup' THEN 20 ELSE 1000 END) AS BIGINT) AS uncached_input_tokens,
        CASE WHEN event_id % 3 = 0 THEN CAST(floor(value * 50) AS BIGINT) ELSE 0 END AS cache_read_tokens,
        CASE WHEN event_id % 5 = 0 THEN CAST(floor(value * 20) AS BIGINT) ELSE 0 END AS cache_write_tokens,
        CASE WHEN user_id % 8 = 5 THEN CAST(floor(value * 10) AS BIGINT) ELSE 0 END AS cache_write_1h_tokens,
        20 + CAST(floor(value * 4) AS BIGINT) AS output_tokens,
        CAST(floor((20 + CAST(floor(value * 4) AS BIGINT)) * (event_id % 10) / 10.0::DOUBLE) AS BIGINT) AS reasoning_tokens,
        CASE WHEN event_id % 50 = 0 THEN 3 ELSE 0 END::BIGINT AS web_search_requests,
        CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight,
        user_id || '-' || (event_id % 10) AS request_hash, event_type, user_id,
        event_type = 'error' AND event_id % 4 = 0 AS is_failed, 'events' AS source, event_id AS seq FROM events""",
    "bucket_rows": """SELECT l_shipdate + to_hours(CASE WHEN l_suppkey % 4 = 0 THEN 1 + l_linenumber % 2 ELSE l_orderkey % 24 END) AS timestamp,
        3600::BIGINT AS bucket_seconds, 'bucket' AS granularity,
        CASE WHEN l_partkey % 8 IN (3, 4, 5) THEN 'anthropic' ELSE 'openai' END AS vendor,
        CASE l_partkey % 8 WHEN 0 THEN 'gpt-5.4-2026-03-05' WHEN 1 THEN 'gpt-4o-2024-08-06' WHEN 2 THEN 'gpt-5.6'
          WHEN 3 THEN 'claude-opus-4-1-20250805' WHEN 4 THEN 'claude-sonnet-4-5-20250929' WHEN 5 THEN 'claude-opus-5'
          WHEN 6 THEN 'text-embedding-3-small' ELSE 'my-finetune' END AS model,
        'ws_' || (l_suppkey % 4) AS workload, CASE WHEN l_partkey % 8 = 6 THEN 'embedding' ELSE 'chat' END AS product,
        CASE l_orderkey % 20 WHEN 0 THEN 'batch' WHEN 1 THEN 'fast' ELSE 'standard' END AS service_tier,
        NULL::VARCHAR AS inference_geo,
        CASE WHEN l_partkey % 8 IN (3, 4, 5) THEN NULL ELSE l_linenumber * 10 END::BIGINT AS requests,
        CAST(l_quantity AS BIGINT) * 100000 AS uncached_input_tokens,
        CASE WHEN l_partkey % 8 <> 6 AND l_linenumber = 2 THEN CAST(l_quantity AS BIGINT) * 20000 ELSE 0 END AS cache_read_tokens,
        0::BIGINT AS cache_write_tokens, 0::BIGINT AS cache_write_1h_tokens,
        CASE WHEN l_partkey % 8 = 6 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 5000 END AS output_tokens,
        0::BIGINT AS reasoning_tokens, 0::BIGINT AS web_search_requests, 1.0::DOUBLE AS weight, NULL::VARCHAR AS request_hash,
        NULL::VARCHAR AS event_type, NULL::BIGINT AS user_id, false AS is_failed, 'lineitem' AS source, NULL::BIGINT AS seq
      FROM lineitem""",
    "raw_rows": "SELECT * FROM log_rows UNION ALL SELECT * FROM bucket_rows",
    "keyed": r"""SELECT *, uncached_input_tokens + cache_read_tokens + cache_write_tokens + cache_write_1h_tokens AS total_input,
        CASE WHEN bare = 'gpt-5.6' THEN 'gpt-5.6-sol' ELSE bare END AS model_key
      FROM (SELECT *, regexp_replace(regexp_replace(lower(model), '^(openai|anthropic|us\.anthropic|eu\.anthropic|global\.anthropic)[./]', ''),
          '(-\d{4}-\d{2}-\d{2}|-\d{8}|@\d{8}|-v\d+(:\d+)?)+$', '') AS bare FROM raw_rows)""",
    "own": f"SELECT r.*, p.p_input IS NOT NULL AS priced, {_costs('p', '1.0::DOUBLE')} FROM keyed r LEFT JOIN prices p USING (model_key)",
    "on_cur": f"""SELECT r.*, t.current_model, t.cheaper_model, t.cur_ratio, t.cheap_ratio, {_costs('p', 't.cur_ratio')}
      FROM keyed r JOIN targets t USING (model_key) JOIN prices p ON p.model_key = t.current_model""",
    "on_cheap": f"""SELECT r.*, {_costs('p', 't.cheap_ratio')}
      FROM keyed r JOIN targets t USING (model_key) JOIN prices p ON p.model_key = t.cheaper_model""",
    "costed": """SELECT * EXCLUDE (c_uncached, c_read, c_write, c_output), coalesce(c_uncached, 0) AS cost_uncached,
        coalesce(c_read, 0) AS cost_cache_read, coalesce(c_write, 0) AS cost_cache_write, coalesce(c_output, 0) AS cost_output,
        web_search_requests * weight * 10.0::DOUBLE / 1000 AS cost_other FROM own""",
    "priced_rows": """SELECT *, cost_uncached + cost_cache_read + cost_cache_write AS cost_input,
        cost_uncached + cost_cache_read + cost_cache_write + cost_output + cost_other AS cost_usd FROM costed""",
    "periods": """SELECT source, min(epoch_us(timestamp)) AS first_us, max(epoch_us(timestamp) + bucket_seconds * 1000000) AS last_us,
        greatest((max(epoch_us(timestamp) + bucket_seconds * 1000000) - min(epoch_us(timestamp))) / 86400e6::DOUBLE, 1 / 24.0::DOUBLE) AS days
      FROM raw_rows GROUP BY source""",
    "rows_m": "SELECT r.*, 30 / p.days AS mf FROM priced_rows r JOIN periods p USING (source)",
    "spend": """SELECT * FROM rows_m WHERE granularity = 'bucket'
        OR vendor NOT IN (SELECT vendor FROM rows_m WHERE granularity = 'bucket')""",
    "chat_spend": "SELECT * FROM spend WHERE product <> 'embedding'",
    "chat_req": "SELECT * FROM rows_m WHERE granularity = 'request'",
    "total": "SELECT sum(cost_usd * mf) AS monthly_spend FROM spend",
    "by_model": """SELECT vendor, model_key, sum(cost_usd * mf) AS monthly_cost, sum(requests * weight * mf) AS requests,
        sum(total_input * weight * mf) AS input_tokens, sum(cache_read_tokens * weight * mf) AS cached_tokens,
        sum(output_tokens * weight * mf) AS output_tokens, bool_and(priced) AS priced FROM spend GROUP BY ALL""",
    "by_workload": """SELECT vendor, workload, sum(cost) AS monthly_cost, arg_max(model_key, cost) AS model_key FROM
        (SELECT vendor, workload, model_key, sum(cost_usd * mf) AS cost FROM spend GROUP BY ALL) GROUP BY ALL""",
    "spend_models": """SELECT model_key, sum(cost_usd * mf) AS cost, sum((cost_input + cost_output) * mf) AS cost_now,
        sum(cost_input * mf) AS input_cost, sum(cost_output * mf) AS output_cost, sum(uncached_input_tokens) AS u,
        sum(cache_read_tokens) AS r, sum(cache_write_tokens) AS w, sum(cache_write_1h_tokens) AS w1h, sum(requests) AS n
      FROM chat_spend WHERE priced GROUP BY 1""",
    "cur_models": """SELECT model_key, sum((c_uncached + c_read + c_write + c_output) * 30 / days) AS on_current FROM on_cur
      JOIN periods USING (source) WHERE product <> 'embedding' AND (granularity = 'bucket'
        OR vendor NOT IN (SELECT vendor FROM rows_m WHERE granularity = 'bucket')) GROUP BY 1""",
    "cheap_models": """SELECT model_key, sum((c_uncached + c_read + c_write + c_output) * 30 / days) AS on_cheaper FROM on_cheap
      JOIN periods USING (source) WHERE product <> 'embedding' AND (granularity = 'bucket'
        OR vendor NOT IN (SELECT vendor FROM rows_m WHERE granularity = 'bucket')) GROUP BY 1""",
    "moves": """SELECT m.model_key, t.current_model, t.cur_ratio, m.cost_now, c.on_current, c.on_current < m.cost_now * 0.99 AS pays
      FROM spend_models m JOIN cur_models c USING (model_key) JOIN targets t USING (model_key) WHERE t.current_model <> m.model_key""",
    "short_shares": """SELECT model_key, sum(CASE WHEN output_tokens - reasoning_tokens <= 120 AND total_input <= 4000 THEN cost_usd ELSE 0 END)
        / sum(cost_usd) AS short_share FROM chat_req WHERE priced GROUP BY 1 HAVING sum(cost_usd) > 0""",
    "routes": """SELECT c.model_key, t.cheaper_model, c.on_current, c.on_current - h.on_cheaper AS delta,
        CASE WHEN s.short_share > 0.6 THEN 0.6 ELSE s.short_share END AS routed_share
      FROM spend_models m JOIN cur_models c USING (model_key) JOIN cheap_models h USING (model_key) JOIN targets t USING (model_key)
      LEFT JOIN short_shares s USING (model_key) WHERE c.on_current - h.on_cheaper > 0""",
    # prompt blocks of the log, previous and next use of a prefix by plain lag / lead
    "blocks": """SELECT model_key, seq, epoch_us(timestamp) AS at_us, total_input, in_scale, b.pos, b.chars, b.hash FROM
      (SELECT *, unnest([{'pos': 0, 'chars': 8000, 'hash': 'sys'}, {'pos': 1, 'chars': 12000, 'hash': 'sys/' || event_type},
        {'pos': 2, 'chars': 16000, 'hash': 'sys/' || event_type || '/' || user_id},
        {'pos': 3, 'chars': 20000, 'hash': CAST(seq AS VARCHAR)}]) AS b FROM chat_req WHERE priced)""",
    "gaps": """SELECT *, at_us - lag(at_us) OVER w AS back_us, lead(at_us) OVER w - at_us AS ahead_us FROM blocks
      WINDOW w AS (PARTITION BY model_key, hash ORDER BY at_us, seq)""",
    "replay_options": """SELECT g.*, o.opt, o.ttl, o.write_price, p.p_cached, p.p_input, p.min_cacheable FROM gaps g JOIN prices p USING (model_key)
      JOIN (SELECT model_key, 'own' AS opt, ttl_seconds * 1000000 AS ttl, p_write AS write_price FROM prices
        UNION ALL SELECT model_key, 'hour', CASE WHEN p_write_1h IS NOT NULL THEN 3600000000 END, p_write_1h FROM prices) o USING (model_key)""",
    "replay_tokens": """SELECT model_key, seq, opt, min(at_us) AS at_us, min(total_input)::DOUBLE AS total, min(in_scale) AS in_scale,
        min(p_cached) AS p_cached, min(p_input) AS p_input, min(write_price) AS write_price, min(min_cacheable) AS min_cacheable,
        arg_max(chars, CASE WHEN back_us <= ttl THEN pos END) * min(total_input)::DOUBLE / 20000 AS hit_raw,
        arg_max(chars, CASE WHEN ahead_us <= ttl THEN pos END) * min(total_input)::DOUBLE / 20000 AS reuse_raw
      FROM replay_options GROUP BY model_key, seq, opt""",
    "replay_used": """SELECT *, CASE WHEN hit_raw >= min_cacheable THEN hit_raw ELSE 0 END AS hit,
        CASE WHEN reuse_raw >= min_cacheable THEN reuse_raw ELSE 0 END AS reuse FROM replay_tokens""",
    "replay_cost": """SELECT *, least(greatest(reuse - hit, 0), total - hit) AS write,
        (hit * p_cached + least(greatest(reuse - hit, 0), total - hit) * write_price
          + (total - hit - least(greatest(reuse - hit, 0), total - hit)) * p_input) / 1e6 * in_scale AS cost FROM replay_used""",
    "replay_sums": """SELECT model_key, sum(cost) FILTER (opt = 'own') AS ideal_own, sum(cost) FILTER (opt = 'hour') AS ideal_hour
      FROM replay_cost GROUP BY 1""",
    "log_models": """SELECT model_key, sum(cost_input) AS cost_input, sum(cost_usd) AS cost_usd,
        sum(cache_read_tokens) / greatest(sum(total_input), 1)::DOUBLE AS hit_today FROM chat_req WHERE priced GROUP BY 1""",
    "cache_rates": """SELECT model_key, price_vendor AS vendor, min_cacheable, hit_today,
        CASE WHEN hour_saving > own_saving THEN '1 h' ELSE (ttl_seconds // 60) || ' min' END AS ttl,
        greatest(CASE WHEN hour_saving > own_saving THEN hour_saving ELSE own_saving END, 0) / cost_usd AS saving_rate
      FROM (SELECT l.*, p.*, l.cost_input - s.ideal_own AS own_saving, l.cost_input - s.ideal_hour AS hour_saving
        FROM log_models l JOIN replay_sums s USING (model_key) JOIN prices p USING (model_key)) WHERE cost_usd > 0""",
    "scenario_base": """SELECT m.*, u + r + w + w1h AS total, CASE WHEN n > 0 THEN (u + r + w + w1h)::DOUBLE / n END AS average_prompt,
        p.min_cacheable, p.p_input, p.p_cached, p.p_write,
        u * p_input + r * p_cached + w * p_write + w1h * coalesce(p_write_1h, p_write) AS now_cost
      FROM spend_models m JOIN prices p USING (model_key)""",
    "scenario_targets": """SELECT b.*, t.low_hit, t.base_hit, t.high_hit, coalesce(average_prompt < min_cacheable, false) AS too_short
      FROM scenario_base b, (SELECT 0.25::DOUBLE AS low_hit, 0.45::DOUBLE AS base_hit, 0.65::DOUBLE AS high_hit) t""",
}
_SAVING = (
    "CASE WHEN total > 0 AND NOT too_short THEN CASE WHEN {t} * total <= r THEN 0 ELSE greatest(0, 1 - ((total - {t} * total - {t} * total / 10)"
    " * p_input + {t} * total * p_cached + {t} * total / 10 * p_write) / now_cost) * input_cost END END"
)
_GROUPED = "SELECT vendor, workload, hour(timestamp) AS h, sum({v}) AS v, count(*) AS n FROM {src} GROUP BY ALL"
_BUSY = """SELECT vendor, workload, sum(n)::BIGINT AS n_requests, CASE WHEN sum(v) > 0 THEN sum(v) FILTER (rk <= 3) / sum(v) ELSE 0 END AS busy_share
  FROM (SELECT *, row_number() OVER (PARTITION BY vendor, workload ORDER BY v DESC, h) AS rk FROM ({grouped})) GROUP BY ALL"""
CTES |= {
    "cache_scenario": f"""SELECT model_key, total, average_prompt, too_short, {_SAVING.format(t='low_hit')} AS low,
        {_SAVING.format(t='base_hit')} AS base, {_SAVING.format(t='high_hit')} AS high FROM scenario_targets""",
    "log_busy": _BUSY.format(grouped=_GROUPED.format(v="weight", src="chat_req")),
    "eligible": "SELECT * FROM chat_spend WHERE priced AND service_tier = 'standard'",
    "bill_busy": _BUSY.format(grouped=_GROUPED.format(v="cost_usd", src="eligible")),
    "batch_groups": """SELECT vendor, workload, sum(cost_usd * mf * (1 - p.batch_mult)) AS potential, max(bucket_seconds) AS widest
      FROM eligible JOIN prices p USING (model_key) GROUP BY ALL HAVING sum(cost_usd * mf * (1 - p.batch_mult)) > 0""",
    "batch_options": """SELECT g.*, CASE WHEN l.n_requests >= 50 THEN l.busy_share WHEN g.widest <= 3600 THEN b.busy_share END AS busy_share
      FROM batch_groups g LEFT JOIN log_busy l USING (vendor, workload) LEFT JOIN bill_busy b USING (vendor, workload)""",
    "reasoning": """SELECT model_key, sum(reasoning_tokens * weight) / sum(output_tokens * weight) AS reasoning_share FROM chat_req
      WHERE priced GROUP BY 1 HAVING sum(output_tokens * weight) > 0""",
    "repeats": """SELECT *, coalesce(epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY model_key, request_hash
        ORDER BY timestamp, seq) <= 86400000000, false) AS is_dup FROM chat_req WHERE priced""",
    "dup_rates": """SELECT model_key, sum(cost_usd) AS cost_usd, sum(CASE WHEN is_dup THEN cost_usd ELSE 0 END) / sum(cost_usd) AS dup_rate,
        sum(CASE WHEN is_failed AND NOT is_dup THEN cost_usd ELSE 0 END) / sum(cost_usd) AS fail_rate
      FROM repeats GROUP BY 1 HAVING sum(cost_usd) > 0""",
    "quantiles": """SELECT workload, count(*) AS n_requests, quantile_cont(output_tokens - reasoning_tokens, 0.5) AS p50,
        quantile_cont(output_tokens - reasoning_tokens, 0.95) AS p95 FROM chat_req GROUP BY 1 HAVING count(*) >= 20""",
    # lever contributions: lever, vendor, subject, target, monthly_cost, after, low, base, high, measured, listed
    "c_migration": """SELECT 'migration' AS lever, NULL::VARCHAR AS vendor, model_key AS subject, current_model AS target, cost_now AS monthly_cost,
        on_current AS after, 0.5 * (cost_now - on_current) AS low, cost_now - on_current AS base, cost_now - on_current AS high,
        false AS measured, true AS counted, true AS listed FROM moves WHERE pays""",
    "c_routing": """SELECT 'routing' AS lever, NULL::VARCHAR AS vendor, model_key AS subject, cheaper_model AS target, on_current AS monthly_cost,
        NULL::DOUBLE AS after, CASE WHEN routed_share IS NULL THEN 0.15 ELSE 0.5 * routed_share END * delta AS low,
        CASE WHEN routed_share IS NULL THEN 0.30 ELSE routed_share END * delta AS base,
        CASE WHEN routed_share IS NULL THEN 0.45 WHEN routed_share + 0.15 > 0.8 THEN 0.8 ELSE routed_share + 0.15 END * delta AS high,
        routed_share IS NOT NULL AS measured, true AS counted,
        CASE WHEN routed_share IS NULL THEN 0.30 ELSE routed_share END * delta >= 1 AS listed FROM routes""",
    "c_caching": """SELECT 'caching' AS lever, NULL::VARCHAR AS vendor, m.model_key AS subject, NULL::VARCHAR AS target, m.cost AS monthly_cost,
        NULL::DOUBLE AS after, coalesce(0.5 * c.saving_rate * m.cost, s.low) AS low, coalesce(0.8 * c.saving_rate * m.cost, s.base) AS base,
        coalesce(c.saving_rate * m.cost, s.high) AS high, c.saving_rate IS NOT NULL AS measured, true AS counted,
        coalesce(0.8 * c.saving_rate * m.cost, s.base) >= 1 AS listed
      FROM spend_models m LEFT JOIN cache_rates c USING (model_key) LEFT JOIN cache_scenario s USING (model_key)
      WHERE coalesce(c.saving_rate, s.base) IS NOT NULL""",
    "c_batch": """SELECT 'batch' AS lever, vendor, workload AS subject, NULL::VARCHAR AS target, potential AS monthly_cost, NULL::DOUBLE AS after,
        potential * CASE WHEN busy_share IS NULL THEN 0.05 WHEN busy_share >= 0.6 THEN 0.5 ELSE 0 END AS low,
        potential * CASE WHEN busy_share IS NULL THEN 0.15 WHEN busy_share >= 0.6 THEN 0.9 ELSE 0 END AS base,
        potential * CASE WHEN busy_share IS NULL THEN 0.25 WHEN busy_share >= 0.6 THEN 1 ELSE 0.1 END AS high,
        busy_share IS NOT NULL AS measured, true AS counted,
        potential * CASE WHEN busy_share IS NULL THEN 0.15 WHEN busy_share >= 0.6 THEN 0.9 ELSE 0 END >= 1 AS listed FROM batch_options""",
    "c_output": """SELECT 'output' AS lever, NULL::VARCHAR AS vendor, m.model_key AS subject, NULL::VARCHAR AS target, output_cost AS monthly_cost,
        NULL::DOUBLE AS after, output_cost * CASE WHEN reasoning_share >= 0.4 THEN 0.10 ELSE 0.05 END AS low,
        output_cost * CASE WHEN reasoning_share >= 0.4 THEN 0.20 ELSE 0.10 END AS base,
        output_cost * CASE WHEN reasoning_share >= 0.4 THEN 0.35 ELSE 0.20 END AS high, false AS measured, true AS counted, true AS listed
      FROM spend_models m LEFT JOIN reasoning USING (model_key) WHERE output_cost > 0""",
    "c_duplicates": """SELECT 'duplicates' AS lever, NULL::VARCHAR AS vendor, m.model_key AS subject, NULL::VARCHAR AS target, m.cost AS monthly_cost,
        NULL::DOUBLE AS after, m.cost * (0.5 * dup_rate + 0.3 * fail_rate) AS low, m.cost * (0.8 * dup_rate + 0.5 * fail_rate) AS base,
        m.cost * (dup_rate + 0.7 * fail_rate) AS high, true AS measured, true AS counted,
        m.cost * (0.8 * dup_rate + 0.5 * fail_rate) >= 1 AS listed FROM spend_models m JOIN dup_rates USING (model_key)
      UNION ALL SELECT 'duplicates', NULL, model_key, NULL, NULL, NULL, 0, 0, 0, true, false, false FROM dup_rates""",
    "c_fast_mode": """SELECT 'fast_mode' AS lever, NULL::VARCHAR AS vendor, model_key AS subject, NULL::VARCHAR AS target, sum(cost_usd * mf) AS monthly_cost,
        NULL::DOUBLE AS after, 0.25 * sum(cost_usd * mf) * (1 - 1 / min(fast_mult)) AS low, 0.5 * sum(cost_usd * mf) * (1 - 1 / min(fast_mult)) AS base,
        0.75 * sum(cost_usd * mf) * (1 - 1 / min(fast_mult)) AS high, false AS measured, true AS counted, false AS listed
      FROM chat_spend JOIN prices p USING (model_key) WHERE service_tier = 'fast' AND fast_mult IS NOT NULL GROUP BY model_key""",
    "contributions": " UNION ALL ".join(
        f"SELECT * FROM c_{n}" for n in ("migration", "routing", "caching", "batch", "output", "duplicates", "fast_mode")
    ),
    "lever_list": "SELECT * FROM (VALUES (1,'migration'),(2,'routing'),(3,'caching'),(4,'batch'),(5,'output'),(6,'duplicates'),(7,'fast_mode')) AS v(rank, lever)",
    "levers": """SELECT n.rank, n.lever, coalesce(sum(low), 0) AS low, coalesce(sum(base), 0) AS base, coalesce(sum(high), 0) AS high,
        CASE n.lever WHEN 'migration' THEN 'exact' WHEN 'output' THEN 'scenario' WHEN 'fast_mode' THEN 'scenario'
          WHEN 'duplicates' THEN CASE WHEN count(c.lever) > 0 THEN 'measured' ELSE 'not measured' END
          ELSE CASE WHEN count(*) FILTER (measured AND counted) = 0 THEN 'scenario'
            WHEN count(*) FILTER (measured AND counted) = count(*) FILTER (counted) THEN 'measured' ELSE 'measured + scenario' END END AS method
      FROM lever_list n LEFT JOIN contributions c USING (lever) GROUP BY n.rank, n.lever""",
    "detail": "SELECT * FROM contributions WHERE counted AND listed",
    "combined": """SELECT monthly_spend, monthly_spend * (1 - product(1 - least(low / monthly_spend, 1))) AS low,
        monthly_spend * (1 - product(1 - least(base / monthly_spend, 1))) AS base,
        monthly_spend * (1 - product(1 - least(high / monthly_spend, 1))) AS high FROM levers, total GROUP BY monthly_spend""",
    "top_names": """SELECT model_key, max(CASE WHEN rk = 1 THEN workload END) AS w1, max(CASE WHEN rk = 2 THEN workload END) AS w2 FROM
      (SELECT model_key, workload, row_number() OVER (PARTITION BY model_key ORDER BY sum(cost_usd) DESC, workload) AS rk
        FROM chat_spend GROUP BY model_key, workload) GROUP BY 1""",
}

# ---- raw input tables ---------------------------------------------------------------------------
_LI = "CAST(l_quantity AS BIGINT)"
_TOK = "CAST(floor(value * 100) AS BIGINT)"
CTES |= {
    "log_input": f"""SELECT *, {LOG_MODEL} AS model, {_TOK} AS tokens, CAST(floor(value) AS BIGINT) AS outs, user_id % 8 AS slot,
        CASE WHEN event_id % 20 < 3 THEN 'priority' END AS rec_tier, event_id % 11 = 0 AS batch,
        CASE WHEN event_id % 13 = 0 THEN 'fast' END AS speed,
        CASE WHEN event_id % 2 = 0 THEN ts ELSE date_trunc('second', ts) END AS at_ts FROM events""",
    "log_tokens": """SELECT *, slot IN (4, 5) AS is_messages, slot NOT IN (4, 5) AND slot % 2 = 0 AS is_chat FROM log_input WHERE event_type <> 'error'""",
    "log_shapes": """SELECT *, CASE WHEN is_messages THEN tokens WHEN is_chat THEN greatest(tokens - tokens // 2 - tokens // 10, 0)
          ELSE greatest(tokens - tokens * 2, 0) END AS uncached_input_tokens,
        CASE WHEN is_messages THEN tokens // 4 WHEN is_chat THEN tokens // 2 ELSE tokens * 2 END AS cache_read_tokens,
        CASE WHEN is_messages THEN CASE WHEN event_id % 2 = 0 THEN tokens // 8 ELSE tokens // 5 END WHEN is_chat THEN tokens // 10 ELSE 0 END AS cache_write_tokens,
        CASE WHEN is_messages AND event_id % 2 = 0 THEN tokens // 16 ELSE 0 END AS cache_write_1h_tokens, outs AS output_tokens,
        CASE WHEN is_messages THEN 3 WHEN is_chat THEN CAST(floor(value / 2) AS BIGINT) ELSE 1 END AS reasoning_tokens,
        CASE WHEN is_messages THEN event_id % 3 ELSE 0 END AS web_search_requests FROM log_tokens""",
    "turn_docs": """SELECT 'turn_' || conv_id || '_' || turn AS source, role, text FROM conversations""",
    "doc_parts": """SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS part_no FROM documents""",
    "fp_all": """SELECT 'doc_' || doc_id AS source, 0 AS block_no, '{"tools":[{"name":' || to_json('lookup_' || lang) || '}]}' AS block FROM documents
      UNION ALL SELECT 'doc_' || doc_id, 1, '{"system":{"text":' || to_json('Policy of ' || source) || ',"type":"text"}}' FROM documents
      UNION ALL SELECT 'doc_' || doc_id, 1 + part_no, CASE WHEN part_no = 1 THEN '{"part":{"text":' || to_json(part) || ',"type":"text"},"role":"user"}'
        ELSE '{"text":' || to_json(part) || ',"type":"text"}' END FROM doc_parts
      UNION ALL SELECT source, 0, '{"system":' || to_json('You answer a ' || role) || '}' FROM turn_docs
      UNION ALL SELECT source, 1, '{"content":' || to_json(text) || ',"role":"user"}' FROM turn_docs""",
    "fp_bodies": """SELECT 'doc_' || d.doc_id AS source, '{"messages":[{"content":[' || p.parts || '],"role":"user"}],"model":"claude-opus-5","system":[{"text":'
        || to_json('Policy of ' || d.source) || ',"type":"text"}],"tools":[{"name":' || to_json('lookup_' || d.lang) || '}]}' AS body
      FROM documents d JOIN (SELECT doc_id, string_agg('{"text":' || to_json(part) || ',"type":"text"}', ',' ORDER BY part_no) AS parts
        FROM doc_parts GROUP BY 1) p USING (doc_id)
      UNION ALL SELECT source, '{"input":' || to_json(text) || ',"instructions":' || to_json('You answer a ' || role) || ',"model":"gpt-5.4"}' FROM turn_docs""",
    "cases": """SELECT CAST(doc_id AS VARCHAR) AS id, lang AS workload, doc_id % 5 AS kind, text, source,
        trim(regexp_replace(lower(text), '[\\s\\x0B\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g')) AS norm_text,
        list_extract(string_split(text, ' '), 1) AS first_word, list_extract(string_split(text, ' '), -1) AS last_word FROM documents""",
    "outs": """SELECT CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN l.quality = 0 THEN reverse(text) ELSE text END AS plain,
        coalesce(l.quality = 0 AND d.doc_id % 5 = 4, false) AS wrong_json FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1""",
}
SPACED = "('  ' || replace(text, ' ', '   ') || ' ')"
_NORM = "trim(regexp_replace(lower({x}), '[\\s\\x0B\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


def _passes(output: str, wrong: str) -> str:
    out = _NORM.format(x=output)
    norm = lambda x: _NORM.format(x=x)
    return f"""CASE kind WHEN 0 THEN {out} = {norm(SPACED)} WHEN 1 THEN contains({out}, {norm('last_word')})
      WHEN 2 THEN contains({out}, {norm('first_word')}) AND contains({out}, {norm('last_word')})
      WHEN 3 THEN {out} = 'other' OR {out} = {norm('text')} ELSE NOT ({wrong}) END"""


CTES |= {
    "scored": f"""SELECT c.*, o.id IS NULL AS missing, {_passes('text', 'false')} AS base_ok,
        CASE WHEN o.id IS NULL THEN false ELSE {_passes('o.plain', 'o.wrong_json')} END AS cand_ok
      FROM cases c LEFT JOIN outs o USING (id)""",
}


def compose(final: str) -> str:
    """Prepend the sub-selects a statement refers to, in dependency order."""
    names = "|".join(sorted(CTES, key=len, reverse=True))
    found: list[str] = []

    def visit(text: str, me: str | None = None) -> None:
        for name in re.findall(rf"(?:FROM|JOIN)\s+({names})\b", text) + re.findall(r",\s*(total)\b", text):
            if name != me and name not in found and name not in stack:
                stack.append(name)
                visit(CTES[name], name)
                stack.remove(name)
                found.append(name)

    stack: list[str] = []
    visit(final)
    listed = ",\n".join(f"{n} AS ({CTES[n]})" for n in found)
    return f"WITH RECURSIVE {listed}\n{final}" if found else final


def rounded(cols: str, digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c.split('.')[-1]}" for c in cols.split())


_KEYS = "source, granularity, vendor, workload, model_key, service_tier, timestamp"
_DETAIL = f"vendor, subject, target, {rounded('monthly_cost after low base high')}, measured, listed"


def _pad(hex_byte: int) -> str:
    return "".join(f"{b ^ hex_byte:02x}" for b in SALT.ljust(64, b"\0"))


def _hmac(text: str) -> str:
    return f"sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode({text}))))"


STATEMENTS: dict[str, str] = {
    "src_openai_usage": f"""SELECT l_shipdate AS timestamp, 3600 AS bucket_seconds, 'openai' AS vendor,
        CASE l_partkey % 3 WHEN 0 THEN 'gpt-4o-2024-08-06' WHEN 1 THEN 'gpt-5.4-2026-03-05' ELSE 'unknown' END AS model,
        CASE l_suppkey % 4 WHEN 0 THEN 'proj_' || l_suppkey WHEN 1 THEN 'user_' || l_suppkey WHEN 2 THEN 'key_' || l_suppkey ELSE 'all' END AS workload,
        {OPENAI_TIER.format(batch="l_returnflag = 'R'", tier="CASE l_linenumber WHEN 1 THEN 'default' WHEN 2 THEN 'auto' WHEN 3 THEN 'Priority' WHEN 4 THEN 'flex' END")} AS service_tier,
        l_linenumber AS requests, CASE WHEN l_linenumber >= 4 THEN {_LI} * 550 WHEN l_linenumber = 3 THEN {_LI} * 600 WHEN l_linenumber = 2 THEN {_LI} * 700 ELSE {_LI} * 1000 END AS uncached_input_tokens,
        CASE WHEN l_linenumber >= 2 THEN {_LI} * 300 ELSE 0 END AS cache_read_tokens, CASE WHEN l_linenumber >= 3 THEN {_LI} * 100 ELSE 0 END AS cache_write_tokens,
        0 AS cache_write_1h_tokens, {_LI} * 10 AS output_tokens, 'openai_usage.json' AS source FROM lineitem""",
    "src_openai_embeddings": f"""SELECT l_shipdate AS timestamp, 'text-embedding-3-small' AS model, CASE WHEN l_suppkey % 4 = 0 THEN 'proj_' || l_suppkey ELSE 'all' END AS workload,
        'embedding' AS product, 1 AS requests, {_LI} * 7 AS uncached_input_tokens, 'openai_usage.json' AS source FROM lineitem""",
    "src_openai_costs": "SELECT CAST(l_shipdate AS DATE) AS date, 'openai' AS vendor, l_linestatus AS line_item, round(l_extendedprice, 4) AS amount_usd, 'openai_costs.json' AS source FROM lineitem",
    "src_anthropic_usage": f"""SELECT l_shipdate AS timestamp, 3600 AS bucket_seconds, 'anthropic' AS vendor,
        CASE l_partkey % 3 WHEN 0 THEN 'claude-opus-5' WHEN 1 THEN 'claude-sonnet-4-5-20250929' ELSE 'claude-opus-4-1-20250805' END AS model,
        CASE l_suppkey % 3 WHEN 0 THEN 'wrkspc_' || l_suppkey WHEN 1 THEN 'key_' || l_suppkey ELSE 'default' END AS workload,
        {ANTHROPIC_TIER.format(speed="CASE WHEN l_returnflag = 'R' THEN 'fast' END", tier="CASE l_linenumber WHEN 1 THEN 'priority_on_demand' WHEN 3 THEN 'flex_discount' WHEN 4 THEN 'Batch' END")} AS service_tier,
        CASE WHEN l_linestatus = 'O' THEN 'us' ELSE 'global' END AS inference_geo, NULL::BIGINT AS requests, {_LI} * 1000 AS uncached_input_tokens,
        {_LI} * 200 AS cache_read_tokens, {_LI} * 30 AS cache_write_tokens, {_LI} * 5 AS cache_write_1h_tokens, {_LI} * 20 AS output_tokens,
        CASE WHEN l_linenumber = 2 THEN 2 ELSE 0 END AS web_search_requests FROM lineitem""",
    "src_anthropic_costs": "SELECT CAST(l_shipdate AS DATE) AS date, 'anthropic' AS vendor, l_returnflag AS line_item, round(CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS DOUBLE) / 100, 4) AS amount_usd, 'anthropic_costs.json' AS source FROM lineitem",
    "detect_kind": """SELECT 'file_' || l_suppkey || '.json' AS source, count(*) AS n_pages, CASE WHEN count(*) FILTER (l_linenumber > 1) = 0 THEN 'empty' ELSE
        CASE l_suppkey % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'openai_usage' WHEN 2 THEN 'openai_embeddings' WHEN 3 THEN 'openai_costs' WHEN 4 THEN 'anthropic_usage'
        WHEN 5 THEN 'anthropic_costs' ELSE 'unknown' END END AS kind FROM lineitem GROUP BY l_suppkey""",
    "src_request_log": f"""SELECT event_id AS seq, at_ts AS timestamp, 'request' AS granularity, vendor, model,
        CASE WHEN event_type = 'view' THEN 'browse' ELSE event_type END AS workload,
        CASE WHEN vendor = 'openai' THEN {OPENAI_TIER.format(batch='batch', tier="tier")} ELSE {ANTHROPIC_TIER.format(speed='speed', tier="tier")} END AS service_tier,
        CASE WHEN is_messages AND event_id % 7 = 0 THEN 'us' END AS inference_geo, 1 AS requests, uncached_input_tokens, cache_read_tokens, cache_write_tokens,
        cache_write_1h_tokens, output_tokens, reasoning_tokens, web_search_requests, CASE WHEN user_id % 2 = 0 THEN 2.0 ELSE 1.0 END AS weight,
        user_id || '-' || (event_id % 10) AS request_hash, CASE event_id % 5 WHEN 0 THEN '500' WHEN 1 THEN '500' WHEN 2 THEN 'Timeout' WHEN 3 THEN '200' END AS status,
        CASE event_id % 5 WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'string' WHEN 3 THEN 'number' ELSE 'null' END AS status_type,
        'log.jsonl' AS source, 2 AS n_blocks FROM (SELECT *, CASE WHEN slot = 6 THEN 'bedrock' ELSE {INFERRED_VENDOR} END AS vendor,
          coalesce(rec_tier, CASE WHEN is_messages THEN 'standard' END) AS tier FROM log_shapes)""",
    "usage_shape_map": """SELECT event_id AS seq, uncached_input_tokens, cache_read_tokens, cache_write_tokens, cache_write_1h_tokens, output_tokens, reasoning_tokens,
        web_search_requests FROM log_shapes""",
    "src_normalised_csv": f"""SELECT event_id AS seq, ts AS timestamp, 0 AS bucket_seconds, CASE WHEN event_type = 'signup' THEN 'request' ELSE 'bucket' END AS granularity,
        CASE WHEN event_type = 'click' THEN 'azure' ELSE {INFERRED_VENDOR} END AS vendor, model, 'all' AS workload, 'chat' AS product,
        CASE WHEN event_type <> 'signup' THEN 'Flex' END AS service_tier, NULL::VARCHAR AS inference_geo, NULL::BIGINT AS requests,
        CASE WHEN event_type <> 'view' THEN outs ELSE 0 END AS uncached_input_tokens, 0 AS cache_read_tokens, 0 AS cache_write_tokens, 0 AS cache_write_1h_tokens,
        event_id AS output_tokens, 0 AS reasoning_tokens, 0 AS web_search_requests, 1.0 AS weight, NULL::VARCHAR AS request_hash,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE '200' END AS status, CASE WHEN event_type = 'error' THEN 'string' ELSE 'number' END AS status_type,
        'usage.csv' AS source FROM log_input""",
    "skip_eval_files": """SELECT source, count(*) AS n_lines, min(doc_id) AS first_seq FROM documents GROUP BY source HAVING arg_min(lang, doc_id) NOT IN ('de', 'fr')""",
    "normalised_union": """SELECT source, granularity, vendor, model_key, workload, count(*) AS n_rows, sum(requests) AS requests, sum(uncached_input_tokens) AS uncached_input_tokens,
        sum(cache_read_tokens) AS cache_read_tokens, sum(cache_write_tokens) AS cache_write_tokens, sum(cache_write_1h_tokens) AS cache_write_1h_tokens,
        sum(output_tokens) AS output_tokens, sum(reasoning_tokens) AS reasoning_tokens, sum(web_search_requests) AS web_search_requests FROM keyed GROUP BY ALL""",
    "eval_bad_lines": """SELECT CAST(conv_id AS VARCHAR) AS source, turn - min_turn + 1 AS line_no FROM conversations
        JOIN (SELECT conv_id, min(turn) AS min_turn FROM conversations GROUP BY 1) USING (conv_id) WHERE role = 'system'""",
    "ts_parse": "SELECT event_id AS seq, at_ts AS timestamp FROM log_input",
    "tier_normalise": f"SELECT {OPENAI_TIER.format(batch='batch', tier='rec_tier')} AS openai_tier, {ANTHROPIC_TIER.format(speed='speed', tier='rec_tier')} AS anthropic_tier, count(*) AS n_rows FROM log_input GROUP BY 1, 2",
    "workload_fallback": "SELECT CASE WHEN event_type = 'view' THEN 'browse' ELSE event_type END AS workload, count(*) AS n_rows FROM events GROUP BY 1",
    "vendor_infer": f"SELECT model, {INFERRED_VENDOR} AS vendor, count(*) AS n_rows FROM raw_rows GROUP BY 1, 2",
    "model_normalise": "SELECT model, model_key, count(*) AS n_rows FROM keyed GROUP BY ALL",
    "priced_usage": f"SELECT {_KEYS}, total_input, priced, {rounded('cost_uncached cost_cache_read cost_cache_write cost_output cost_other cost_input cost_usd', 10)} FROM priced_rows",
    "tier_multiplier": """SELECT model_key, service_tier, CASE WHEN service_tier = 'batch' THEN batch_mult WHEN service_tier = 'flex' AND price_vendor = 'openai' THEN batch_mult
          WHEN service_tier = 'fast' AND fast_mult IS NOT NULL THEN fast_mult ELSE 1.0 END AS multiplier,
        NOT (service_tier IN ('standard', 'batch') OR (service_tier = 'flex' AND price_vendor = 'openai') OR (service_tier = 'fast' AND fast_mult IS NOT NULL)) AS unverified,
        count(*) AS n_rows FROM keyed JOIN prices USING (model_key) GROUP BY ALL""",
    "row_scales": "SELECT model_key, granularity, round(in_scale, 8) AS in_scale, round(out_scale, 8) AS out_scale, count(*) AS n_rows FROM own WHERE priced GROUP BY ALL",
    "reprice": f"""SELECT {_KEYS}, current_model, cheaper_model, round(now_cost, 10) AS cost_on_current, round(c_uncached + c_read + c_write + c_output, 10) AS cost_on_cheaper
      FROM (SELECT r.*, {_costs('p', 'r.cheap_ratio')} FROM (SELECT * EXCLUDE (c_uncached, c_read, c_write, c_output, in_scale, out_scale),
        c_uncached + c_read + c_write + c_output AS now_cost FROM on_cur) r LEFT JOIN prices p ON p.model_key = r.cheaper_model)""",
    "token_ratio": """SELECT model_key, current_model, cheaper_model, round(r1, 8) AS cur_ratio, round(r2, 8) AS cheap_ratio, n AS output_tokens, round(n * r1, 2) AS on_current,
        round(n * r2, 2) AS on_cheaper FROM (SELECT model_key, current_model, cheaper_model, min(cur_ratio) AS r1, coalesce(min(cheap_ratio), 1) AS r2, sum(output_tokens) AS n
          FROM on_cur GROUP BY 1, 2, 3)""",
    "successor_closure": "SELECT k.model_key, count(*) AS n_rows, t.successor, t.current_model, t.cheaper_model FROM keyed k LEFT JOIN targets t USING (model_key) GROUP BY ALL",
    "price_dim_checks": "SELECT model_key, 'price_order' AS rule, count(*) AS n_rows FROM keyed JOIN prices USING (model_key) WHERE p_output > 0 AND NOT (p_cached > 0 AND p_cached < p_input AND p_input < p_output AND p_write >= p_input) GROUP BY 1",
    "failed_calls": """SELECT event_id AS seq, at_ts AS timestamp, model, CASE event_id % 5 WHEN 0 THEN '500' ELSE 'Timeout' END AS status,
        CASE event_id % 5 WHEN 0 THEN 'number' ELSE 'string' END AS status_type FROM log_tokens WHERE event_id % 5 IN (0, 2)""",
    "spend_of_record": f"SELECT {_KEYS}, {rounded('cost_usd', 10)} FROM spend",
    "chat_only_spend": f"SELECT {_KEYS}, product, {rounded('cost_usd', 10)} FROM priced_rows WHERE product <> 'embedding'",
    "source_period": "SELECT source, first_us, last_us, round(days, 8) AS days, round(30 / days, 8) AS monthly_factor FROM periods",
    "by_model": f"""SELECT vendor, model_key, {rounded('monthly_cost requests')}, {rounded('input_tokens cached_tokens output_tokens', 2)}, priced,
        round(monthly_cost / monthly_spend, 8) AS share, round(cached_tokens / nullif(input_tokens, 0), 8) AS cache_hit FROM by_model, total""",
    "by_workload": "SELECT vendor, workload, round(monthly_cost, 4) AS monthly_cost, model_key, round(monthly_cost / monthly_spend, 8) AS share FROM by_workload, total",
    "top_workloads": "SELECT vendor, workload, round(monthly_cost, 4) AS monthly_cost, model_key, round(monthly_cost / monthly_spend, 8) AS share FROM by_workload, total ORDER BY by_workload.monthly_cost DESC LIMIT 10",
    "by_token_type": """SELECT t AS token_type, round(v, 4) AS monthly_cost FROM (SELECT unnest([{'t': 'Uncached input', 'v': sum(cost_uncached * mf)}, {'t': 'Cache reads', 'v': sum(cost_cache_read * mf)},
        {'t': 'Cache writes', 'v': sum(cost_cache_write * mf)}, {'t': 'Output (incl. reasoning)', 'v': sum(cost_output * mf)}, {'t': 'Web search', 'v': sum(cost_other * mf)}], recursive := true) FROM spend)""",
    "embedding_spend": "SELECT model_key, round(sum(cost_usd * mf), 4) AS monthly_cost FROM spend WHERE product = 'embedding' GROUP BY 1",
    "reconcile": """SELECT * FROM (WITH billed AS (SELECT CAST(o_orderdate AS DATE) AS date, CASE o_orderkey % 5 WHEN 3 THEN 'mistral' WHEN 4 THEN 'anthropic' ELSE 'openai' END AS vendor, o_totalprice / 1000 AS usd
          FROM orders WHERE day(o_orderdate) <> 13),
        invoiced_days AS (SELECT vendor, date, sum(usd) AS invoiced FROM billed GROUP BY 1, 2 UNION ALL SELECT DISTINCT 'cohere', date, 0.0 FROM billed),
        bucketed AS MATERIALIZED (SELECT DISTINCT vendor FROM priced_rows WHERE granularity = 'bucket'),
        modelled_days AS (SELECT vendor, CAST(timestamp AS DATE) AS date, sum(cost_usd) AS modelled FROM priced_rows
          WHERE granularity = 'bucket' OR vendor NOT IN (SELECT vendor FROM bucketed) GROUP BY 1, 2)
        SELECT vendor, count(*) AS days, round(sum(invoiced), 4) AS invoiced, round(coalesce(sum(modelled), 0), 4) AS modelled,
          round((coalesce(sum(modelled), 0) - sum(invoiced)) / nullif(sum(invoiced), 0), 8) AS diff_pct
        FROM invoiced_days LEFT JOIN modelled_days USING (vendor, date) GROUP BY 1)""",
    "data_quality": f"""SELECT 'unknown_model' AS code, NULL AS source, model_key AS subject, count(*) AS n FROM priced_rows WHERE NOT priced GROUP BY 3
      UNION ALL SELECT 'unverified_tier', NULL, model_key || ':' || service_tier, count(*) FROM keyed JOIN prices USING (model_key)
        WHERE NOT (service_tier IN ('standard', 'batch') OR (service_tier = 'fast' AND fast_mult IS NOT NULL)) GROUP BY 3
      UNION ALL SELECT 'skipped_result', 'openai_usage.json', 'organization.usage.embeddings.result', count(*) FROM lineitem
      UNION ALL SELECT 'long_context_window', 'anthropic_usage.json', NULL, count(*) FROM lineitem WHERE l_quantity > 40
      UNION ALL SELECT 'empty_export', 'file_' || l_suppkey || '.json', NULL, 1 FROM lineitem GROUP BY l_suppkey HAVING l_suppkey % 7 = 0 OR count(*) FILTER (l_linenumber > 1) = 0
      UNION ALL SELECT 'log_line_without_usage', 'log.jsonl', NULL, count(*) FROM events WHERE event_type = 'error'
      UNION ALL SELECT 'stale_prices', NULL, '2026-09-29', date_diff('day', DATE '2026-09-29', DATE '2027-03-01')""",
    "duplicate_calls": f"SELECT model_key, request_hash, seq, timestamp, {rounded('cost_usd', 10)} FROM repeats WHERE is_dup",
    "duplicate_rates": f"SELECT model_key, {rounded('cost_usd')}, {rounded('dup_rate fail_rate', 8)} FROM dup_rates",
    "cache_replay": """SELECT o.model_key, o.seq, make_timestamp(o.at_us) AS timestamp, round(o.total, 4) AS total, round(o.hit, 4) AS hit_own, round(o.reuse, 4) AS reuse_own,
        round(o.write, 4) AS write_own, round(o.cost, 12) AS cost_own, round(h.hit, 4) AS hit_hour, round(h.reuse, 4) AS reuse_hour, round(h.write, 4) AS write_hour, round(h.cost, 12) AS cost_hour
        FROM replay_cost o JOIN replay_cost h ON o.model_key = h.model_key AND o.seq = h.seq AND o.opt = 'own' AND h.opt = 'hour'""",
    "stable_prefix": """SELECT model_key, max(pos) AS pos, arg_max(median_chars, pos) AS prefix_chars, max(n_requests) AS n_requests FROM
        (SELECT model_key, pos, hash, count(*) AS n, CAST(median(chars) AS BIGINT) AS median_chars FROM blocks GROUP BY ALL) JOIN
        (SELECT model_key, count(DISTINCT seq) AS n_requests FROM blocks GROUP BY 1) USING (model_key) WHERE n * 2 >= n_requests AND n_requests >= 5 GROUP BY 1""",
    "cache_rates": f"SELECT model_key, vendor, ttl, {rounded('saving_rate hit_today', 8)} FROM cache_rates",
    "cache_scenario": f"SELECT model_key, total, too_short, {rounded('average_prompt low base high')} FROM cache_scenario",
    "apply_rates": f"SELECT subject, {rounded('monthly_cost low base high')}, measured, listed FROM c_caching WHERE measured",
    "routing_candidates": f"SELECT model_key, {rounded('short_share', 8)} FROM short_shares",
    "hour_concentration": f"SELECT vendor, workload, n_requests, {rounded('busy_share', 8)} FROM log_busy",
    "reasoning_share": f"SELECT model_key, {rounded('reasoning_share', 8)} FROM reasoning",
    "output_quantiles": f"SELECT workload, n_requests, {rounded('p50 p95')} FROM quantiles",
    "batch_what_if": "SELECT vendor, subject AS workload, round(monthly_cost, 4) AS saving_if_batched FROM c_batch WHERE NOT listed ORDER BY monthly_cost DESC LIMIT 3",
    "batch_confirmed": """SELECT vendor, workload AS subject, NULL::VARCHAR AS target, round(potential, 4) AS monthly_cost, NULL::DOUBLE AS after, round(x, 4) AS low, round(x, 4) AS base,
        round(x, 4) AS high, true AS measured, x >= 1 AS listed FROM (SELECT *, CASE WHEN workload = 'ws_1' THEN potential ELSE 0 END AS x FROM batch_groups)""",
    "levers": f"SELECT rank, lever, {rounded('low base high')}, method FROM levers",
    "top_lever_rows": f"""SELECT lever, rank, vendor, subject, target, {rounded('low base high')} FROM
        (SELECT *, row_number() OVER (PARTITION BY lever ORDER BY base DESC, vendor, subject) AS rank FROM detail) WHERE rank <= 10""",
    "summary_levers": f"SELECT rank, lever, {rounded('low base high')}, method FROM levers WHERE base > 0 ORDER BY levers.base DESC LIMIT 3",
    "combined_savings": f"SELECT {rounded('monthly_spend low base high')} FROM combined",
    "lever_evidence": """SELECT lever, subject, metric, round(value, 4) AS value FROM (
      SELECT 'migration' AS lever, model_key AS subject, 'monthly_now' AS metric, cost_now AS value FROM moves
      UNION ALL SELECT 'migration', model_key, 'monthly_after', on_current FROM moves
      UNION ALL SELECT 'migration', model_key, 'token_ratio', cur_ratio FROM moves
      UNION ALL SELECT 'migration', model_key, 'pays', CASE WHEN pays THEN 1 ELSE 0 END FROM moves
      UNION ALL SELECT 'routing', model_key, CASE WHEN routed_share < 0.05 THEN 'few_short_calls' ELSE 'short_call_share' END, routed_share FROM routes WHERE routed_share IS NOT NULL
      UNION ALL SELECT 'caching', model_key, 'below_cache_minimum', min_cacheable FROM cache_rates WHERE saving_rate < 0.01
      UNION ALL SELECT 'caching', model_key, 'cache_hit_today', hit_today FROM cache_rates WHERE saving_rate >= 0.01
      UNION ALL SELECT 'caching', model_key, 'measured_saving_rate', saving_rate FROM cache_rates WHERE saving_rate >= 0.01
      UNION ALL SELECT 'caching', model_key, 'average_prompt_tokens', average_prompt FROM cache_scenario WHERE too_short AND model_key NOT IN (SELECT model_key FROM cache_rates)
      UNION ALL SELECT 'batch', workload, 'busiest_3h_share', busy_share FROM batch_options WHERE busy_share >= 0.6
      UNION ALL SELECT 'batch', subject, 'what_if_saving', monthly_cost FROM (SELECT * FROM c_batch WHERE NOT listed ORDER BY monthly_cost DESC LIMIT 3)
      UNION ALL SELECT 'output', model_key, 'reasoning_share', reasoning_share FROM reasoning JOIN spend_models USING (model_key) WHERE reasoning_share >= 0.4 AND output_cost > 0
      UNION ALL SELECT 'output', workload, 'visible_p50', p50 FROM quantiles UNION ALL SELECT 'output', workload, 'visible_p95', p95 FROM quantiles
      UNION ALL SELECT 'duplicates', model_key, 'repeat_share', dup_rate FROM dup_rates WHERE dup_rate > 0.005 OR fail_rate > 0.005
      UNION ALL SELECT 'duplicates', model_key, 'failed_share', fail_rate FROM dup_rates WHERE dup_rate > 0.005 OR fail_rate > 0.005
      UNION ALL SELECT 'fast_mode', subject, 'monthly_cost_in_fast_mode', monthly_cost FROM c_fast_mode)""",
    "summary": f"""SELECT {rounded('monthly_spend low base high')}, make_timestamp(first_us) AS period_start, make_timestamp(last_us) AS period_end,
        round((last_us - first_us) / 86400e6, 8) AS days, round(low * 12, 4) AS low_yearly, round(base * 12, 4) AS base_yearly, round(high * 12, 4) AS high_yearly,
        round(base / monthly_spend, 8) AS base_share, base * 12 >= 5700 AS guarantee_met
        FROM combined, (SELECT min(epoch_us(timestamp)) AS first_us, max(epoch_us(timestamp) + bucket_seconds * 1000000) AS last_us FROM spend)""",
    "plan_migration": """SELECT rank, subject AS model_key, target AS successor, round(base, 4) AS saving_base, concat_ws(', ', w1, w2) AS workloads FROM
        (SELECT *, row_number() OVER (ORDER BY base DESC, subject) AS rank FROM detail WHERE lever = 'migration' AND base >= 1) d LEFT JOIN top_names n ON n.model_key = d.subject""",
    "plan_routing": """SELECT workload, model_key, cheaper_model, round(short_share, 8) AS short_share FROM (SELECT workload, model_key,
        sum(CASE WHEN output_tokens - reasoning_tokens <= 120 AND total_input <= 4000 THEN cost_usd ELSE 0 END) / sum(cost_usd) AS short_share FROM chat_req WHERE priced GROUP BY 1, 2)
        JOIN targets USING (model_key) WHERE short_share >= 0.2 AND cheaper_model IS NOT NULL AND (SELECT base FROM levers WHERE lever = 'routing') >= 1""",
    "plan_cache": """SELECT d.subject AS model_key, c.vendor, c.ttl, CASE WHEN c.vendor = 'anthropic' THEN CASE c.ttl WHEN '1 h' THEN '1h' ELSE '5m' END END AS ttl_parameter,
        8000 AS prefix_chars, CASE WHEN c.vendor <> 'anthropic' THEN replace(coalesce(w1, w2, d.subject), '_', '-') END AS cache_key, round(d.base, 4) AS saving_base
        FROM detail d JOIN cache_rates c ON c.model_key = d.subject LEFT JOIN top_names n ON n.model_key = d.subject WHERE d.lever = 'caching' AND d.base >= 50""",
    "plan_batch": "SELECT vendor, subject AS workload, round(base, 4) AS saving_base FROM detail WHERE lever = 'batch' AND base >= 1",
    "plan_max_tokens": """SELECT workload, CAST(ceil(quantile_cont(output_tokens, 0.95) * 1.1) AS BIGINT) AS max_tokens FROM chat_req
        WHERE (SELECT base FROM levers WHERE lever = 'output') >= 1 GROUP BY 1 HAVING count(*) >= 20""",
    "plan_duplicates": "SELECT row_number() OVER (ORDER BY base DESC, subject) AS rank, subject AS model_key, round(base, 4) AS saving_base FROM detail WHERE lever = 'duplicates' AND base >= 1",
    "plan_fast": "SELECT DISTINCT model_key FROM chat_spend WHERE priced AND service_tier = 'fast' AND (SELECT base FROM levers WHERE lever = 'fast_mode') >= 1",
    "eval_checks": """SELECT id, 0 AS check_no, CASE kind WHEN 0 THEN 'exact' WHEN 1 THEN 'contains' WHEN 2 THEN 'contains_all' WHEN 3 THEN 'one_of' ELSE 'json_field' END AS kind,
        cand_ok AS passed FROM scored WHERE NOT missing""",
    "eval_items": f"""SELECT id, workload, cand_ok AS passed, missing, CASE WHEN cand_ok THEN 0 ELSE 1 END AS n_failed, md5(CASE WHEN missing THEN 'missing output' WHEN cand_ok THEN ''
        ELSE CASE kind WHEN 0 THEN 'exact:' || {SPACED} WHEN 1 THEN 'contains:' || last_word WHEN 2 THEN 'contains_all:' WHEN 3 THEN 'one_of:' ELSE 'json_field:source' END END) AS failed_md5,
        CASE WHEN missing THEN '' ELSE 'gpt-6.1-sol' END AS model FROM scored""",
    "eval_score": "SELECT count(*) AS n, count(*) FILTER (cand_ok) AS passed, round(count(*) FILTER (cand_ok) / count(*), 8) AS rate FROM scored",
    "eval_models": """SELECT 'candidate' AS side, 'gpt-6.1-sol' AS model, count(*) AS n FROM scored WHERE NOT missing HAVING count(*) > 0
        UNION ALL SELECT 'baseline', 'gpt-4o', count(*) FROM documents HAVING count(*) > 0""",
    "eval_gate": """SELECT n AS baseline_n, b AS baseline_passed, round(b / n, 8) AS baseline_rate, n AS candidate_n, c AS candidate_passed, round(c / n, 8) AS candidate_rate,
        round(c / n - b / n, 8) AS delta, 0.02 AS tolerance, c / n + 1e-12 >= b / n - 0.02 AS gate_pass FROM
        (SELECT count(*) AS n, count(*) FILTER (base_ok) AS b, count(*) FILTER (cand_ok) AS c FROM scored)""",
    "eval_regressions": "SELECT id, workload, missing, CASE WHEN missing THEN '' ELSE 'gpt-6.1-sol' END AS model FROM scored WHERE base_ok AND NOT cand_ok",
    "eval_by_workload": """SELECT workload, n AS baseline_n, b AS baseline_passed, round(b / n, 8) AS baseline_rate, n AS candidate_n, c AS candidate_passed, round(c / n, 8) AS candidate_rate,
        round(c / n - b / n, 8) AS delta FROM (SELECT workload, count(*) AS n, count(*) FILTER (base_ok) AS b, count(*) FILTER (cand_ok) AS c FROM scored GROUP BY 1)""",
    "eval_init": """SELECT rank, workload || '_' || printf('%03d', rank) AS id, workload, '' AS input FROM (SELECT workload, row_number() OVER (ORDER BY sum(cost_usd) DESC, workload) AS rank
        FROM priced_rows GROUP BY workload)""",
    "fp_blocks": "SELECT source, block_no, length(block) AS n_chars, md5(block) AS block_md5 FROM fp_all",
    "fp_prefixes": f"""SELECT source, block_no, {_hmac('prefix')} AS prefix_hash, length(prefix) AS prefix_chars FROM
        (SELECT source, block_no, string_agg(block, '') OVER (PARTITION BY source ORDER BY block_no) AS prefix FROM fp_all)""",
    "fp_request_hash": f"SELECT source, {_hmac('body')} AS request_hash FROM fp_bodies",
    "fp_redact": f"""SELECT source, CASE WHEN source LIKE 'doc%' THEN 'fingerprint,timestamp,usage' ELSE 'fingerprint,timestamp' END AS fields, {_hmac('body')} AS request_hash, n_blocks
        FROM fp_bodies JOIN (SELECT source, count(*) AS n_blocks FROM fp_all GROUP BY 1) USING (source)""",
}
STATEMENTS |= {f"lever_{n}": f"SELECT {_DETAIL} FROM c_{n}" for n in ("migration", "routing", "caching", "batch", "output", "duplicates", "fast_mode")}


def oracle_sql() -> dict[str, str]:
    return {name: compose(text) for name, text in STATEMENTS.items()}
