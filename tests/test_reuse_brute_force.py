"""Replay, repeats and stable prefix against slow sequential loops on a small random log with hot keys."""

import random
import statistics
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from spendscope.operators import duplicates, reuse
from spendscope.price_dim import price_rows
from spendscope.schema import as_usage

BOOK = {r["model_key"]: r for r in price_rows()}
MODELS = ["gpt-5.4", "gpt-4o", "claude-sonnet-4-5"]
EPOCH = datetime(2026, 9, 1, tzinfo=timezone.utc)


def random_log(n, seed):
    rng, rows = random.Random(seed), []
    for seq in range(n):
        # A third of the calls share one instant; many others share seconds.
        second = 5_000 if rng.random() < 0.33 else rng.randrange(0, 200_000 if rng.random() < 0.5 else 4_000)
        depth = rng.randrange(0, 5)
        hashes = [rng.choice(["hot", "hot", f"h{rng.randrange(6)}"]) for _ in range(depth)]
        chars = sorted(rng.randrange(1, 20_000) for _ in range(depth))
        rows.append(
            {
                "seq": seq, "second": second, "model": rng.choice(MODELS), "tokens": rng.randrange(500, 30_000),
                "hashes": hashes, "chars": chars, "request": rng.choice(["same", "same", f"r{rng.randrange(20)}", None]),
                "status": rng.choice(["200", "500"]),
            }
        )
    return rows


@pytest.fixture(scope="module")
def case(spark):
    rows = random_log(400, 5)
    frame = spark.createDataFrame(
        [
            (EPOCH + timedelta(seconds=r["second"]), r["model"], r["tokens"], r["hashes"], r["chars"], r["request"], r["status"], r["seq"])
            for r in rows
        ],
        "timestamp timestamp, model string, uncached_input_tokens bigint, prefix_hashes array<string>,"
        " prefix_chars array<bigint>, request_hash string, status string, seq bigint",
    )
    usage = as_usage(
        frame.withColumns(
            {
                "granularity": F.lit("request"), "vendor": F.lit("openai"), "requests": F.lit(1),
                "status_type": F.lit("number"), "source": F.lit("log"),
            }
        )
    )
    return rows, usage


def sequential_replay(rows, model, ttl, write_price):
    price = BOOK[model]
    calls = sorted((r for r in rows if r["model"] == model and r["hashes"]), key=lambda r: (r["second"], r["seq"]))

    def walk(ordered):
        used, out = {}, {}
        for r in ordered:
            tokens = 0.0
            for h, c in reversed(list(zip(r["hashes"], r["chars"]))):
                if h in used and abs(r["second"] - used[h]) <= ttl:
                    tokens = c * r["tokens"] / r["chars"][-1]
                    tokens = tokens if tokens >= price["min_cacheable"] else 0.0
                    break
            out[r["seq"]] = tokens
            used.update(dict.fromkeys(r["hashes"], r["second"]))
        return out

    hit, later, cost = walk(calls), walk(calls[::-1]), {}
    for r in calls:
        h, total = hit[r["seq"]], r["tokens"]
        w = min(max(later[r["seq"]] - h, 0), total - h)
        cost[r["seq"]] = (h * price["p_cached"] + w * write_price + (total - h - w) * price["p_input"]) / 1e6
    return cost


def test_replay(spark, case):
    rows, usage = case
    found = {r.seq: r for r in reuse.cache_replay(spark, usage).collect()}
    assert len(found) == sum(bool(r["hashes"]) for r in rows)
    for model in MODELS:
        price = BOOK[model]
        for seq, cost in sequential_replay(rows, model, price["ttl_seconds"], price["p_write"]).items():
            assert found[seq].cost_own == pytest.approx(cost), seq
        if price["p_write_1h"]:
            for seq, cost in sequential_replay(rows, model, 3600, price["p_write_1h"]).items():
                assert found[seq].cost_hour == pytest.approx(cost), seq


def test_repeats(spark, case):
    rows, usage = case
    last, repeated, sums = {}, set(), {}
    for r in sorted(rows, key=lambda r: (r["second"], r["seq"])):
        key = (r["model"], r["request"])
        cost = r["tokens"] * BOOK[r["model"]]["p_input"] / 1e6
        total = sums.setdefault(r["model"], [0.0, 0.0, 0.0])
        total[0] += cost
        if r["request"] is not None and key in last and r["second"] - last[key] <= 86_400:
            repeated.add(r["seq"])
            total[1] += cost
        elif r["status"] == "500":
            total[2] += cost
        last[key] = r["second"]
    assert {r.seq for r in duplicates.duplicate_calls(spark, usage).collect()} == repeated
    for r in duplicates.duplicate_rates(spark, usage).collect():
        total, dup, failed = sums[r.model_key]
        assert (r.cost_usd, r.dup_rate, r.fail_rate) == pytest.approx((total, dup / total, failed / total))


def test_stable_prefix(spark, case):
    rows, usage = case
    found = {r.model_key: r.prefix_chars for r in reuse.stable_prefix(spark, usage).collect()}
    for model in MODELS:
        calls = sorted((r for r in rows if r["model"] == model and r["hashes"]), key=lambda r: (r["second"], r["seq"]))
        best = None
        for k in range(5):
            at = {}
            for r in calls:
                if k < len(r["hashes"]):
                    at.setdefault(r["hashes"][k], []).append(r["chars"][k])
            top = max(at.values(), key=len, default=[])
            if not top or len(top) / len(calls) < 0.5:
                break
            best = int(statistics.median(top))
        assert found.get(model) == best
