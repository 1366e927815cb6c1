"""Times the headline queries; prints one JSON line.

Each query is timed from building its plan to the last result row being computed in Spark (nothing is
pulled to the driver). One untimed run warms up the JVM and the code generator; results are never cached
between queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spendscope import queries as registry  # noqa: E402
from spendscope.session import local_session  # noqa: E402

HEADLINE = [
    "priced_usage", "by_model", "by_workload", "reconcile", "src_openai_usage", "src_anthropic_usage",
    "src_request_log", "duplicate_rates", "cache_replay", "stable_prefix", "levers", "combined_savings",
    "eval_gate", "fp_prefixes", "data_quality",
]


def run(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("OFF")
    all_queries, seconds = registry.queries(), {}
    for name in names:
        run(spark, all_queries[name], sf_dir)
        seconds[name] = round(statistics.median(run(spark, all_queries[name], sf_dir) for _ in range(repeats)), 3)
        print(name, seconds[name], file=sys.stderr)
    line = {
        "metric": "headline queries, warm, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
