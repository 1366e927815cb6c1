"""Input in too few splits is dealt out to all cores; nothing else about it changes."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from spendscope import adapters
from spendscope.functions import spread as sp
from spendscope.queries import queries
from spendscope.sources import request_log
from spendscope.sources.load import load_usage

SMALLEST = "/root/testdata/sf0.001"


def calls(n):
    return [
        json.dumps({"timestamp": 1785715200 + i, "model": "gpt-5.4", "workload": f"w{i % 3}", "usage": {"prompt_tokens": i, "completion_tokens": 1}})
        for i in range(n)
    ]


@pytest.fixture
def log(tmp_path):
    path = tmp_path / "a log" / "50%20.jsonl.gz"
    path.parent.mkdir()
    path.write_bytes(gzip.compress("\n".join([*calls(200), "not json", ""]).encode()))
    return str(path.parent)


def test_a_gzip_log_is_dealt_to_all_cores(spark, log, monkeypatch):
    lines = request_log.read_lines(spark, log)
    assert lines.rdd.getNumPartitions() == 1
    assert sp.spread(lines) is lines  # too small
    monkeypatch.setattr(sp, "LEAST_BYTES", 1)
    dealt = sp.spread(lines)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() == spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, lines.collect()))  # seq and split_start are the file's


def test_size_is_that_of_the_files(spark, log, tmp_path):
    assert sp.input_bytes(spark.read.text(log)) == (tmp_path / "a log" / "50%20.jsonl.gz").stat().st_size


def test_the_load_is_the_same(spark, log, monkeypatch):
    def loaded():
        found = load_usage(spark, logs_jsonl=log)
        rows = sorted(found.usage.select("seq", "workload", "uncached_input_tokens").collect()), sorted(found.notes.collect(), key=str)
        found.release()
        return rows

    once = loaded()
    assert len(once[0]) == 200 and [r.n for r in once[1] if r.code == "invalid_json"] == [1]
    monkeypatch.setattr(sp, "LEAST_BYTES", 1)
    assert loaded() == once


def test_many_splits_are_left_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sp, "LEAST_BYTES", 0)
    spark.range(100).repartition(9).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        table = spark.read.parquet(str(tmp_path / "t"))
        assert sp.spread(table) is table
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_an_empty_table(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "t"))
    assert sp.spread(spark.read.parquet(str(tmp_path / "t"))).collect() == []


def test_pruning_and_filters_pass_below_the_exchange(spark, monkeypatch):
    monkeypatch.setattr(sp, "LEAST_BYTES", 0)
    dealt = adapters.table(spark, SMALLEST, "lineitem").filter("l_quantity > 40").select("l_partkey")
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" in plan and "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan


@pytest.mark.parametrize("name", ["src_openai_usage", "detect_kind", "cache_replay", "output_quantiles", "data_quality", "eval_gate"])
def test_queries_give_the_same_rows(spark, monkeypatch, name):
    rows = lambda: sorted(map(str, queries()[name](spark, SMALLEST).collect()))
    plain = rows()
    monkeypatch.setattr(sp, "LEAST_BYTES", 0)
    assert rows() == plain
