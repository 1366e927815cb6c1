"""Registered queries against their SQL on the smallest tables (the full comparison: ``python -m oracle.check``)."""

import os

import pytest

from oracle.check import compare, connect
from oracle.sql import oracle_sql
from spendscope.queries import queries

SF_DIR = "/root/testdata/sf0.001"
CHECKED = [
    "src_openai_usage", "src_openai_embeddings", "src_openai_costs", "src_anthropic_usage", "src_anthropic_costs", "src_request_log",
    "src_normalised_csv", "usage_shape_map", "detect_kind", "skip_eval_files", "eval_bad_lines", "ts_parse", "priced_usage",
    "spend_of_record", "reconcile", "data_quality", "cache_replay", "duplicate_calls", "levers", "lever_evidence", "summary",
    "plan_cache", "plan_migration", "plan_duplicates", "eval_checks", "eval_items", "eval_score", "eval_models", "eval_init",
    "fp_prefixes", "fp_redact",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not mounted")


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    problem = compare(connect(SF_DIR), spark, SF_DIR, queries()[name], oracle_sql()[name])
    assert problem is None, problem
