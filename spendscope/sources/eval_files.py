"""Eval cases and outputs as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.functions import json_values as js
from spendscope.schema import first_non_blank
from spendscope.sources.request_log import numbered_bad_lines, parsed, read_lines


def read_eval_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Parsed lines; a line that is not JSON is an error that names file and line."""
    lines = read_lines(spark, paths)
    bad = numbered_bad_lines(lines).orderBy("path", "line_no").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].path}:{bad[0].line_no}: invalid JSON")
    return parsed(lines)


def _plain(value: Column) -> Column:
    """Scalar as text; objects and lists as JSON."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))


def cases(records: DataFrame) -> DataFrame:
    """(id, workload, seq, checks) with the check values as texts."""

    def check(c: Column) -> Column:
        value = F.try_variant_get(c, "$.value", "variant")
        listed = F.try_variant_get(value, "$", "array<string>")
        kind = first_non_blank(
            F.try_variant_get(c, "$.type", "string"), F.try_variant_get(c, "$.kind", "string"), default="contains"
        )
        return F.struct(
            kind.alias("kind"),
            F.try_variant_get(c, "$.field", "string").alias("field"),
            _plain(value).alias("value"),
            F.when(js.kind_of(value) == "array", listed).otherwise(F.array(_plain(value))).alias("values"),
        )

    rec = F.col("rec")
    return records.select(
        js.text(rec, "id").alias("id"),
        js.text(rec, "workload").alias("workload"),
        "seq",
        F.transform(js.get(rec, "checks", "array<variant>"), check).alias("checks"),
    )


def outputs(records: DataFrame) -> DataFrame:
    rec = F.col("rec")
    return records.filter(js.has_key(rec, "id")).select(
        js.text(rec, "id").alias("id"), js.text(rec, "output").alias("output"), js.text(rec, "model").alias("model"), "seq"
    )
