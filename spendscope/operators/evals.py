"""Eval set scoring and the quality gate for model changes.

Cases and outputs are tables. One join brings them together; the checks of a case are evaluated inside its
row with higher-order functions, so nothing is exploded and no output text is shuffled a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Check kinds and how much the candidate may lose.
CHECK_KINDS = ["exact", "contains", "contains_all", "one_of", "json_field"]
EVAL_TOLERANCE = 0.02

CHECK_TYPE = "array<struct<kind:string,field:string,value:string,values:array<string>>>"


# All characters that separate words, not only the ASCII ones.
WHITESPACE = r"[\s\x0B\x1c-\x1f\x85\p{Z}]+"


def normal_text(text: Column) -> Column:
    """Lower case, runs of whitespace as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), WHITESPACE, " "))


def json_fields(output: Column, checks: Column) -> Column:
    """Fields of an output that is a JSON object, parsed once and only where a check asks for a field."""
    asked = F.exists(checks, lambda c: c["kind"] == "json_field")
    return F.when(asked, F.from_json(output, "map<string,string>"))


def check_passes(fields: Column, normal_output: Column, check: Column) -> Column:
    """``check.values`` holds every accepted or required text; ``check.value`` a single one."""
    wanted = F.transform(check["values"], normal_text)
    single = normal_text(check["value"])
    field = F.try_element_at(fields, check["field"])
    kind = check["kind"]
    return (
        F.when(kind == "exact", normal_output == single)
        .when(kind == "contains", normal_output.contains(single))
        .when(kind == "contains_all", F.forall(wanted, lambda w: normal_output.contains(w)))
        .when(kind == "one_of", F.exists(wanted, lambda w: normal_output == w))
        .when(
            kind == "json_field",
            fields.isNotNull() & field.eqNullSafe(check["value"]),
        )
        .otherwise(F.raise_error(F.concat(F.lit("unknown check type "), kind)).cast("boolean"))
    )


def check_label(check: Column) -> Column:
    return F.concat(check["kind"], F.lit(":"), F.coalesce(F.nullif(check["field"], F.lit("")), check["value"], F.lit("")))


def last_outputs(outputs: DataFrame) -> DataFrame:
    """One output per id: the last one given wins; outputs without an id are dropped."""
    return (
        outputs.filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max_by(F.struct("output", "model"), "seq").alias("last"))
        .select("id", F.coalesce("last.output", F.lit("")).alias("output"), F.coalesce("last.model", F.lit("")).alias("model"))
    )


def eval_items(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """One scored row per case: (id, workload, seq, passed, missing, failed_checks, model)."""
    joined = cases.join(last_outputs(outputs), "id", "left")
    joined = joined.withColumns(
        {
            "workload": F.coalesce(F.nullif(F.col("workload"), F.lit("")), F.lit("all")),
            "missing": F.col("output").isNull(),
            "normal_output": normal_text(F.col("output")),
            "fields": json_fields(F.col("output"), F.col("checks")),
        }
    )
    failed = F.filter(
        F.coalesce("checks", F.array().cast(CHECK_TYPE)),
        lambda c: ~F.coalesce(check_passes(F.col("fields"), F.col("normal_output"), c), F.lit(False)),
    )
    labels = F.when(F.col("missing"), F.array(F.lit("missing output"))).otherwise(F.transform(failed, check_label))
    return joined.withColumn("failed_checks", labels).select(
        "id",
        "workload",
        "seq",
        (F.size("failed_checks") == 0).alias("passed"),
        "missing",
        "failed_checks",
        F.coalesce("model", F.lit("")).alias("model"),
    )


def eval_checks(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Result of every single check of the cases that have an output."""
    joined = cases.join(last_outputs(outputs), "id").withColumns(
        {"normal_output": normal_text(F.col("output")), "fields": json_fields(F.col("output"), F.col("checks"))}
    )
    exploded = joined.select("id", "normal_output", "fields", F.posexplode("checks").alias("check_no", "check"))
    return exploded.select(
        "id",
        "check_no",
        F.col("check.kind").alias("kind"),
        check_passes(F.col("fields"), F.col("normal_output"), F.col("check")).alias("passed"),
    )


def eval_score(items: DataFrame) -> DataFrame:
    """Overall score: cases, passed and rate."""
    return items.agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed")).withColumn(
        "rate", F.coalesce(F.col("passed") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    )


def eval_models(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Models that produced each side's outputs, and how many."""
    sides = [items.select(F.lit(side).alias("side"), "model") for side, items in (("baseline", baseline), ("candidate", candidate))]
    return sides[0].unionByName(sides[1]).filter(F.col("model") != "").groupBy("side", "model").agg(F.count(F.lit(1)).alias("n"))


def workload_scores(items: DataFrame) -> DataFrame:
    return items.groupBy("workload").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"))


def eval_gate(baseline: DataFrame, candidate: DataFrame, tolerance: float = EVAL_TOLERANCE) -> DataFrame:
    """Baseline against candidate, as one row; both inputs are scored items."""

    def one_row(items: DataFrame, side: str) -> DataFrame:
        return eval_score(items).select(
            F.lit(1).alias("one"), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "passed", "rate")]
        )

    rows = one_row(baseline, "baseline").join(F.broadcast(one_row(candidate, "candidate")), "one").drop("one")
    return rows.withColumns(
        {
            "delta": F.col("candidate_rate") - F.col("baseline_rate"),
            "tolerance": F.lit(tolerance),
            "gate_pass": F.col("candidate_rate") + 1e-12 >= F.col("baseline_rate") - tolerance,
        }
    )


def eval_regressions(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Cases the candidate fails although the baseline passed them."""
    passed = baseline.filter("passed").select("id").distinct()
    return candidate.filter(~F.col("passed")).join(passed, "id", "left_semi")


def first_regressions(regressions: DataFrame, n: int = 8) -> DataFrame:
    return regressions.orderBy("seq").limit(n)


def eval_by_workload(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    def side(items: DataFrame, name: str) -> DataFrame:
        scores = workload_scores(items).withColumn("rate", F.col("passed") / F.col("n"))
        return scores.select("workload", *[F.col(c).alias(f"{name}_{c}") for c in ("n", "passed", "rate")])

    return (
        side(baseline, "baseline")
        .join(side(candidate, "candidate"), "workload", "full_outer")
        .withColumn("delta", F.col("candidate_rate") - F.col("baseline_rate"))
        .orderBy("workload")
    )


def eval_skeleton(cells: DataFrame, first: int | None = None) -> DataFrame:
    """One empty case per workload, dearest first; ``first`` keeps so many.

    Costs are not normalised and cover buckets and requests alike.
    """
    named = (
        cells.filter(F.col("workload").isNotNull())
        .groupBy("workload")
        .agg(F.sum("cost_usd").alias("cost"))
        .filter(~F.col("workload").isin("", "all", "nan"))
    )
    top = named if first is None else named.orderBy(F.desc("cost"), "workload").limit(first)
    # Without a named workload the skeleton has one catch-all case.
    catch_all = top.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0)
    names = top.unionByName(catch_all.select(F.lit("all").alias("workload"), F.lit(0.0).alias("cost")))
    # A row per workload name is left to number.
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("cost"), "workload")
    numbered = names.withColumn("rank", F.row_number().over(order))
    return numbered.select(
        "rank",
        F.concat("workload", F.lit("_"), F.format_string("%03d", "rank")).alias("id"),
        "workload",
        F.lit("").alias("input"),
        F.array().cast(CHECK_TYPE).alias("checks"),
    )


def write_eval_skeleton(skeleton: DataFrame, folder: str) -> None:
    skeleton.orderBy("rank").drop("rank").coalesce(1).write.json(folder)
