"""The end-to-end analysis: named, lazily built tables over one normalised usage table.

Nothing is computed until a table is used. The rows are read a handful of times at most: for the cells, the
replay, the duplicate check, the token quantiles and the invoice check, each with only the columns it needs.
The cells, the two rate tables and the lever contributions are small and read many times, so they are
written once to the shared folder and read back from there.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.functions.tables import Workspace
from spendscope.operators import breakdowns, cells as cl, duplicates, quality, reuse
from spendscope.plans import actions, evidence, levers as lv
from spendscope.session import prepared

# A year must save this multiple of the audit price.
GUARANTEE_MULTIPLE = 3
AUDIT_PRICE_USD = 1900


class Analysis:
    """Tables of one analysis. ``batchable`` names workloads confirmed as non-interactive; ``notes`` are those of the
    load, ``eval_result`` a gate row, both for the report; ``as_of`` is the day on which the prices' age is told."""

    def __init__(
        self,
        spark: SparkSession,
        usage: DataFrame,
        invoice: DataFrame | None = None,
        batchable: Iterable[str] = (),
        notes: DataFrame | None = None,
        eval_result: DataFrame | None = None,
        as_of: dt.date | None = None,
    ):
        self.spark = prepared(spark)
        self.usage = usage
        self.invoice = invoice
        self.batchable = sorted(batchable)
        self.load_notes = notes
        self.eval_result = eval_result
        self.as_of = as_of or dt.date.today()
        self.workspace = Workspace(self.spark)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.workspace.settle(df, name)

    # -- shared inputs

    @cached_property
    def raw_cells(self) -> DataFrame:
        return self._keep(cl.usage_cells(self.spark, self.usage), "raw_cells")

    @cached_property
    def cells(self) -> DataFrame:
        return self._keep(cl.with_monthly_factor(self.raw_cells), "cells")

    @cached_property
    def spend(self) -> DataFrame:
        """Cells of the spend of record."""
        return cl.spend_of_record(self.cells)

    @cached_property
    def chat_cells(self) -> DataFrame:
        return cl.chat_only(self.cells)

    @cached_property
    def chat_spend(self) -> DataFrame:
        return cl.chat_only(self.spend)

    @cached_property
    def chat_usage(self) -> DataFrame:
        return cl.chat_only(self.usage)

    @cached_property
    def replay(self) -> DataFrame:
        return reuse.cache_replay(self.spark, self.chat_usage)

    @cached_property
    def cache_rates(self) -> DataFrame:
        return self._keep(lv.cache_rates(self.spark, self.chat_cells, self.replay), "cache_rates")

    @cached_property
    def duplicate_rates(self) -> DataFrame:
        return self._keep(duplicates.duplicate_rates(self.spark, self.chat_usage), "duplicate_rates")

    @cached_property
    def stable_prefix(self) -> DataFrame:
        return reuse.stable_prefix(self.spark, self.chat_usage)

    # -- breakdowns

    @cached_property
    def periods(self) -> DataFrame:
        return cl.source_periods(self.raw_cells)

    @cached_property
    def monthly_spend(self) -> DataFrame:
        return breakdowns.total_spend(self.spend)

    @cached_property
    def by_model(self) -> DataFrame:
        return breakdowns.by_model(self.spend)

    @cached_property
    def by_workload(self) -> DataFrame:
        return breakdowns.by_workload(self.spend)

    @cached_property
    def top_workloads(self) -> DataFrame:
        return breakdowns.top_workloads(self.spend)

    @cached_property
    def by_token_type(self) -> DataFrame:
        return breakdowns.by_token_type(self.spend)

    @cached_property
    def embedding_spend(self) -> DataFrame:
        return breakdowns.embedding_spend(self.spend)

    @cached_property
    def reconciliation(self) -> DataFrame | None:
        if self.invoice is None:
            return None
        return breakdowns.reconcile(breakdowns.daily_costs(self.spark, self.usage), self.invoice)

    # -- levers

    @cached_property
    def migration(self) -> DataFrame:
        return lv.lever_migration(self.spark, self.chat_spend)

    @cached_property
    def routing(self) -> DataFrame:
        return lv.lever_routing(self.spark, self.chat_spend, self.chat_cells)

    @cached_property
    def cache_scenario(self) -> DataFrame:
        return lv.cache_scenario(self.spark, self.chat_spend)

    @cached_property
    def caching(self) -> DataFrame:
        return lv.lever_caching(self.spark, self.chat_spend, self.cache_rates)

    @cached_property
    def batch(self) -> DataFrame:
        return lv.lever_batch(self.spark, self.chat_spend, self.chat_cells, self.batchable)

    @cached_property
    def batch_what_if(self) -> DataFrame:
        return lv.batch_what_if(self.batch)

    @cached_property
    def output(self) -> DataFrame:
        return lv.lever_output(self.chat_spend, self.chat_cells)

    @cached_property
    def duplicates(self) -> DataFrame:
        return lv.lever_duplicates(self.chat_spend, self.duplicate_rates)

    @cached_property
    def fast_mode(self) -> DataFrame:
        return lv.lever_fast_mode(self.spark, self.chat_spend)

    @cached_property
    def contributions(self) -> DataFrame:
        """A few rows per model or workload; kept because totals, details and evidence all read it."""
        parts = [self.migration, self.routing, self.caching, self.batch, self.output, self.duplicates, self.fast_mode]
        return self._keep(lv.all_contributions(parts), "contributions")

    @cached_property
    def levers(self) -> DataFrame:
        return lv.lever_totals(self.spark, self.contributions, batchable=bool(self.batchable))

    @cached_property
    def lever_detail(self) -> DataFrame:
        return lv.lever_detail(self.contributions)

    @cached_property
    def top_lever_rows(self) -> DataFrame:
        return lv.top_lever_rows(self.lever_detail)

    @cached_property
    def summary_levers(self) -> DataFrame:
        return lv.summary_levers(self.levers)

    @cached_property
    def combined(self) -> DataFrame:
        return lv.combined_savings(self.levers, self.monthly_spend.scalar())

    @cached_property
    def output_quantiles(self) -> DataFrame:
        return lv.output_quantiles(self.chat_usage)

    @cached_property
    def lever_evidence(self) -> DataFrame:
        options = lv.batch_options(self.spark, self.chat_spend, self.chat_cells, self.batchable)
        return evidence.all_facts(
            [
                evidence.migration_facts(lv.migration_options(self.spark, self.chat_spend)),
                evidence.routing_facts(lv.routing_options(self.spark, self.chat_spend, self.chat_cells)),
                evidence.caching_facts(self.chat_spend, self.cache_rates, self.cache_scenario),
                evidence.batch_facts(options, self.batch_what_if, self.batchable),
                evidence.output_facts(self.contributions, lv.reasoning_share(self.chat_cells), self.output_quantiles),
                evidence.duplicate_facts(self.duplicate_rates),
                evidence.fast_facts(self.contributions),
            ]
        )

    # -- action tables: each reads its own lever alone, so none waits for the replay or the duplicate check of another

    def _totals(self, lever: DataFrame) -> DataFrame:
        return lv.lever_totals(self.spark, lever, batchable=bool(self.batchable))

    @cached_property
    def plan_migration(self) -> DataFrame:
        return actions.plan_migration(lv.lever_detail(self.migration), self.chat_spend)

    @cached_property
    def plan_routing(self) -> DataFrame:
        return actions.plan_routing(self.spark, self._totals(self.routing), self.chat_cells)

    @cached_property
    def plan_cache(self) -> DataFrame:
        return actions.plan_cache(lv.lever_detail(self.caching), self.cache_rates, self.stable_prefix, self.chat_spend)

    @cached_property
    def plan_batch(self) -> DataFrame:
        return actions.plan_batch(lv.lever_detail(self.batch))

    @cached_property
    def plan_max_tokens(self) -> DataFrame:
        return actions.plan_max_tokens(self._totals(self.output), self.chat_usage)

    @cached_property
    def plan_duplicates(self) -> DataFrame:
        return actions.plan_duplicates(lv.lever_detail(self.duplicates))

    @cached_property
    def plan_fast(self) -> DataFrame:
        return actions.plan_fast(self._totals(self.fast_mode), self.chat_spend)

    # -- summary

    @cached_property
    def summary(self) -> DataFrame:
        """One row: spend, savings per month and year, covered period, guarantee check."""
        totals = self.spend.agg(
            F.timestamp_micros(F.min("first_us")).alias("period_start"),
            F.timestamp_micros(F.max("last_us")).alias("period_end"),
            F.min(F.struct("first_us")).alias("first"),
            F.max("last_us").alias("last_us"),
        ).select("period_start", "period_end", cl.period_days(F.col("first.first_us"), F.col("last_us")).alias("days"))
        # Both sides are single-row aggregates.
        stacked = self.combined.withColumn("one", F.lit(1)).join(F.broadcast(totals.withColumn("one", F.lit(1))), "one")
        yearly = {f"{name}_yearly": F.col(name) * 12 for name in lv.SCENARIOS}
        return stacked.withColumns(
            {
                **yearly,
                "base_share": F.col("base") / F.nullif(F.col("monthly_spend"), F.lit(0.0)),
                "guarantee_met": F.col("base") * 12 >= float(GUARANTEE_MULTIPLE * AUDIT_PRICE_USD),
            }
        ).drop("one")

    @property
    def notes(self) -> DataFrame:
        """Data-quality notes: those of the load, or of the usage table, and the age of the prices."""
        found = quality.usage_notes(self.spark, self.usage, self._keep) if self.load_notes is None else self.load_notes
        return found.unionByName(quality.stale_prices(self.spark, self.as_of))

    @property
    def prices(self) -> DataFrame:
        """When the price list was verified, and how old it is."""
        return quality.price_date(self.spark, self.as_of)

    def tables(self) -> dict[str, DataFrame]:
        """Every result table by name (the machine-readable report)."""
        names = [
            "summary", "levers", "lever_detail", "lever_evidence", "by_model", "by_workload", "by_token_type",
            "embedding_spend", "plan_migration", "plan_routing", "plan_cache", "plan_batch", "plan_max_tokens",
            "plan_duplicates", "plan_fast", "notes", "prices",
        ]
        found = {name: getattr(self, name) for name in names}
        if self.reconciliation is not None:
            found["reconciliation"] = self.reconciliation
        if self.eval_result is not None:
            found["eval_result"] = self.eval_result
        return found

    def write(self, folder: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
        for name, df in self.tables().items():
            df.write.format(fmt).mode(mode).save(f"{folder}/{name}")

    def release(self) -> None:
        """Delete the written intermediate tables; tables built from them stop working."""
        self.workspace.release()
