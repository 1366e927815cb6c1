"""Many files in, one usage table and one invoice table out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spendscope.functions.hashing import new_salt
from spendscope.functions.joins import checked_broadcast
from spendscope.functions.spread import spread
from spendscope.functions.tables import Workspace
from spendscope.operators import quality
from spendscope.schema import empty_invoice, empty_usage
from spendscope.session import prepared
from spendscope.sources import csv_usage, exports, request_log


@dataclass
class Loaded:
    usage: DataFrame
    invoice: DataFrame
    notes: DataFrame
    space: Workspace

    def release(self) -> None:
        """Delete the written tables."""
        self.space.release()


def merged(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    """All sources in one frame with one schema."""
    return reduce(DataFrame.unionByName, frames) if frames else empty


def load_usage(
    spark: SparkSession,
    exports_json: str | list[str] | None = None,
    logs_jsonl: str | list[str] | None = None,
    usage_csv: str | list[str] | None = None,
    salt: bytes | None = None,
) -> Loaded:
    """Load exports (JSON pages), request logs (JSONL) and normalised CSV files.

    The kind of every export is found from its first result. Each kind is one projection over the same
    exploded results, filtered by the kinds of their files. The usage table is written once to the shared folder: each
    line is parsed and fingerprinted once, and every table of the analysis reads columns.
    """
    spark = prepared(spark)
    space = Workspace(spark)
    usage, invoices, notes = [], [], []
    if exports_json:
        pages = exports.read_pages(spark, exports_json)
        kinds = space.settle(exports.detect_kind(pages), "kinds")
        unknown = [r.path for r in kinds.filter(F.col("kind") == "unknown").select("path").limit(5).collect()]
        if unknown:
            raise ValueError(f"unrecognised export format: {', '.join(unknown)}")
        found = exports.results(pages).join(checked_broadcast(kinds.select("path", "kind")), "path")
        of = {k: found.filter(F.col("kind") == k) for k in quality.EXPORT_KINDS}
        usage += [
            exports.openai_usage(of["openai_usage"]),
            exports.openai_embeddings(of["openai_embeddings"]),
            exports.anthropic_usage(of["anthropic_usage"]),
        ]
        invoices += [exports.openai_costs(of["openai_costs"]), exports.anthropic_costs(of["anthropic_costs"])]
        notes += [
            quality.skipped_results(exports.skipped_results(of["openai_usage"])),
            quality.long_context(exports.long_context_rows(of["anthropic_usage"])),
            quality.empty_exports(kinds),
        ]
    if logs_jsonl:
        lines = request_log.read_lines(spark, logs_jsonl)
        evals = space.settle(request_log.eval_files(lines), "eval-files")
        records = request_log.parsed(request_log.without_eval_files(spread(lines), evals))
        usage.append(request_log.request_rows(records, salt or new_salt()))
        notes.append(quality.unusable_lines(request_log.lines_without_usage(records)))
    if usage_csv:
        usage.append(csv_usage.read_usage_csv(spark, usage_csv))
    written = Observation("usage")
    frame = space.settle(merged(usage, empty_usage(spark)).observe(written, F.count(F.lit(1)).alias("rows")), "usage")
    if not written.get["rows"]:
        raise ValueError("No usage rows loaded")
    notes.append(quality.usage_notes(spark, frame, space.settle))
    return Loaded(frame, merged(invoices, empty_invoice(spark)), merged(notes, quality.no_notes(spark)), space)
