"""Import of candidates into the solution table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorekeep.functions.tags import concat_tags
from lorekeep.functions.text import fallback_status, fallback_untrimmed
from lorekeep.operators.first_wins import outcome_counts, outcomes, resolve_keys
from lorekeep.operators.solutions import append_created, created_solutions, keyed_creates
from lorekeep.sources.candidates import DEFAULT_SOURCES, SourceRegistry


@dataclass(frozen=True)
class ImportResult:
    """``summary`` is one row ``(imported, duplicates, skipped)``; ``created`` the new solutions."""

    table: DataFrame
    created: DataFrame
    outcomes: DataFrame
    summary: DataFrame


def candidate_requests(
    candidates: DataFrame, adapter: str, default_status: str | None = None, default_tags: Sequence[str] = ()
) -> DataFrame:
    """Create requests from candidates: always ``auto``, blanks filled from the batch defaults."""
    return candidates.select(
        "seq",
        "title",
        "problem",
        "solution_text",
        F.lit("").alias("raw_content"),
        F.lit("auto").alias("efficacy_source"),
        fallback_status(F.col("status"), default_status).alias("status"),
        fallback_untrimmed(F.col("source_type"), F.lit(adapter)).alias("source_type"),
        fallback_untrimmed(F.col("source_name"), F.lit(adapter)).alias("source_name"),
        "source_ref",
        "raw_content_ref",
        concat_tags(F.col("tags"), default_tags).alias("tags"),
    )


def import_candidates(
    candidates: DataFrame,
    stored: DataFrame | None = None,
    *,
    adapter: str = "local_json",
    default_status: str | None = None,
    default_tags: Sequence[str] = (),
    as_of=None,
) -> ImportResult:
    """Imports ``candidates`` (with ``seq``); all rows or, if the job fails, none."""
    requests = candidate_requests(candidates, adapter, default_status, default_tags)
    keyed = keyed_creates(requests)
    resolved = resolve_keys(keyed, stored, "dedup_key")
    counts = outcome_counts(keyed, resolved).select(
        F.col("created").alias("imported"),
        F.col("duplicate").alias("duplicates"),
        F.col("rejected").alias("skipped"),
    )
    return ImportResult(
        table=append_created(stored, requests, resolved, as_of),
        created=created_solutions(requests, resolved, as_of),
        outcomes=outcomes(keyed, resolved, "dedup_key"),
        summary=counts,
    )


def import_path(
    spark: SparkSession,
    path: str,
    stored: DataFrame | None = None,
    *,
    adapter: str = "local_json",
    sources: SourceRegistry = DEFAULT_SOURCES,
    **defaults,
) -> ImportResult:
    """Reads with the named source and imports.  The candidates are staged: text is parsed once and
    ``seq`` cannot change; it follows file names and places in the files."""
    candidates = sources.read_numbered(spark, adapter, path)
    return import_candidates(candidates, stored, adapter=SourceRegistry.canonical(adapter), **defaults)
