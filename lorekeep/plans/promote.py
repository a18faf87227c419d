"""Promotion of analysed captures into solutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorekeep import schemas as S
from lorekeep.functions.keys import capture_ref
from lorekeep.functions.tags import append_category
from lorekeep.functions.text import fallback_title, first_non_blank, keep_raw_if_short
from lorekeep.operators.first_wins import WriteResult, attach_per_key
from lorekeep.operators.solutions import create_solutions
from lorekeep.session import stage


def promotion_requests(captures: DataFrame, insights: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Create requests for ``asked(seq, id)`` (``id`` unique), or for all captures in order of their ids; captures without
    an insight drop out."""
    # a long text stays where it lies
    picked = captures.select(
        "id",
        fallback_title(F.col("content")).alias("capture_title"),
        keep_raw_if_short(F.col("content")).alias("raw_content"),
        F.col("source").alias("capture_source"),
    )
    told = insights.withColumnRenamed("capture_id", "id")
    if asked is None:
        picked = picked.withColumn("seq", F.col("id"))
    else:
        picked = picked.join(asked, "id")
        told = told.join(asked.select("id"), "id", "left_semi")
    return picked.join(told, "id").select(
        "seq",
        first_non_blank(F.col("title"), F.col("capture_title")).alias("title"),
        "problem",
        first_non_blank(F.col("solution_text"), F.col("summary")).alias("solution_text"),
        "raw_content",
        F.lit("auto").alias("efficacy_source"),
        first_non_blank(F.col("suggested_status"), F.lit(S.DEFAULT_SUGGESTED_STATUS)).alias("status"),
        F.lit("capture").alias("source_type"),
        first_non_blank(F.col("source_name"), F.col("capture_source")).alias("source_name"),
        capture_ref(F.col("id")).alias("source_ref"),
        capture_ref(F.col("id")).alias("raw_content_ref"),
        append_category(F.col("tags"), F.col("category")).alias("tags"),
    )


def promote_captures(
    captures: DataFrame, insights: DataFrame, stored: DataFrame | None, requests: DataFrame, as_of=None
) -> WriteResult:
    """Promotes ``requests(seq, id)``; ``id`` names a capture.

    Outcomes: ``created``, ``duplicate``, ``invalid``, ``unanalyzed``, ``not_found``.  Asking again for
    a capture in the same batch is a duplicate of its first promotion.
    """
    asked = requests.groupBy("id").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    # read for the keys and for the new rows: captures and insights meet once
    made = stage(promotion_requests(captures, insights, asked.select("seq", "id")), "promotion-requests")
    done = create_solutions(stored, made, as_of)
    report = done.outcomes.select("seq", "outcome", F.col("id").alias("solution_id"))
    known = captures.select("id", F.lit(True).alias("known"))
    per_id = (
        asked.withColumnRenamed("seq", "first_seq")
        .join(known, "id", "left")
        .join(report.withColumnRenamed("seq", "first_seq"), "first_seq", "left")
        .select("id", "n", "first_seq", "known", "outcome", "solution_id")
    )
    per_id = stage(per_id, "promotions")
    again = F.when(F.col("outcome") == "created", "duplicate").otherwise(F.col("outcome"))
    verdict = (
        F.when(F.col("known").isNull(), "not_found")
        .when(F.col("outcome").isNull(), "unanalyzed")
        .when(F.col("seq") == F.col("first_seq"), F.col("outcome"))
        .otherwise(again)
    )
    joined = attach_per_key(requests.select("seq", "id"), per_id, "id")
    return WriteResult(
        done.table, joined.select("seq", verdict.alias("outcome"), F.col("solution_id").alias("id"))
    )
