"""Captures and their insights: ingest, list, look up, upsert, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorekeep import schemas as S
from lorekeep.functions.keys import write_time
from lorekeep.functions.tags import tags_ordered_distinct
from lorekeep.functions.text import char_count, content_type, keyword, line_count, nz, utrim
from lorekeep.operators.first_wins import WriteResult, attach_per_key, new_rows, outcomes, resolve_keys
from lorekeep.operators.search import CaptureFilter, has_keyword, newest_first, page_ids
from lorekeep.session import stage
from lorekeep.sources.trigrams import TrigramIndex

EMPTY = "empty"


def normalize_captures(rows: DataFrame) -> DataFrame:
    """Raw ``(seq, content[, source, captured_at])`` rows as captures without an id.

    ``reject`` is ``empty`` for text that is blank after trimming, else null.
    """
    have = rows.columns
    source = F.col("source") if "source" in have else F.lit(S.DEFAULT_CAPTURE_SOURCE)
    at = F.date_trunc("second", F.col("captured_at")) if "captured_at" in have else F.lit(None)
    return rows.select(
        "seq",
        utrim(nz(F.col("content"))).alias("content"),
        F.coalesce(source, F.lit(S.DEFAULT_CAPTURE_SOURCE)).alias("source"),
        at.cast("timestamp").alias("captured_at"),
    ).select(
        "seq",
        "content",
        content_type(F.col("content")).alias("content_type"),
        char_count(F.col("content")).alias("char_count"),
        line_count(F.col("content")).alias("line_count"),
        "source",
        "captured_at",
        F.when(F.col("content") == "", EMPTY).alias("reject"),
    )


def keyed_captures(rows: DataFrame) -> DataFrame:
    """``(seq, reject, content_hash)``, staged."""
    text = utrim(nz(F.col("content")))
    narrow = rows.select(
        "seq",
        F.when(text == "", EMPTY).alias("reject"),
        F.when(text != "", F.sha2(text, 256)).alias("content_hash"),
    )
    return stage(narrow, "capture-keys")


def insert_captures(stored: DataFrame | None, rows: DataFrame, as_of=None) -> WriteResult:
    """Stores each text whose hash is new; a duplicate reports the stored id."""
    keyed = keyed_captures(rows)
    resolved = resolve_keys(keyed, stored, "content_hash")
    fresh = captured_rows(rows, resolved, as_of)
    table = fresh if stored is None else stored.unionByName(fresh)
    return WriteResult(table, outcomes(keyed, resolved, "content_hash"))


def captured_rows(rows: DataFrame, resolved: DataFrame, as_of=None) -> DataFrame:
    fresh = new_rows(normalize_captures(rows), resolved, "content_hash")
    return S.conform(
        fresh.withColumn("captured_at", F.coalesce(F.col("captured_at"), write_time(as_of))), S.CAPTURE
    )


def with_capture_time(report: DataFrame, captures: DataFrame) -> DataFrame:
    """Adds the stored capture time to an outcome report.

    Many rows of a report may share one id, and all rejected rows the null one: ids meet their time per key.
    """
    report = stage(report, "report")
    uses = report.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    times = stage(captures.select("id", "captured_at").join(uses, "id"), "capture-times")
    return attach_per_key(report, times, "id")


def public_insight(insights: DataFrame) -> DataFrame:
    """Without the hidden raw response."""
    return insights.drop("raw_json")


def with_insight(captures: DataFrame, insights: DataFrame, how: str = "left") -> DataFrame:
    """Each capture with its insight as a nested struct, null where there is none."""
    nested = insights.select(F.col("capture_id").alias("id"), F.struct(*insights.columns).alias("insight"))
    return captures.join(nested, "id", how)


def filter_analyzed(captures: DataFrame, insights: DataFrame, analyzed: bool | None) -> DataFrame:
    if analyzed is None:
        return captures
    keys = insights.select(F.col("capture_id").alias("id"))
    return captures.join(keys, "id", "left_semi" if analyzed else "left_anti")


def unanalyzed(captures: DataFrame, insights: DataFrame) -> DataFrame:
    return filter_analyzed(captures, insights, False)


CAPTURE_TEXTS = ("content", "content_type")
INSIGHT_TEXTS = ("summary", "category")


def matching_captures(
    captures: DataFrame,
    insights: DataFrame,
    f: CaptureFilter,
    own_index: TrigramIndex | None = None,
    told_index: TrigramIndex | None = None,
) -> DataFrame:
    """``(id, captured_at)`` of the captures that pass the analysed filter and the keyword.

    Each table is searched where it lies and only narrow rows are shuffled: a capture matches by its
    own text, or because its insight matches.  An index of ``CAPTURE_TEXTS`` or of ``INSIGHT_TEXTS``
    (by ``capture_id``) saves reading most texts; the rows are the same.
    """
    narrow = captures.select("id", "captured_at")
    word = keyword(f.query)
    if word:
        near = own_index.narrowed(captures, word) if own_index else captures
        near_told = told_index.narrowed(insights, word) if told_index else insights
        own = near.where(has_keyword(word, *CAPTURE_TEXTS)).select("id", "captured_at")
        told = near_told.where(has_keyword(word, *INSIGHT_TEXTS)).select(F.col("capture_id").alias("id"))
        narrow = own.unionByName(narrow.join(told, "id", "left_semi")).distinct()
    return filter_analyzed(narrow, insights, f.analyzed)


def _picked(captures: DataFrame, insights: DataFrame, ids: DataFrame) -> DataFrame:
    """The captures of ``ids`` (unique) with their insights; both tables are reduced before they meet."""
    told = insights.join(ids.select(F.col("id").alias("capture_id")), "capture_id", "left_semi")
    return with_insight(captures.join(ids.select("id"), "id", "left_semi"), told)


def search_captures(
    captures: DataFrame,
    insights: DataFrame,
    f: CaptureFilter,
    own_index: TrigramIndex | None = None,
    told_index: TrigramIndex | None = None,
) -> DataFrame:
    return _picked(captures, insights, matching_captures(captures, insights, f, own_index, told_index))


def list_captures(captures: DataFrame, insights: DataFrame, f: CaptureFilter) -> DataFrame:
    """One page, newest first.  The page is found on narrow rows; its at most 100 ids go into both scans
    as a pushed-down filter."""
    ids = page_ids(matching_captures(captures, insights, f), "captured_at", f.limit, f.offset)[0]
    told = public_insight(insights).where(F.col("capture_id").isin(ids))
    rows = with_insight(captures.where(F.col("id").isin(ids)), told)
    return newest_first(rows, "captured_at", f.limit, 0)


def lookup_captures(captures: DataFrame, insights: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, found, ...)`` for each asked id; a missing capture has ``found = false``."""
    asked = ids.select("id").distinct()
    hits = _picked(captures, public_insight(insights), asked).withColumn("found", F.lit(True))
    return asked.join(hits, "id", "left").withColumn("found", F.coalesce(F.col("found"), F.lit(False)))


def upsert_insights(stored: DataFrame | None, rows: DataFrame, as_of=None) -> DataFrame:
    """The insight table after inserting or overwriting by ``capture_id``; the last ``seq`` per id stays."""
    last = rows.groupBy("capture_id").agg(F.max("seq").alias("seq"))
    chosen = rows.drop("capture_id").join(last, "seq")
    fresh = S.conform(
        chosen.withColumn("tags", tags_ordered_distinct(F.col("tags"))).withColumn("analyzed_at", write_time(as_of)),
        S.INSIGHT,
    )
    fresh = S.fill_defaults(fresh)
    if stored is None:
        return fresh
    return stored.join(last.select("capture_id"), "capture_id", "left_anti").unionByName(fresh)


def delete_captures(captures: DataFrame, insights: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given ids; an unknown id is no error, and insights go with their capture."""
    return without_captures(captures, "id", ids), without_captures(insights, "capture_id", ids)


def without_captures(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` (any part of a table) without those whose ``key`` is among ``ids``."""
    return rows.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def clear_unanalyzed(captures: DataFrame, insights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The captures that have an insight, and one row ``(deleted)``."""
    keep = filter_analyzed(captures, insights, True)
    return keep, unanalyzed(captures, insights).agg(F.count(F.lit(1)).alias("deleted"))

