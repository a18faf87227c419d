"""Create, update, delete and look up solutions; DataFrames of requests in, new table state out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lorekeep import schemas as S
from lorekeep.functions.keys import dedup_key, write_time
from lorekeep.functions.tags import nz_tags, tags_sorted_set
from lorekeep.functions.text import nz, trimmed_lower, utrim
from lorekeep.operators.first_wins import (
    WriteResult,
    attach_per_key,
    first_per_key,
    new_rows,
    outcomes,
    resolve_keys,
)
from lorekeep.session import stage

INVALID = "invalid"
TRIMMED = ("title", "problem", "solution_text", "raw_content", "source_name", "source_ref", "raw_content_ref")
TRIMMED_LOWER = ("efficacy_source", "status", "source_type")


def _reject(title: Column, solution_text: Column, status: Column, efficacy: Column | None = None) -> Column:
    """Null for a valid request; else the first rule it breaks."""
    rule = F.when(title == "", "blank_title").when(solution_text == "", "blank_solution_text")
    if efficacy is not None:
        rule = rule.when(~efficacy.isin(*S.EFFICACY_SOURCES), "unknown_efficacy_source")
    return rule.when(~status.isin(*S.STATUSES), "unknown_status")


def normalize_create(requests: DataFrame) -> DataFrame:
    """``seq``, the ten normalised fields, ``tags`` as a sorted set and ``invalid_reason``."""
    have = set(requests.columns)
    field = lambda name: nz(F.col(name)) if name in have else F.lit("")
    return requests.select(
        "seq",
        *[utrim(field(c)).alias(c) for c in TRIMMED],
        *[trimmed_lower(field(c)).alias(c) for c in TRIMMED_LOWER],
        tags_sorted_set(F.col("tags")).alias("tags"),
    ).withColumn(
        "invalid_reason",
        _reject(F.col("title"), F.col("solution_text"), F.col("status"), F.col("efficacy_source")),
    )


def normalize_update(requests: DataFrame) -> DataFrame:
    return requests.select(
        "seq",
        "id",
        *[utrim(nz(F.col(c))).alias(c) for c in ("title", "problem", "solution_text")],
        trimmed_lower(nz(F.col("status"))).alias("status"),
        tags_sorted_set(F.col("tags")).alias("tags"),
    ).withColumn("invalid_reason", _reject(F.col("title"), F.col("solution_text"), F.col("status")))


def keyed_creates(requests: DataFrame) -> DataFrame:
    """``(seq, reject, dedup_key)`` of every request, staged: the texts are hashed once."""
    narrow = normalize_create(requests).select(
        "seq",
        F.when(F.col("invalid_reason").isNotNull(), INVALID).alias("reject"),
        F.when(F.col("invalid_reason").isNull(), dedup_key()).alias("dedup_key"),
    )
    return stage(narrow, "solution-keys")


def create_solutions(stored: DataFrame | None, requests: DataFrame, as_of=None) -> WriteResult:
    """Stores each valid request whose fingerprint is new; outcomes: created, duplicate, invalid.

    ``requests`` holds ``seq`` (unique, the order of application), ``tags`` and any of the other
    create fields.  A duplicate reports the id of the stored row.
    """
    keyed = keyed_creates(requests)
    resolved = resolve_keys(keyed, stored, "dedup_key")
    return WriteResult(
        append_created(stored, requests, resolved, as_of), outcomes(keyed, resolved, "dedup_key")
    )


def created_solutions(requests: DataFrame, resolved: DataFrame, as_of=None) -> DataFrame:
    now = write_time(as_of)
    rows = new_rows(normalize_create(requests), resolved, "dedup_key")
    return S.conform(rows.withColumn("created_at", now).withColumn("updated_at", now), S.SOLUTION)


def append_created(stored: DataFrame | None, requests: DataFrame, resolved: DataFrame, as_of=None) -> DataFrame:
    created = created_solutions(requests, resolved, as_of)
    return created if stored is None else stored.unionByName(created)


def update_solutions(stored: DataFrame, updates: DataFrame, as_of=None) -> WriteResult:
    """The whole table after :func:`planned_updates`, and the outcomes."""
    accepted, report = planned_updates(stored, updates)
    return WriteResult(apply_updates(stored, accepted, as_of), report)


def apply_updates(rows: DataFrame, accepted: DataFrame, as_of=None) -> DataFrame:
    """``rows`` (any part of the table) with the accepted updates of their ids."""
    changed = F.col("u").isNotNull()
    return rows.join(accepted, "id", "left").select(
        *[
            F.when(changed, F.col(f"u.{c}")).otherwise(F.col(c)).alias(c)
            if c in ("title", "problem", "solution_text", "status", "tags", "dedup_key")
            else F.when(changed, write_time(as_of)).otherwise(F.col(c)).alias(c)
            if c == "updated_at"
            else F.col(c)
            for c in rows.columns
        ]
    )


def planned_updates(stored: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to change, ``(id, u)`` with the new values, and one outcome ``(seq, outcome, id)`` per request.

    Overwrites title, problem, solution_text, status and tags, and recomputes the fingerprint.

    Outcomes: ``updated``, ``duplicate`` (with the id that holds the fingerprint), ``not_found``,
    ``invalid``, ``superseded``.  The batch rule: a fingerprint held at the start of the batch by
    another row stays reserved; among the new fingerprints the first ``seq`` wins; of several valid
    updates of one row only the last is applied.  This differs from applying requests one by one only
    when rows swap fingerprints inside a batch or a row is updated twice.
    """
    fresh = normalize_update(updates)
    marks = stage(
        fresh.select("seq", "id", F.when(F.col("invalid_reason").isNotNull(), INVALID).alias("reject")),
        "update-marks",
    )
    latest = (
        marks.where(F.col("reject").isNull())
        .groupBy("id")
        .agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("updates"))
    )
    # The stored rows are reduced to the updated ones before anything else meets them.
    kept_fields = stored.select("id", "source_type", "source_name", "source_ref").join(latest, "id")
    live = fresh.drop("id").join(kept_fields, "seq").select("seq", "id", "updates", dedup_key().alias("new_key"))
    live = stage(live, "update-keys")

    wanted = first_per_key(live, "new_key")
    holders = stored.select(F.col("dedup_key").alias("new_key"), F.col("id").alias("holder_id"))
    wanted = wanted.join(holders.join(wanted.select("new_key"), "new_key", "left_semi"), "new_key", "left")
    # The stored holder may itself be updated to the key it already has; then it is the winner.
    first = live.select(F.col("seq").alias("first_seq"), F.col("id").alias("first_id"))
    wanted = wanted.join(first, "first_seq").select(
        "new_key", "n", F.coalesce("holder_id", "first_id").alias("winner_id")
    )
    wanted = stage(wanted, "update-winners")
    decided = attach_per_key(live, wanted, "new_key").select(
        "seq", "id", "updates", "new_key", (F.col("winner_id") == F.col("id")).alias("applied"), "winner_id"
    )
    decided = stage(decided, "update-decisions")

    accepted = fresh.join(decided.where("applied").select("seq", "new_key"), "seq").select(
        "id",
        F.struct("title", "problem", "solution_text", "status", "tags", F.col("new_key").alias("dedup_key")).alias("u"),
    )
    accepted = stage(accepted, "updates")

    per_id = decided.select("id", "updates", F.col("seq").alias("last_seq"), "applied", "winner_id")
    verdict = (
        F.when(F.col("reject").isNotNull(), F.col("reject"))
        .when(F.col("last_seq").isNull(), "not_found")
        .when(F.col("seq") != F.col("last_seq"), "superseded")
        .when(F.col("applied"), "updated")
        .otherwise("duplicate")
    )
    report = attach_per_key(marks, per_id, "id", size="updates").withColumn("outcome", verdict)
    shown = F.when(F.col("outcome") == "duplicate", F.col("winner_id")).when(
        F.col("outcome").isin("updated", "superseded"), F.col("id")
    )
    return accepted, report.select("seq", "outcome", shown.alias("id"))


def replace_tags(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Replaces the whole tag set of the rows named by ``changes(id, tags)`` (``id`` unique)."""
    fresh = changes.select("id", tags_sorted_set(F.col("tags")).alias("_tags"))
    return (
        stored.join(fresh, "id", "left")
        .withColumn("tags", F.coalesce(F.col("_tags"), F.col("tags")))
        .select(*stored.columns)
    )


def delete_solutions(stored: DataFrame, requests: DataFrame) -> WriteResult:
    """Deletes by ``id``; a second request for the same id finds nothing."""
    asked = requests.groupBy("id").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))
    hits = stage(stored.select("id").join(asked, "id"), "delete-hits")
    report = attach_per_key(requests.select("seq", "id"), hits, "id").select(
        "seq",
        F.when(F.col("seq") == F.col("first_seq"), "deleted").otherwise("not_found").alias("outcome"),
        "id",
    )
    return WriteResult(stored.join(asked.select("id"), "id", "left_anti"), report)


def affected_rows(report: DataFrame, *names: str) -> DataFrame:
    """One row with a counter per outcome name."""
    return report.agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names])


def lookup_by_id(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """The stored rows whose ``id`` occurs in ``ids``; a missing id gives no row."""
    return stored.join(ids.select("id").distinct(), "id", "left_semi")


def lookup_by_key(stored: DataFrame, keys: DataFrame) -> DataFrame:
    return stored.join(keys.select("dedup_key").distinct(), "dedup_key", "left_semi")


def solution_tags(stored: DataFrame) -> DataFrame:
    """The child rows ``(solution_id, tag)``."""
    return stored.select(F.col("id").alias("solution_id"), F.explode("tags").alias("tag"))


def with_tags(rows: DataFrame, tag_rows: DataFrame) -> DataFrame:
    """Left outer 1:N join from the child rows back to one array per solution."""
    grouped = tag_rows.groupBy(F.col("solution_id").alias("id")).agg(
        F.array_sort(F.collect_set("tag")).alias("tags")
    )
    return rows.drop("tags").join(grouped, "id", "left").withColumn("tags", nz_tags(F.col("tags")))


def tags_group_concat(tag_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """``(id, tags_csv)`` per solution; ``''`` without tags.  The order is fixed by sorting."""
    return with_tags(rows.select("id"), tag_rows).select("id", F.array_join("tags", ",").alias("tags_csv"))
