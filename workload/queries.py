"""One query per operator, over the whole given tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorekeep import schemas as S
from lorekeep.functions import keys, tags, text
from lorekeep.operators import captures as C, events as E, search as Q, solutions as D
from lorekeep.operators.first_wins import first_per_key
from lorekeep.operators.recent_ring import recent_ring
from lorekeep.plans import enrich, importing, promote
from lorekeep.session import ship_package
from lorekeep.sources import candidates as src, tables
from lorekeep.sources.ranges import Change, RangeTables
from lorekeep.sources.trigrams import TrigramIndex
from lorekeep.streaming.captures import CaptureSink
from lorekeep.streaming.events import DoubleTriggerStream, RecentRingStream
from lorekeep.streaming.runner import run_available
import workload
from workload import inputs as I
from workload.base import (
    AS_OF,
    LATER,
    captures,
    csv,
    fresh_path,
    insight_rows,
    insights,
    seconds,
    solutions,
)

Query = Callable[[SparkSession, str], DataFrame]
WORD = "Tion"
GAP = 3_600_000_000
CHORD_GAP = 36_000_000_000
DEFAULT_TAGS = ("imported", "Auto")
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _value(name: str, sql: str, key: str, column) -> None:
    """A query that applies one scalar function to every row of a view."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return I.view(spark, sf_dir, sql).select(F.col(key).alias("k"), column().alias("v"))

    QUERIES[name] = run


c = F.col
ALL_CAPTURES = f"{I.CAPTURES} union all {I.MORE_CAPTURES}"
DOCUMENTS = "select doc_id, text, lang, source, n_chars from {documents}"

# --- scalar functions
_value("utrim", ALL_CAPTURES, "seq", lambda: text.utrim(c("content")))
_value("ulower", DOCUMENTS, "doc_id", lambda: text.ulower(c("text")))
_value("normalize_text", I.MORE_CANDIDATES, "seq", lambda: text.normalize_text(c("solution_text")))
_value("tags_sorted_set", I.INSIGHTS, "capture_seq", lambda: csv(tags.tags_sorted_set(c("tags"))))
_value("tags_ordered_distinct", I.INSIGHTS, "capture_seq", lambda: csv(tags.tags_ordered_distinct(c("tags"))))
_value("dedup_key", I.MORE_CANDIDATES, "seq", lambda: keys.dedup_key())
_value("content_hash", ALL_CAPTURES, "seq", lambda: keys.content_hash(c("content")))
_value("char_count", ALL_CAPTURES, "seq", lambda: text.char_count(c("content")))
_value("line_count", ALL_CAPTURES, "seq", lambda: text.line_count(c("content")))
_value("content_type", ALL_CAPTURES, "seq", lambda: text.content_type(c("content")))
_value("first_non_blank", I.INSIGHTS, "capture_seq", lambda: text.first_non_blank(c("solution_text"), c("summary")))
_value("fallback_untrimmed", I.CANDIDATES, "seq", lambda: text.fallback_untrimmed(c("source_name"), F.lit("local_json")))
_value("fallback_status", I.CANDIDATES, "seq", lambda: text.fallback_status(c("status"), " "))
_value("fallback_title", ALL_CAPTURES, "seq", lambda: text.fallback_title(c("content")))
_value("keep_raw_if_short", ALL_CAPTURES, "seq", lambda: text.keep_raw_if_short(c("content")))
_value("capture_ref", ALL_CAPTURES, "seq", lambda: keys.capture_ref(c("seq")))
_value("append_category_tag", I.INSIGHTS, "capture_seq", lambda: csv(tags.append_category(c("tags"), c("category"))))
_value("clamp_confidence", I.INSIGHTS, "capture_seq", lambda: text.clamp_confidence(c("confidence")))
_value("rfc3339", I.CAPTURES, "seq", lambda: text.rfc3339(c("captured_at")))
_value("sql_lower_ascii", DOCUMENTS, "doc_id", lambda: text.alower(c("text")))
_value("concat_tags", I.CANDIDATES, "seq", lambda: csv(tags.concat_tags(c("tags"), DEFAULT_TAGS)))
_value("now_seconds", I.CANDIDATES, "seq", lambda: F.date_format(keys.write_time(LATER), "yyyy-MM-dd HH:mm:ss.SSS"))


@query
def split_tags_csv(spark, sf_dir):
    rows = I.view(spark, sf_dir, I.CANDIDATES).withColumn("tags_csv", csv(c("tags")))
    return rows.select(c("seq").alias("k"), F.array_join(tags.split_tags_csv(c("tags_csv")), "|").alias("v"))


@query
def parse_ts(spark, sf_dir):
    rows = I.view(spark, sf_dir, "select event_id, event_type, ts from {events}")
    shown = F.when(c("event_type") == "error", "no time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return rows.select(c("event_id").alias("k"), F.date_format(text.parse_ts(shown), "yyyyMMddHHmmss").alias("v"))


@query
def null_defaults(spark, sf_dir):
    rows = I.view(
        spark,
        sf_dir,
        "select d.doc_id, l.quality, l.toxic, case when l.doc_id is not null then d.source end as label_source "
        "from {documents} d left join {labels} l on l.doc_id = d.doc_id",
    )
    return S.fill_defaults(rows)


@query
def normalize_analysis(spark, sf_dir):
    rows = I.view(spark, sf_dir, I.INSIGHTS).withColumn("source_ref", F.lit(""))
    return enrich.normalize_analysis(rows).withColumn("tags", csv(c("tags")))


# --- sources and sinks


def _json_files(spark: SparkSession, sf_dir: str, as_array: bool, mixed: bool = False) -> str:
    """The candidates as JSON files: lines, or one array per block of ``seq``; every other block as lines if ``mixed``."""
    path = fresh_path(spark, "candidates-json")
    rows = I.view(spark, sf_dir, I.CANDIDATES)
    fields = F.struct(*S.CANDIDATE.names)
    if not as_array:
        rows.select(F.to_json(fields).alias("value")).write.text(path)
        return path
    block = F.floor(c("seq") / 1000)
    rows = rows.withColumn("block", block).repartition("block").sortWithinPartitions("block", "seq")
    bounds = rows.groupBy("block").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    opening = F.when(c("seq") == c("low"), "[").otherwise(",")
    closing = F.when(c("seq") == c("high"), "] trailing text").otherwise("")
    value = F.concat(opening, F.to_json(fields), closing)
    if mixed:
        value = F.when(c("block") % 2 == 0, value).otherwise(F.to_json(fields))
    lines = rows.join(bounds, "block").select("block", "seq", value.alias("value"))
    lines.repartition("block").sortWithinPartitions("block", "seq").drop("seq").write.partitionBy("block").text(path)
    return path


def _candidates(rows: DataFrame) -> DataFrame:
    return S.conform(rows, S.CANDIDATE).withColumn("tags", csv(c("tags")))


@query
def import_json_array(spark, sf_dir):
    return _candidates(src.read_json(spark, _json_files(spark, sf_dir, True)))


@query
def import_jsonl(spark, sf_dir):
    return _candidates(src.read_json(spark, _json_files(spark, sf_dir, False)))


@query
def source_registry(spark, sf_dir):
    path = fresh_path(spark, "candidates")
    I.view(spark, sf_dir, I.CANDIDATES).write.parquet(path)
    return _candidates(src.DEFAULT_SOURCES.read(spark, " Parquet ", f" {path} "))


@query
def capture_batch(spark, sf_dir):
    rows = C.normalize_captures(I.view(spark, sf_dir, ALL_CAPTURES))
    return rows.withColumn("captured_s", seconds("captured_at")).drop("captured_at")


@query
def request_build(spark, sf_dir):
    body = enrich.request_json("model-1")
    at = lambda p: F.get_json_object("body", p)
    return captures(spark, sf_dir).select("id", body.alias("body")).select(
        "id",
        at("$.model").alias("model"),
        at("$.input[0].content[0].text").alias("prompt"),
        at("$.input[1].role").alias("role"),
        at("$.input[1].content[0].text").alias("text"),
        at("$.text.format.name").alias("answer"),
    )


@query
def response_parse(spark, sf_dir):
    """Answers in two output items among other content; some broken, blank or outside the envelope."""
    rows = I.view(spark, sf_dir, I.INSIGHTS).withColumn("source_ref", F.lit(""))
    answer = F.to_json(F.struct(*S.ANALYSIS.names))
    answer = F.when(c("category") == "DE", F.lit("{broken")).when(c("category") == "FR", F.lit(" ")).otherwise(answer)
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    half = F.floor(F.char_length("answer") / 2).cast("int")
    first = F.substring(c("answer"), F.lit(1), half)
    second = F.substring(c("answer"), half + 1, F.char_length("answer"))
    item = lambda *parts: F.struct(F.array(*parts).alias("content"))
    body = F.to_json(
        F.struct(
            F.array(
                item(part("reasoning", c("problem")), part("output_text", first)), item(part("text", second))
            ).alias("output")
        )
    )
    body = F.when(c("confidence") < 0, F.lit("<html>")).otherwise(body)
    parsed = enrich.parse_responses(
        rows.withColumn("answer", answer).select(c("capture_seq").alias("id"), body.alias("body"))
    )
    return parsed.withColumn("tags", csv(c("tags"))).drop("body")


@query
def tags_json_codec(spark, sf_dir):
    rows = I.view(spark, sf_dir, I.INSIGHTS)
    stored = tags.encode_tags(tags.tags_ordered_distinct(c("tags")))
    rows = rows.select(c("capture_seq").alias("k"), stored.alias("tags_json"), "suggested_status")
    read = F.when(c("suggested_status") == "bogus", "no json").otherwise(c("tags_json"))
    return rows.select("k", "tags_json", csv(tags.decode_tags(read)).alias("tags"))


@query
def schema_upgrade(spark, sf_dir):
    rows = I.view(spark, sf_dir, "select doc_id, lang, source from {documents}")
    once = S.with_default_column(rows, "raw_content")
    return S.with_default_column(once, "raw_content")


@query
def table_snapshot(spark, sf_dir):
    path = fresh_path(spark, "snapshots")
    stored = solutions(spark, sf_dir)
    tables.write_snapshot(stored, path)
    tables.write_snapshot(stored.where(c("status") != "failed"), path)
    return tables.read_snapshot(spark, path, S.SOLUTION).select("id", "status", "dedup_key")


@query
def analysis_schema(spark, sf_dir):
    rows = I.view(spark, sf_dir, I.INSIGHTS)
    rows = rows.withColumn("source_ref", F.when(c("category") != "DE", F.lit("")))
    return enrich.check_analysis(rows).select("capture_seq", "contract_error")


# --- filters, lookups, search


@query
def create_validate(spark, sf_dir):
    requests = importing.candidate_requests(I.view(spark, sf_dir, I.CANDIDATES), "local_json")
    return D.normalize_create(requests).withColumn("tags", csv(c("tags")))


@query
def update_validate(spark, sf_dir):
    return D.normalize_update(I.view(spark, sf_dir, I.UPDATES)).withColumn("tags", csv(c("tags")))


def _matches(spark: SparkSession, sf_dir: str, **f) -> DataFrame:
    return Q.filter_solutions(solutions(spark, sf_dir), Q.SolutionFilter(**f)).select("id", "title", "status")


@query
def filter_status(spark, sf_dir):
    return _matches(spark, sf_dir, status=" FAILED ")


@query
def filter_efficacy(spark, sf_dir):
    return _matches(spark, sf_dir, efficacy_source="Auto")


@query
def filter_efficacy_mixed(spark, sf_dir):
    """Drafts are taken as assessed by hand, so the filter meets both values."""
    source = F.when(c("status") == "draft", "manual").otherwise("auto")
    rows = solutions(spark, sf_dir).withColumn("efficacy_source", source)
    return Q.filter_solutions(rows, Q.SolutionFilter(efficacy_source="Auto")).select("id", "title", "status")


@query
def search_solutions(spark, sf_dir):
    return _matches(spark, sf_dir, query=f" {WORD} L")


@query
def conjunctive_filter(spark, sf_dir):
    return _matches(spark, sf_dir, query=WORD, status="draft", efficacy_source="auto", tag=" FR")


INDEXED_WORDS = ("Tion L", "oument", "LE_s%ti", "es", "qzxj", "\u00e9ment \u00e9")


@query
def search_trigrams(spark, sf_dir):
    """The keyword search through a trigram index, for frequent, rare, absent and short words and wildcards."""
    stored = solutions(spark, sf_dir)
    index = TrigramIndex(fresh_path(spark, "solution-grams"), ("title", "problem", "solution_text", "tags"))
    index.add(stored)
    found = [
        Q.filter_solutions(index.narrowed(stored, word), Q.SolutionFilter(query=word)).select(F.lit(word).alias("asked"), "id")
        for word in INDEXED_WORDS
    ]
    return reduce(DataFrame.unionByName, found)


@query
def search_captures_trigrams(spark, sf_dir):
    """Captures by their own text or their insight's, each through its index."""
    stored, told = captures(spark, sf_dir), insights(spark, sf_dir)
    own_index = TrigramIndex(fresh_path(spark, "capture-grams"), C.CAPTURE_TEXTS)
    told_index = TrigramIndex(fresh_path(spark, "insight-grams"), C.INSIGHT_TEXTS, "capture_id")
    own_index.add(stored)
    told_index.add(told)
    found = [
        C.matching_captures(stored, told, Q.CaptureFilter(query=word), own_index, told_index).select(
            F.lit(word).alias("asked"), "id"
        )
        for word in INDEXED_WORDS
    ]
    return reduce(DataFrame.unionByName, found)


@query
def filter_tag(spark, sf_dir):
    return _matches(spark, sf_dir, tag=" DE ")


@query
def filter_tag_rows(spark, sf_dir):
    """The same filter over rows of a tag table, for tags kept apart from their solutions."""
    stored = solutions(spark, sf_dir)
    return Q.filter_tag_relational(stored, D.solution_tags(stored), " DE ").select("id", "title", "status")


@query
def search_or_exists(spark, sf_dir):
    stored = solutions(spark, sf_dir)
    return Q.search_or_exists(stored, D.solution_tags(stored), "ES").select("id", "title", "status")


@query
def search_captures(spark, sf_dir):
    found = Q.CaptureFilter(query="En", analyzed=None)
    rows = C.search_captures(captures(spark, sf_dir), insights(spark, sf_dir), found)
    return rows.select("id", "content_type", c("insight.category").alias("category"))


@query
def filter_analyzed(spark, sf_dir):
    parts = [
        C.filter_analyzed(captures(spark, sf_dir), insights(spark, sf_dir), Q.parse_analyzed(raw)).select(
            F.lit(raw).alias("asked"), "id"
        )
        for raw in ("", " TRUE ", "no")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def lookup_solution_by_id(spark, sf_dir):
    ids = I.view(spark, sf_dir, "select doc_id * 2 as id from {labels}")
    return D.lookup_by_id(solutions(spark, sf_dir), ids).select("id", "title", csv("tags").alias("tags"))


@query
def lookup_solution_by_key(spark, sf_dir):
    asked = importing.candidate_requests(I.view(spark, sf_dir, I.MORE_CANDIDATES), "local_json")
    asked = asked.select(keys.dedup_key().alias("dedup_key"))
    return D.lookup_by_key(solutions(spark, sf_dir), asked).select("id", "dedup_key", "raw_content_ref")


@query
def lookup_capture(spark, sf_dir):
    ids = I.view(spark, sf_dir, "select doc_id * 5 as id from {labels}")
    rows = C.lookup_captures(captures(spark, sf_dir), insights(spark, sf_dir), ids)
    return rows.select("id", "found", "content", c("insight.title").alias("insight_title"))


PATTERNS = ("A_e", "tion%LA", "a\\b", "100%", "é", "_", "%", "e.", "[a-z]")


@query
def like_literal_semantics(spark, sf_dir):
    rows = I.view(spark, sf_dir, DOCUMENTS)
    counted = rows.agg(
        *[F.count_if(text.contains_keyword(c("text"), text.keyword(p))).alias(f"p{i}") for i, p in enumerate(PATTERNS)]
    )
    return counted


@query
def capture_reject_blank(spark, sf_dir):
    rows = C.normalize_captures(I.view(spark, sf_dir, ALL_CAPTURES))
    return rows.where(c("reject").isNotNull()).select("seq", "reject")


@query
def project_public(spark, sf_dir):
    rows = C.public_insight(insights(spark, sf_dir))
    return rows.withColumns({"tags": csv("tags"), "analyzed_s": seconds("analyzed_at")}).drop("analyzed_at")


# --- joins and aggregates


@query
def solutions_with_tags(spark, sf_dir):
    stored = solutions(spark, sf_dir)
    rows = D.with_tags(stored, D.solution_tags(stored))
    return rows.select("id", "title", csv("tags").alias("tags"))


@query
def captures_with_insight(spark, sf_dir):
    rows = C.with_insight(captures(spark, sf_dir), insights(spark, sf_dir))
    return rows.select(
        "id",
        "source",
        # asked of one field: the whole struct would move all texts of an insight
        c("insight.capture_id").isNotNull().alias("analyzed"),
        c("insight.summary").alias("summary"),
        c("insight.confidence").alias("confidence"),
    )


@query
def unanalyzed_captures(spark, sf_dir):
    return C.unanalyzed(captures(spark, sf_dir), insights(spark, sf_dir)).select("id", "content_hash")


def _more_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.view(spark, sf_dir, I.MORE_CANDIDATES)
    return importing.candidate_requests(rows, "local_json", default_tags=DEFAULT_TAGS)


@query
def new_vs_existing(spark, sf_dir):
    rows = importing.candidate_requests(I.view(spark, sf_dir, I.MORE_CANDIDATES), "local_json")
    firsts = first_per_key(rows.select("seq", keys.dedup_key().alias("dedup_key")), "dedup_key")
    return firsts.join(solutions(spark, sf_dir), "dedup_key", "left_anti")


@query
def resolve_existing(spark, sf_dir):
    done = C.insert_captures(captures(spark, sf_dir), I.view(spark, sf_dir, I.MORE_CAPTURES))
    rows = C.with_capture_time(done.outcomes, done.table)
    return rows.select("seq", "outcome", "id", seconds("captured_at").alias("captured_s"))


@query
def tags_group_concat(spark, sf_dir):
    stored = solutions(spark, sf_dir)
    return D.tags_group_concat(D.solution_tags(stored), stored)


@query
def count_solutions(spark, sf_dir):
    return Q.count_solutions(solutions(spark, sf_dir), Q.SolutionFilter(query=WORD, limit=5, offset=2))


@query
def import_summary(spark, sf_dir):
    rows = I.view(spark, sf_dir, I.MORE_CANDIDATES)
    return importing.import_candidates(rows, solutions(spark, sf_dir), as_of=LATER).summary


@query
def affected_rows(spark, sf_dir):
    done = D.update_solutions(solutions(spark, sf_dir), I.view(spark, sf_dir, I.UPDATES), LATER)
    return D.affected_rows(done.outcomes, "updated", "duplicate", "not_found", "invalid", "superseded")


@query
def page_with_total(spark, sf_dir):
    page, totals = Q.page_with_total(solutions(spark, sf_dir), Q.SolutionFilter(query=WORD, limit=30, offset=10))
    items = page.select(F.lit("item").alias("kind"), c("id").alias("n"))
    return items.unionByName(totals.select(F.expr("stack(2, 'count', cast(count as bigint), 'total', total) as (kind, n)")))


@query
def tag_counts(spark, sf_dir):
    return Q.tag_counts(solutions(spark, sf_dir))


# --- windows, sorts, pages


@query
def first_wins_dedup(spark, sf_dir):
    return importing.import_candidates(I.view(spark, sf_dir, I.CANDIDATES), as_of=AS_OF).outcomes


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.view(spark, sf_dir, "select event_id, user_id, ts from {events}")
    return rows.select("user_id", E.at_micros(c("ts")).alias("at_us"), "event_id")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.view(spark, sf_dir, I.KEYS)
    return rows.select("user_id", E.at_micros(c("ts")).alias("at_us"), "event_id", "key", "action")


@query
def double_trigger(spark, sf_dir):
    return E.double_trigger(_events(spark, sf_dir), GAP)


@query
def chord_held(spark, sf_dir):
    return E.chord_held(_keys(spark, sf_dir))


@query
def double_chord(spark, sf_dir):
    return E.double_chord(_keys(spark, sf_dir), CHORD_GAP)


def _solution_page(spark: SparkSession, sf_dir: str, **f) -> DataFrame:
    page = Q.list_solutions(solutions(spark, sf_dir), Q.SolutionFilter(**f))
    return page.select("id", "title", "solution_text", csv("tags").alias("tags"), seconds("updated_at").alias("updated_s"))


@query
def list_solutions(spark, sf_dir):
    return _solution_page(spark, sf_dir, limit=50, offset=31)


@query
def page_bounds(spark, sf_dir):
    return _solution_page(spark, sf_dir, limit=101, offset=-3)


@query
def solutions_search(spark, sf_dir):
    return _solution_page(spark, sf_dir, query=WORD, status="draft", limit=40)


@query
def list_captures(spark, sf_dir):
    page = C.list_captures(
        captures(spark, sf_dir), insights(spark, sf_dir), Q.CaptureFilter(query="e", limit=60, offset=7)
    )
    return page.select("id", "content", "content_type", seconds("captured_at").alias("captured_s"), c("insight.title").alias("insight_title"))


@query
def pager_info(spark, sf_dir):
    info = Q.pager_info(Q.count_solutions(solutions(spark, sf_dir), Q.SolutionFilter()), page=7)
    return info.withColumnRenamed("offset", "page_offset")


@query
def pager_info_past_end(spark, sf_dir):
    info = Q.pager_info(Q.count_solutions(solutions(spark, sf_dir), Q.SolutionFilter(status="failed")), page=10**9)
    return info.withColumnRenamed("offset", "page_offset")


# --- table changes


def _table(rows: DataFrame) -> DataFrame:
    times = {"created_s": seconds("created_at"), "updated_s": seconds("updated_at"), "tags": csv("tags")}
    return rows.withColumns(times).drop("created_at", "updated_at")


@query
def create_solutions(spark, sf_dir):
    return D.create_solutions(solutions(spark, sf_dir), _more_requests(spark, sf_dir), LATER).outcomes


@query
def create_solutions_table(spark, sf_dir):
    return _table(D.create_solutions(solutions(spark, sf_dir), _more_requests(spark, sf_dir), LATER).table)


@query
def update_solutions(spark, sf_dir):
    return D.update_solutions(solutions(spark, sf_dir), I.view(spark, sf_dir, I.UPDATES), LATER).outcomes


@query
def update_solutions_table(spark, sf_dir):
    return _table(D.update_solutions(solutions(spark, sf_dir), I.view(spark, sf_dir, I.UPDATES), LATER).table)


@query
def replace_tags(spark, sf_dir):
    changes = I.view(spark, sf_dir, "select page_id + 1 as id, 'New, NEW,,' || url as tags_csv from {pages}")
    return D.replace_tags(solutions(spark, sf_dir), changes).select("id", csv("tags").alias("tags"))


DELETES = (
    "select doc_id * 2 as seq, doc_id * 2 as id from {labels} "
    "union all select page_id * 2 + 1, page_id + 1 from {pages}"
)


@query
def delete_solutions(spark, sf_dir):
    return D.delete_solutions(solutions(spark, sf_dir), I.view(spark, sf_dir, DELETES)).outcomes


@query
def delete_solutions_table(spark, sf_dir):
    return D.delete_solutions(solutions(spark, sf_dir), I.view(spark, sf_dir, DELETES)).table.select("id", "dedup_key")


INSIGHT_EDITS = """
select page_id * 2 as seq, page_id + 1 as capture_id, url as title, html as summary, 'PAGE' as category,
       cast(0.25 as double) as confidence, 'B,a, b ,A' as tags_csv from {pages}
union all
select page_id * 2 + 1, cast(floor(page_id / 2) as bigint) + 1, 'again', url, 'again', cast(0.5 as double), '' from {pages}
"""


@query
def upsert_insights(spark, sf_dir):
    done = C.upsert_insights(insights(spark, sf_dir), I.view(spark, sf_dir, INSIGHT_EDITS), LATER)
    return done.select(
        "capture_id", "title", "summary", "category", "confidence", "suggested_status",
        csv("tags").alias("tags"), seconds("analyzed_at").alias("analyzed_s"),
    )


@query
def delete_captures(spark, sf_dir):
    ids = I.view(spark, sf_dir, "select doc_id + 1 as id from {labels}")
    left, kept = C.delete_captures(captures(spark, sf_dir), insights(spark, sf_dir), ids)
    return left.select(F.lit("capture").alias("kind"), "id").unionByName(
        kept.select(F.lit("insight").alias("kind"), c("capture_id").alias("id"))
    )


def _ranges(spark, sf_dir, **tables: DataFrame) -> RangeTables:
    """The given tables, stored in id ranges of which a change touches a part."""
    kinds = {"solutions": S.SOLUTION, "captures": S.CAPTURE, "insights": S.INSIGHT}
    keys = {name: "capture_id" if name == "insights" else "id" for name in tables}
    store = RangeTables(spark, fresh_path(spark, "ranges"), keys, {n: kinds[n] for n in tables}, rows_per_range=256)
    for name, rows in tables.items():
        store.create(name, rows)
    return store


@query
def update_solutions_ranges(spark, sf_dir):
    store = _ranges(spark, sf_dir, solutions=solutions(spark, sf_dir))
    accepted, _ = D.planned_updates(store.read("solutions"), I.view(spark, sf_dir, I.UPDATES))
    store.apply(Change("solutions", accepted.select("id"), lambda part: D.apply_updates(part, accepted, LATER)))
    return _table(store.read("solutions"))


@query
def delete_solutions_ranges(spark, sf_dir):
    store = _ranges(spark, sf_dir, solutions=solutions(spark, sf_dir))
    gone = I.view(spark, sf_dir, DELETES)
    store.apply(Change("solutions", gone.select("id"), lambda part: D.delete_solutions(part, gone).table))
    return store.read("solutions").select("id", "dedup_key")


@query
def delete_captures_ranges(spark, sf_dir):
    """Captures and their insights change together."""
    store = _ranges(spark, sf_dir, captures=captures(spark, sf_dir), insights=insights(spark, sf_dir))
    ids = I.view(spark, sf_dir, "select doc_id + 1 as id from {labels}")
    store.apply(
        Change("captures", ids, lambda part: C.without_captures(part, "id", ids)),
        Change("insights", ids, lambda part: C.without_captures(part, "capture_id", ids)),
    )
    return store.read("captures").select(F.lit("capture").alias("kind"), "id").unionByName(
        store.read("insights").select(F.lit("insight").alias("kind"), c("capture_id").alias("id"))
    )


@query
def clear_unanalyzed(spark, sf_dir):
    kept, deleted = C.clear_unanalyzed(captures(spark, sf_dir), insights(spark, sf_dir))
    return kept.select(F.lit("kept").alias("kind"), c("id").alias("n")).unionByName(
        deleted.select(F.lit("deleted").alias("kind"), c("deleted").alias("n"))
    )


def _capture_table(rows: DataFrame) -> DataFrame:
    return rows.withColumn("captured_s", seconds("captured_at")).drop("captured_at")


@query
def insert_captures(spark, sf_dir):
    return C.insert_captures(captures(spark, sf_dir), I.view(spark, sf_dir, I.MORE_CAPTURES)).outcomes


@query
def insert_captures_table(spark, sf_dir):
    return _capture_table(C.insert_captures(captures(spark, sf_dir), I.view(spark, sf_dir, I.MORE_CAPTURES)).table)


# --- plans


@query
def import_solutions(spark, sf_dir):
    rows = I.view(spark, sf_dir, I.CANDIDATES)
    done = importing.import_candidates(rows, default_status=" Failed", default_tags=DEFAULT_TAGS, as_of=LATER)
    return _table(done.table)


@query
def import_path(spark, sf_dir):
    """Import from a folder of arrays and JSON lines, numbered by file name and place in the file."""
    path = _json_files(spark, sf_dir, True, mixed=True)
    return importing.import_path(spark, path, default_status=" Failed", default_tags=DEFAULT_TAGS, as_of=LATER).outcomes


def _insight_table(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[n for n in S.INSIGHT.names if n not in ("tags", "raw_json", "analyzed_at")],
        csv("tags").alias("tags"),
        seconds("analyzed_at").alias("analyzed_s"),
    )


@query
def analyze_captures(spark, sf_dir):
    done, _ = enrich.analyze_captures(captures(spark, sf_dir), insights(spark, sf_dir), model="rules-1", as_of=LATER)
    return _insight_table(done)


def failing_answer(row) -> str:
    """The rule extractor with one failure class per content type."""
    kind = row["content_type"]
    if kind == "url":
        raise enrich.MissingKey("no key")
    if kind == "code":
        raise TimeoutError("too slow")
    if kind == "chat_transcript":
        raise RuntimeError("refused")
    if kind == "long_text":
        return json.dumps({"output": []})
    return enrich.rule_answer(row)


@query
def analysis_outcomes(spark, sf_dir):
    ship_package(spark, workload)
    _, report = enrich.analyze_captures(
        captures(spark, sf_dir), insights(spark, sf_dir), enrich.calls(failing_answer), as_of=LATER
    )
    return enrich.analysis_outcomes(report)


# Each id twice in a row, then once more after all others, and ids without a capture.
ANALYSIS_REQUESTS = """
select (doc_id - 1000000000) * 4 as seq, doc_id + 1 as id from {documents}
union all select (doc_id - 1000000000) * 4 + 1, doc_id + 1 from {documents}
union all select doc_id * 4, doc_id + 1 from {documents}
union all select page_id * 4 + 2, -page_id from {pages}
"""


@query
def analyze_requests(spark, sf_dir):
    done = enrich.analyze_requests(
        captures(spark, sf_dir), insights(spark, sf_dir), I.view(spark, sf_dir, ANALYSIS_REQUESTS), as_of=LATER
    )
    return done.report.select("seq", "id", "status")


PROMOTIONS = (
    "select doc_id * 2 as seq, doc_id + 1 as id from {documents} "
    "union all select page_id * 2 + 1, page_id * 8 + 1 from {pages}"
)


@query
def promote_captures(spark, sf_dir):
    done = promote.promote_captures(
        captures(spark, sf_dir), insights(spark, sf_dir), solutions(spark, sf_dir), I.view(spark, sf_dir, PROMOTIONS), LATER
    )
    return done.outcomes


@query
def promote_captures_table(spark, sf_dir):
    done = promote.promote_captures(
        captures(spark, sf_dir), insights(spark, sf_dir), None, I.view(spark, sf_dir, PROMOTIONS), LATER
    )
    return _table(done.table)


# --- streams: the rows arrive in two loads, and the stream resumes from its checkpoint


def _two_loads(spark: SparkSession, name: str, loads: list[DataFrame], run: Callable[[DataFrame, str], None]) -> str:
    root = fresh_path(spark, name)
    schema = loads[0].schema
    for i, rows in enumerate(loads):
        rows.write.mode("append").parquet(f"{root}/in")
        run(spark.readStream.schema(schema).parquet(f"{root}/in"), root)
    return root


def _capture_loads(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [I.view(spark, sf_dir, sql) for sql in (I.CAPTURES, I.MORE_CAPTURES)]


@query
def capture_stream(spark, sf_dir):
    def run(rows: DataFrame, root: str) -> None:
        run_available(rows, CaptureSink(root), f"{root}/checkpoint").awaitTermination()

    root = _two_loads(spark, "capture-stream", _capture_loads(spark, sf_dir), run)
    return _capture_table(CaptureSink(root).captures(spark))


@query
def auto_analyze_promote(spark, sf_dir):
    def run(rows: DataFrame, root: str) -> None:
        sink = CaptureSink(root, auto_analyze=True, model="rules-1", as_of=LATER)
        run_available(rows, sink, f"{root}/checkpoint").awaitTermination()

    root = _two_loads(spark, "auto", _capture_loads(spark, sf_dir), run)
    return _table(CaptureSink(root).solutions(spark))


@query
def capture_stream_report(spark, sf_dir):
    """What became of every streamed row and of every analysis, with one failure class per content type."""
    ship_package(spark, workload)

    def run(rows: DataFrame, root: str) -> None:
        sink = CaptureSink(root, auto_analyze=True, extractor=enrich.calls(failing_answer), as_of=LATER)
        run_available(rows, sink, f"{root}/checkpoint").awaitTermination()

    root = _two_loads(spark, "capture-report", _capture_loads(spark, sf_dir), run)
    done = CaptureSink(root)
    taken = done.outcomes(spark).select("seq", "id", c("outcome").alias("status"))
    analysed = done.analyses(spark).select(F.lit(None).cast("bigint").alias("seq"), "id", "status")
    return taken.unionByName(analysed)


MIDDLE = 1_705_276_800_000_000
GAPPY_EVENTS = """
select event_id, case when event_type = 'error' then null else user_id end as user_id,
       case when event_type = 'signup' then null else ts end as ts
from {events}
"""


@query
def double_trigger_stream(spark, sf_dir):
    rows = _events(spark, sf_dir)
    loads = [rows.where(c("at_us") < MIDDLE), rows.where(c("at_us") >= MIDDLE)]

    def run(rows: DataFrame, root: str) -> None:
        DoubleTriggerStream(root, GAP).start(rows).awaitTermination()

    root = _two_loads(spark, "trigger", loads, run)
    return DoubleTriggerStream(root).firings(spark)


@query
def refused_presses_stream(spark, sf_dir):
    """The later half arrives first, so presses of the earlier half are late; some have no user or time."""
    rows = I.view(spark, sf_dir, GAPPY_EVENTS).select("user_id", E.at_micros(c("ts")).alias("at_us"), "event_id")
    later = F.coalesce(c("at_us") >= MIDDLE, F.lit(False))

    def run(rows: DataFrame, root: str) -> None:
        DoubleTriggerStream(root, GAP).start(rows).awaitTermination()

    root = _two_loads(spark, "refused", [rows.where(later), rows.where(~later)], run)
    return DoubleTriggerStream(root, GAP).refused(spark)


def _ring_rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    rows = I.view(spark, sf_dir, sql)
    return rows.select(c("source").alias("key"), "seq", keys.content_hash(c("content")).alias("hash"))


@query
def recent_ring_throttle(spark, sf_dir):
    return recent_ring(_ring_rows(spark, sf_dir, ALL_CAPTURES)).rows


@query
def recent_ring_stream(spark, sf_dir):
    loads = [_ring_rows(spark, sf_dir, sql) for sql in (I.CAPTURES, I.MORE_CAPTURES)]

    def run(rows: DataFrame, root: str) -> None:
        RecentRingStream(root).run(rows)

    root = _two_loads(spark, "ring", loads, run)
    return RecentRingStream(root).decisions(spark)
