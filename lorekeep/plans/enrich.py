"""Enrichment of captures: build requests, call an extractor, read its answers, store insights."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

import lorekeep
from lorekeep import schemas as S
from lorekeep.functions.keys import content_hash
from lorekeep.functions.tags import tags_ordered_distinct
from lorekeep.functions.text import (
    WHITE_SPACE,
    clamp_confidence,
    first_non_blank,
    holds_one_value,
    is_blank,
    nz,
    rfc3339,
    trimmed_lower,
    utrim,
)
from lorekeep.operators.captures import unanalyzed, upsert_insights
from lorekeep.operators.first_wins import attach_per_key, first_per_key
from lorekeep.operators.recent_ring import recent_ring
from lorekeep.session import ship_package, stage

SYSTEM_PROMPT = "Describe the captured text as one JSON object that follows the given schema."
ANSWER_NAME = "capture_analysis"
# The lines that introduce a text in a request.
CAPTURED_AT, CONTENT_TYPE, CONTENT = "Captured at: ", "\nContent type: ", "\nCaptured content:\n"
CALL_RESULT = "id bigint, status string, error string, body string"


class MissingKey(Exception):
    """The extractor has no credentials."""


def answer_format() -> dict:
    """The JSON schema an answer must follow: every field required, nothing else allowed."""
    kinds = {"array<string>": {"type": "array", "items": {"type": "string"}}, "double": {"type": "number"}}
    fields = {f.name: dict(kinds.get(f.dataType.simpleString(), {"type": "string"})) for f in S.ANALYSIS.fields}
    fields["suggested_status"]["enum"] = list(S.STATUSES)
    schema = {
        "type": "object",
        "properties": fields,
        "required": list(fields),
        "additionalProperties": False,
    }
    return {"format": {"type": "json_schema", "name": ANSWER_NAME, "strict": True, "schema": schema}}


def request_json(model: str, prompt: str = SYSTEM_PROMPT) -> Column:
    """The request body for a capture row."""

    def message(role: str, text: Column) -> Column:
        part = F.struct(F.lit("input_text").alias("type"), text.alias("text"))
        return F.struct(F.lit(role).alias("role"), F.array(part).alias("content"))

    user = F.concat(
        F.lit(CAPTURED_AT),
        rfc3339(F.col("captured_at")),
        F.lit(CONTENT_TYPE),
        F.col("content_type"),
        F.lit(CONTENT),
        F.col("content"),
    )
    body = F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.array(message("system", F.lit(prompt)), message("user", user)).alias("input"),
        )
    )
    tail = ',"text":' + json.dumps(answer_format()) + "}"
    return F.concat(F.substring(body, F.lit(1), F.char_length(body) - 1), F.lit(tail))


def output_text(envelope: Column) -> Column:
    """All answer texts of a response, in order, joined."""
    parts = F.flatten(
        F.transform(envelope["output"], lambda o: F.coalesce(o["content"], F.array().cast(_CONTENT)))
    )
    texts = F.filter(parts, lambda p: p["type"].isin(*S.ENVELOPE_TEXT_TYPES))
    return nz(F.array_join(F.transform(texts, lambda p: nz(p["text"])), ""))


_CONTENT = "array<struct<type: string, text: string>>"


def _checked(schema: StructType) -> StructType:
    return StructType(list(schema.fields)).add("_corrupt", StringType())


def _parse(text: Column, schema: StructType) -> Column:
    """The one value of ``text``; null if there are more, or text beside it."""
    value = F.from_json(text, _checked(schema), {"columnNameOfCorruptRecord": "_corrupt"})
    return F.when(holds_one_value(text), value)


def _kinds_hold(whole: Column) -> Column:
    """Whether texts, the number and the tags of an answer, read as a variant, have these kinds (or are null or missing)."""
    held = F.lit(True)
    for f in S.ANALYSIS.fields:
        raw = F.to_json(F.try_variant_get(whole, f"$.{f.name}", "variant"))
        if f.dataType == StringType():
            fits = raw.startswith('"')
        elif isinstance(f.dataType, ArrayType):
            fits = raw.startswith("[") & F.forall(
                F.coalesce(F.try_variant_get(whole, f"$.{f.name}", "array<variant>"), F.array()),
                lambda v: F.coalesce(F.to_json(v).rlike('^("|null$)'), F.lit(True)),
            )
        else:
            fits = raw.rlike(r"^-?[0-9]")
        held &= F.coalesce(fits | (raw == "null"), F.lit(True))
    return held


def parse_responses(rows: DataFrame, body: str = "body") -> DataFrame:
    """Adds the fields of the analysis and ``parse_error``; a bad answer fails its row, not the job.

    Stage the result before filtering by ``parse_error``: a filter would parse each answer anew for every rule it holds.
    """
    envelope, answer = F.col("_envelope"), F.col("_answer")
    error = (
        F.when(envelope.isNull() | envelope["_corrupt"].isNotNull(), "bad_envelope")
        .when(is_blank(F.col("_text")), "empty_output")
        .when(answer.isNull() | answer["_corrupt"].isNotNull() | ~_kinds_hold(F.col("_whole")), "bad_json")
    )
    return (
        rows.withColumn("_envelope", _parse(F.col(body), S.ENVELOPE))
        .withColumn("_text", output_text(envelope))
        .withColumns({"_answer": _parse(F.col("_text"), S.ANALYSIS), "_whole": F.try_parse_json("_text")})
        .withColumn("parse_error", error)
        .select(*rows.columns, "parse_error", *[answer[f.name].alias(f.name) for f in S.ANALYSIS.fields])
    )


def normalize_analysis(rows: DataFrame) -> DataFrame:
    """Trims the texts, lower-cases category and status, clamps the confidence, cleans the tags."""
    lowered = ("category", "suggested_status")
    texts = [f.name for f in S.ANALYSIS.fields if f.dataType == StringType()]
    return rows.withColumns(
        {c: trimmed_lower(nz(F.col(c))) if c in lowered else utrim(nz(F.col(c))) for c in texts}
        | {
            "confidence": clamp_confidence(F.coalesce(F.col("confidence"), F.lit(0.0))),
            "tags": tags_ordered_distinct(F.col("tags")),
        }
    )


def check_analysis(rows: DataFrame) -> DataFrame:
    """Adds ``contract_error``: the first broken rule of the answer format, null when it holds."""
    missing = F.lit(None).cast("string")
    for f in reversed(S.ANALYSIS.fields):
        missing = F.when(F.col(f.name).isNull(), f"missing {f.name}").otherwise(missing)
    unknown = F.when(~F.col("suggested_status").isin(*S.STATUSES), "unknown suggested_status")
    return rows.withColumn("contract_error", F.coalesce(missing, unknown))


def calls(answer: Callable[[dict], str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Turns a function of one capture into a ``mapInPandas`` function that reports each failure class."""

    def one(row: dict) -> tuple[str, str, str]:
        try:
            return "ok", "", answer(row)
        except MissingKey as e:
            return "unavailable", str(e), ""
        except TimeoutError as e:
            return "timeout", str(e), ""
        except Exception as e:  # noqa: BLE001 - any other failure is an outcome of this row
            return "error", str(e), ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(row) for row in batch.to_dict("records")]
            yield pd.DataFrame(found, columns=["status", "error", "body"], index=batch.index).assign(id=batch["id"])[
                ["id", "status", "error", "body"]
            ]

    return run


def rule_answer(row: dict) -> str:
    """A deterministic extractor without a model: the first line is the title, code is its own solution."""
    kind = row["content_type"]
    analysis = {
        "title": row["content"].split("\n")[0].strip(WHITE_SPACE),
        "summary": row["content"],
        "category": kind,
        "problem": "",
        "solution_text": row["content"] if kind == "code" else "",
        "occurred_at": "",
        "source_name": "",
        "source_ref": "",
        "suggested_status": "",
        "confidence": 0.5,
        "tags": [kind, "Auto"],
    }
    return json.dumps({"output": [{"content": [{"type": "output_text", "text": json.dumps(analysis)}]}]})


def analyze_captures(
    captures: DataFrame,
    insights: DataFrame | None,
    extractor: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None,
    *,
    model: str = "",
    provider: str = "rules",
    prompt: str | None = None,
    throttle_by: str | None = None,
    keep_at: str | None = None,
    slices: int = 1,
    as_of=None,
) -> tuple[DataFrame, DataFrame]:
    """The new insight table, and ``(id, status, error)`` per capture.

    ``insights`` is the table so far; where there is none, all captures are asked for.  The extractor gets ``id``, ``content``, ``content_type`` and ``captured_at``, and with a ``prompt``
    also the ready ``request_json``.
    Status is ``cached`` where an insight exists, ``throttled`` where the recent ring of
    ``throttle_by`` refuses, else the result of the call: ``ok``, ``unavailable``, ``timeout``,
    ``error``, ``bad_envelope``, ``empty_output`` or ``bad_json``.  The answers are staged, so a lost
    executor or a later step never repeats a finished call.  With ``keep_at``, a folder that names the run, they are kept
    there in ``slices`` and a run that failed goes on where it stopped (see ``kept_answers``).
    """
    pending = captures
    if insights is not None:
        # The ids are compared first, so the texts of captures with an insight never move.
        todo = stage(unanalyzed(captures.select("id"), insights), "pending")
        pending = captures.join(todo, "id", "left_semi")
    if throttle_by:
        ring = recent_ring(
            pending.select(F.col(throttle_by).alias("key"), F.col("id").alias("seq"), content_hash(F.col("content")).alias("hash"))
        )
        ring = stage(ring.rows.select(F.col("seq").alias("id"), "accepted"), "throttle")
        refused = ring.where(~F.col("accepted")).select(
            "id", F.lit("throttled").alias("status"), F.lit("").alias("error")
        )
        pending = pending.join(ring.where("accepted").select("id"), "id", "left_semi")
    fresh, called = _called(captures, pending, extractor, model, provider, prompt, keep_at, slices)
    report = called
    if insights is not None:
        held = captures.select("id").join(insights.select(F.col("capture_id").alias("id")), "id", "left_semi")
        report = called.unionByName(held.select("id", F.lit("cached").alias("status"), F.lit("").alias("error")))
    if throttle_by:
        report = report.unionByName(refused)
    return upsert_insights(insights, fresh, as_of), report


def _called(
    captures: DataFrame,
    pending: DataFrame,
    extractor: Callable | None,
    model: str,
    provider: str,
    prompt: str | None,
    keep_at: str | None = None,
    slices: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """One call per row of ``pending``: the insights it yields, and ``(id, status, error)``."""
    ship_package(captures.sparkSession, lorekeep)
    work = pending.select("id", "content", "content_type", "captured_at")
    if prompt is not None:
        work = work.withColumn("request_json", request_json(model, prompt))
    extractor = extractor or calls(rule_answer)
    # read for the insights, for their ids and for the report: every answer is parsed once
    if keep_at:
        answers = kept_answers(work, extractor, keep_at, slices)
        parsed = stage(parse_responses(answers.where(F.col("status") == "ok")), "parsed-answers")
    else:
        # answers are long: they are stored with what they were parsed to, not once more beside it
        answers = stage(parse_responses(work.mapInPandas(extractor, CALL_RESULT)), "parsed-answers")
        parsed = answers.where(F.col("status") == "ok")
    good = normalize_analysis(parsed.where(F.col("parse_error").isNull()))
    source = captures.select("id", F.col("source").alias("capture_source"))
    fresh = good.join(source, "id").select(
        F.col("id").alias("seq"),
        F.col("id").alias("capture_id"),
        *[c for c in S.ANALYSIS.names if c not in ("source_name", "suggested_status")],
        first_non_blank(F.col("source_name"), F.col("capture_source")).alias("source_name"),
        first_non_blank(F.col("suggested_status"), F.lit(S.DEFAULT_SUGGESTED_STATUS)).alias("suggested_status"),
        F.lit(model).alias("model"),
        F.lit(provider).alias("provider"),
        F.col("body").alias("raw_json"),
    )
    failed = answers.where(F.col("status") != "ok").select("id", "status", "error")
    read = parsed.select("id", F.coalesce("parse_error", F.lit("ok")).alias("status"), F.lit("").alias("error"))
    return fresh, failed.unionByName(read)


CRASHED = "crashed"


def _guarded(extractor: Callable) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Keeps what an extractor answered before it broke down: the rows it had not answered are ``crashed``, those
    after them are not asked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answered: set = set()
            try:
                for part in extractor(iter([batch])):
                    answered.update(part["id"])
                    yield part
            except Exception as e:  # noqa: BLE001 - told by the driver once the answers are stored
                left = [i for i in batch["id"] if i not in answered]
                yield pd.DataFrame({"id": left, "status": CRASHED, "error": str(e), "body": ""})
                return

    return run


def kept_answers(work: DataFrame, extractor: Callable, path: str, slices: int = 1) -> DataFrame:
    """The extractor's answers to ``work``, kept under ``path`` so that no answered row is asked again.

    Rows are asked in ``slices`` jobs, by id.  A slice is stored when it is done, so a lost executor repeats the calls of
    its unfinished tasks alone, and a stopped run repeats at most one slice's.  An extractor that breaks down fails the
    run once the slice's answers are stored.  A later call with the same ``path`` asks only for rows without an ``ok``
    answer.  Small slices lose less, large ones keep more tasks busy.
    """
    spark = work.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    kind = CALL_RESULT + ", attempt int, slice int"
    earlier = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    attempts = [int(name.removeprefix("attempt=")) for name in earlier if name.startswith("attempt=")]
    attempt = max(attempts, default=-1) + 1
    todo = work
    if attempts:
        held = stage(spark.read.schema(kind).parquet(path).where("status = 'ok'").select("id"), "answered")
        todo = work.join(held, "id", "left_anti")
    for k in range(slices):
        part = f"{path}/attempt={attempt}/slice={k}"
        mine = todo.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == k)
        mine.mapInPandas(_guarded(extractor), CALL_RESULT).write.parquet(part)
        broken = spark.read.schema(CALL_RESULT).parquet(part).where(F.col("status") == CRASHED).select("error").first()
        if broken:
            raise RuntimeError(f"the extractor broke down, its answers are kept under {path}: {broken['error']}")
    answers = spark.read.schema(kind).parquet(path).join(work.select("id"), "id", "left_semi")
    # a row without a good answer shows its latest failure; all rows were asked in the last attempt or answered before it
    return answers.where((F.col("status") == "ok") | (F.col("attempt") == attempt)).select("id", "status", "error", "body")


@dataclass(frozen=True)
class AnalysisResult:
    """The new insight table, ``report(seq, id, status, error)`` per request, and ``rings(key, ring)`` to hand to
    the next batch of requests."""

    table: DataFrame
    report: DataFrame
    rings: DataFrame


def analyze_requests(
    captures: DataFrame,
    insights: DataFrame,
    requests: DataFrame,
    extractor: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None,
    *,
    rings: DataFrame | None = None,
    keep_at: str | None = None,
    slices: int = 1,
    model: str = "",
    provider: str = "rules",
    prompt: str | None = None,
    as_of=None,
) -> AnalysisResult:
    """Analyses the captures that ``requests(seq, id)`` ask for; ``seq`` is unique, ids may repeat without limit.

    The requests are read as made together, before any answer is in: ``not_found`` for an unknown or null id,
    ``cached`` where the table has an insight; of the others, in ``seq`` order, those whose text is among the last
    three accepted are ``throttled``.  Each capture with an accepted request is called once.  Its first accepted
    request reports the result, a later one ``cached`` or the same failure.  ``rings`` are those an earlier batch
    ended with.  ``keep_at`` and ``slices`` as for :func:`analyze_captures`.
    """
    asked = requests.select("seq", "id")
    uses = asked.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    told = insights.select(F.col("capture_id").alias("id"), F.lit(True).alias("told"))
    known = uses.join(captures.select("id", "content_hash"), "id").join(told, "id", "left")
    known = stage(known.withColumn("found", F.lit(True)), "asked-captures")
    rows = stage(attach_per_key(asked, known, "id"), "requests")
    status = F.when(F.col("found").isNull(), "not_found").when(F.col("told"), "cached")
    settled = rows.where(status.isNotNull()).select("seq", "id", status.alias("status"), F.lit("").alias("error"))

    ring = recent_ring(
        rows.where(status.isNull()).select(F.lit("").alias("key"), "seq", F.col("content_hash").alias("hash")), given=rings
    )
    decided = stage(ring.rows.select("seq", "accepted"), "throttle").join(rows.select("seq", "id"), "seq")
    throttled = decided.where(~F.col("accepted")).select(
        "seq", "id", F.lit("throttled").alias("status"), F.lit("").alias("error")
    )
    accepted = stage(decided.where("accepted").select("seq", "id"), "accepted")
    firsts = stage(first_per_key(accepted, "id"), "first-accepted")
    fresh, called = _called(
        captures, captures.join(firsts.select("id"), "id", "left_semi"), extractor, model, provider, prompt, keep_at, slices
    )
    results = stage(called.join(firsts, "id"), "results")
    again = (F.col("seq") != F.col("first_seq")) & (F.col("status") == "ok")
    answered = attach_per_key(accepted, results, "id").select(
        "seq", "id", F.when(again, "cached").otherwise(F.col("status")).alias("status"), "error"
    )
    report = settled.unionByName(throttled).unionByName(answered)
    if rings is None:
        after = ring.rings
    else:
        idle = rings.join(ring.rings, rings["key"].eqNullSafe(ring.rings["key"]), "left_anti")
        after = idle.unionByName(ring.rings)
    return AnalysisResult(upsert_insights(insights, fresh, as_of), report, after)


def analysis_outcomes(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
