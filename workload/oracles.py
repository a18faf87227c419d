"""The same results in DuckDB SQL, written from the rules and not from the Spark plans."""

from __future__ import annotations

from lorekeep import schemas as S
from lorekeep.functions.text import WHITE_SPACE as WS
from workload import inputs as I
from workload import queries as W

LATER_S = 1706933106
AS_OF_S = 1704412800
OK_STATUS = "('draft', 'probable_success', 'confirmed_success', 'failed')"


def T(x: str) -> str:
    return f"trim({x}, '{WS}')"


def L(x: str) -> str:
    return T(f"lower({x})")


def N(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[{WS}]+', ' ', 'g'))"


def A(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def lst(csv: str) -> str:
    return f"(case when {csv} = '' then [''] else string_split({csv}, ',') end)"


def cleaned(tags: str) -> str:
    return f"list_filter(list_transform({tags}, lambda t: {L('t')}), lambda t: t <> '')"


def sorted_set(tags: str) -> str:
    return f"list_sort(list_distinct({cleaned(tags)}))"


def ordered(tags: str) -> str:
    # One row per tag and its first place; list_distinct does not keep the order.
    return f"list_filter({cleaned(tags)}, lambda t, i: list_position({cleaned(tags)}, t) = i)"


def join(tags: str, by: str = ",") -> str:
    return f"coalesce(array_to_string({tags}, '{by}'), '')"


def first(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({T(x)}, '')" for x in xs) + ", '')"


def ctype(x: str) -> str:
    low = f"lower({x})"
    has = lambda *marks: " or ".join(f"contains({low}, '{m}')" for m in marks)
    return (
        f"case when starts_with({low}, 'http://') or starts_with({low}, 'https://') then 'url' "
        f"when {has('```', 'package ', 'func ', 'class ')} then 'code' "
        f"when {has('user:', 'assistant:', 'system:')} then 'chat_transcript' "
        f"when {newlines(x)} > 8 then 'long_text' else 'text' end"
    )


def newlines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')))"


def lines(x: str) -> str:
    return f"cast(case when {x} = '' then 0 else {newlines(x)} + 1 end as integer)"


def key(tags: str) -> str:
    fields = ("title", "problem", "solution_text", "source_type", "source_name", "source_ref")
    parts = [N(f) for f in fields] + [join(tags, "|")]
    return "sha256(" + " || chr(10) || ".join(parts) + ")"


def src(name: str) -> str:
    return I.sql_text(getattr(I, name))


ALL_CAPTURES = f"{src('CAPTURES')} union all {src('MORE_CAPTURES')}"
IMPORT_TAGS = "['imported', 'Auto']"


def blank_or(x: str, default: str) -> str:
    return f"case when {T(x)} = '' then '{default}' else {x} end"


# --- reusable CTEs


def requests(name: str, view: str, status: str = "probable_success", more_tags: str = "[]") -> str:
    """Normalised import requests with their reject rule and fingerprint."""
    tags = sorted_set(f"list_concat({lst('tags_csv')}, {more_tags})")
    return f"""
    {name}_n as (
      select seq, {T('title')} as title, {T('problem')} as problem, {T('solution_text')} as solution_text,
             '' as raw_content, 'auto' as efficacy_source, {L(blank_or('status', status))} as status,
             {L(blank_or('source_type', 'local_json'))} as source_type,
             {T(blank_or('source_name', 'local_json'))} as source_name, {T('source_ref')} as source_ref,
             {T('raw_content_ref')} as raw_content_ref, {tags} as tags
      from ({view})),
    {name} as (
      select *, case when title = '' then 'blank_title' when solution_text = '' then 'blank_solution_text'
                     when status not in {OK_STATUS} then 'unknown_status' end as invalid_reason,
             {key('tags')} as dedup_key
      from {name}_n)"""


def created(name: str, req: str, stored: str | None, at: int) -> str:
    """``{name}_keys`` (per fingerprint: first seq, id) and ``{name}`` (the new rows)."""
    held = f"select dedup_key from {stored}" if stored else "select '' where false"
    base = f"(select max(id) from {stored})" if stored else "0"
    return f"""
    {name}_first as (
      select * from {req} where invalid_reason is null
      qualify row_number() over (partition by dedup_key order by seq) = 1),
    {name} as (
      select {base} + row_number() over (order by seq) as id, seq, title, problem, solution_text, raw_content,
             efficacy_source, status, source_type, source_name, source_ref, raw_content_ref, dedup_key, tags,
             cast({at} as bigint) as created_s, cast({at} as bigint) as updated_s
      from {name}_first where dedup_key not in ({held}))"""


SOLUTION_COLS = (
    "id, title, problem, solution_text, raw_content, efficacy_source, status, source_type, source_name, "
    "source_ref, raw_content_ref, dedup_key, tags, created_s, updated_s"
)
TABLE_COLS = SOLUTION_COLS.replace(" tags,", f" {join('tags')} as tags,")

STORED = (
    requests("req", src("CANDIDATES"))
    + ","
    + created("imported", "req", None, AS_OF_S)
    + f""",
    stored as (
      select {SOLUTION_COLS.replace(', updated_s', '')}, 1704067200 + cast(floor(id / 3) as bigint) as updated_s
      from imported)"""
)

MORE = requests("more", src("MORE_CANDIDATES"), more_tags=IMPORT_TAGS)
MORE_PLAIN = requests("more", src("MORE_CANDIDATES"))


def outcome(req: str, new: str, stored: str | None) -> str:
    held = f"left join {stored} s on s.dedup_key = r.dedup_key" if stored else ""
    sid = "s.id" if stored else "null"
    return f"""
    select r.seq, case when r.invalid_reason is not null then 'invalid'
                       when n.seq = r.seq then 'created' else 'duplicate' end as outcome,
           case when r.invalid_reason is null then coalesce(n.id, {sid}) end as id
    from {req} r left join {new} n on n.dedup_key = r.dedup_key {held}"""


def capture_rows(name: str, view: str) -> str:
    text = T("content")
    return f"""
    {name} as (
      select seq, content, sha256(content) as content_hash, {ctype('content')} as content_type,
             cast(length(content) as integer) as char_count, {lines('content')} as line_count, source, captured_s
      from (select seq, {text} as content, source, captured_s from ({view})))"""


def captured(name: str, rows: str, stored: str | None) -> str:
    held = f"select content_hash from {stored}" if stored else "select '' where false"
    base = f"(select max(id) from {stored})" if stored else "0"
    return f"""
    {name} as (
      select {base} + row_number() over (order by seq) as id, * from (
        select * from {rows} where content <> ''
        qualify row_number() over (partition by content_hash order by seq) = 1)
      where content_hash not in ({held}))"""


CAPTURE_COLS = "id, content, content_hash, content_type, char_count, line_count, source, captured_s"
CAPS = capture_rows("cap_rows", src("CAPTURES")) + "," + captured("caps", "cap_rows", None)
MORE_CAPS = capture_rows("more_rows", src("MORE_CAPTURES")) + "," + captured("more_caps", "more_rows", "caps")

INSIGHT_TEXTS = "title, summary, category, problem, solution_text, occurred_at, source_name"
INSIGHTS = (
    CAPS
    + f""",
    insights as (
      select c.id as capture_id, i.title, i.summary, i.category, i.problem, i.solution_text, i.occurred_at,
             i.source_name, '' as source_ref, i.suggested_status, i.confidence, {ordered(lst('i.tags_csv'))} as tags,
             'm' as model, 'p' as provider, cast({AS_OF_S} as bigint) as analyzed_s, c.content
      from ({src('INSIGHTS')}) i join cap_rows r on r.seq = i.capture_seq join caps c on c.content_hash = r.content_hash
      qualify row_number() over (partition by c.id order by i.capture_seq desc) = 1)"""
)
INSIGHT_COLS = (
    "capture_id, title, summary, category, problem, solution_text, occurred_at, source_name, source_ref, "
    "suggested_status, confidence, model, provider"
)

RULES_INSIGHTS = lambda caps, guard: f"""
      select id as capture_id, {T("string_split(content, chr(10))[1]")} as title, content as summary,
             content_type as category, '' as problem,
             case when content_type = 'code' then content else '' end as solution_text, '' as occurred_at,
             {T('source')} as source_name, '' as source_ref, 'draft' as suggested_status,
             cast(0.5 as double) as confidence, [content_type, 'auto'] as tags, 'rules-1' as model,
             'rules' as provider, cast({LATER_S} as bigint) as analyzed_s, content
      from {caps} {guard}"""


def with_(*ctes: str) -> str:
    return "with " + ",".join(ctes) + " "


def promoted(caps: str, insights: str, asked: str) -> str:
    """Create requests of promoted captures, in the columns of :func:`requests`."""
    title = first("i.title", f"substr({T('c.content')}, 1, 24)", "'未命名抓取'")
    tags = sorted_set(f"case when {T('i.category')} = '' then i.tags else list_append(i.tags, i.category) end")
    return f"""
    promo_n as (
      select a.seq, {title} as title, {T('i.problem')} as problem, {first('i.solution_text', 'i.summary')} as solution_text,
             case when length(c.content) <= 4096 then c.content else '' end as raw_content, 'auto' as efficacy_source,
             {L(first('i.suggested_status', "'draft'"))} as status, 'capture' as source_type,
             {first('i.source_name', 'c.source')} as source_name, 'capture://' || c.id as source_ref,
             'capture://' || c.id as raw_content_ref, {tags} as tags, c.id as capture_id
      from {asked} a join {caps} c on c.id = a.id join {insights} i on i.capture_id = c.id),
    promo as (
      select *, case when title = '' then 'blank_title' when solution_text = '' then 'blank_solution_text'
                     when status not in {OK_STATUS} then 'unknown_status' end as invalid_reason,
             {key('tags')} as dedup_key
      from promo_n)"""


def like(col: str, word: str) -> str:
    return f"{A(f'coalesce({col}, {chr(39)*2})')} like '%{word}%'"


WORD = W.WORD.lower()
TEXTS = ("title", "problem", "solution_text")


def searched(word: str) -> str:
    tests = [like(f, word) for f in TEXTS]
    tests.append(f"list_bool_or(list_transform(tags, lambda t: {like('t', word)}))")
    return "(" + " or ".join(f"coalesce({t}, false)" for t in tests) + ")"


def stored_where(cond: str) -> str:
    return with_(STORED) + f"select id, title, status from stored where {cond}"


def page(cond: str, limit: int, offset: int) -> str:
    return (
        with_(STORED)
        + f"select id, title, solution_text, {join('tags')} as tags, updated_s from stored where {cond} "
        f"order by updated_s desc, id desc limit {limit} offset {offset}"
    )


def value(view: str, k: str, expr: str) -> str:
    return f"select {k} as k, {expr} as v from ({view})"


DOCS = "select * from documents"

# --- updates
UPDATES = f"""
    upd_n as (
      select seq, id, {T('title')} as title, {T('problem')} as problem, {T('solution_text')} as solution_text,
             {L('status')} as status, {sorted_set(lst('tags_csv'))} as tags
      from ({src('UPDATES')})),
    upd as (
      select *, case when title = '' then 'blank_title' when solution_text = '' then 'blank_solution_text'
                     when status not in {OK_STATUS} then 'unknown_status' end as invalid_reason
      from upd_n)"""
DECIDED = (
    UPDATES
    + f""",
    live_n as (
      select u.seq, u.id, u.title, u.problem, u.solution_text, u.status, u.tags, s.source_type, s.source_name, s.source_ref
      from upd u join stored s on s.id = u.id where u.invalid_reason is null
      qualify row_number() over (partition by u.id order by u.seq desc) = 1),
    live as (select *, {key('tags')} as new_key from live_n),
    decided as (
      select l.*, coalesce(h.id, first_value(l.id) over (partition by l.new_key order by l.seq)) as winner_id
      from live l left join stored h on h.dedup_key = l.new_key),
    reported as (
      select u.seq, case when u.invalid_reason is not null then 'invalid' when s.id is null then 'not_found'
                         when d.seq <> u.seq then 'superseded' when d.winner_id = u.id then 'updated'
                         else 'duplicate' end as outcome, u.id as asked_id, d.winner_id
      from upd u left join stored s on s.id = u.id left join decided d on d.id = u.id)"""
)

# --- events
EVENTS = "select user_id, epoch_us(ts) as at_us, event_id from events"
KEYS = f"select user_id, epoch_us(ts) as at_us, event_id, key, action from ({src('KEYS')})"
HELD = f"""
    states as (
      select *, last_value(case when key = 'ctrl' then action end ignore nulls)
                over (partition by user_id order by at_us, event_id rows unbounded preceding) as state
      from ({KEYS})),
    held as (select user_id, at_us, event_id from states where key = 'c' and action = 'down' and state = 'down')"""


def pairs(rows: str, gap: int) -> str:
    return f"""
    gaps as (
      select *, case when at_us - lag(at_us) over w <= {gap} then 0 else 1 end as fresh
      from ({rows}) window w as (partition by user_id order by at_us, event_id)),
    runs as (select *, sum(fresh) over (partition by user_id order by at_us, event_id rows unbounded preceding) as run from gaps),
    placed as (select *, row_number() over (partition by user_id, run order by at_us, event_id) as place from runs)
    select user_id, at_us, event_id from placed where place % 2 = 0"""


def ring(rows: str, order: str) -> str:
    return f"""with recursive ring_rows as materialized (
      select source as key, seq, sha256({T('content')}) as hash,
             row_number() over (partition by source order by {order}) as n from ({rows})),
    walk as (
      select key, seq, hash, n, true as accepted, [hash] as ring from ring_rows where n = 1
      union all
      select r.key, r.seq, r.hash, r.n, not list_contains(w.ring, r.hash),
             case when list_contains(w.ring, r.hash) then w.ring else list_prepend(r.hash, w.ring)[1:3] end
      from walk w join ring_rows r on r.key = w.key and r.n = w.n + 1)
    select key, seq, hash, accepted from walk"""


ANALYSIS_TEXTS = [f.name for f in S.ANALYSIS.fields if f.name not in ("confidence", "tags")]
FAILURES = {"url": "unavailable", "code": "timeout", "chat_transcript": "error", "long_text": "empty_output", "text": "ok"}


def _response_parse() -> str:
    bad = "case when confidence < 0 then 'bad_envelope' when category = 'FR' then 'empty_output' when category = 'DE' then 'bad_json' end"
    fields = [f"case when {bad} is null then {c if c != 'source_ref' else chr(39) * 2} end as {c}" for c in ANALYSIS_TEXTS]
    return (
        f"select capture_seq as id, {bad} as parse_error, {', '.join(fields)}, "
        f"case when {bad} is null then confidence end as confidence, "
        f"case when {bad} is null then tags_csv end as tags from ({src('INSIGHTS')})"
    )


def _normalize_analysis() -> str:
    texts = [c for c in ANALYSIS_TEXTS if c not in ("category", "suggested_status", "source_ref")]
    return (
        f"select capture_seq, {', '.join(f'{T(c)} as {c}' for c in texts)}, {L('category')} as category, "
        f"{L('suggested_status')} as suggested_status, '' as source_ref, "
        f"greatest(0.0::double, least(1.0::double, confidence)) as confidence, {join(ordered(lst('tags_csv')))} as tags "
        f"from ({src('INSIGHTS')})"
    )


def oracles() -> dict[str, str]:
    ins, cand, more = src("INSIGHTS"), src("CANDIDATES"), src("MORE_CANDIDATES")
    caps = src("CAPTURES")
    cols = "title, problem, solution_text, source_type, source_name, source_ref, raw_content_ref"
    found = {
        "utrim": value(ALL_CAPTURES, "seq", T("content")),
        "ulower": value(DOCS, "doc_id", "lower(text)"),
        "normalize_text": value(more, "seq", N("solution_text")),
        "tags_sorted_set": value(ins, "capture_seq", join(sorted_set(lst("tags_csv")))),
        "tags_ordered_distinct": value(ins, "capture_seq", join(ordered(lst("tags_csv")))),
        "dedup_key": value(more, "seq", key(sorted_set(lst("tags_csv")))),
        "content_hash": value(ALL_CAPTURES, "seq", f"sha256({T('content')})"),
        "char_count": value(ALL_CAPTURES, "seq", "cast(length(content) as integer)"),
        "line_count": value(ALL_CAPTURES, "seq", lines("content")),
        "content_type": value(ALL_CAPTURES, "seq", ctype("content")),
        "first_non_blank": value(ins, "capture_seq", first("solution_text", "summary")),
        "fallback_untrimmed": value(cand, "seq", blank_or("source_name", "local_json")),
        "fallback_status": value(cand, "seq", blank_or("status", "probable_success")),
        "fallback_title": value(
            ALL_CAPTURES, "seq", f"case when {T('content')} = '' then '未命名抓取' else substr({T('content')}, 1, 24) end"
        ),
        "keep_raw_if_short": value(
            ALL_CAPTURES, "seq", f"case when length({T('content')}) <= 4096 then {T('content')} else '' end"
        ),
        "capture_ref": value(ALL_CAPTURES, "seq", "'capture://' || seq"),
        "append_category_tag": value(
            ins,
            "capture_seq",
            join(f"case when {T('category')} = '' then {lst('tags_csv')} else list_append({lst('tags_csv')}, category) end"),
        ),
        "clamp_confidence": value(ins, "capture_seq", "greatest(0.0::double, least(1.0::double, confidence))"),
        "rfc3339": value(caps, "seq", "strftime(make_timestamp(captured_s * 1000000), '%Y-%m-%dT%H:%M:%SZ')"),
        "sql_lower_ascii": value(DOCS, "doc_id", A("text")),
        "concat_tags": value(cand, "seq", join(f"list_concat({lst('tags_csv')}, {IMPORT_TAGS})")),
        "now_seconds": value(cand, "seq", "'2024-02-03 04:05:06.000'"),
        "split_tags_csv": value(
            cand, "seq", join(f"list_filter(list_transform(string_split(tags_csv, ','), lambda t: {T('t')}), lambda t: t <> '')", "|")
        ),
        "parse_ts": value(
            "select * from events", "event_id", "case when event_type <> 'error' then strftime(ts, '%Y%m%d%H%M%S') end"
        ),
        "null_defaults": "select d.doc_id, coalesce(l.quality, 0) as quality, coalesce(l.toxic, 0) as toxic, "
        "case when l.doc_id is null then '' else d.source end as label_source "
        "from documents d left join labels l on l.doc_id = d.doc_id",
        "normalize_analysis": _normalize_analysis(),
        "source_registry": f"select {cols}, tags_csv as tags, status from ({cand})",
        "capture_batch": with_(capture_rows("r", ALL_CAPTURES))
        + "select seq, content, content_type, char_count, line_count, source, captured_s, "
        "case when content = '' then 'empty' end as reject from r",
        "request_build": with_(CAPS)
        + "select id, 'model-1' as model, 'Describe the captured text as one JSON object that follows the given schema.' as prompt, "
        "'user' as role, 'Captured at: ' || strftime(make_timestamp(captured_s * 1000000), '%Y-%m-%dT%H:%M:%SZ') || chr(10) || "
        "'Content type: ' || content_type || chr(10) || 'Captured content:' || chr(10) || content as text, "
        "'capture_analysis' as answer from caps",
        "response_parse": _response_parse(),
        "tags_json_codec": f"select capture_seq as k, cast(to_json({ordered(lst('tags_csv'))}) as varchar) as tags_json, "
        f"case when suggested_status = 'bogus' then '' else {join(ordered(lst('tags_csv')))} end as tags from ({ins})",
        "schema_upgrade": "select doc_id, lang, source, '' as raw_content from documents",
        "table_snapshot": with_(STORED) + "select id, status, dedup_key from stored where status <> 'failed'",
        "analysis_schema": "select capture_seq, case when category = 'DE' then 'missing source_ref' "
        f"when suggested_status not in {OK_STATUS} then 'unknown suggested_status' end as contract_error from ({ins})",
        "create_validate": with_(requests("req", cand))
        + "select seq, title, problem, solution_text, raw_content, efficacy_source, status, source_type, source_name, "
        f"source_ref, raw_content_ref, {join('tags')} as tags, invalid_reason from req",
        "update_validate": with_(UPDATES)
        + f"select seq, id, title, problem, solution_text, status, {join('tags')} as tags, invalid_reason from upd",
        "filter_status": stored_where("status = 'failed'"),
        "filter_efficacy": stored_where("efficacy_source = 'auto'"),
        "filter_efficacy_mixed": stored_where("status <> 'draft'"),
        "search_solutions": stored_where(searched(f"{WORD} l")),
        "conjunctive_filter": stored_where(
            f"{searched(WORD)} and status = 'draft' and efficacy_source = 'auto' and list_contains(tags, 'fr')"
        ),
        "search_trigrams": with_(STORED)
        + " union all ".join(f"select '{w}' as asked, id from stored where {searched(w.lower())}" for w in W.INDEXED_WORDS),
        "search_captures_trigrams": with_(INSIGHTS)
        + " union all ".join(
            f"select '{w}' as asked, c.id from caps c left join insights i on i.capture_id = c.id where "
            + " or ".join(like(x, w.lower()) for x in ("c.content", "c.content_type", "i.summary", "i.category"))
            for w in W.INDEXED_WORDS
        ),
        "filter_tag": stored_where("list_contains(tags, 'de')"),
        "search_or_exists": stored_where(searched("es")),
        "search_captures": with_(INSIGHTS)
        + "select c.id, c.content_type, i.category from caps c left join insights i on i.capture_id = c.id where "
        + " or ".join(like(x, "en") for x in ("c.content", "c.content_type", "i.summary", "i.category")),
        "filter_analyzed": with_(INSIGHTS)
        + "select '' as asked, id from caps union all select ' TRUE ', id from caps where id in (select capture_id from insights) "
        "union all select 'no', id from caps where id not in (select capture_id from insights)",
        "lookup_solution_by_id": with_(STORED)
        + f"select id, title, {join('tags')} as tags from stored where id in (select doc_id * 2 from labels)",
        "lookup_solution_by_key": with_(STORED, MORE_PLAIN)
        + "select id, dedup_key, raw_content_ref from stored where dedup_key in (select dedup_key from more)",
        "lookup_capture": with_(INSIGHTS)
        + "select a.id, c.id is not null as found, c.content, i.title as insight_title from (select doc_id * 5 as id from labels) a "
        "left join caps c on c.id = a.id left join insights i on i.capture_id = a.id",
        "like_literal_semantics": "select "
        + ", ".join(
            f"count(*) filter ({A('text')} like '%{p.lower()}%') as p{i}" for i, p in enumerate(W.PATTERNS)
        )
        + " from documents",
        "capture_reject_blank": f"select seq, 'empty' as reject from ({ALL_CAPTURES}) where {T('content')} = ''",
        "project_public": with_(INSIGHTS)
        + f"select {INSIGHT_COLS}, {join('tags')} as tags, analyzed_s from insights",
        "solutions_with_tags": with_(STORED) + f"select id, title, {join('tags')} as tags from stored",
        "captures_with_insight": with_(INSIGHTS)
        + "select c.id, c.source, i.capture_id is not null as analyzed, i.summary, i.confidence "
        "from caps c left join insights i on i.capture_id = c.id",
        "unanalyzed_captures": with_(INSIGHTS)
        + "select id, content_hash from caps left join insights on capture_id = id where capture_id is null",
        "new_vs_existing": with_(STORED, MORE_PLAIN)
        + "select dedup_key, min(seq) as first_seq, count(*) as n from more "
        "where dedup_key not in (select dedup_key from stored) group by dedup_key",
        "resolve_existing": with_(CAPS, MORE_CAPS)
        + "select r.seq, case when r.content = '' then 'empty' when n.seq = r.seq then 'created' else 'duplicate' end as outcome, "
        "coalesce(n.id, c.id) as id, coalesce(n.captured_s, c.captured_s) as captured_s "
        "from more_rows r left join more_caps n on n.content_hash = r.content_hash left join caps c on c.content_hash = r.content_hash",
        "insert_captures": with_(CAPS, MORE_CAPS)
        + "select r.seq, case when r.content = '' then 'empty' when n.seq = r.seq then 'created' else 'duplicate' end as outcome, "
        "coalesce(n.id, c.id) as id from more_rows r left join more_caps n on n.content_hash = r.content_hash "
        "left join caps c on c.content_hash = r.content_hash",
        "insert_captures_table": with_(CAPS, MORE_CAPS)
        + f"select {CAPTURE_COLS} from caps union all select {CAPTURE_COLS} from more_caps",
        "tags_group_concat": with_(STORED) + f"select id, {join('tags')} as tags_csv from stored",
        "count_solutions": with_(STORED) + f"select count(*) as total from stored where {searched(WORD)}",
        "import_summary": with_(STORED, MORE_PLAIN, created("fresh", "more", "stored", LATER_S))
        + "select (select count(*) from fresh) as imported, "
        "(select count(*) from more where invalid_reason is null) - (select count(*) from fresh) as duplicates, "
        "(select count(*) from more where invalid_reason is not null) as skipped",
        "affected_rows": with_(STORED, DECIDED)
        + "select "
        + ", ".join(
            f"count(*) filter (outcome = '{o}') as {o}" for o in ("updated", "duplicate", "not_found", "invalid", "superseded")
        )
        + " from reported",
        "page_with_total": with_(STORED)
        + f", hits as (select id, updated_s from stored where {searched(WORD)}), "
        "page as (select id from hits order by updated_s desc, id desc limit 30 offset 10) "
        "select 'item' as kind, id as n from page union all select 'count', count(*) from page union all select 'total', count(*) from hits",
        "tag_counts": with_(STORED) + "select tag, count(*) as n from (select unnest(tags) as tag from stored) group by tag",
        "first_wins_dedup": with_(requests("req", cand), created("fresh", "req", None, AS_OF_S))
        + outcome("req", "fresh", None),
        "double_trigger": "with " + pairs(EVENTS, W.GAP),
        "chord_held": "with " + HELD + " select * from held",
        "double_chord": "with " + HELD + ", " + pairs("select * from held", W.CHORD_GAP),
        "list_solutions": page("true", 50, 31),
        "page_bounds": page("true", 20, 0),
        "solutions_search": page(f"{searched(WORD)} and status = 'draft'", 40, 0),
        "list_captures": with_(INSIGHTS)
        + "select c.id, c.content, c.content_type, c.captured_s, i.title as insight_title "
        "from caps c left join insights i on i.capture_id = c.id where "
        + " or ".join(like(x, "e") for x in ("c.content", "c.content_type", "i.summary", "i.category"))
        + " order by c.captured_s desc, c.id desc limit 60 offset 7",
        "pager_info": with_(STORED)
        + ", t as (select count(*) as total, greatest(1, cast(ceil(count(*) / 40.0) as bigint)) as pages from stored) "
        "select total, pages, least(7, pages) as page, (least(7, pages) - 1) * 40 as page_offset from t",
        "pager_info_past_end": with_(STORED)
        + ", t as (select count(*) as total from stored where status = 'failed'), "
        "p as (select total, greatest(1, (total + 39) // 40) as pages from t) "
        "select total, pages, pages as page, (pages - 1) * 40 as page_offset from p",
        "create_solutions": with_(STORED, MORE, created("fresh", "more", "stored", LATER_S)) + outcome("more", "fresh", "stored"),
        "create_solutions_table": with_(STORED, MORE, created("fresh", "more", "stored", LATER_S))
        + f"select {TABLE_COLS} from stored union all select {TABLE_COLS} from fresh",
        "update_solutions": with_(STORED, DECIDED)
        + "select seq, outcome, case when outcome = 'duplicate' then winner_id when outcome in ('updated', 'superseded') then asked_id end as id from reported",
        "update_solutions_table": with_(STORED, DECIDED)
        + ", u as (select * from decided where winner_id = id) select s.id, "
        + ", ".join(
            f"case when u.id is null then s.{x} else u.{x} end as {x}" for x in ("title", "problem", "solution_text", "status")
        )
        + ", s.raw_content, s.efficacy_source, s.source_type, s.source_name, s.source_ref, s.raw_content_ref, "
        f"coalesce(u.new_key, s.dedup_key) as dedup_key, {join('case when u.id is null then s.tags else u.tags end')} as tags, "
        f"s.created_s, case when u.id is null then s.updated_s else {LATER_S} end as updated_s "
        "from stored s left join u on u.id = s.id",
        "replace_tags": with_(STORED)
        + f"select s.id, coalesce({join(sorted_set(lst('t.tags_csv'))).replace('coalesce(', '(', 1).replace(chr(44) + ' ' + chr(39) * 2 + ')', ')')}, {join('s.tags')}) as tags "
        "from stored s left join (select page_id + 1 as id, 'New, NEW,,' || url as tags_csv from pages) t on t.id = s.id",
        "delete_solutions": with_(STORED)
        + f"select d.seq, case when s.id is not null and row_number() over (partition by d.id order by d.seq) = 1 "
        f"then 'deleted' else 'not_found' end as outcome, d.id from ({I.sql_text(W.DELETES)}) d left join stored s on s.id = d.id",
        "delete_solutions_table": with_(STORED)
        + f"select id, dedup_key from stored where id not in (select id from ({I.sql_text(W.DELETES)}))",
        "upsert_insights": with_(INSIGHTS)
        + f", edits as (select *, row_number() over (partition by capture_id order by seq desc) as n from ({I.sql_text(W.INSIGHT_EDITS)})) "
        f"select capture_id, title, summary, category, confidence, '' as suggested_status, {join(ordered(lst('tags_csv')))} as tags, "
        f"cast({LATER_S} as bigint) as analyzed_s from edits where n = 1 "
        f"union all select capture_id, title, summary, category, confidence, suggested_status, {join('tags')}, analyzed_s "
        "from insights where capture_id not in (select capture_id from edits)",
        "delete_captures": with_(INSIGHTS)
        + "select 'capture' as kind, id from caps where id not in (select doc_id + 1 from labels) "
        "union all select 'insight', capture_id from insights where capture_id not in (select doc_id + 1 from labels)",
        "clear_unanalyzed": with_(INSIGHTS)
        + "select 'kept' as kind, id as n from caps where id in (select capture_id from insights) "
        "union all select 'deleted', count(*) from caps where id not in (select capture_id from insights)",
        "import_solutions": with_(
            requests("req", cand, status=" Failed", more_tags=IMPORT_TAGS), created("fresh", "req", None, LATER_S)
        )
        + f"select {TABLE_COLS} from fresh",
        "import_path": with_(
            requests(
                "req",
                "select * replace (row_number() over (order by cast(cast(floor(seq / 1000) as bigint) as varchar), seq) - 1 "
                f"as seq) from ({cand})",
                status=" Failed",
                more_tags=IMPORT_TAGS,
            ),
            created("fresh", "req", None, LATER_S),
        )
        + outcome("req", "fresh", None),
        "analyze_captures": with_(INSIGHTS)
        + f", fresh as ({RULES_INSIGHTS('caps', 'where id not in (select capture_id from insights)')}) "
        + " union all ".join(f"select {INSIGHT_COLS}, {join('tags')} as tags, analyzed_s from {t}" for t in ("insights", "fresh")),
        "analysis_outcomes": with_(INSIGHTS)
        + "select case when id in (select capture_id from insights) then 'cached' "
        + " ".join(f"when content_type = '{k}' then '{v}'" for k, v in FAILURES.items())
        + " end as status, count(*) as n from caps group by 1",
    }
    asked = f"asked_all as ({I.sql_text(W.PROMOTIONS)}), asked as (select id, min(seq) as seq from asked_all group by id)"
    found["promote_captures"] = (
        with_(STORED, INSIGHTS, asked, promoted("caps", "insights", "asked"), created("fresh", "promo", "stored", LATER_S))
        + """, done as (
          select p.capture_id, p.seq, p.invalid_reason, coalesce(f.id, s.id) as id, f.seq as new_seq
          from promo p left join fresh f on f.dedup_key = p.dedup_key left join stored s on s.dedup_key = p.dedup_key)
        select a.seq, case when c.id is null then 'not_found' when d.capture_id is null then 'unanalyzed'
                           when d.invalid_reason is not null then 'invalid' when d.new_seq = a.seq then 'created'
                           else 'duplicate' end as outcome,
               case when d.invalid_reason is null then d.id end as id
        from asked_all a left join caps c on c.id = a.id left join done d on d.capture_id = a.id"""
    )
    found["promote_captures_table"] = (
        with_(INSIGHTS, asked, promoted("caps", "insights", "asked"), created("fresh", "promo", None, LATER_S))
        + f"select {TABLE_COLS} from fresh"
    )
    found["capture_stream"] = found["insert_captures_table"]
    found["auto_analyze_promote"] = (
        with_(
            CAPS,
            MORE_CAPS,
            f"every as (select {CAPTURE_COLS} from caps union all select {CAPTURE_COLS} from more_caps)",
            f"fresh_insights as ({RULES_INSIGHTS('every', '')})",
            "asked as (select id as seq, id from every)",
            promoted("every", "fresh_insights", "asked"),
            created("fresh", "promo", None, LATER_S),
        )
        + f"select {TABLE_COLS} from fresh"
    )
    found["capture_stream_report"] = with_(
        CAPS, MORE_CAPS, f"every as (select {CAPTURE_COLS} from caps union all select {CAPTURE_COLS} from more_caps)"
    ) + (
        "select r.seq, c.id, case when r.content = '' then 'empty' when c.seq = r.seq then 'created' else 'duplicate' end as status "
        "from cap_rows r left join caps c on c.content_hash = r.content_hash union all "
        "select r.seq, coalesce(n.id, c.id), case when r.content = '' then 'empty' when n.seq = r.seq then 'created' else 'duplicate' end "
        "from more_rows r left join more_caps n on n.content_hash = r.content_hash left join caps c on c.content_hash = r.content_hash "
        "union all select null, id, case " + " ".join(f"when content_type = '{k}' then '{v}'" for k, v in FAILURES.items()) + " end from every"
    )
    for name in ("update_solutions_table", "delete_solutions_table", "delete_captures"):
        found[name.removesuffix("_table") + "_ranges"] = found[name]
    found["filter_tag_rows"] = found["filter_tag"]
    found["import_json_array"] = found["import_jsonl"] = found["source_registry"]
    found["double_trigger_stream"] = found["double_trigger"]
    found["refused_presses_stream"] = (
        f"with e as (select user_id, epoch_us(ts) as at_us, event_id from ({I.sql_text(W.GAPPY_EVENTS)})), "
        f"newest as (select user_id, max(at_us) as last_us from e where at_us >= {W.MIDDLE} group by user_id) "
        "select e.user_id, at_us, event_id, 'late' as reason from e join newest n on n.user_id = e.user_id "
        f"where at_us < {W.MIDDLE} union all "
        "select user_id, at_us, event_id, 'incomplete' from e where user_id is null or at_us is null"
    )
    # An id is asked for twice in a row, and once more after all others.
    found["analyze_requests"] = with_(INSIGHTS, f"asked as ({I.sql_text(W.ANALYSIS_REQUESTS)})") + (
        "select a.seq, a.id, case when c.id is null then 'not_found' when i.capture_id is not null then 'cached' "
        "when abs(a.seq) % 2 = 1 then 'throttled' when a.seq >= 0 then 'cached' else 'ok' end as status "
        "from asked a left join caps c on c.id = a.id left join insights i on i.capture_id = a.id"
    )
    found["recent_ring_throttle"] = ring(ALL_CAPTURES, "seq")
    found["recent_ring_stream"] = ring(
        f"select 1 as load, * from ({caps}) union all select 2, * from ({src('MORE_CAPTURES')})", "load, seq"
    )
    return found
