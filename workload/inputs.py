"""Input views over the given tables, in the SQL that Spark and DuckDB share.

One text is the input of the Spark query and the first CTE of its oracle.  Every view reads its tables
whole; tags travel as comma lists and times as epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("documents", "pages", "conversations", "benchmark", "labels", "events", "region")

# Every content type, blanks, exact copies and copies with other outer white space.
CAPTURES = """
select doc_id * 8 as seq, text as content, source, 1704067200 + cast(floor(doc_id / 3) as bigint) as captured_s
from {documents}
union all select page_id * 8 + 1, url, 'pages', 1704067200 + page_id from {pages}
union all select (conv_id * 4096 + turn) * 8 + 2, role || ': ' || text, 'conversations', 1704067200 + conv_id
from {conversations}
union all select item_id * 8 + 3, 'func ' || text, 'benchmark', 1704067200 + item_id from {benchmark}
union all select cast(r_regionkey as bigint) * 8 + 4, chr(32) || chr(10) || chr(9), 'blank', 1704067200 from {region}
"""
# A second day: every document again, wrapped in white space, and pages as new texts.
MORE_CAPTURES = """
select doc_id * 8 + 5 as seq, chr(160) || text || chr(10) as content, 'again' as source,
       1704153600 + doc_id as captured_s
from {documents}
union all select page_id * 8 + 6, html, 'html', 1704153600 + page_id from {pages}
union all select page_id * 8 + 7, html, 'html copy', 1704153600 + page_id from {pages}
"""
# One insight per labelled document; blanks for the fallbacks, an unknown status, values to clamp.
INSIGHTS = """
select l.doc_id * 8 as capture_seq,
       case when l.toxic = 1 then '' else d.lang || ' ' || d.source end as title,
       d.text as summary,
       case when d.lang = 'es' then ' ' else upper(d.lang) end as category,
       d.source as problem,
       case when l.quality = 0 then ' ' else d.text end as solution_text,
       '' as occurred_at,
       case when d.lang = 'fr' then '' else 'src-' || d.source end as source_name,
       case when l.toxic = 1 and l.quality = 0 then 'bogus' when l.toxic = 1 then ' Failed'
            when d.lang = 'en' then 'confirmed_success' else '' end as suggested_status,
       l.quality * cast(1.5 as double) - l.toxic * cast(2.0 as double) as confidence,
       d.lang || ', ' || upper(d.lang) || ',,' || d.source as tags_csv
from {labels} l join {documents} d on d.doc_id = l.doc_id
"""
# Blank titles, missing and unknown status, exact copies of the text.
CANDIDATES = """
select d.doc_id * 4 as seq,
       case when d.n_chars < 100 then ' ' else d.lang || ' note' end as title,
       'from ' || d.lang as problem, d.text as solution_text,
       case when d.lang = 'en' then 'Chat' else 'chat ' end as source_type,
       case when d.lang = 'de' then ' ' else 'conversation-export' end as source_name,
       '' as source_ref, 'raw://' || cast(d.doc_id as varchar(20)) as raw_content_ref,
       d.lang || ',' || upper(d.lang) || ', x' as tags_csv,
       case when l.doc_id is null then '' when l.toxic = 1 then 'bogus' when l.quality = 1 then 'Draft '
            else 'failed' end as status
from {documents} d left join {labels} l on l.doc_id = d.doc_id
"""
# The same candidates in other case and spacing, and conversation turns as new ones.
MORE_CANDIDATES = """
select doc_id * 4 + 1 as seq, upper(lang) || '  Note' as title, '  FROM ' || lang as problem,
       text || chr(10) || chr(10) as solution_text, 'CHAT' as source_type, 'Conversation-Export' as source_name,
       ' ' as source_ref, 'raw://copy' as raw_content_ref, 'X, ' || lang as tags_csv, 'draft' as status
from {documents}
union all
select (conv_id * 4096 + turn) * 4 + 2, role || ' turn', '', text, '', '', 'conv-' || cast(conv_id as varchar(20)),
       '', role, 'Confirmed_Success'
from {conversations}
"""
# Unknown ids, an unknown status, blank texts, wanted fingerprints in conflict, rows updated twice.
UPDATES = """
select doc_id * 2 as seq, doc_id + 1 as id, 'edited ' || lang as title, '' as problem,
       case when n_chars < 200 then '' else text end as solution_text,
       case when source = 'src3' then 'nope' else 'Confirmed_Success' end as status,
       'edited,' || lang as tags_csv
from {documents}
union all
select page_id * 2 + 1, page_id + 1, 'page edit', 'second', url, 'failed', 'page' from {pages}
"""
KEYS = """
select event_id, user_id, ts,
       case when event_type in ('view', 'error') then 'ctrl' else 'c' end as key,
       case when event_type = 'error' then 'up' else 'down' end as action
from {events}
"""


_tables: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read once per application."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}.parquet")
    if key not in _tables:
        _tables[key] = spark.read.parquet(key[1])
    return _tables[key]


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    df = spark.sql(sql, **tables)
    if "tags_csv" in df.columns:
        df = df.withColumn("tags", F.split("tags_csv", ",")).drop("tags_csv")
    if "captured_s" in df.columns:
        df = df.withColumn("captured_at", F.timestamp_seconds("captured_s")).drop("captured_s")
    return df


def sql_text(sql: str) -> str:
    """The view for DuckDB, where the tables are plain names."""
    return sql.format(**{t: t for t in TABLES}).strip()
