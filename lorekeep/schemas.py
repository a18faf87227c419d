"""Table schemas and the fixed values that decide results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

STRINGS = ArrayType(StringType())


def _struct(*fields: tuple[str, DataType]) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


def _texts(*names: str) -> list[tuple[str, DataType]]:
    return [(name, StringType()) for name in names]


CANDIDATE = _struct(
    *_texts("title", "problem", "solution_text", "source_type", "source_name", "source_ref", "raw_content_ref"),
    ("tags", STRINGS),
    ("status", StringType()),
)
SOLUTION = _struct(
    ("id", LongType()),
    *_texts("title", "problem", "solution_text", "raw_content", "efficacy_source", "status"),
    *_texts("source_type", "source_name", "source_ref", "raw_content_ref", "dedup_key"),
    ("tags", STRINGS),
    ("created_at", TimestampType()),
    ("updated_at", TimestampType()),
)
CAPTURE = _struct(
    ("id", LongType()),
    *_texts("content", "content_hash", "content_type"),
    ("char_count", IntegerType()),
    ("line_count", IntegerType()),
    ("source", StringType()),
    ("captured_at", TimestampType()),
)
ANALYSIS = _struct(
    *_texts("title", "summary", "category", "problem", "solution_text", "occurred_at"),
    *_texts("source_name", "source_ref", "suggested_status"),
    ("confidence", DoubleType()),
    ("tags", STRINGS),
)
INSIGHT = StructType(
    [StructField("capture_id", LongType()), *ANALYSIS.fields]
    + [StructField(name, kind) for name, kind in _texts("model", "provider", "raw_json")]
    + [StructField("analyzed_at", TimestampType())]
)
ENVELOPE = _struct(
    ("output", ArrayType(_struct(("content", ArrayType(_struct(*_texts("type", "text"))))))),
)

# The enums, limits and labels that stored results depend on.
EFFICACY_SOURCES = ("manual", "auto")
STATUSES = ("draft", "probable_success", "confirmed_success", "failed")
DEFAULT_STATUS = "probable_success"
DEFAULT_SUGGESTED_STATUS = "draft"
DEFAULT_CAPTURE_SOURCE = "clipboard"
UNTITLED = "未命名抓取"
FALLBACK_TITLE_CHARS = 24
RAW_CONTENT_MAX_CHARS = 4096
LONG_TEXT_MIN_NEWLINES = 8
PAGE_SIZE_DEFAULT = 20
PAGE_SIZE_MAX = 100
CLIENT_PAGE_SIZE = 40
DOUBLE_TRIGGER_GAP_MICROS = 900_000
RECENT_RING_SIZE = 3
CAPTURE_REF_PREFIX = "capture://"
ENVELOPE_TEXT_TYPES = ("output_text", "text")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Selects the columns of ``schema`` in order; absent ones become their default."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else default_value(f.dataType.simpleString()))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def default_value(type_name: str) -> Column:
    if type_name == "string":
        return F.lit("")
    if type_name in ("int", "bigint", "double"):
        return F.lit(0)
    if type_name == "array<string>":
        return F.array().cast("array<string>")
    return F.lit(None)


def with_default_column(df: DataFrame, name: str, default: str = "") -> DataFrame:
    """Adds a column an older table lacks, and fills its nulls; repeating it changes nothing."""
    value = F.lit(default) if name not in df.columns else F.coalesce(F.col(name), F.lit(default))
    return df.withColumn(name, value)


def fill_defaults(df: DataFrame) -> DataFrame:
    """Null strings, numbers and string arrays become ``''``, 0 and an empty array."""
    return df.select(
        *[
            F.coalesce(F.col(f.name), default_value(f.dataType.simpleString()).cast(f.dataType)).alias(f.name)
            if f.dataType.simpleString() in ("string", "int", "bigint", "double", "array<string>")
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
