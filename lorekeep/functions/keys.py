"""Fingerprints, references and the write time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lorekeep import schemas as S
from lorekeep.functions.tags import tags_sorted_set
from lorekeep.functions.text import normalize_text, nz, utrim

KEY_FIELDS = ("title", "problem", "solution_text", "source_type", "source_name", "source_ref")


def dedup_key(fields: dict[str, Column] | None = None, tags: Column | None = None) -> Column:
    """Hex SHA-256 of the six normalised key fields and the sorted tags, one per line.

    Null fields count as ``''``, so the number of lines never changes.
    """
    cols = {name: F.col(name) for name in KEY_FIELDS} | (fields or {})
    tag_line = F.array_join(tags_sorted_set(F.col("tags") if tags is None else tags), "|")
    return F.sha2(F.concat_ws("\n", *[normalize_text(nz(cols[n])) for n in KEY_FIELDS], tag_line), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(utrim(content), 256)


def capture_ref(capture_id: Column) -> Column:
    return F.concat(F.lit(S.CAPTURE_REF_PREFIX), capture_id.cast("string"))


def write_time(as_of=None) -> Column:
    """The time stamped on written rows, in whole seconds; pass ``as_of`` for repeatable results."""
    moment = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return F.date_trunc("second", moment)
