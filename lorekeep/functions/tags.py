"""The tag rules: sorted set, ordered distinct, comma lists, JSON text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from lorekeep.functions.text import is_blank, nz, trimmed_lower, utrim

EMPTY = "array<string>"


def no_tags() -> Column:
    return F.array().cast(EMPTY)


def nz_tags(tags: Column) -> Column:
    return F.coalesce(tags, no_tags())


def tags_ordered_distinct(tags: Column) -> Column:
    """Trimmed, lower-cased, blanks dropped, first-seen order kept."""
    cleaned = F.transform(nz_tags(tags), lambda t: trimmed_lower(nz(t)))
    return F.array_distinct(F.filter(cleaned, lambda t: t != ""))


def tags_sorted_set(tags: Column) -> Column:
    """As :func:`tags_ordered_distinct`, in byte order."""
    return F.array_sort(tags_ordered_distinct(tags))


def split_tags_csv(csv: Column) -> Column:
    return F.filter(F.transform(F.split(nz(csv), ","), utrim), lambda t: t != "")


def join_tags_csv(tags: Column) -> Column:
    return F.array_join(F.array_sort(nz_tags(tags)), ",")


def append_category(tags: Column, category: Column) -> Column:
    return F.when(is_blank(category), nz_tags(tags)).otherwise(F.array_append(nz_tags(tags), category))


def concat_tags(tags: Column, defaults: Sequence[str]) -> Column:
    return F.concat(nz_tags(tags), F.array(*[F.lit(t) for t in defaults]).cast(EMPTY))


def encode_tags(tags: Column) -> Column:
    return F.to_json(nz_tags(tags))


def decode_tags(text: Column) -> Column:
    """Tags from JSON text; text that is no JSON array gives no tags."""
    return nz_tags(F.from_json(text, EMPTY))
