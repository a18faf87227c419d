"""Filters, search, paging and counts."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from lorekeep import schemas as S
from lorekeep.functions.text import WHITE_SPACE, contains_keyword, keyword, lower_literal, nz
from lorekeep.operators.first_wins import with_dense_rank

DEEP_OFFSET = 100_000
"""Beyond this many rows a page is found by rank, not by a top-k that holds all rows before it."""


@dataclass(frozen=True)
class SolutionFilter:
    query: str = ""
    status: str = ""
    efficacy_source: str = ""
    tag: str = ""
    limit: int = 0
    offset: int = 0


@dataclass(frozen=True)
class CaptureFilter:
    query: str = ""
    analyzed: bool | None = None
    limit: int = 0
    offset: int = 0


def parse_analyzed(raw: str | None) -> bool | None:
    """Blank means any; only ``true`` and ``1`` mean yes."""
    text = keyword(raw)
    return None if text == "" else text in ("true", "1")


def page_bounds(limit: object = 0, offset: object = 0) -> tuple[int, int]:
    """A limit outside 1..100 becomes 20 and a negative offset 0; text that is no number counts as 0."""

    def number(value: object) -> int:
        return int(str(value)) if re.fullmatch(r"[+-]?[0-9]+", str(value), re.ASCII) else 0

    size, start = number(limit), number(offset)
    return (size if 0 < size <= S.PAGE_SIZE_MAX else S.PAGE_SIZE_DEFAULT), max(start, 0)


def exact(value: str) -> str:
    return lower_literal(value).strip(WHITE_SPACE)


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def has_keyword(word: str, *cols: str) -> Column:
    return any_of([contains_keyword(nz(F.col(c)), word) for c in cols])


def tag_has_keyword(word: str) -> Column:
    return F.exists("tags", lambda t: contains_keyword(t, word))


def solution_predicates(f: SolutionFilter) -> list[Column]:
    """The optional predicates of a filter; the page and the total share them."""
    found: list[Column] = []
    if exact(f.status):
        found.append(F.col("status") == exact(f.status))
    if exact(f.efficacy_source):
        found.append(F.col("efficacy_source") == exact(f.efficacy_source))
    if exact(f.tag):
        found.append(F.array_contains("tags", exact(f.tag)))
    word = keyword(f.query)
    if word:
        found.append(has_keyword(word, "title", "problem", "solution_text") | tag_has_keyword(word))
    return found


def filter_solutions(stored: DataFrame, f: SolutionFilter) -> DataFrame:
    return stored.where(all_of(solution_predicates(f)))


def newest_first(rows: DataFrame, changed: str, limit: object, offset: object) -> DataFrame:
    """One page in the order of ``changed`` and ``id``, both descending: a top-k per task, no full sort."""
    size, start = page_bounds(limit, offset)
    return rows.orderBy(F.col(changed).desc(), F.col("id").desc()).offset(start).limit(size)


def page_ids(matches: DataFrame, changed: str, limit: object, offset: object) -> tuple[list[int], int]:
    """The ids of one page, at most 100 numbers, and the number of all matches; ``matches`` needs ``id`` and ``changed``.

    The pass that finds the page counts the matches on its way.  A deep page is taken by rank from a range-partitioned
    sort of these two columns, whose stored rows are counted; the result is the same.
    """
    narrow = matches.select("id", changed)
    size, start = page_bounds(limit, offset)
    if start > DEEP_OFFSET:
        ranked = with_dense_rank(narrow, F.col(changed).desc(), F.col("id").desc(), label="pages")
        page = ranked.where(F.col("rank").between(start, start + size - 1)).orderBy("rank")
        return [row["id"] for row in page.collect()], ranked.count()
    seen = Observation()
    page = newest_first(narrow.observe(seen, F.count(F.lit(1)).alias("total")), changed, limit, offset)
    ids = [row["id"] for row in page.collect()]
    if ids:
        return ids, seen.get["total"]
    # a plan known to be empty never runs, so nothing would be observed
    return ids, narrow.count() if start else 0


def _page_and_count(stored: DataFrame, f: SolutionFilter) -> tuple[DataFrame, int]:
    ids, total = page_ids(filter_solutions(stored, f), "updated_at", f.limit, f.offset)
    return newest_first(stored.where(F.col("id").isin(ids)), "updated_at", f.limit, 0), total


def list_solutions(stored: DataFrame, f: SolutionFilter) -> DataFrame:
    """One page, newest change first.

    The page is found on the searched columns; its ids then go into the scan as a pushed-down filter, so
    the other columns are read only from the row groups that hold the page.
    """
    return _page_and_count(stored, f)[0]


def count_solutions(stored: DataFrame, f: SolutionFilter) -> DataFrame:
    return filter_solutions(stored, f).agg(F.count(F.lit(1)).alias("total"))


def page_with_total(stored: DataFrame, f: SolutionFilter) -> tuple[DataFrame, DataFrame]:
    """The page, and one row ``(count, total)``; one pass over the searched columns gives both."""
    page, total = _page_and_count(stored, f)
    limit, offset = page_bounds(f.limit, f.offset)
    on_page = max(0, min(limit, total - offset))
    row = stored.sparkSession.range(1)
    return page, row.select(F.lit(on_page).cast("bigint").alias("count"), F.lit(total).cast("bigint").alias("total"))


def pager_info(total: DataFrame, page: int, size: int = S.CLIENT_PAGE_SIZE) -> DataFrame:
    """Page count, the page clamped to it, and the offset of that page."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size))
    at = F.greatest(F.lit(1), F.least(F.lit(page), F.col("pages")))
    return (
        total.withColumn("pages", pages)
        .withColumn("page", at)
        .withColumn("offset", (F.col("page") - 1) * size)
        .select("total", "pages", "page", "offset")
    )


def filter_tag_relational(stored: DataFrame, tag_rows: DataFrame, tag: str) -> DataFrame:
    """The tag filter over child rows, as a semi-join."""
    wanted = tag_rows.where(F.col("tag") == exact(tag)).select(F.col("solution_id").alias("id"))
    return stored.join(wanted, "id", "left_semi")


def search_or_exists(stored: DataFrame, tag_rows: DataFrame, query: str) -> DataFrame:
    """The keyword search over child rows: texts match, or some tag row does.

    Only ids meet; of ``stored`` the join moves the columns that are read from its result.
    """
    word = keyword(query)
    told = stored.where(has_keyword(word, "title", "problem", "solution_text")).select("id")
    tagged = tag_rows.where(contains_keyword(F.col("tag"), word)).select(F.col("solution_id").alias("id"))
    return stored.join(told.union(tagged).distinct(), "id", "left_semi").select(*stored.columns)


def tag_counts(stored: DataFrame) -> DataFrame:
    return stored.select(F.explode("tags").alias("tag")).groupBy("tag").count().withColumnRenamed("count", "n")
