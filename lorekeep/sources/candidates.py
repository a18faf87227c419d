"""Import sources: a name maps to a function ``(spark, path) -> DataFrame`` of candidate columns.

A reader of files also gives ``_at``, the place a row was read from, by which an import numbers its rows.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, StructType

from lorekeep import schemas as S
from lorekeep.functions.text import WHITE_SPACE, holds_one_value, lower_literal, utrim
from lorekeep.session import stage

Reader = Callable[[SparkSession, str], DataFrame]

FAIL_FAST = {"mode": "FAILFAST"}
PLACE = "_at"


def _place() -> Column:
    """File, start of the part of it that was read at once, and reading order inside that part."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    ).alias(PLACE)


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Each file holds one JSON array; text after the array is ignored.

    One such file cannot be split, so it is read by one task; a large import belongs in many files or
    in JSON lines.
    """
    return spark.read.schema(S.CANDIDATE).options(multiLine=True, **FAIL_FAST).json(path).select("*", _place())


def read_json_array_with_nulls(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_json_array`, and a ``null`` element is an empty candidate instead of an error.

    Each file is held as one value, so this is for files of ordinary size.
    """
    files = spark.read.text(path, wholetext=True)
    elements = F.explode(F.from_json(F.col("value"), ArrayType(S.CANDIDATE), FAIL_FAST))
    rows = files.select(elements.alias("item"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return rows.select("item.*", F.struct("file", "start", F.monotonically_increasing_id().alias("row")).alias(PLACE))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line.  Blank lines are skipped, a ``null`` line is an empty candidate, and a
    bad line fails the read."""
    line = utrim(F.col("value"))
    value = F.from_json(F.concat(F.lit("["), line, F.lit("]")), ArrayType(S.CANDIDATE), FAIL_FAST)[0]
    several = F.raise_error(F.lit("malformed JSON lines file: a line holds more or less than one value"))
    item = F.when(holds_one_value(line), value).otherwise(several.cast(S.CANDIDATE))
    return spark.read.text(path).where(line != "").select(item.alias("item"), _place()).select("item.*", PLACE)


def _layouts(spark: SparkSession, path: str) -> dict[bool, list[str]]:
    """The files of ``path`` with text in them, by whether their first text is ``[``.

    Each file is judged by itself, on its first line that is not blank; only file names reach the driver.
    """
    line = utrim(F.col("value"))
    lines = spark.read.text(path).select(_place(), line.alias("line")).where("line <> ''")
    first = lines.groupBy(f"{PLACE}.file").agg(F.min_by(F.col("line").startswith("["), PLACE).alias("array"))
    found: dict[bool, list[str]] = {True: [], False: []}
    for row in first.orderBy("file").collect():
        found[row["array"]].append(unquote(row["file"]))
    return found


LAYOUTS: dict[str, Reader] = {
    "array": read_json_array,
    "array_with_nulls": read_json_array_with_nulls,
    "jsonl": read_json_lines,
}


def read_json(spark: SparkSession, path: str, layout: str = "auto") -> DataFrame:
    """``auto`` takes each file as an array when its first text is ``[``, else as JSON lines."""
    if layout != "auto":
        return LAYOUTS[layout](spark, path)
    files = _layouts(spark, path)
    if not (files[True] and files[False]):
        return LAYOUTS["array" if files[True] else "jsonl"](spark, path)
    arrays, lines = read_json_array(spark, files[True]), read_json_lines(spark, files[False])
    return arrays.unionByName(lines)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _conform_placed(spark.read.parquet(path).drop(PLACE).select("*", _place()))


def _conform_placed(rows: DataFrame) -> DataFrame:
    """The candidate columns and the place."""
    return S.conform(rows, StructType([*S.CANDIDATE.fields, rows.schema[PLACE]]))


class SourceRegistry:
    """Readers by name; names are trimmed and lower-cased."""

    def __init__(self, **readers: Reader):
        self._readers: dict[str, Reader] = dict(readers)

    def register(self, name: str, reader: Reader) -> None:
        self._readers[self.canonical(name)] = reader

    @staticmethod
    def canonical(name: str) -> str:
        return lower_literal(name).strip(WHITE_SPACE)

    def _rows(self, spark: SparkSession, name: str, path: str) -> DataFrame:
        reader = self._readers.get(self.canonical(name))
        if reader is None:
            raise ValueError(f"no import source is registered under the name {name!r}")
        path = path.strip(WHITE_SPACE)
        if not path:
            raise ValueError("the import path is blank")
        return reader(spark, path)

    def read(self, spark: SparkSession, name: str, path: str) -> DataFrame:
        """The candidates of ``path``, nulls filled."""
        return S.fill_defaults(S.conform(self._rows(spark, name, path), S.CANDIDATE))

    def read_numbered(self, spark: SparkSession, name: str, path: str) -> DataFrame:
        """The candidates of ``path`` with ``seq``, staged; see :func:`numbered`."""
        rows = self._rows(spark, name, path)
        placed = _conform_placed(rows) if PLACE in rows.columns else S.conform(rows, S.CANDIDATE)
        return numbered(S.fill_defaults(placed))


DEFAULT_SOURCES = SourceRegistry(local_json=read_json, parquet=read_parquet)


def numbered(candidates: DataFrame) -> DataFrame:
    """The rows, staged, with ``seq`` from 0: by file path, then by place in the file.

    How Spark deals files over tasks has no say.  Each part of a file that was read at once is counted (one row a part
    is all that is sorted) and its rows keep their distance from its first.  Rows without a place are
    numbered in the order Spark reads them.
    """
    if PLACE not in candidates.columns:
        return stage(candidates.withColumn("seq", F.monotonically_increasing_id()), "candidates")
    rows = stage(candidates, "candidates")
    parts = rows.groupBy(f"{PLACE}.file", f"{PLACE}.start").agg(F.min(f"{PLACE}.row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    parts = stage(parts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))), "candidate-parts")
    at = (F.col(f"{PLACE}.file") == F.col("file")) & (F.col(f"{PLACE}.start") == F.col("start"))
    found = rows.join(parts, at).withColumn("seq", F.col("offset") + F.col(f"{PLACE}.row") - F.col("first"))
    return found.drop(PLACE, "file", "start", "first", "n", "offset")
