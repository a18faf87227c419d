"""Tables in folders of id ranges, so that a change rewrites only the ranges it touches.

A row with id ``i`` lies in ``<root>/<table>/range=i // rows_per_range``.  A change first stages the new content of the
touched ranges of all its tables, then puts them in place table by table.  The staged content is the record of
the change: if the second step stops halfway, opening the tables again finishes it, with the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType

ROWS_PER_RANGE = 1 << 20


@dataclass(frozen=True)
class Change:
    """New content for the ranges of ``table`` that ``ids`` (column ``id``) touch: ``rewrite`` gets their rows."""

    table: str
    ids: DataFrame
    rewrite: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class RangeTables:
    """Tables under ``root``; ``keys`` names each table's id column, ``schemas`` its columns."""

    spark: SparkSession
    root: str
    keys: dict[str, str]
    schemas: dict[str, StructType]
    rows_per_range: int = ROWS_PER_RANGE

    def __post_init__(self) -> None:
        self._finish()

    def _files(self, path: str):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def _names(self, path: str) -> list[str]:
        files, root = self._files(path)
        return sorted(s.getPath().getName() for s in files.listStatus(root)) if files.exists(root) else []

    def _range(self, column: str) -> Column:
        return F.floor(F.col(column) / self.rows_per_range).cast("bigint")

    def _read(self, path: str, table: str) -> DataFrame:
        if not any(n.startswith("range=") for n in self._names(path)):
            return self.spark.createDataFrame([], StructType([*self.schemas[table].fields]).add("range", LongType()))
        return self.spark.read.schema(StructType([*self.schemas[table].fields]).add("range", LongType())).parquet(path)

    def read(self, table: str) -> DataFrame:
        return self._read(f"{self.root}/{table}", table).drop("range")

    def _write(self, rows: DataFrame, table: str, path: str) -> None:
        key = self.keys[table]
        placed = rows.select(*self.schemas[table].names).withColumn("range", self._range(key))
        placed = placed.repartitionByRange("range", key).sortWithinPartitions("range", key)
        # ranges without rows here keep their files
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range").parquet(path)

    def create(self, table: str, rows: DataFrame) -> None:
        self._write(rows, table, f"{self.root}/{table}")

    def apply(self, *changes: Change) -> None:
        """Makes all changes, or after a failure all of them once the tables are opened again.

        Only the numbers of the touched ranges come to the driver.
        """
        record = f"{self.root}/_changes/{uuid.uuid4().hex}"
        for change in changes:
            touched = [r[0] for r in change.ids.select(self._range("id")).distinct().collect() if r[0] is not None]
            path = f"{record}/{change.table}"
            held = self._read(f"{self.root}/{change.table}", change.table).where(F.col("range").isin(touched)).drop("range")
            self._write(change.rewrite(held), change.table, path)
            filled = set(self._names(path))
            emptied = [(r,) for r in touched if f"range={r}" not in filled]
            self.spark.createDataFrame(emptied, "range bigint").coalesce(1).write.parquet(f"{record}/_emptied-{change.table}")
        # from here on the change counts
        self.spark.createDataFrame([(c.table,) for c in changes], "name string").coalesce(1).write.parquet(f"{record}/_tables")
        self._put(record)

    def _put(self, record: str) -> None:
        """Puts the content of ``record`` in place; may be repeated."""
        for row in self.spark.read.schema("name string").parquet(f"{record}/_tables").collect():
            table, target = row["name"], f"{self.root}/{row['name']}"
            rows = self._read(f"{record}/{table}", table).drop("range")
            if any(n.startswith("range=") for n in self._names(f"{record}/{table}")):
                self._write(rows, table, target)
            for r in self.spark.read.schema("range bigint").parquet(f"{record}/_emptied-{table}").collect():
                files, folder = self._files(f"{target}/range={r['range']}")
                files.delete(folder, True)
        files, folder = self._files(record)
        files.delete(folder, True)

    def _finish(self) -> None:
        """Finishes a change that was recorded in full, drops one that was not."""
        for name in self._names(f"{self.root}/_changes"):
            record = f"{self.root}/_changes/{name}"
            if "_SUCCESS" in self._names(f"{record}/_tables"):
                self._put(record)
            else:
                files, folder = self._files(record)
                files.delete(folder, True)
