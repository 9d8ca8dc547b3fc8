"""Keyed tables in partitions, changed by rewriting the touched partitions only.

A table is a folder with data folders, one per version and partition, and manifests: a small list of the data folders that make up a version. A merge reads the
partitions that its incoming keys fall into (the folders of all others are not opened), writes their new content beside the old, and adds a manifest.
Readers take the newest manifest, so they see a version whole, and a merge that fails leaves the last one in place. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "_part"


def by_month(on: str) -> Column:
    return F.coalesce(F.date_format(on, "yyyy-MM"), F.lit("none"))


class VersionedTable:
    """A table under ``path``; ``part`` gives the partition of a row from its key columns."""

    def __init__(self, spark: SparkSession, path: str, part: Column) -> None:
        self.spark, self.path, self.part = spark, path.rstrip("/"), part

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema("version long, part string, folder string, columns string").parquet(f"{self.path}/manifests/*")

    def folders(self) -> dict[str, str]:
        """Partition -> data folder of the newest version."""
        rows = self._manifests()
        last = rows.agg(F.max("version")).scalar()
        return {r.part: r.folder for r in rows.where((F.col("version") == last) & F.col("part").isNotNull()).collect()}  # one row per partition

    def _state(self) -> tuple[int, T.StructType]:
        newest = self._manifests().orderBy(F.desc("version")).first()
        return newest.version, T._parse_datatype_json_string(newest.columns)

    def _publish(self, version: int, folders: dict[str, str], schema: T.StructType) -> None:
        rows = [(version, p, f, schema.json()) for p, f in sorted(folders.items())] or [(version, None, None, schema.json())]
        frame = self.spark.createDataFrame(rows, "version long, part string, folder string, columns string")
        frame.coalesce(1).write.parquet(f"{self.path}/manifests/{version:012d}")

    def _write(self, df: DataFrame) -> dict[str, str]:
        """New data folders of the partitions of ``df``, not published yet."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.withColumn(PART, self.part).hint("rebalance", PART).write.partitionBy(PART).parquet(folder)  # a large partition takes several tasks
        written = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField(PART, T.StringType())])).parquet(folder).select(PART).distinct().collect()
        return {r[0]: f"{folder}/{PART}={r[0]}" for r in written}

    def create(self, df: DataFrame) -> VersionedTable:
        self._publish(0, self._write(df), df.schema)
        return self

    def read(self, parts: set[str] | None = None) -> DataFrame:
        """The rows of the newest version, or of some of its partitions."""
        schema = self._state()[1]
        folders = [f for p, f in sorted(self.folders().items()) if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def merge(self, incoming: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> set[str]:
        """Publish a version in which the partitions of ``incoming`` hold ``change(their rows, incoming)``; returns these partitions."""
        touched = {r[0] for r in incoming.select(self.part.alias(PART)).distinct().collect()}  # one row per partition
        version, schema = self._state()
        old = self.folders()
        new = self._write(change(self.read(touched), incoming).select(*schema.names))
        self._publish(version + 1, {p: f for p, f in old.items() if p not in touched} | new, schema)
        return touched
