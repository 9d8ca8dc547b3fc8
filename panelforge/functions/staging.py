"""Stage boundaries: a plan that is read several times is written once as a Parquet table.

The table lies in the shared folder named by ``spark.checkpoint.dir``; where that is unset, as in tests, below the
session's warehouse folder, which a cluster shares too. It survives lost executors, cuts the lineage, and keeps column
pruning and size statistics, which a row-format checkpoint does not. Steps of a daily run are written once per state of their
input folder: a changed, added or removed input file makes them run again.
Files are left to the folder's own retention rule, except those of a step that says which of its tables its result still
needs (``releasing``). The shuffle files of a stage go as soon as its table is written.
"""

from __future__ import annotations

import contextlib
import functools
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def staging_folder(spark: SparkSession) -> str:
    """The session's shared folder, with a sub-folder for this application."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
    return f"{shared}/{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: list[list[str]] = []


@contextlib.contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the job inside are removed at its end, since nothing reads them again."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str, keep: bool = False, parts: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once and read it back. Inside ``releasing`` the table goes at the end, unless ``keep``.

    With ``parts`` (columns of few values) the table has a folder per value, so a filter on them reads its own files only.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    with _own_shuffles(spark):
        (df.hint("rebalance", *parts).write.partitionBy(*parts) if parts else df.write).parquet(path)
    if _open and not keep:
        _open[-1].append(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.select(*df.columns) if parts else back


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


@contextlib.contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside are removed at the end. What a result reads later has to be staged with ``keep``."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def input_state(spark: SparkSession, folder: str) -> tuple:
    """Names, lengths and times of all files below a folder, as one row of sums (no content is read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    mark = F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.max("modificationTime"), F.sum(mark)).first())


_published: dict[tuple, DataFrame] = {}


def published(name: str, parts: Sequence[str] = ()) -> Callable:
    """Decorator for a step ``fn(spark, folder)`` of a daily run whose table later steps read; ``parts`` as in ``staged``."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @functools.wraps(fn)
        def read(spark: SparkSession, folder: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, folder, name, input_state(spark, folder))
            if key not in _published:
                _published[key] = staged(fn(spark, folder), name, parts=parts)
            return _published[key]

        return read

    return wrap


def forget_published() -> None:
    """Make every step run again (for timing)."""
    _published.clear()
