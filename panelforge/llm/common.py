"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.staging import staged

#: Name of the column that tells rows apart.
ROW = "__row"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def _stored(docs: DataFrame) -> bool:
    """Whether every row of ``docs`` is one row of a Parquet file, by its plan."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and "parquet" in node.simpleString(1 << 20) and "_metadata" not in docs.columns


def with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with a row mark that is the same in every later scan, however the files are split then.

    For rows of Parquet files it is a hash of the file's path beside the place of the row in it, with as many bits for the place as the longest file needs; the
    hash takes another seed until no two files share it. All else is written with its marks first. Callers that join by the mark use the one
    table returned. A column of the same name is replaced.
    """
    docs = docs.drop(ROW)
    if not _stored(docs):
        return staged(docs.withColumn(ROW, F.monotonically_increasing_id()), "marked")
    path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    longest = docs.select(path.alias("path"), place.alias("place")).groupBy("path").agg(F.max("place").alias("last"))
    files = staged(longest.select("path", "last"), "files")
    bits = max((files.agg(F.max("last")).first()[0] or 0).bit_length(), 1)
    for seed in range(100):
        mark = F.shiftleft(F.pmod(F.xxhash64(F.lit(seed), F.col("path")), F.lit(1 << (63 - bits))), bits)
        if not files.groupBy(mark).count().where("count > 1").limit(1).count():
            return docs.withColumn(ROW, F.shiftleft(F.pmod(F.xxhash64(F.lit(seed), path), F.lit(1 << (63 - bits))), bits) + place)
    raise ValueError("too many files for marks of 63 bits; write fewer and longer ones")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one piece holds about ``limit`` bytes of a text column, or a single longer row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if batch.column(column).nbytes <= limit:
            yield batch
            continue
        sizes = [v.as_buffer().size if v.is_valid else 0 for v in batch.column(column)]
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def hash_parts(df: DataFrame, rows: int, per_part: int) -> int:
    """Partitions for ``rows`` rows of which a task may hold ``per_part``; at least the session's shuffle setting."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_apart(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that mark rows and return all columns of their input: a user's column named like the mark keeps its name and values."""

    @functools.wraps(fn)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        clash = [c for c in docs.columns if c.lower() == ROW]
        if not clash:
            return fn(docs, *args, **kwargs)
        other = free_name(docs, ROW)
        return fn(docs.withColumnRenamed(clash[0], other), *args, **kwargs).withColumnRenamed(other, clash[0])

    return run
