"""Batch resume: what is still to do, and how to compute only that with the same result as a full rebuild."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.windows import Axis


def pending(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys (dates, entities) expected but not present yet."""
    return expected.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")


def since_high_water(feed: DataFrame, stored: DataFrame, on: str = "d", overlap_days: int = 5) -> DataFrame:
    """Feed rows from a few days before the last stored date on; everything when nothing is stored."""
    start = stored.agg(F.date_sub(F.max(on), overlap_days)).scalar()
    return feed.where(start.isNull() | (F.col(on) >= start))


def rewrite_latest(feed: DataFrame, stored: DataFrame, on: str, strict: bool) -> DataFrame:
    """Rows not older than the newest stored value (strictly newer when ``strict``)."""
    last = stored.agg(F.max(on)).scalar()
    newer = F.col(on) > last if strict else F.col(on) >= last
    return feed.where(last.isNull() | newer)


def with_context(
    full: DataFrame, stored: DataFrame, axis: Axis, context_rows: int, compute: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Compute only new rows per entity, reading ``context_rows`` earlier rows of each as window history.

    Entities without stored rows are computed in full. The result equals the tail of a full rebuild as long as no
    window reaches further back than the context.
    """
    keys = list(axis.by)
    last = stored.groupBy(*keys).agg(F.max(axis.on).alias("_last"))
    marked = full.join(last, keys, "left")
    is_new = F.col("_last").isNull() | (F.col(axis.on) > F.col("_last"))
    recent = Window.partitionBy(*keys, "_new").orderBy(F.col(axis.on).desc())
    sliced = (
        marked.withColumn("_new", is_new)
        .withColumn("_k", F.row_number().over(recent))
        .where(F.col("_new") | (F.col("_k") <= context_rows))
        .drop("_k")
    )
    return compute(sliced).where("_new").drop("_new", "_last")
