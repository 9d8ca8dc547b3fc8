"""Keyed table maintenance as joins: the result is the new table content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the one with the highest ``order`` value; combines map-side, so copies do not pile up."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Existing keys win; of several incoming rows with one key the first by ``order`` is kept."""
    new = first_per_key(incoming, keys, order).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(new.select(*target.columns))


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Incoming values replace the listed columns; unknown keys are added, other columns stay."""
    new = incoming.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_hit"))
    out = target.join(new, list(keys), "full_outer")
    return out.select(
        *[
            F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
            for c in target.columns
        ]
    )


def fill_null(target: DataFrame, values: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Set the listed columns only where they are NULL."""
    new = values.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols])
    out = target.join(new, list(keys), "left")
    return out.select(*[F.coalesce(c, f"_n_{c}").alias(c) if c in cols else F.col(c) for c in target.columns])


def join_update(target: DataFrame, values: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Replace (or add) the listed columns on matching keys; rows without a match keep their values."""
    new = values.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_hit"))
    out = target.join(new, list(keys), "left")
    hit = F.col("_hit").isNotNull()
    old = {c: F.col(c) if c in target.columns else F.lit(None) for c in cols}
    rest = [c for c in target.columns if c not in cols]
    return out.select(*rest, *[F.when(hit, F.col(f"_n_{c}")).otherwise(old[c]).alias(c) for c in cols])


def drop_excluded(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def replace_table(df: DataFrame, path: str) -> None:
    """Truncate and reload."""
    df.write.mode("overwrite").parquet(path)
