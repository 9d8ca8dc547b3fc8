"""Cross-sectional ranks, rank targets and per-date normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.asof import asof_join
from panelforge.functions.numeric import floor_round, safe_ratio
from panelforge.functions.ranking import rank_pct


def ranked(df: DataFrame, by: Sequence[str], value: str, out: str, min_count: int = 2) -> DataFrame:
    """Percentile rank of the six-decimal value within the groups."""
    return rank_pct(df.withColumn("_v", floor_round(value, 6)), by, "_v", out, min_count).drop("_v")


def rank_targets(df: DataFrame, value: str = "target_return_21d", tiers: Sequence[int] = (1, 2)) -> DataFrame:
    """Rank, above-median flag and top/bottom-third flag (middle NULL) of rows in the given tiers."""
    pool = df.where(F.col("tier").isin(*tiers) & F.col(value).isNotNull())
    pool = pool.withColumn("_v", floor_round(value, 6))
    out = rank_pct(pool, ["d"], "_v", "_p", digits=None).drop("_v")
    p = F.col("_p")
    return out.withColumns(
        {
            "target_rank_21d": floor_round(p, 6),
            "target_direction_median": (p > 0.5).cast("int"),
            "target_direction_tertile": F.when(p > 2.0 / 3.0, 1).when(p < 1.0 / 3.0, 0).cast("int"),
        }
    ).drop("_p")


def fit_daily_stats(df: DataFrame, cols: Sequence[str], min_names: int = 10, key: str = "tk", on: str = "d") -> DataFrame:
    """Mean and sample deviation of each column per date with enough names."""
    aggs = [a for c in cols for a in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"))]
    stats = df.groupBy(on).agg(*aggs, F.count_distinct(key).alias("_names"))
    return stats.where(F.col("_names") >= min_names).drop("_names")


def apply_daily_stats(df: DataFrame, stats: DataFrame, cols: Sequence[str], on: str = "d") -> DataFrame:
    """Z-score with the last statistics on or before the date; the raw value where none apply."""
    take = [f"{p}_{c}" for c in cols for p in ("mean", "std")]
    hit = asof_join(df, stats, [], on, on, take)
    return hit.withColumns({c: _z(c, F.col(f"mean_{c}"), F.col(f"std_{c}")) for c in cols}).drop(*take)


def apply_overall_stats(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variant without dates: the mean of all daily means and deviations."""
    overall = stats.agg(
        F.struct(*[F.avg(f"{p}_{c}").alias(f"{p}_{c}") for c in cols for p in ("mean", "std")])
    ).scalar()
    tmp = df.withColumn("_s", overall)
    return tmp.withColumns({c: _z(c, F.col(f"_s.mean_{c}"), F.col(f"_s.std_{c}")) for c in cols}).drop("_s")


def _z(c: str, mean: Column, std: Column) -> Column:
    return F.coalesce(safe_ratio(F.col(c) - mean, std), F.col(c))


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-null rows per column as (name, filled) rows."""
    aggs = [F.struct(F.lit(c).alias("name"), F.count(c).alias("filled")) for c in cols]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("i")).select("i.*")
