"""Bars, trading calendar and corporate actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.asof import asof_join
from panelforge.functions.numeric import floor_round
from panelforge.functions.windows import Axis


def trading_calendar(bounds: DataFrame, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """Weekdays between two date columns of a one-row frame, less holidays; output column ``d``."""
    days = bounds.select(F.explode(F.sequence(F.col(start), F.col(end))).alias("d")).where(F.weekday("d") < 5)
    return days if holidays is None else days.join(holidays.select("d").distinct(), "d", "left_anti")


def price_gap_flag(axis: Axis, days: int = 5) -> Column:
    """1 when the previous row of the entity is more than ``days`` calendar days back; first row 0."""
    gap = F.date_diff(F.col(axis.on), axis.shift(axis.on))
    return F.when(gap > days, 1).otherwise(0).cast("int")


def keep_series(raw: DataFrame, universe: DataFrame, series: str = "EQ", key: str = "tk") -> DataFrame:
    """Rows of one series that belong to the universe."""
    return raw.where(F.trim("series") == series).join(universe.select(key).distinct(), key, "left_semi")


def build_bars(raw: DataFrame) -> DataFrame:
    """Drop rows without a close, fill a missing high/low with it, add the typical price."""
    hi, lo = F.coalesce("hi", "cl"), F.coalesce("lo", "cl")
    typical = floor_round((hi + lo + F.col("cl")) / 3, 4)
    return raw.where(F.col("cl").isNotNull()).select(
        "tk",
        "d",
        floor_round("op", 4).alias("op"),
        floor_round(hi, 4).alias("hi"),
        floor_round(lo, 4).alias("lo"),
        floor_round("cl", 4).alias("cl"),
        "vol",
        typical.alias("typical"),
        typical.alias("vwap"),
    )


def split_factors(splits: DataFrame) -> DataFrame:
    """Backward cumulative factor: the product of 1/ratio over this and all later splits of the ticker."""
    later = Window.partitionBy("tk").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    return splits.where("ratio > 0").select("tk", "d", (1.0 / F.product("ratio").over(later)).alias("factor"))


def adjust_close(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Close times the factor of the first split strictly after the date (1 when there is none)."""
    hit = asof_join(
        bars, factors, ["tk"], "d", "d", ["factor"], direction="forward", strict=True, left_unique=True
    )
    return hit.withColumn("adj", floor_round(F.col("cl") * F.coalesce("factor", F.lit(1.0)), 4)).drop("factor")


def action_rows(splits: DataFrame, dividends: DataFrame) -> DataFrame:
    """Splits and dividends as one event table keyed by (ticker, date, action type)."""
    s = splits.select(
        "tk", "d", F.lit("split").alias("action_type"), floor_round("ratio", 6).alias("ratio"),
        F.lit(None).cast("double").alias("amount"),
    )
    v = dividends.select(
        "tk", "d", F.lit("dividend").alias("action_type"), F.lit(None).cast("double").alias("ratio"),
        floor_round("amount", 4).alias("amount"),
    )
    return s.unionByName(v)


def ingest_summary(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Date range, tickers, rows and share of expected trading days present, as one row."""
    expected = calendar.agg(F.count(F.lit(1)).alias("n")).scalar()
    return bars.agg(
        F.min("d").alias("min_date"),
        F.max("d").alias("max_date"),
        F.count_distinct("tk").alias("tickers"),
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("d").alias("ingested_days"),
    ).select(
        "*",
        expected.alias("expected_days"),
        floor_round(F.try_divide(F.col("ingested_days") * 100.0, expected), 4).alias("coverage_pct"),
    )


def thin_keys(df: DataFrame, key: str, below: int = 100, top: int = 15) -> DataFrame:
    """Entities with few rows, fewest first."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("days"))
        .where(F.col("days") < below)
        .orderBy("days", key)
        .limit(top)
    )


def ingest_issues(summary: DataFrame, today: Column, max_lag: int = 5, min_tickers: int = 450) -> DataFrame:
    """Problems as rows: (issue, value); empty when all is well."""
    lag = F.date_diff(today, F.col("max_date"))
    found = F.array(
        F.when(lag > max_lag, F.struct(F.lit("stale").alias("issue"), lag.cast("bigint").alias("value"))),
        F.when(
            F.col("tickers") < min_tickers,
            F.struct(F.lit("few_tickers").alias("issue"), F.col("tickers").cast("bigint").alias("value")),
        ),
    )
    return summary.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("i.*")


def latest_per_key(df: DataFrame, keys: list[str], on: str, upto: Column | None = None) -> DataFrame:
    """Last row of each key by ``on``, optionally not after a bound; map-side combinable."""
    rows = df if upto is None else df.where(F.col(on) <= upto)
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), on).alias("_r")).select(*keys, "_r.*")
