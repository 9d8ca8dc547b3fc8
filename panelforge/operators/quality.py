"""Data-quality tiers and coverage summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.numeric import half_even


@dataclass(frozen=True)
class TierRules:
    """Thresholds of the tiers; defaults as published (years, coverage ratio, average daily value)."""

    a: tuple[float, float, float] = (8, 0.93, 5)
    b: tuple[float, float, float] = (4, 0.75, 1)
    min_days: int = 252
    value_unit: float = 1e7
    recent_rows: int = 90


def coverage(bars: DataFrame) -> DataFrame:
    """Days present, start, years, expected days and coverage ratio per entity."""
    n = bars.groupBy("tk").agg(
        F.count(F.lit(1)).alias("days"), F.min("d").alias("start_date"), F.max("d").alias("end_date")
    )
    span = F.date_diff("end_date", "start_date")
    expected = F.greatest(F.lit(1.0), half_even(span * 252 / F.lit(365.0), 0))
    n = n.withColumn("expected_days", expected.cast("bigint"))
    ratio = half_even(F.least(F.lit(1.0), F.col("days") / F.col("expected_days")), 4)
    return n.withColumns(
        {"coverage_years": half_even(F.col("days") / F.lit(252.0), 2), "coverage_ratio": ratio}
    ).withColumn("gap_pct", half_even((1 - F.col("coverage_ratio")) * 100, 2))


def average_daily_value(bars: DataFrame, rows: int = 90, unit: float = 1e7, digits: int = 4) -> DataFrame:
    """Mean traded value of the last ``rows`` rows; the row-number filter is pushed below the shuffle by Spark."""
    w = Window.partitionBy("tk").orderBy(F.col("d").desc())
    recent = bars.select("tk", "d", (F.col("cl") * F.col("vol")).alias("v")).withColumn("k", F.row_number().over(w))
    value = F.sum(F.round("v", 4).cast("decimal(28,4)")).cast("double") / F.count(F.lit(1))
    return recent.where(F.col("k") <= rows).groupBy("tk").agg(half_even(value / F.lit(unit), digits).alias("adv"))


def tier_letter(rules: TierRules) -> Column:
    def meets(t: tuple[float, float, float]) -> Column:
        return (F.col("coverage_years") >= t[0]) & (F.col("coverage_ratio") >= t[1]) & (F.col("adv") >= t[2])

    return F.when(F.col("days") < rules.min_days, "X").when(meets(rules.a), "A").when(meets(rules.b), "B").otherwise("C")


def assess(bars: DataFrame, eligible: DataFrame, rules: TierRules = TierRules()) -> DataFrame:
    """One row per entity: coverage, average value, eligibility flag and tier."""
    out = coverage(bars).join(average_daily_value(bars, rules.recent_rows, rules.value_unit), "tk")
    out = out.join(eligible.select("tk", F.lit(1).alias("eligible")).distinct(), "tk", "left")
    return out.withColumns({"eligible": F.coalesce("eligible", F.lit(0)), "tier": tier_letter(rules)})


# Tier letters that take part, as integers.
TIER_INT = {"A": 1, "B": 2, "C": 3}


def tier_int(df: DataFrame, c: str = "tier") -> DataFrame:
    """Letters to 1/2/3; other letters are dropped."""
    code = F.when(F.col(c) == "A", 1).when(F.col(c) == "B", 2).when(F.col(c) == "C", 3)
    return df.where(F.col(c).isin(*TIER_INT)).withColumn(c, code)


def tier_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("tier").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("eligible").alias("n_eligible"))


def missing_keys(expected: DataFrame, present: DataFrame, key: str = "tk") -> DataFrame:
    return expected.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def export_summary(panel: DataFrame) -> DataFrame:
    return panel.groupBy("tier").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("tk").alias("n_keys"))


def yearly_nulls(df: DataFrame, c: str) -> DataFrame:
    """Rows and NULL share of a column per year, with the rows per value as (year, value, n)."""
    per_value = df.groupBy(F.year("d").alias("year"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    year = per_value.groupBy("year").agg(
        F.sum("n").alias("year_rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls")
    )
    return per_value.join(year, "year").select(
        "year", "value", "n", "year_rows", half_even(F.col("nulls") * 100.0 / F.col("year_rows"), 2).alias("null_pct")
    )


def table_counts(tables: dict[str, DataFrame], expected: dict[str, int] | None = None) -> DataFrame:
    """Row count of each table and whether it meets the minimum."""
    return _union(
        [
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("name"), "n_rows", (F.col("n_rows") >= (expected or {}).get(name, 1)).alias("passed")
            )
            for name, df in tables.items()
        ]
    )


def last_dates(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    return _union([df.agg(F.max(c).alias("last_date")).select(F.lit(n).alias("name"), "last_date") for n, (df, c) in tables.items()])


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
