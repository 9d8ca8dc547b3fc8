"""Market-wide series: one row per date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.asof import asof_join
from panelforge.functions.windows import MARKET, Axis, pct_change


def align_series(long: DataFrame, names: Sequence[str], on: str = "d") -> DataFrame:
    """Long (date, name, value) rows to one column per declared name on the union of dates."""
    return long.groupBy(on).pivot("name", list(names)).agg(F.first("value"))


def attach_low_frequency(daily: DataFrame, low: DataFrame, values: Sequence[str], low_on: str = "d") -> DataFrame:
    """Carry a sparse series forward onto the daily dates."""
    return asof_join(daily, low, [], "d", low_on, list(values), left_unique=True)


def drop_empty_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Remove dates on which every market column is NULL."""
    return df.where(F.coalesce(*[F.col(c) for c in cols]).isNotNull())


def year_over_year(c: str, axis: Axis = MARKET, lag: int = 12) -> Column:
    """Percentage change against the value ``lag`` rows earlier."""
    return axis.pct_change(c, lag) * 100


def rescale(c: str, factor: float) -> Column:
    return F.col(c) * factor


def join_flows(left: DataFrame, right: DataFrame, on: Sequence[str], value: str, suffixes: tuple[str, str]) -> DataFrame:
    a = left.withColumnRenamed(value, value + suffixes[0])
    b = right.withColumnRenamed(value, value + suffixes[1])
    return a.join(b, list(on))


def expand_months(monthly: DataFrame, days: DataFrame) -> DataFrame:
    """Repeat each month's values on every trading day of that month (``y``, ``m`` keys)."""
    keyed = days.select("d").distinct().select("d", F.year("d").alias("y"), F.month("d").alias("m"))
    return keyed.join(monthly, ["y", "m"]).drop("y", "m")


def with_flow_source(macro: DataFrame, monthly: DataFrame, daily: DataFrame) -> DataFrame:
    """Attach monthly and daily net flows; the flag says which one counts on the date."""
    m = expand_months(
        monthly.select("y", "m", F.col("fii").alias("fii_m"), F.col("dii").alias("dii_m")), macro
    )
    v = daily.select("d", F.col("fii").alias("fii_d"), F.col("dii").alias("dii_d"))
    flag = F.when(F.col("fii_d").isNotNull(), "daily").when(F.col("fii_m").isNotNull(), "monthly")
    return macro.join(m, "d", "left").join(v, "d", "left").withColumn("flow_flag", flag)


def best_flow() -> Column:
    """Daily value where flagged daily, else the monthly one."""
    return F.when(F.col("flow_flag") == "daily", F.col("fii_d")).otherwise(F.col("fii_m"))


# (output, source) pairs of the one-row returns used as regression factors
FACTOR_RETURNS = {
    "ret_ix50": "ix50", "ret_ix500": "ix500", "ret_fx": "fx", "ret_vix": "vix", "ret_crude": "crude", "ret_gold": "gold",
}


def market_features(macro: DataFrame, fill: str | None = "pad") -> DataFrame:
    """Factor returns, index returns, standardised flows and the policy-rate change per date."""
    spec = {out: (src, 1) for out, src in FACTOR_RETURNS.items()}
    spec |= {"ix500_return_21d": ("ix500", 21), "ix500_return_60d": ("ix500", 60)}
    out = pct_change(macro, MARKET, spec, fill).withColumn("flow_best", best_flow())
    return out.withColumns(
        {
            "ret_fii": MARKET.zscore("flow_best"),
            "ret_dii": MARKET.zscore("dii_m"),
            "rate_change": MARKET.diff("rate"),
        }
    )


def row_at_or_before(df: DataFrame, when: Column, on: str = "d") -> DataFrame:
    """The last row not after a date."""
    return df.where(F.col(on) <= when).orderBy(F.col(on).desc()).limit(1)


def first_present(candidates: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(value, label) of the first non-null candidate column; candidates are (column, label) pairs."""
    value = F.coalesce(*[F.col(c) for c, _ in candidates])
    label = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(lab)) for c, lab in candidates])
    return value, label


def fill_audit(df: DataFrame, cols: Sequence[str], on: str = "d") -> DataFrame:
    """Filled rows and first/last filled date of each column, one row per column."""
    aggs = [
        F.struct(
            F.lit(c).alias("name"),
            F.count(c).alias("filled"),
            F.min(F.when(F.col(c).isNotNull(), F.col(on))).alias("first_date"),
            F.max(F.when(F.col(c).isNotNull(), F.col(on))).alias("last_date"),
        )
        for c in cols
    ]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("i")).select("i.*")


def month_below(df: DataFrame, year: int, month: int, value: str, bound: float) -> DataFrame:
    """First row of a month with a pass flag: value present and under the bound."""
    one = df.where((F.year("d") == year) & (F.month("d") == month)).orderBy("d").limit(1)
    return one.select("d", value, (F.col(value).isNotNull() & (F.col(value) < bound)).alias("passed"))
