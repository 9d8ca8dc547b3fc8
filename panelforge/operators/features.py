"""Price-derived features, targets and the assembled feature panel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.numeric import safe_ln, safe_ratio
from panelforge.functions.recursive import beta_step, grouped
from panelforge.functions.windows import Axis, rolling_extremes

TRADING_DAYS = 252
ANNUAL = math.sqrt(252.0)


def simple_returns(axis: Axis, c: str, horizons=(1, 5, 21, 60)) -> dict[str, Column]:
    return {f"return_{n}d": axis.pct_change(c, n) for n in horizons}


def log_return(axis: Axis, c: str) -> Column:
    return safe_ln(safe_ratio(c, axis.shift(c)))


def momentum(axis: Axis, c: str) -> dict[str, Column]:
    """Twelve- and six-month return less the last month's."""
    month = axis.pct_change(c, 21)
    return {"mom_12_1": axis.pct_change(c, 252) - month, "mom_6_1": axis.pct_change(c, 126) - month}


def realised_vol(axis: Axis, log_ret: str, n: int = 20, min_count: int | None = None) -> Column:
    return axis.roll(F.stddev_samp, log_ret, n, min_count) * F.lit(ANNUAL)


def volume_ratio(axis: Axis, vol: str, n: int = 20) -> Column:
    return safe_ratio(vol, axis.roll(F.avg, vol, n))


def range_position(df: DataFrame, axis: Axis, c: str, hi: str, lo: str, n: int = 252, min_count: int = 63) -> DataFrame:
    """Price against the rolling high and low."""
    out = rolling_extremes(df, axis, {"_top": ("max", hi), "_bottom": ("min", lo)}, n, min_count)
    return out.withColumns(
        {"price_to_52w_high": safe_ratio(c, "_top"), "price_to_52w_low": safe_ratio(c, "_bottom")}
    ).drop("_top", "_bottom")


def band_features(c: str, upper: str = "bb_upper", middle: str = "bb_middle", lower: str = "bb_lower") -> dict[str, Column]:
    width = F.nullif(F.col(upper) - F.col(lower), F.lit(0.0))
    return {"bb_width": safe_ratio(width, middle), "bb_pctb": safe_ratio(F.col(c) - F.col(lower), width)}


def present(c: str) -> Column:
    """1 when the value exists, else 0."""
    return F.col(c).isNotNull().cast("int")


def forward_return(axis: Axis, c: str, n: int = 21) -> Column:
    return safe_ratio(axis.shift(c, -n), c) - 1


def forward_vol(axis: Axis, log_ret: str, n: int = 5) -> Column:
    """Annualised deviation of the next ``n`` log returns that exist (at least two)."""
    return F.stddev_samp(log_ret).over(axis.rows(1, n)) * F.lit(ANNUAL)


def targets(
    df: DataFrame, axis: Axis, c: str, log_ret: str, dates: DataFrame | None = None, cutoff_calendar_days: int = 21
) -> DataFrame:
    """Forward return and volatility, NULL within the last calendar days of the whole data set.

    ``dates`` may name a cheaper frame that holds the same last date.
    """
    last = (df if dates is None else dates).agg(F.date_sub(F.max(axis.on), cutoff_calendar_days)).scalar()
    seen = F.col(axis.on) <= last
    return df.withColumns(
        {
            "target_return_21d": F.when(seen, forward_return(axis, c)),
            "target_vol_5d": F.when(seen, forward_vol(axis, log_ret)),
        }
    )


def with_betas(df: DataFrame, axis: Axis, ret: str, factors: dict[str, str]) -> DataFrame:
    """Rolling sensitivities of ``ret`` to each factor; ``factors`` maps output to factor column."""
    return grouped(df, axis, [beta_step(ret, factors)])


def relative_strength(own: str, index: str) -> Column:
    return F.col(own) - F.col(index)


def add_price_features(df: DataFrame, axis: Axis, price: str) -> DataFrame:
    """Returns, momentum, volatility, ratios and availability flags on bars with indicators."""
    out = range_position(df, axis, price, "hi", "lo").withColumns(
        {
            **simple_returns(axis, price),
            "log_return_1d": log_return(axis, price),
            **momentum(axis, price),
            "volume_ratio_20d": volume_ratio(axis, "vol"),
            **{f"price_to_sma{n}": safe_ratio(price, f"sma_{n}") for n in (20, 50, 200)},
            **band_features(price),
            "obv_change_5d": axis.pct_change("obv", 5),
        }
    )
    return out.withColumn("volatility_20d", realised_vol(axis, "log_return_1d"))
