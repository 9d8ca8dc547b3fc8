"""Technical indicators per entity.

Windowed indicators are ordinary column expressions. The recursive ones (exponential and Wilder smoothing) run in
one grouped map that passes the other columns through, so it adds no shuffle after windows on the same entity.
Warm-up rows are NULL everywhere.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.numeric import floor_round, safe_ratio
from panelforge.functions.recursive import Step, ema, grouped, wilder
from panelforge.functions.windows import Axis, rolling_means


def smas(df: DataFrame, axis: Axis, c: str, spans: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    """Simple moving averages ``sma_n`` over full windows."""
    return rolling_means(df, axis, c, {f"sma_{n}": n for n in spans})


def bollinger(df: DataFrame, axis: Axis, c: str, n: int = 20, k: float = 2.0) -> DataFrame:
    """Bands at ``k`` population standard deviations around the mean."""
    mid = rolling_means(df, axis, c, {"bb_middle": n}).withColumn("_dev", axis.roll(F.stddev_pop, c, n))
    return mid.withColumns(
        {"bb_upper": F.col("bb_middle") + F.col("_dev") * k, "bb_lower": F.col("bb_middle") - F.col("_dev") * k}
    ).drop("_dev")


def stochastic(df: DataFrame, axis: Axis, n: int = 14, smooth: int = 3) -> DataFrame:
    """%K over ``n`` rows and its ``smooth``-row mean %D."""
    lowest, highest = axis.roll(F.min, "lo", n), axis.roll(F.max, "hi", n)
    k = df.withColumn("stoch_k", safe_ratio((F.col("cl") - lowest) * 100.0, highest - lowest))
    return k.withColumn("stoch_d", axis.roll(F.avg, "stoch_k", smooth))


def on_balance_volume(df: DataFrame, axis: Axis, close: str = "cl", vol: str = "vol") -> DataFrame:
    """Volume added on up moves and subtracted on down moves."""
    step = df.withColumn("_step", F.coalesce(F.signum(axis.diff(close)) * F.col(vol), F.lit(0.0)))
    return step.withColumn("obv", axis.running(F.sum, "_step")).drop("_step")


def vwap_deviation(price: str, vwap: str) -> Column:
    return safe_ratio(F.col(price) - F.col(vwap), vwap) * 100


RECURSIVE = ("ema_9", "ema_21", "macd", "macd_signal", "macd_hist", "rsi_14", "atr_14", "adx_14")


def recursive_step(price: str) -> Step:
    """Exponential means, MACD, RSI, ATR and ADX from ``hi``, ``lo``, ``cl`` and a price column."""

    def smooth(pdf: pd.DataFrame) -> dict[str, pd.Series]:
        p, hi, lo, cl = (pdf[c].astype("float64") for c in (price, "hi", "lo", "cl"))
        line = ema(p, 12) - ema(p, 26)
        signal = ema(line, 9)
        move = p.diff()
        up, down = wilder(move.clip(lower=0.0), 14), wilder((-move).clip(lower=0.0), 14)
        prev, reach = cl.shift(1), true_range(hi, lo, cl)
        rise, fall = hi.diff(), -lo.diff()
        plus = rise.where((rise > fall) & (rise > 0), 0.0).mask(rise.isna())
        minus = fall.where((fall > rise) & (fall > 0), 0.0).mask(fall.isna())
        base = wilder(reach.mask(prev.isna()), 14)
        base = base.where(base != 0)
        di_up, di_down = wilder(plus, 14) / base * 100.0, wilder(minus, 14) / base * 100.0
        both = di_up + di_down
        return {
            "ema_9": ema(p, 9),
            "ema_21": ema(p, 21),
            "macd": line,
            "macd_signal": signal,
            "macd_hist": line - signal,
            "rsi_14": (100.0 - 100.0 / (1.0 + up / down.where(down != 0))).mask(down == 0, 100.0),
            "atr_14": wilder(reach, 14),
            "adx_14": wilder((di_up - di_down).abs() / both.where(both != 0) * 100.0, 14),
        }

    return RECURSIVE, (price, "hi", "lo", "cl"), smooth


def atr_step() -> Step:
    """ATR alone, from ``hi``, ``lo`` and ``cl``."""

    def smooth(pdf: pd.DataFrame) -> dict[str, pd.Series]:
        hi, lo, cl = (pdf[c].astype("float64") for c in ("hi", "lo", "cl"))
        return {"atr_14": wilder(true_range(hi, lo, cl), 14)}

    return ("atr_14",), ("hi", "lo", "cl"), smooth


def true_range(hi: pd.Series, lo: pd.Series, cl: pd.Series) -> pd.Series:
    prev = cl.shift(1)
    return pd.concat([hi - lo, (hi - prev).abs(), (lo - prev).abs()], axis=1).max(axis=1)


def with_recursive(df: DataFrame, axis: Axis, price: str = "cl") -> DataFrame:
    return grouped(df, axis, [recursive_step(price)])


INDICATORS = (
    "sma_20", "sma_50", "sma_200", "ema_9", "ema_21", "macd", "macd_signal", "macd_hist", "rsi_14", "bb_upper",
    "bb_middle", "bb_lower", "atr_14", "stoch_k", "stoch_d", "adx_14", "obv", "vwap_dev",
)
WARMUP = ("sma_20", "sma_50", "sma_200", "ema_9", "ema_21", "macd", "rsi_14")


def windowed(df: DataFrame, axis: Axis, price: str = "cl") -> DataFrame:
    """All indicators that are plain window expressions; needs a ``vwap`` column."""
    out = bollinger(smas(df, axis, price), axis, price).withColumn("vwap_dev", vwap_deviation(price, "vwap"))
    return on_balance_volume(stochastic(out, axis), axis)


def indicators(df: DataFrame, axis: Axis, price: str = "cl", digits: int | None = 4) -> DataFrame:
    """The full indicator table, published at four decimals."""
    out = with_recursive(windowed(df, axis, price), axis, price)
    return out if digits is None else out.withColumns({c: floor_round(c, digits) for c in INDICATORS})


def warmed_up(df: DataFrame, axis: Axis, min_rows: int = 30, required: tuple[str, ...] = WARMUP) -> DataFrame:
    """Entities with enough history, and only rows on which every required indicator exists."""
    long_enough = F.count(F.lit(1)).over(axis.whole()) >= min_rows
    return df.withColumn("_ok", long_enough).where("_ok").drop("_ok").dropna(subset=list(required))
