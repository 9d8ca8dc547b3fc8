"""Candidate selection, position sizes and book statistics, for all dates in one job.

After the slot limit a (date, direction) pool holds at most ``max_positions`` rows, so the window sums over it are
bounded. The limit itself is a row number with a constant bound, which Spark applies before the shuffle as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelforge.functions.numeric import clip, safe_ratio
from panelforge.functions.windows import Axis


@dataclass(frozen=True)
class BookRules:
    """Sizing parameters; defaults as published."""

    max_positions: int = 45
    min_positions: int = 25
    long_at: float = 0.82
    short_at: float = 0.08
    short_share: float = 0.20
    long_target: float = 1.30
    short_target: float = 0.10
    cap_core: float = 0.08
    cap_mid: float = 0.05
    cap_short: float = 0.025
    min_size: float = 0.005
    vol_floor: float = 0.005
    atr_fallback: float = 0.02
    inv_vol_weight: float = 0.60
    # variant with a volatility target
    vt_cap_core: float = 0.10
    vt_cap_mid: float = 0.05
    vt_cap_short: float = 0.025
    vt_target_vol: float = 0.15
    vt_min_size: float = 0.003
    cash_floor: float = 0.02


# Deployable share of net asset value per regime integer; other regimes 0.90.
DEPLOY_CAP = {0: 0.97, 1: 0.88, 2: 0.90, 3: 0.94}
DEPLOY_CAP_BACKTEST = {0: 0.99, 1: 0.88, 2: 0.90, 3: 0.94}
DEFAULT_CAP = 0.90


def _pool() -> WindowSpec:
    return Window.partitionBy("d", "direction")


def deploy_cap(regime: Column, table: dict[int, float] = DEPLOY_CAP, in_defence: Column | None = None, cut: float = 0.20) -> Column:
    """Cap by regime, cut while the book is in drawdown defence."""
    cap = F.lit(DEFAULT_CAP)
    for k, v in table.items():
        cap = F.when(regime == k, F.lit(v)).otherwise(cap)
    return cap if in_defence is None else F.when(in_defence, cap * (1 - cut)).otherwise(cap)


def candidates(signals: DataFrame, rules: BookRules = BookRules()) -> DataFrame:
    """Long and short candidates by rank thresholds."""
    p = F.col("final_rank")
    side = F.when(p >= rules.long_at, "long").when(p <= rules.short_at, "short")
    return signals.withColumn("direction", side).where("direction is not null")


def slots(cands: DataFrame, rules: BookRules = BookRules()) -> DataFrame:
    """Best candidates per date up to the slots of each side; ``pos`` is the place within the side."""
    counts = cands.groupBy("d").agg(
        F.count_if(F.col("direction") == "long").alias("_nl"), F.count_if(F.col("direction") == "short").alias("_ns")
    )
    cap = rules.max_positions
    most_shorts = max(3, round(cap * rules.short_share))
    short_slots = F.least(F.lit(most_shorts), F.col("_ns"))
    long_slots = F.greatest(F.least(F.lit(cap) - short_slots, F.col("_nl")), F.least(F.lit(5), F.col("_nl")))
    merit = F.when(F.col("direction") == "long", -F.col("final_rank")).otherwise(F.col("final_rank"))
    best = cands.withColumn("pos", F.row_number().over(_pool().orderBy(merit, "tk"))).where(F.col("pos") <= cap)
    picked = best.join(counts, "d").where(
        F.col("pos") <= F.when(F.col("direction") == "long", long_slots).otherwise(short_slots)
    )
    return picked.drop("_nl", "_ns")


def atr_pct(atr: str, price: str, rules: BookRules = BookRules()) -> Column:
    return clip(F.coalesce(safe_ratio(atr, price), F.lit(rules.atr_fallback)), lo=rules.vol_floor)


def vol_proxy(axis: Axis, ret: str, rules: BookRules = BookRules(), n: int = 15) -> Column:
    """Deviation of the last returns, with fallback and floor."""
    return clip(F.coalesce(F.stddev_samp(ret).over(axis.rows(-(n - 1), 0)), F.lit(rules.atr_fallback)), lo=rules.vol_floor)


def _conviction() -> Column:
    p = F.when(F.col("direction") == "long", F.col("final_rank")).otherwise(1.0 - F.col("final_rank"))
    return clip(p, 0.0, 1.0)


def _caps(core: float, mid: float, short: float) -> Column:
    return F.when(F.col("direction") == "short", short).when(F.col("tier").isin(2, 3), mid).otherwise(core)


def _scaled(size: str, cap: str, target: str) -> Column:
    """Scale the pool down to its target once, then clip again."""
    total = F.sum(size).over(_pool())
    scaled = F.least(F.col(size) * F.least(F.col(target) / total, F.lit(1.0)), F.col(cap))
    return F.when(total > 0, scaled).otherwise(F.col(size))


def sizes(pool: DataFrame, rules: BookRules = BookRules()) -> DataFrame:
    """Inverse-volatility and conviction weights, capped per position, scaled once to the side's target.

    Needs ``atr_pct``, ``vol``, ``final_rank``, ``tier``, ``direction`` and ``deploy_cap``; dust is dropped.
    """
    vol = 0.5 * F.col("atr_pct") + 0.5 * F.coalesce("vol", "atr_pct")
    df = pool.withColumns({"_inv": 1.0 / F.greatest(vol, F.lit(rules.vol_floor)), "_conv": _conviction()})
    norm = safe_ratio("_conv", F.sum("_conv").over(_pool())) * F.count(F.lit(1)).over(_pool())
    df = df.withColumn("_w", rules.inv_vol_weight * F.col("_inv") + (1 - rules.inv_vol_weight) * F.coalesce(norm, F.lit(0.0)))
    book = F.when(F.col("direction") == "long", rules.long_target).otherwise(rules.short_target)
    df = df.withColumns({"_target": F.least(book, F.col("deploy_cap")), "_cap": _caps(rules.cap_core, rules.cap_mid, rules.cap_short)})
    df = df.withColumn("_size", F.least(F.coalesce(safe_ratio("_w", F.sum("_w").over(_pool())), F.lit(0.0)) * F.col("_target"), F.col("_cap")))
    df = df.withColumn("size", _scaled("_size", "_cap", "_target")).where(F.col("size") >= rules.min_size)
    return df.drop("_inv", "_conv", "_w", "_target", "_cap", "_size")


def sizes_vol_target(pool: DataFrame, rules: BookRules = BookRules()) -> DataFrame:
    """Variant: inverse of the recent deviation alone, then scaled by a volatility target within (0.5, 1.5)."""
    df = pool.withColumns({"_inv": 1.0 / F.greatest(F.col("atr_pct"), F.lit(rules.vol_floor)), "_conv": _conviction()})
    norm = F.col("_conv") / (F.sum("_conv").over(_pool()) + 1e-9) * F.count(F.lit(1)).over(_pool())
    df = df.withColumn("_w", rules.inv_vol_weight * F.col("_inv") + (1 - rules.inv_vol_weight) * norm)
    long_book = F.greatest(F.col("deploy_cap") - rules.cash_floor, F.lit(0.0))
    short_book = F.least(F.lit(rules.short_target), F.col("deploy_cap") * 0.10)
    book = F.when(F.col("direction") == "long", long_book).otherwise(short_book)
    df = df.withColumns(
        {"_target": F.least(book, F.col("deploy_cap")), "_cap": _caps(rules.vt_cap_core, rules.vt_cap_mid, rules.vt_cap_short)}
    )
    raw = F.least(F.col("_w") / (F.sum("_w").over(_pool()) + 1e-9) * F.col("_target"), F.col("_cap"))
    annual = F.coalesce(F.col("vol"), F.lit(rules.vt_target_vol) / F.sqrt(F.lit(252.0))) * F.sqrt(F.lit(252.0))
    scale = clip(F.lit(rules.vt_target_vol) / F.greatest(annual, F.lit(0.01)), 0.5, 1.5)
    df = df.withColumn("_raw", raw).withColumn("_size", F.least(F.col("_raw") * scale, F.col("_cap")))
    df = df.withColumn("size", _scaled("_size", "_cap", "_target")).where(F.col("size") >= rules.vt_min_size)
    return df.drop("_inv", "_conv", "_w", "_target", "_cap", "_raw", "_size")


def cap_sectors(sized: DataFrame, limit: float = 0.30, book: tuple[str, ...] = ("d", "direction")) -> DataFrame:
    """Scale sectors above their share of the book down to it, once; the total is not restored."""
    total = F.sum("size").over(Window.partitionBy(*book))
    part = F.sum("size").over(Window.partitionBy(*book, "sector"))
    df = sized.withColumns({"_t": total, "_p": part})
    over = F.col("_p") / F.col("_t") > limit
    return df.withColumn("size", F.when(over, F.col("size") * (limit * F.col("_t")) / F.col("_p")).otherwise(F.col("size"))).drop("_t", "_p")


def book_stats(sized: DataFrame, rules: BookRules = BookRules(), by: str = "d") -> DataFrame:
    """Gross, net and cash shares, counts, long sectors and the small-book warning."""
    side = F.col("direction")
    size = F.col("size").cast("double")
    g = sized.groupBy(by).agg(
        F.coalesce(F.sum(F.when(side == "long", size)), F.lit(0.0)).alias("gross_long"),
        F.coalesce(F.sum(F.when(side == "short", size)), F.lit(0.0)).alias("gross_short"),
        F.count_if(side == "long").alias("n_longs"),
        F.count_if(side == "short").alias("n_shorts"),
        F.count_distinct(F.when(side == "long", F.col("sector"))).alias("long_sectors"),
    )
    n = F.col("n_longs") + F.col("n_shorts")
    return g.withColumns(
        {
            "net": F.col("gross_long") - F.col("gross_short"),
            "gross": F.col("gross_long") + F.col("gross_short"),
            "cash": 1.0 - F.col("gross_long") - F.col("gross_short"),
            "n_total": n,
            "below_min": n < rules.min_positions,
        }
    )


def sector_nav(sized: DataFrame, by: str = "d") -> DataFrame:
    return sized.groupBy(by, "sector").agg(F.sum("size").alias("nav_share"), F.count(F.lit(1)).alias("n"))


def holdings(sized: DataFrame, nav: float, price: str = "price") -> DataFrame:
    """Allocation and whole units at the price; no quantity without a price."""
    alloc = F.round(F.col("size") * nav)
    return sized.withColumn("alloc", alloc).withColumn(
        "quantity", F.when(F.col(price) > 0, F.floor(safe_ratio("alloc", price)))
    )
