"""Risk limits as rule tables over positions, portfolios and proposals.

Frames: ``positions`` (pid, tk, direction, size, sector, is_midcap, entry_price, current_price), ``state`` (pid, nav,
peak_nav, cash, nav_return_21d, flow_today, flow_negative_days, is_budget, is_expiry) and ``proposals`` (pid, tk,
direction, size, sector, is_midcap, eligible, market_cap, circuit_hits). Many portfolios are screened in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.numeric import safe_ratio
from panelforge.functions.staging import staged

# Sector names treated as financial.
FINANCIAL_SECTORS = ("Financial Services", "Financials", "Banking", "BFSI", "Banks", "Insurance", "NBFC")


@dataclass(frozen=True)
class Limits:
    """Hard limits; defaults as published. Sizes are shares of net asset value."""

    core_long: float = 0.08
    mid_long: float = 0.05
    short: float = 0.025
    long_stop: float = -0.15
    short_stop: float = 0.10
    min_size: float = 0.005
    sector_long: float = 0.30
    sector_long_fin: float = 0.35
    sector_short: float = 0.15
    net_min: float = 0.80
    net_max: float = 1.25
    gross_max: float = 1.60
    cash_min: float = 0.05
    midcap_max: float = 0.40
    review_return: float = -0.05
    peak_stop: float = -0.10
    flow_sell: float = 5000.0
    flow_days: int = 5
    flow_net_max: float = 0.85
    circuit_hits: int = 2
    min_cap: float = 3000.0
    budget_cut: float = 0.25
    financial: tuple[str, ...] = FINANCIAL_SECTORS


RULE = "struct<status:string,limit:string,size:double>"


def _no() -> Column:
    return F.lit(None).cast(RULE)


def _reject(code: str | Column) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    return F.struct(F.lit("REJECTED").alias("status"), code.alias("limit"), F.lit(0.0).alias("size"))


def _reduce(code: str | Column, size: Column) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    return F.struct(F.lit("REDUCED").alias("status"), code.alias("limit"), size.cast("double").alias("size"))


def _fit(code: str, headroom: Column, lim: Limits) -> Column:
    """Shrink to the headroom, or reject when it is below the minimum size."""
    return F.when(headroom < lim.min_size, _reject(code)).otherwise(_reduce(code, headroom))


def exposures(positions: DataFrame, state: DataFrame) -> DataFrame:
    """Gross, net, cash and mid-cap shares and the number of long sectors of each portfolio."""
    long, short = F.col("direction") == "long", F.col("direction") == "short"

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("size"))), F.lit(0.0))

    g = positions.groupBy("pid").agg(
        total(long).alias("gross_long"), total(short).alias("gross_short"), total(long & F.col("is_midcap")).alias("mid_long"),
        F.count_distinct(F.when(long, F.col("sector"))).alias("long_sectors"),
    )
    out = state.join(g, "pid", "left").fillna(0, ["gross_long", "gross_short", "mid_long", "long_sectors"])
    return out.withColumns(
        {
            "net": F.col("gross_long") - F.col("gross_short"),
            "gross": F.col("gross_long") + F.col("gross_short"),
            "cash_pct": F.when(F.col("nav") > 0, F.col("cash") / F.col("nav")).otherwise(0.0),
            "midcap_share": F.coalesce(safe_ratio("mid_long", "gross_long"), F.lit(0.0)),
        }
    )


def sector_exposures(positions: DataFrame) -> DataFrame:
    return positions.groupBy("pid", "sector").agg(
        F.coalesce(F.sum(F.when(F.col("direction") == "long", F.col("size"))), F.lit(0.0)).alias("sector_long"),
        F.coalesce(F.sum(F.when(F.col("direction") == "short", F.col("size"))), F.lit(0.0)).alias("sector_short"),
    )


def with_context(proposals: DataFrame, positions: DataFrame, state: DataFrame) -> DataFrame:
    """Proposals with their portfolio's exposures, sector sums and the position already held, if any."""
    held = positions.select("pid", "tk", "entry_price", "current_price")
    out = proposals.join(exposures(positions, state), "pid").join(sector_exposures(positions), ["pid", "sector"], "left")
    return out.fillna(0.0, ["sector_long", "sector_short"]).join(held, ["pid", "tk"], "left").withColumn("now", F.col("size"))


def _long() -> Column:
    return F.col("direction") == "long"


def position_rule(lim: Limits) -> Column:
    """Minimum size, caps by kind (a cut ends the group), then the stop-loss of a position already held."""
    now = F.col("now")
    mid = F.col("is_midcap")
    cap = F.when(_long(), F.when(mid, lim.mid_long).otherwise(lim.core_long)).otherwise(lim.short)
    code = F.when(_long(), F.when(mid, "P2").otherwise("P1")).otherwise("P3")
    move = F.when(F.col("entry_price") > 0, safe_ratio(F.col("current_price") - F.col("entry_price"), "entry_price"))
    return (
        F.when(now < lim.min_size, _reject("P6"))
        .when(now > cap, _reduce(code, cap))
        .when(_long() & (move <= lim.long_stop), _reject("P4"))
        .when(~_long() & (move >= lim.short_stop), _reject("P5"))
        .otherwise(_no())
    )


def sector_rule(lim: Limits) -> Column:
    fin = F.col("sector").isin(*lim.financial)
    cap = F.when(fin, lim.sector_long_fin).otherwise(lim.sector_long)
    now = F.col("now")
    return (
        F.when(_long() & (F.col("sector_long") + now > cap), _fit("S1", cap - F.col("sector_long"), lim))
        .when(~_long() & (F.col("sector_short") + now > lim.sector_short), _fit("S2", lim.sector_short - F.col("sector_short"), lim))
        .otherwise(_no())
    )


def portfolio_rule(lim: Limits) -> Column:
    """Peak stop, drawdown review, cash reserve, gross cap, net range; the first hit decides."""
    now = F.col("now")
    fall = F.when(F.col("peak_nav") > 0, (F.col("nav") - F.col("peak_nav")) / F.col("peak_nav"))
    net = F.when(_long(), F.col("net") + now).otherwise(F.col("net") - now)
    return (
        F.when(fall <= lim.peak_stop, _reject("PT6"))
        .when(F.col("nav_return_21d") <= lim.review_return, _reject("PT5"))
        .when(F.col("cash_pct") - now < lim.cash_min, _fit("PT3", F.col("cash_pct") - lim.cash_min, lim))
        .when(F.col("gross") + now > lim.gross_max, _fit("PT2", lim.gross_max - F.col("gross"), lim))
        .when(net > lim.net_max, _reject("PT1"))
        .when((net < lim.net_min) & (F.col("gross_long") > 0) & ~_long(), _reject("PT1"))
        .otherwise(_no())
    )


def midcap_rule(lim: Limits) -> Column:
    """Mid-cap share of the long book, solved for the largest size that keeps it."""
    now, book, mid = F.col("now"), F.col("gross_long"), F.col("midcap_share") * F.col("gross_long")
    share = safe_ratio(mid + now, book + now)
    room = F.greatest((lim.midcap_max * book - mid) / (1 - lim.midcap_max), F.lit(0.0))
    return F.when(_long() & F.col("is_midcap") & (share > lim.midcap_max), _fit("PT4", room, lim)).otherwise(_no())


def seasonal_rule(lim: Limits) -> Column:
    """Expiry week, budget period, flow sell-off and short-trap rules, in that order."""
    now = F.col("now")
    cut = now * (1 - lim.budget_cut)
    sell_off = F.coalesce(F.col("flow_today") < -lim.flow_sell, F.lit(False)) | (F.col("flow_negative_days") >= lim.flow_days)
    room = F.greatest(lim.flow_net_max - F.col("net"), F.lit(0.0))
    return (
        F.when(F.col("is_expiry") & ~_long(), _reject("IR1"))
        .when(F.col("is_budget"), _fit("IR2", cut, lim))
        .when(_long() & sell_off & (F.col("net") + now > lim.flow_net_max), _fit("IR4", room, lim))
        .when(~_long() & (F.col("circuit_hits") >= lim.circuit_hits), _reject("IR5"))
        .when(~_long() & (F.col("market_cap") < lim.min_cap), _reject("IR5"))
        .otherwise(_no())
    )


def eligibility_rule() -> Column:
    """Invalid input and shorts outside the eligible list."""
    valid = F.col("direction").isin("long", "short")
    return (
        F.when(~valid | (F.col("now") <= 0), _reject(F.lit(None).cast("string")))
        .when(~_long() & ~F.col("eligible"), _reject("FO"))
        .otherwise(_no())
    )


def apply_rule(df: DataFrame, rule: Column) -> DataFrame:
    """Single-rule outcome: status, limit code and approved size of each proposal."""
    d = df.withColumn("_r", rule)
    return d.withColumns(
        {
            "status": F.coalesce(F.col("_r.status"), F.lit("APPROVED")),
            "limit_code": F.col("_r.limit"),
            "approved_size": F.coalesce(F.col("_r.size"), F.col("now")),
        }
    ).drop("_r")


def decide(df: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """All groups in order: a rejection ends, a reduction feeds the next group, a mid-cap cut ends as well."""
    open_ = F.col("_end").isNull()
    out = df.withColumns({"_end": _no(), "_first": F.lit(None).cast("string")})
    chain = [
        (eligibility_rule(), False), (position_rule(lim), False), (sector_rule(lim), False), (portfolio_rule(lim), False),
        (midcap_rule(lim), True), (seasonal_rule(lim), False),
    ]
    for rule, final in chain:
        out = out.withColumn("_r", F.when(open_, rule))
        stop = F.col("_r").isNotNull() & (F.lit(final) | (F.col("_r.status") == "REJECTED"))
        cut = F.col("_r.status") == "REDUCED"
        out = out.withColumns(
            {
                "_end": F.when(stop, F.col("_r")).otherwise(F.col("_end")),
                "now": F.when(cut, F.col("_r.size")).otherwise(F.col("now")),
                "_first": F.when(cut, F.coalesce("_first", "_r.limit")).otherwise(F.col("_first")),
            }
        )
    smaller = F.col("now") < F.col("size")
    ended = F.col("_end").isNotNull()
    return out.withColumns(
        {
            "status": F.when(ended, F.col("_end.status")).when(smaller, "REDUCED").otherwise("APPROVED"),
            "limit_code": F.when(ended, F.col("_end.limit")).when(smaller, F.col("_first")),
            "approved_size": F.when(ended, F.col("_end.size")).otherwise(F.col("now")),
        }
    ).drop("_r", "_end", "_first", "now")


def screen(proposals: DataFrame, positions: DataFrame, state: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """Proposals that pass, possibly reduced, against a fixed state.

    The decisions are written first: a filter pushed down through the rule chain would copy every rule into itself.
    """
    decided = staged(decide(with_context(proposals, positions, state), lim), "decisions")
    return decided.where("status <> 'REJECTED'")


def rejected(proposals: DataFrame, positions: DataFrame, state: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """Proposals that fail and the limit that stopped them; decisions are written first, as in :func:`screen`."""
    decided = staged(decide(with_context(proposals, positions, state), lim), "decisions")
    return decided.where("status = 'REJECTED'").select("pid", "tk", "direction", "size", "limit_code")
