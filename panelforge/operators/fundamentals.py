"""Statement facts, ratios, sector medians and their point-in-time join to the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.asof import asof_join
from panelforge.functions.numeric import floor_round, safe_ratio
from panelforge.functions.ranking import quantiles
from panelforge.functions.windows import Axis

PERIODS = Axis(("tk",), "period")

# Ratio columns in published order.
RATIOS = (
    "revenue_yoy_growth", "ebitda_margin", "net_margin", "fcf_margin", "asset_turnover", "roa", "debt_to_equity",
    "gross_profit_margin", "gross_margin_is_proxy", "debt_to_assets", "ocf_to_net_income", "delta_roa",
    "delta_debtequity",
)
MEDIAN_RATIOS = tuple(c for c in RATIOS if c != "gross_margin_is_proxy")

LAG_DAYS = 60
STALE_DAYS = 400
UNIT = 1e7


def derive_statement(df: DataFrame, banks: DataFrame, unit: float = UNIT) -> DataFrame:
    """Derived facts of one statement row.

    Input columns: revenue, expenses, ebitda, net_income, equity_capital, reserves, total_debt, total_assets,
    fixed_assets, cwip, investments, operating_cf, investing_cf, free_cash_flow. ``banks`` lists the entities whose
    liquid assets are their investments and which have no gross profit. Money columns are scaled to single units.
    """
    bank = F.coalesce(F.col("_bank"), F.lit(False))
    d = df.join(banks.select("tk", F.lit(True).alias("_bank")).distinct(), "tk", "left")
    zero = F.lit(0.0)
    equity_raw = F.coalesce("equity_capital", zero) + F.coalesce("reserves", zero)
    has_equity = (F.coalesce("equity_capital", zero) != 0) | (F.coalesce("reserves", zero) != 0)
    equity = F.when(has_equity, equity_raw)
    held = F.coalesce("investments", zero)
    assets = F.col("total_assets")
    spare = assets - (F.coalesce("fixed_assets", zero) + F.coalesce("cwip", zero) + held)
    cash = F.when(bank, F.when(held > 0, held)).otherwise(
        F.when((assets > 0) & (spare > 0) & (spare < assets * 0.95), spare)
    )
    op, inv, fcf = F.col("operating_cf"), F.col("investing_cf"), F.col("free_cash_flow")
    # free cash flow: as reported, else operating plus investing, else operating alone
    free = F.coalesce(fcf, floor_round(op + inv, 2), op)
    capex = F.when(fcf.isNotNull(), floor_round(op - fcf, 2)).otherwise(F.when(op.isNotNull(), F.abs(inv)))
    money = {
        "revenue": F.col("revenue"),
        "gross_profit": F.when(~bank, floor_round(F.col("revenue") - F.col("expenses"), 2)),
        "ebitda": F.col("ebitda"),
        "net_income": F.col("net_income"),
        "total_assets": assets,
        "total_equity": equity,
        "cash": floor_round(cash, 2),
        "total_debt": F.col("total_debt"),
        "operating_cf": op,
        "capex": capex,
        "free_cash_flow": free,
    }
    return d.select(
        "tk",
        "period",
        *[(c * F.lit(unit)).cast("bigint").alias(n) for n, c in money.items()],
        floor_round(safe_ratio("total_debt", equity), 4).alias("debt_to_equity"),
        floor_round(safe_ratio("net_income", "total_assets"), 4).alias("roa"),
    )


def mask_snapshots(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep today's snapshot columns only on the latest period of each entity."""
    latest = F.col("period") == F.max("period").over(PERIODS.whole())
    return df.withColumns({c: F.when(latest, F.col(c)) for c in cols})


def margin_proxy(financial: Column) -> dict[str, Column]:
    """Gross margin, falling back to net income for financial sectors or where gross profit is missing."""
    proxy = financial | F.col("gross_profit").isNull()
    numerator = F.when(proxy, F.col("net_income")).otherwise(F.col("gross_profit"))
    return {
        "gross_profit_margin": safe_ratio(numerator, "revenue"),
        "gross_margin_is_proxy": proxy.cast("double"),
    }


def ratios(fund: DataFrame, sectors: DataFrame, financial_sectors: Sequence[str], lag_days: int = LAG_DAYS) -> DataFrame:
    """Growth, margin, efficiency and solvency ratios plus the date from which they are public."""
    d = fund.join(sectors.select("tk", "sector"), "tk", "left").withColumn("sector", F.coalesce("sector", F.lit("Others")))
    prev = PERIODS.shift("revenue")
    cols = {
        "revenue_yoy_growth": safe_ratio(F.col("revenue") - prev, prev),
        "ebitda_margin": safe_ratio("ebitda", "revenue"),
        "net_margin": safe_ratio("net_income", "revenue"),
        "fcf_margin": safe_ratio("free_cash_flow", "revenue"),
        "asset_turnover": safe_ratio("revenue", "total_assets"),
        "debt_to_assets": safe_ratio("total_debt", "total_assets"),
        "ocf_to_net_income": safe_ratio("operating_cf", "net_income"),
        **margin_proxy(F.col("sector").isin(*financial_sectors)),
        "delta_roa": PERIODS.diff("roa"),
        "delta_debtequity": PERIODS.diff("debt_to_equity"),
        "effective_date": F.date_add("period", lag_days),
    }
    return d.withColumns(cols).select("tk", "period", "effective_date", "sector", *RATIOS)


def sector_medians(ratio: DataFrame, min_tickers: int = 3, cols: Sequence[str] = MEDIAN_RATIOS) -> DataFrame:
    """Median of each ratio per (sector, period); NULL with fewer than ``min_tickers`` values."""
    by = ["sector", "period"]
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in cols])
    long = ratio.select(*by, F.explode(items).alias("i")).select(*by, "i.name", "i.x")
    med = quantiles(long, [*by, "name"], "x", {"med": 0.5}).where(F.col("n_values") >= min_tickers)
    wide = med.groupBy(*by).agg(*[F.max(F.when(F.col("name") == c, F.col("med"))).alias(c) for c in cols])
    counts = ratio.groupBy(*by).agg(F.count(F.lit(1)).alias("ticker_count"))
    return counts.join(wide, by, "left")


def attach_own(panel: DataFrame, ratio: DataFrame, stale_days: int = STALE_DAYS, cols: Sequence[str] = RATIOS) -> DataFrame:
    """Last published ratios of the entity, dropped when the period is more than ``stale_days`` old."""
    hit = asof_join(
        panel, ratio.drop("sector"), ["tk"], "d", "effective_date", ["period", *cols], left_unique=True
    )
    fresh = F.date_diff("d", "period") <= stale_days
    out = hit.withColumn("_fresh", F.coalesce(fresh, F.lit(False)))
    return out.withColumns(
        {
            **{c: F.when(F.col("_fresh"), F.col(c)) for c in cols},
            "matched_period": F.when(F.col("_fresh"), F.col("period")),
            "fundamentals_available": F.col("_fresh").cast("int"),
        }
    ).drop("_fresh", "period")


def fill_from_sector(
    panel: DataFrame,
    medians: DataFrame,
    lag_days: int = LAG_DAYS,
    cols: Sequence[str] = MEDIAN_RATIOS,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Rows without own ratios take the sector medians of the last period at least ``lag_days`` back.

    The as-of match runs on distinct (sector, date) pairs, so a large sector is not one time line of all its rows;
    ``keys`` may supply those pairs from a cheaper frame.
    """
    med = medians.select("sector", "period", *[F.col(c).alias(f"_sm_{c}") for c in cols])
    keyed = panel.withColumn("_jd", F.date_sub("d", lag_days))
    probe = None if keys is None else keys.select("sector", F.date_sub("d", lag_days).alias("_jd"))
    take = ["period", *[f"_sm_{c}" for c in cols]]
    hit = asof_join(keyed, med, ["sector"], "_jd", "period", take, probe=probe)
    missing = F.col("fundamentals_available") == 0
    return hit.withColumns(
        {
            **{c: F.when(missing, F.coalesce(f"_sm_{c}", c)).otherwise(F.col(c)) for c in cols},
            "matched_period": F.when(missing, F.coalesce("period", "matched_period")).otherwise(F.col("matched_period")),
        }
    ).drop("_jd", "period", *[f"_sm_{c}" for c in cols])


def sector_relative(panel: DataFrame, medians: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Difference to the sector median of the matched period; ``spec`` maps output to ratio."""
    med = medians.select(
        "sector", F.col("period").alias("matched_period"), *[F.col(c).alias(f"_rel_{c}") for c in spec.values()]
    )
    hit = panel.join(med, ["sector", "matched_period"], "left")
    return hit.withColumns({out: F.col(c) - F.col(f"_rel_{c}") for out, c in spec.items()}).drop(
        *[f"_rel_{c}" for c in spec.values()]
    )


RELATIVE = {"rel_roa": "roa", "rel_ebitda_margin": "ebitda_margin"}


def point_in_time(panel: DataFrame, ratio: DataFrame, medians: DataFrame) -> DataFrame:
    """Own ratios, sector fallback and sector-relative values; the panel needs (tk, d, sector)."""
    filled = fill_from_sector(attach_own(panel, ratio), medians, keys=panel)
    return sector_relative(filled, medians, RELATIVE)
