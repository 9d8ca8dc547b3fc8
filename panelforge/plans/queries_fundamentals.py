"""Statement, ratio and point-in-time queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.numeric import floor_round
from panelforge.operators import fundamentals as FU
from panelforge.plans.oracle_views import r, view
from panelforge.plans.registry import query
from panelforge.sources import panel as P

FIN = ("S0",)

view(
    "stmt",
    f"""SELECT tk, period, {r('revenue/1e7', 2)} AS revenue, {r('total_debt/1e7', 2)} AS expenses, {r('ebitda/1e7', 2)} AS ebitda,
    {r('net_income/1e7', 2)} AS net_income, {r('total_equity/1e7', 2)} AS equity_capital, {r('free_cash_flow/1e7', 2)} AS reserves,
    {r('total_debt/1e7', 2)} AS total_debt, {r('total_assets/1e7', 2)} AS total_assets, {r('operating_cf/1e7', 2)} AS fixed_assets,
    CAST(NULL AS DOUBLE) AS cwip, {r('free_cash_flow/1e7', 2)} AS investments, {r('operating_cf/1e7', 2)} AS operating_cf,
    {r('-gross_profit/1e7', 2)} AS investing_cf, CASE WHEN year(period) % 2 = 0 THEN {r('free_cash_flow/1e7', 2)} END AS free_cash_flow FROM fund""",
    "fund",
)


def statements(spark, sf):
    f = P.fund(spark, sf)

    def cr(c):
        return floor_round(F.col(c) / 1e7, 2)

    return f.select(
        "tk", "period", cr("revenue").alias("revenue"), cr("total_debt").alias("expenses"), cr("ebitda").alias("ebitda"),
        cr("net_income").alias("net_income"), cr("total_equity").alias("equity_capital"), cr("free_cash_flow").alias("reserves"),
        cr("total_debt").alias("total_debt"), cr("total_assets").alias("total_assets"), cr("operating_cf").alias("fixed_assets"),
        F.lit(None).cast("double").alias("cwip"), cr("free_cash_flow").alias("investments"), cr("operating_cf").alias("operating_cf"),
        floor_round(-F.col("gross_profit") / 1e7, 2).alias("investing_cf"),
        F.when(F.year("period") % 2 == 0, cr("free_cash_flow")).alias("free_cash_flow"),
    )


def _unit(x: str) -> str:
    return f"CAST(trunc(({x})*1e7) AS BIGINT)"


@query(
    "fund_derive",
    f"""SELECT tk, period, {_unit('revenue')} AS revenue, {_unit(f"CASE WHEN NOT bank THEN {r('revenue-expenses', 2)} END")} AS gross_profit,
    {_unit('ebitda')} AS ebitda, {_unit('net_income')} AS net_income, {_unit('total_assets')} AS total_assets,
    {_unit('eq')} AS total_equity, {_unit(r('CASE WHEN bank THEN CASE WHEN inv > 0 THEN inv END WHEN total_assets > 0 AND spare > 0 AND spare < total_assets*0.95::DOUBLE THEN spare END', 2))} AS cash,
    {_unit('total_debt')} AS total_debt, {_unit('operating_cf')} AS operating_cf,
    {_unit(f"CASE WHEN free_cash_flow IS NOT NULL THEN {r('operating_cf-free_cash_flow', 2)} WHEN operating_cf IS NOT NULL THEN abs(investing_cf) END")} AS capex,
    {_unit(f"coalesce(free_cash_flow, {r('operating_cf+investing_cf', 2)}, operating_cf)")} AS free_cash_flow,
    {r('total_debt/nullif(eq,0)', 4)} AS debt_to_equity, {r('net_income/nullif(total_assets,0)', 4)} AS roa FROM
    (SELECT s.*, tk IN (SELECT tk FROM sector WHERE sector='S0') AS bank, coalesce(investments,0) AS inv,
     CASE WHEN coalesce(equity_capital,0)<>0 OR coalesce(reserves,0)<>0 THEN coalesce(equity_capital,0)+coalesce(reserves,0) END AS eq,
     total_assets-(coalesce(fixed_assets,0)+coalesce(cwip,0)+coalesce(investments,0)) AS spare FROM stmt s)""",
    ("stmt", "sector"),
)
def fund_derive(spark, sf):
    banks = P.sector(spark, sf).where("sector = 'S0'")
    return FU.derive_statement(statements(spark, sf), banks)


@query(
    "fund_snapshot_mask",
    """SELECT tk, period, CASE WHEN period = max(period) OVER (PARTITION BY tk) THEN roa END AS roa,
    CASE WHEN period = max(period) OVER (PARTITION BY tk) THEN debt_to_equity END AS debt_to_equity FROM fund""",
    ("fund",),
)
def fund_snapshot_mask(spark, sf):
    return FU.mask_snapshots(P.fund(spark, sf).select("tk", "period", "roa", "debt_to_equity"), ["roa", "debt_to_equity"])


view(
    "fratio",
    """SELECT tk, period, period + 60 AS effective_date, sector, (revenue - pr)/nullif(pr,0) AS revenue_yoy_growth,
    ebitda/nullif(revenue,0) AS ebitda_margin, net_income/nullif(revenue,0) AS net_margin, free_cash_flow/nullif(revenue,0) AS fcf_margin,
    revenue/nullif(total_assets,0) AS asset_turnover, roa, debt_to_equity,
    CASE WHEN px THEN net_income ELSE gross_profit END/nullif(revenue,0) AS gross_profit_margin, CAST(px AS DOUBLE) AS gross_margin_is_proxy,
    total_debt/nullif(total_assets,0) AS debt_to_assets, operating_cf/nullif(net_income,0) AS ocf_to_net_income,
    roa - lag(roa) OVER o AS delta_roa, debt_to_equity - lag(debt_to_equity) OVER o AS delta_debtequity FROM
    (SELECT f.*, s.sector, lag(revenue) OVER (PARTITION BY tk ORDER BY period) AS pr, s.sector='S0' OR gross_profit IS NULL AS px
     FROM fund f JOIN sector s USING (tk)) WINDOW o AS (PARTITION BY tk ORDER BY period)""",
    "fund", "sector",
)
view(
    "fmed",
    "SELECT sector, period, count(*) AS ticker_count, "
    + ", ".join(f"CASE WHEN count({c}) >= 3 THEN median({c}) END AS {c}" for c in FU.MEDIAN_RATIOS)
    + " FROM fratio GROUP BY 1,2",
    "fratio",
)
view(
    "pown",
    "SELECT tk, d, sector, CASE WHEN ok THEN period END AS mp, CAST(coalesce(ok,false) AS INT) AS fundamentals_available, "
    + ", ".join(f"CASE WHEN ok THEN {c} END AS {c}" for c in FU.RATIOS)
    + " FROM (SELECT b.tk, b.d, s.sector, f.* EXCLUDE (tk, sector), b.d - f.period <= 400 AS ok FROM bars b JOIN sector s USING (tk)"
    + " ASOF LEFT JOIN fratio f ON b.tk=f.tk AND b.d >= f.effective_date)",
    "bars", "sector", "fratio",
)
view(
    "pfill",
    "SELECT o.tk, o.d, o.sector, o.fundamentals_available, o.gross_margin_is_proxy, "
    "CASE WHEN fundamentals_available=0 THEN coalesce(m.period, o.mp) ELSE o.mp END AS matched_period, "
    + ", ".join(f"CASE WHEN fundamentals_available=0 THEN coalesce(m.{c}, o.{c}) ELSE o.{c} END AS {c}" for c in FU.MEDIAN_RATIOS)
    + " FROM pown o ASOF LEFT JOIN fmed m ON o.sector=m.sector AND o.d-60 >= m.period",
    "pown", "fmed",
)
view(
    "pit",
    "SELECT p.*, p.roa - m.roa AS rel_roa, p.ebitda_margin - m.ebitda_margin AS rel_ebitda_margin FROM pfill p"
    " LEFT JOIN fmed m ON p.sector=m.sector AND p.matched_period=m.period",
    "pfill", "fmed",
)


def fratio(spark, sf):
    return FU.ratios(P.fund(spark, sf), P.sector(spark, sf), FIN)


def _cols(cols):
    return ", ".join(f"{r(c)} AS {c}" for c in cols)


_R = ("revenue_yoy_growth", "ebitda_margin", "net_margin", "fcf_margin", "asset_turnover", "roa", "debt_to_equity", "debt_to_assets", "ocf_to_net_income")


@query("fund_ratios", f"SELECT tk, period, effective_date, {_cols(_R)} FROM fratio", ("fratio",))
def fund_ratios(spark, sf):
    return fratio(spark, sf).select("tk", "period", "effective_date", *[floor_round(c).alias(c) for c in _R])


@query("fund_margin_proxy", f"SELECT tk, period, sector, {_cols(('gross_profit_margin', 'gross_margin_is_proxy'))} FROM fratio", ("fratio",))
def fund_margin_proxy(spark, sf):
    return fratio(spark, sf).select("tk", "period", "sector", *[floor_round(c).alias(c) for c in ("gross_profit_margin", "gross_margin_is_proxy")])


@query("fund_deltas", f"SELECT tk, period, {_cols(('delta_roa', 'delta_debtequity'))} FROM fratio", ("fratio",))
def fund_deltas(spark, sf):
    return fratio(spark, sf).select("tk", "period", *[floor_round(c).alias(c) for c in ("delta_roa", "delta_debtequity")])


@query("fund_sector_median", f"SELECT sector, period, ticker_count, {_cols(FU.MEDIAN_RATIOS)} FROM fmed", ("fmed",))
def fund_sector_median(spark, sf):
    return FU.sector_medians(fratio(spark, sf)).select(
        "sector", "period", "ticker_count", *[floor_round(c).alias(c) for c in FU.MEDIAN_RATIOS]
    )


def panel_base(spark, sf):
    return P.bars(spark, sf).select("tk", "d").join(P.sector(spark, sf), "tk")


@query("asof_fundamentals", f"SELECT tk, d, mp AS matched_period, fundamentals_available, {_cols(FU.RATIOS)} FROM pown", ("pown",))
def asof_fundamentals(spark, sf):
    own = FU.attach_own(panel_base(spark, sf), fratio(spark, sf))
    return own.select("tk", "d", "matched_period", "fundamentals_available", *[floor_round(c).alias(c) for c in FU.RATIOS])


@query("asof_sector_fallback", f"SELECT tk, d, matched_period, fundamentals_available, {_cols(FU.RATIOS)} FROM pfill", ("pfill",))
def asof_sector_fallback(spark, sf):
    f = fratio(spark, sf)
    out = FU.fill_from_sector(FU.attach_own(panel_base(spark, sf), f), FU.sector_medians(f))
    return out.select("tk", "d", "matched_period", "fundamentals_available", *[floor_round(c).alias(c) for c in FU.RATIOS])


@query("fund_sector_relative", f"SELECT tk, d, {_cols(FU.RELATIVE)} FROM pit", ("pit",))
def fund_sector_relative(spark, sf):
    f = fratio(spark, sf)
    out = FU.point_in_time(panel_base(spark, sf), f, FU.sector_medians(f))
    return out.select("tk", "d", *[floor_round(c).alias(c) for c in FU.RELATIVE])


@query(
    "feat_interaction",
    f"SELECT tk, d, {r('ret_fx*revenue_yoy_growth')} AS fx_x_revenue_growth FROM pown LEFT JOIN mkt USING (d)",
    ("pown", "mkt"),
)
def feat_interaction(spark, sf):
    from panelforge.plans.queries_macro import market

    own = FU.attach_own(panel_base(spark, sf), fratio(spark, sf)).join(market(spark, sf), "d", "left")
    return own.select("tk", "d", floor_round(F.col("ret_fx") * F.col("revenue_yoy_growth")).alias("fx_x_revenue_growth"))
