"""The flagship query and the SQL that rebuilds it independently."""

from __future__ import annotations

from panelforge.functions.staging import staged
from panelforge.plans import feature_panel as FP
from panelforge.plans.oracle_views import r, view
from panelforge.plans.queries_features import pc, rank_sql, tiers3
from panelforge.plans.queries_fundamentals import FIN
from panelforge.plans.queries_macro import market
from panelforge.plans.queries_quality import regimes
from panelforge.plans.registry import query
from panelforge.sources import panel as P

_SRC = {
    **{c: f"f.{c}" for c in FP.PRICE if not c.startswith("rs_")},
    "rs_21d": "f.return_21d - m.ix500_return_21d", "rs_60d": "f.return_60d - m.ix500_return_60d",
    **{f"price_to_sma{n}": f"i.adj/nullif(i.sma_{n},0)" for n in (20, 50, 200)},
    "price_to_52w_high": "f.price_to_52w_high", "price_to_52w_low": "f.price_to_52w_low",
    "bb_width": "nullif(i.bb_upper-i.bb_lower,0)/nullif(i.bb_middle,0)", "bb_pctb": "(i.adj-i.bb_lower)/nullif(i.bb_upper-i.bb_lower,0)",
    **{c: f"i.{c}" for c in ("macd_hist", "rsi_14", "atr_14", "stoch_k", "adx_14", "obv_change_5d", "vwap_dev")},
    "fx_x_revenue_growth": "m.ret_fx*p.revenue_yoy_growth", "rate_change": "m.rate_change",
    "target_return_21d": "t.target_return_21d", "target_vol_5d": "t.target_vol_5d",
}


def _value(c: str) -> str:
    if c in _SRC:
        return _SRC[c]
    return f"b.{c}" if c in FP.BETAS else f"p.{c}"


view("ind5", f"SELECT *, {pc('obv', 5)} AS obv_change_5d FROM ind", "ind")
view(
    "fp_vals",
    "SELECT f.tk, f.d, p.sector, " + ", ".join(f"{r(_value(c))} AS {c}" for c in FP.VALUES)
    + """, CAST(CASE WHEN f.d - lag(f.d) OVER (PARTITION BY f.tk ORDER BY f.d) > 5 THEN 1 ELSE 0 END AS INT) AS price_gap_flag,
    CAST(i.sma_200 IS NOT NULL AS INT) AS sma200_available, CAST(i.sma_50 IS NOT NULL AS INT) AS sma50_available,
    CAST(i.adx_14 IS NOT NULL AS INT) AS adx14_available, CAST(f.volatility_20d IS NOT NULL AS INT) AS volatility20d_available,
    p.fundamentals_available, ti.tier, g.regime_int
    FROM feat f JOIN ind5 i USING (tk,d) JOIN pit p USING (tk,d) JOIN beta b USING (tk,d) JOIN targ t USING (tk,d) JOIN tier3 ti USING (tk)
    LEFT JOIN mkt m ON m.d=f.d LEFT JOIN reg g ON g.d=f.d""",
    "feat", "ind5", "pit", "beta", "targ", "tier3", "mkt", "reg",
)
_RANK_SQL = ", ".join(f"{rank_sql(v, ', '.join(by), k)} AS {out}" for out, v, by, k in FP.RANKS if not out.startswith("_"))


@query(
    "feature_panel",
    f"""SELECT tk, d, {', '.join(FP.VALUES)}, {', '.join(FP.RANK_OUT)}, {', '.join(FP.FLAGS)}, {r('tp')} AS target_rank_21d,
    CAST(tp > 0.5 AS INT) AS target_direction_median, CAST(CASE WHEN tp > 2.0::DOUBLE/3 THEN 1 WHEN tp < 1.0::DOUBLE/3 THEN 0 END AS INT) AS target_direction_tertile
    FROM (SELECT *, {_RANK_SQL}, {rank_sql('pool', 'd', raw=True)} AS tp FROM (SELECT *, CASE WHEN tier IN (1,2) THEN target_return_21d END AS pool FROM fp_vals))""",
    ("fp_vals",),
)
def feature_panel(spark, sf):
    mkt = staged(market(spark, sf), "market")
    return FP.feature_panel(
        P.bars(spark, sf), P.splits(spark, sf), P.fund(spark, sf), P.sector(spark, sf), tiers3(spark, sf),
        mkt, staged(regimes(spark, sf, mkt), "regimes"), FIN,
    )
