"""Per-entity price features, cross-sectional ranks and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.numeric import floor_round, safe_ratio
from panelforge.functions.windows import Axis
from panelforge.operators import bars as B
from panelforge.operators import crosssection as X
from panelforge.operators import features as E
from panelforge.operators import indicators as I
from panelforge.plans.oracle_views import r, view
from panelforge.plans.queries_bars import adj
from panelforge.plans.queries_indicators import bars_vwap, ma
from panelforge.plans.queries_macro import market
from panelforge.plans.registry import query
from panelforge.sources import panel as P

TK = Axis(("tk",), "d")
BETAS = {
    "beta_to_ix50": "ret_ix50", "beta_to_ix500": "ret_ix500", "beta_to_fx": "ret_fx", "beta_to_vix": "ret_vix",
    "beta_to_crude": "ret_crude", "beta_to_gold": "ret_gold", "beta_to_fii": "ret_fii", "beta_to_dii": "ret_dii",
}


def pc(c: str, n: int = 1) -> str:
    return f"{c}/nullif(lag({c},{n}) OVER (PARTITION BY tk ORDER BY d),0)-1"


view(
    "feat",
    f"""SELECT *, mom_252 - return_21d AS mom_12_1, mom_126 - return_21d AS mom_6_1,
    {ma('stddev_samp', 'log_return_1d', 20)}*sqrt(252.0::DOUBLE) AS volatility_20d FROM (
    SELECT *, {pc('adj')} AS return_1d, {pc('adj', 5)} AS return_5d, {pc('adj', 21)} AS return_21d, {pc('adj', 60)} AS return_60d,
    {pc('adj', 252)} AS mom_252, {pc('adj', 126)} AS mom_126,
    CASE WHEN adj/nullif(lag(adj) OVER (PARTITION BY tk ORDER BY d),0) > 0 THEN ln(adj/nullif(lag(adj) OVER (PARTITION BY tk ORDER BY d),0)) END AS log_return_1d,
    vol/nullif({ma('avg', 'vol', 20)},0) AS volume_ratio_20d,
    adj/nullif({ma('max', 'hi', 252, 63)},0) AS price_to_52w_high, adj/nullif({ma('min', 'lo', 252, 63)},0) AS price_to_52w_low
    FROM adj)""",
    "adj",
)


def _sel(cols, src="feat"):
    return "SELECT tk, d, " + ", ".join(f"{r(c)} AS {c}" for c in cols) + f" FROM {src}"


def _round(df, cols, keys=("tk", "d")):
    return df.select(*keys, *[floor_round(c).alias(c) for c in cols])


RET = ("return_1d", "return_5d", "return_21d", "return_60d", "log_return_1d")


@query("feat_returns", _sel(RET), ("feat",))
def feat_returns(spark, sf):
    df = adj(spark, sf).withColumns({**E.simple_returns(TK, "adj"), "log_return_1d": E.log_return(TK, "adj")})
    return _round(df, RET)


@query("feat_momentum", _sel(("mom_12_1", "mom_6_1")), ("feat",))
def feat_momentum(spark, sf):
    return _round(adj(spark, sf).withColumns(E.momentum(TK, "adj")), ("mom_12_1", "mom_6_1"))


def log_returns(spark, sf):
    return adj(spark, sf).withColumn("log_return_1d", E.log_return(TK, "adj"))


@query("feat_volatility", _sel(("volatility_20d",)), ("feat",))
def feat_volatility(spark, sf):
    df = log_returns(spark, sf).withColumn("volatility_20d", E.realised_vol(TK, "log_return_1d"))
    return _round(df, ("volatility_20d",))


@query("feat_volume_ratio", _sel(("volume_ratio_20d",)), ("feat",))
def feat_volume_ratio(spark, sf):
    return _round(adj(spark, sf).withColumn("volume_ratio_20d", E.volume_ratio(TK, "vol")), ("volume_ratio_20d",))


@query(
    "feat_price_to_sma",
    "SELECT tk, d, " + ", ".join(f"{r(f'adj/nullif(sma_{n},0)')} AS price_to_sma{n}" for n in (20, 50, 200)) + " FROM ind_w",
    ("ind_w",),
)
def feat_price_to_sma(spark, sf):
    ratio = {f"price_to_sma{n}": safe_ratio("adj", f"sma_{n}") for n in (20, 50, 200)}
    return _round(I.smas(adj(spark, sf), TK, "adj").withColumns(ratio), ratio)


@query("feat_52w", _sel(("price_to_52w_high", "price_to_52w_low")), ("feat",))
def feat_52w(spark, sf):
    return _round(E.range_position(adj(spark, sf), TK, "adj", "hi", "lo"), ("price_to_52w_high", "price_to_52w_low"))


@query(
    "feat_bands",
    f"""SELECT tk, d, {r("nullif(bb_upper-bb_lower,0)/nullif(bb_middle,0)")} AS bb_width,
    {r("(adj-bb_lower)/nullif(bb_upper-bb_lower,0)")} AS bb_pctb FROM ind_w""",
    ("ind_w",),
)
def feat_bands(spark, sf):
    b = I.bollinger(adj(spark, sf), TK, "adj")
    return _round(b.withColumns(E.band_features("adj")), ("bb_width", "bb_pctb"))


@query("feat_obv_change", f"SELECT tk, d, {r(pc('obv', 5))} AS obv_change_5d FROM ind_w", ("ind_w",))
def feat_obv_change(spark, sf):
    b = I.on_balance_volume(adj(spark, sf), TK)
    return _round(b.withColumn("obv_change_5d", TK.pct_change("obv", 5)), ("obv_change_5d",))


@query(
    "feat_flags",
    f"""SELECT tk, d, CAST(w.sma_200 IS NOT NULL AS INT) AS sma200_available, CAST(w.sma_50 IS NOT NULL AS INT) AS sma50_available,
    CAST(f.volatility_20d IS NOT NULL AS INT) AS volatility20d_available FROM ind_w w JOIN feat f USING (tk,d)""",
    ("ind_w", "feat"),
)
def feat_flags(spark, sf):
    b = I.smas(log_returns(spark, sf), TK, "adj").withColumn("volatility_20d", E.realised_vol(TK, "log_return_1d"))
    return b.select(
        "tk", "d", E.present("sma_200").alias("sma200_available"), E.present("sma_50").alias("sma50_available"),
        E.present("volatility_20d").alias("volatility20d_available"),
    )


def beta_sql(x: str) -> str:
    w = "OVER (PARTITION BY tk ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN count(CASE WHEN return_1d IS NOT NULL AND {x} IS NOT NULL THEN 1 END) {w} >= 63 THEN covar_samp(return_1d,{x}) {w} END"
            f"/nullif(CASE WHEN count({x}) {w} >= 63 THEN var_samp({x}) {w} END,0)")


view("feat_mkt", "SELECT f.*, m.* EXCLUDE (d, flow_best) FROM feat f LEFT JOIN mkt m USING (d)", "feat", "mkt")
view("beta", "SELECT tk, d, " + ", ".join(f"{beta_sql(f)} AS {b}" for b, f in BETAS.items()) + " FROM feat_mkt", "feat_mkt")


@query("feat_beta", _sel(BETAS, "beta"), ("beta",))
def feat_beta(spark, sf):
    df = adj(spark, sf).withColumn("return_1d", TK.pct_change("adj")).join(market(spark, sf), "d", "left")
    return _round(E.with_betas(df, TK, "return_1d", BETAS), BETAS)


@query(
    "feat_rel_strength",
    f"SELECT tk, d, {r('return_21d-ix500_return_21d')} AS rs_21d, {r('return_60d-ix500_return_60d')} AS rs_60d FROM feat_mkt",
    ("feat_mkt",),
)
def feat_rel_strength(spark, sf):
    df = adj(spark, sf).withColumns(E.simple_returns(TK, "adj", (21, 60))).join(market(spark, sf), "d", "left")
    rs = {f"rs_{n}d": E.relative_strength(f"return_{n}d", f"ix500_return_{n}d") for n in (21, 60)}
    return _round(df.withColumns(rs), rs)


@query(
    "feat_join_panel",
    f"""SELECT tk, d, {r('w.sma_20', 4)} AS sma_20, {r('w.stoch_k', 4)} AS stoch_k, m.ix500, m.rate, m.flow_flag
    FROM ind_w w LEFT JOIN mac m USING (d)""",
    ("ind_w", "mac"),
)
def feat_join_panel(spark, sf):
    from panelforge.plans.queries_macro import macro_full

    b = bars_vwap(spark, sf)
    ind = I.windowed(b, TK, "adj").select("tk", "d", *[floor_round(c, 4).alias(c) for c in ("sma_20", "stoch_k")])
    mac = macro_full(spark, sf).select("d", "ix500", "rate", "flow_flag")
    return b.select("tk", "d").join(ind, ["tk", "d"], "left").join(mac, "d", "left")


@query("scalar_safe_ratio", f"SELECT tk, d, {r('(hi-lo)/nullif(cl-lo,0)')} AS ratio FROM bars", ("bars",))
def scalar_safe_ratio(spark, sf):
    return P.bars(spark, sf).select("tk", "d", floor_round(safe_ratio(F.col("hi") - F.col("lo"), F.col("cl") - F.col("lo"))).alias("ratio"))


# ---- cross-section and targets -------------------------------------------------------------------


def rank_sql(value: str, by: str, min_count: int = 1, where: str = "true", raw: bool = False) -> str:
    """Percentile rank with mean rank of ties; the caller selects from a frame holding ``value`` and ``by``."""
    n = f"count({value}) OVER (PARTITION BY {by})"
    p = (f"(rank() OVER (PARTITION BY {by} ORDER BY {value} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {value}) + 1)/2.0::DOUBLE - 1)/{n}")
    return f"CASE WHEN {value} IS NOT NULL AND {n} >= {min_count} THEN {p if raw else r(p)} END"


view("feat_r", f"SELECT tk, d, sector, {r('return_21d')} AS v21, {r('mom_12_1')} AS v12, {r('volatility_20d')} AS vv FROM feat JOIN sector USING (tk)", "feat", "sector")


def returns_21(spark, sf):
    df = adj(spark, sf).withColumns({**E.simple_returns(TK, "adj", (21,)), **E.momentum(TK, "adj")})
    return df.join(P.sector(spark, sf), "tk")


@query("cs_rank", f"SELECT tk, d, {rank_sql('v21', 'd', 2)} AS mom_1m_rank FROM feat_r", ("feat_r",))
def cs_rank(spark, sf):
    return X.ranked(returns_21(spark, sf), ["d"], "return_21d", "mom_1m_rank", 2).select("tk", "d", "mom_1m_rank")


@query("cs_sector_rank", f"SELECT tk, d, sector, {rank_sql('v21', 'd, sector', 3)} AS sector_rank FROM feat_r", ("feat_r",))
def cs_sector_rank(spark, sf):
    return X.ranked(returns_21(spark, sf), ["d", "sector"], "return_21d", "sector_rank", 3).select("tk", "d", "sector", "sector_rank")


view(
    "targ",
    """SELECT *, CASE WHEN d <= m - 21 THEN lead(adj,21) OVER o/nullif(adj,0)-1 END AS target_return_21d,
    CASE WHEN d <= m - 21 THEN stddev_samp(log_return_1d) OVER (PARTITION BY tk ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)*sqrt(252.0::DOUBLE) END AS target_vol_5d
    FROM (SELECT *, max(d) OVER () AS m FROM feat) WINDOW o AS (PARTITION BY tk ORDER BY d)""",
    "feat",
)


def with_targets(spark, sf):
    return E.targets(log_returns(spark, sf), TK, "adj", "log_return_1d", dates=P.bars(spark, sf))


@query("target_return", _sel(("target_return_21d",), "targ"), ("targ",))
def target_return(spark, sf):
    return _round(with_targets(spark, sf), ("target_return_21d",))


@query("target_vol", _sel(("target_vol_5d",), "targ"), ("targ",))
def target_vol(spark, sf):
    return _round(with_targets(spark, sf), ("target_vol_5d",))


# tiers by history length, as a stand-in for the quality table
view("tier3", "SELECT tk, CAST(CASE WHEN n < avg_n*0.98 THEN 3 WHEN n < avg_n THEN 2 ELSE 1 END AS INT) AS tier FROM (SELECT tk, count(*) AS n, avg(count(*)) OVER () AS avg_n FROM bars GROUP BY tk)", "bars")


def tiers3(spark, sf):
    n = P.bars(spark, sf).groupBy("tk").agg(F.count(F.lit(1)).alias("n"))
    mean = n.agg(F.avg("n")).scalar()
    return n.select("tk", F.when(F.col("n") < mean * 0.98, 3).when(F.col("n") < mean, 2).otherwise(1).alias("tier"))


_TR = f"SELECT tk, d, {rank_sql('v', 'd', raw=True)} AS p FROM (SELECT tk, d, {r('target_return_21d')} AS v FROM targ JOIN tier3 USING (tk) WHERE tier IN (1,2) AND target_return_21d IS NOT NULL)"
view("trank", _TR, "targ", "tier3")


@query(
    "target_rank",
    f"""SELECT tk, d, {r('p')} AS target_rank_21d, CAST(p > 0.5 AS INT) AS target_direction_median,
    CAST(CASE WHEN p > 2.0::DOUBLE/3 THEN 1 WHEN p < 1.0::DOUBLE/3 THEN 0 END AS INT) AS target_direction_tertile FROM trank""",
    ("trank",),
)
def target_rank(spark, sf):
    df = with_targets(spark, sf).join(tiers3(spark, sf), "tk")
    return X.rank_targets(df).select("tk", "d", "target_rank_21d", "target_direction_median", "target_direction_tertile")


view(
    "csfit",
    "SELECT d, avg(return_21d) AS mean_return_21d, stddev_samp(return_21d) AS std_return_21d, avg(volatility_20d) AS mean_volatility_20d,"
    " stddev_samp(volatility_20d) AS std_volatility_20d FROM feat GROUP BY d HAVING count(DISTINCT tk) >= 10",
    "feat",
)
_FIT = ("return_21d", "volatility_20d")


def norm_input(spark, sf):
    df = log_returns(spark, sf).withColumns({**E.simple_returns(TK, "adj", (21,)), "volatility_20d": E.realised_vol(TK, "log_return_1d")})
    return df.select("tk", "d", *_FIT)


@query(
    "cs_norm_fit",
    "SELECT d, " + ", ".join(f"{r(c)} AS {c}" for c in ("mean_return_21d", "std_return_21d", "mean_volatility_20d", "std_volatility_20d")) + " FROM csfit",
    ("csfit",),
)
def cs_norm_fit(spark, sf):
    stats = X.fit_daily_stats(norm_input(spark, sf), _FIT)
    return stats.select("d", *[floor_round(c).alias(c) for c in stats.columns if c != "d"])


@query(
    "cs_norm_apply",
    "SELECT f.tk, f.d, " + ", ".join(f"{r(f'coalesce((f.{c}-s.mean_{c})/nullif(s.std_{c},0), f.{c})')} AS {c}" for c in _FIT)
    + " FROM feat f ASOF LEFT JOIN (SELECT * FROM csfit WHERE d < DATE '2000-01-01') s ON f.d >= s.d",
    ("feat", "csfit"),
)
def cs_norm_apply(spark, sf):
    df = norm_input(spark, sf)
    stats = X.fit_daily_stats(df.where("d < date'2000-01-01'"), _FIT)
    return _round(X.apply_daily_stats(df, stats, _FIT), _FIT)


@query(
    "cs_norm_overall",
    "WITH o AS (SELECT " + ", ".join(f"avg({p}_{c}) AS {p}_{c}" for c in _FIT for p in ("mean", "std")) + " FROM csfit) SELECT tk, d, "
    + ", ".join(f"{r(f'coalesce(({c}-mean_{c})/nullif(std_{c},0), {c})')} AS {c}" for c in _FIT) + " FROM feat, o",
    ("feat", "csfit"),
)
def cs_norm_overall(spark, sf):
    df = norm_input(spark, sf)
    return _round(X.apply_overall_stats(df, X.fit_daily_stats(df, _FIT), _FIT), _FIT)


@query(
    "dq_rank_coverage",
    f"""WITH k AS (SELECT {rank_sql('v21', 'd', 2)} AS a, {rank_sql('v12', 'd', 2)} AS b FROM feat_r)
    SELECT 'mom_1m_rank' AS name, count(a) AS filled FROM k UNION ALL SELECT 'mom_12_1_rank', count(b) FROM k""",
    ("feat_r",),
)
def dq_rank_coverage(spark, sf):
    from panelforge.functions.ranking import rank_many

    df = returns_21(spark, sf).select("tk", "d", floor_round("return_21d").alias("a"), floor_round("mom_12_1").alias("b"))
    ranks = rank_many(df, ["tk", "d"], [("mom_1m_rank", "a", ["d"], 2), ("mom_12_1_rank", "b", ["d"], 2)])
    return X.coverage(ranks, ("mom_1m_rank", "mom_12_1_rank"))
