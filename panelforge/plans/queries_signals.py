"""Signal, calibration, sizing and book queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.numeric import floor_round
from panelforge.functions.recursive import grouped
from panelforge.functions.staging import published, staged
from panelforge.functions.windows import Axis
from panelforge.operators import features as E
from panelforge.operators import indicators as I
from panelforge.operators import signals as SG
from panelforge.operators import sizing as Z
from panelforge.plans.oracle_views import r, view
from panelforge.plans.queries_bars import adj
from panelforge.plans.queries_features import rank_sql, tiers3
from panelforge.plans.queries_indicators import recursive
from panelforge.plans.queries_quality import regimes_table as regimes
from panelforge.plans.registry import query
from panelforge.sources import panel as P

TK = Axis(("tk",), "d")

view(
    "scores",
    f"""SELECT tk, d, t.tier, s.sector, {r('return_21d')} AS s1, {r('-volatility_20d')} AS s2, {r('-price_to_52w_high')} AS s3,
    CASE WHEN price_to_52w_high IS NOT NULL THEN {r('volatility_20d/sqrt(252.0::DOUBLE)')} END AS vol
    FROM feat JOIN tier3 t USING (tk) JOIN sector s USING (tk) WHERE return_21d IS NOT NULL AND volatility_20d IS NOT NULL""",
    "feat", "tier3", "sector",
)
view("sranks", f"SELECT *, {rank_sql('s1', 'd', raw=True)} AS r1, {rank_sql('s2', 'd', raw=True)} AS r2, {rank_sql('s3', 'd', raw=True)} AS r3 FROM scores", "scores")
_CASE = ["CASE regime_int " + " ".join(f"WHEN {k} THEN {w[i]}::DOUBLE" for k, w in SG.WEIGHTS.items()) + " END" for i in range(3)]
view(
    "sblend",
    f"SELECT *, {_CASE[0]}*r1 + {_CASE[1]}*r2 + {_CASE[2]}*coalesce(r3, 0.5::DOUBLE) AS raw_score FROM (SELECT s.*, coalesce(g.regime_int, 3) AS regime_int FROM sranks s LEFT JOIN reg g USING (d))",
    "sranks", "reg",
)
view(
    "sover",
    f"""SELECT b.*, CASE WHEN tier=3 THEN 0.5::DOUBLE + (coalesce(l.lead, 0.5::DOUBLE)-0.5::DOUBLE)*1.0::DOUBLE ELSE 0.5::DOUBLE + (raw_score-0.5::DOUBLE)*1.0::DOUBLE END AS score
    FROM sblend b LEFT JOIN (SELECT d, sector, {r('avg(raw_score)', 9)} AS lead FROM sblend WHERE tier=1 GROUP BY 1,2) l USING (d, sector)""",
    "sblend",
)
view(
    "sig",
    f"""SELECT * EXCLUDE (vol), coalesce(vol, (SELECT median(vol) FROM scores)) AS vol,
    CAST(CASE WHEN final_rank <= 0.2 THEN CASE WHEN tier=3 THEN 0 ELSE -1 END WHEN final_rank >= 0.8 THEN 1 ELSE 0 END AS INT) AS signal FROM
    (SELECT *, {rank_sql('sc9', 'd', raw=True)} AS final_rank FROM (SELECT *, {r('score', 9)} AS sc9 FROM sover))""",
    "sover", "scores",
)


@published("scores")
def scores(spark, sf):
    b = adj(spark, sf).withColumn("log_return_1d", E.log_return(TK, "adj"))
    b = E.range_position(b, TK, "adj", "hi", "lo").withColumns(
        {**E.simple_returns(TK, "adj", (21,)), "volatility_20d": E.realised_vol(TK, "log_return_1d")}
    )
    b = b.join(tiers3(spark, sf), "tk").join(P.sector(spark, sf), "tk").where("return_21d is not null and volatility_20d is not null")
    top = F.col("price_to_52w_high")
    out = b.select(
        "tk", "d", "tier", "sector", floor_round("return_21d").alias("s1"), floor_round(-F.col("volatility_20d")).alias("s2"),
        floor_round(-top).alias("s3"), F.when(top.isNotNull(), floor_round(F.col("volatility_20d") / F.sqrt(F.lit(252.0)))).alias("vol"),
    )
    return out


def blended(spark, sf):
    return SG.blend(SG.model_ranks(scores(spark, sf)), regimes(spark, sf))


@published("signals")
def signals(spark, sf):
    """Final signals, written once: every report and book below reads them."""
    sc = scores(spark, sf)
    ranked = staged(SG.model_ranks(sc), "ranked")
    blend = staged(SG.shrink_by_tier(SG.blend(ranked, regimes(spark, sf))), "blend")
    return SG.fill_vol(SG.final_signal(SG.sector_override(blend)))


@query("sig_model_ranks", f"SELECT tk, d, {r('r1')} AS r1, {r('r2')} AS r2, {r('r3')} AS r3 FROM sranks", ("sranks",))
def sig_model_ranks(spark, sf):
    m = SG.model_ranks(scores(spark, sf))
    return m.select("tk", "d", *[floor_round(c).alias(c) for c in ("r1", "r2", "r3")])


@query("sig_missing_scores", "SELECT tk, d, s1, s2, s3, 0.0::DOUBLE AS s4 FROM scores", ("scores",))
def sig_missing_scores(spark, sf):
    return SG.add_missing_scores(scores(spark, sf), ("s1", "s2", "s3", "s4")).select("tk", "d", "s1", "s2", "s3", "s4")


@query("sig_blend", f"SELECT tk, d, regime_int, {r('raw_score')} AS raw_score FROM sblend", ("sblend",))
def sig_blend(spark, sf):
    return blended(spark, sf).select("tk", "d", "regime_int", floor_round("raw_score").alias("raw_score"))


@query(
    "sig_tier_shrink",
    f"SELECT tk, d, {r('0.5::DOUBLE + (raw_score-0.5::DOUBLE)*CASE tier WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END')} AS score FROM sblend",
    ("sblend",),
)
def sig_tier_shrink(spark, sf):
    return SG.shrink_by_tier(blended(spark, sf), {1: 1.0, 2: 0.8}).select("tk", "d", floor_round("score").alias("score"))


@query("sig_tier_c_override", f"SELECT tk, d, tier, {r('score')} AS score FROM sover", ("sover",))
def sig_tier_c_override(spark, sf):
    out = SG.sector_override(SG.shrink_by_tier(staged(blended(spark, sf), "blend")))
    return out.select("tk", "d", "tier", floor_round("score").alias("score"))


@query("sig_final", f"SELECT tk, d, {r('final_rank')} AS final_rank, signal FROM sig", ("sig",))
def sig_final(spark, sf):
    return signals(spark, sf).select("tk", "d", floor_round("final_rank").alias("final_rank"), "signal")


@query("sig_vol_fill", f"SELECT tk, d, {r('coalesce(vol, (SELECT median(vol) FROM scores))')} AS vol FROM scores", ("scores",))
def sig_vol_fill(spark, sf):
    return SG.fill_vol(scores(spark, sf)).select("tk", "d", floor_round("vol").alias("vol"))


view(
    "fwd",
    "SELECT tk, d, " + ", ".join(f"lead(adj,{n}) OVER (PARTITION BY tk ORDER BY d)/nullif(adj,0)-1 AS fwd_{n}" for n in (21, 63, 252)) + " FROM adj",
    "adj",
)
view(
    "calib",
    f"""SELECT bin, {', '.join(f"{r(f'avg(fwd_{n})')} AS mean_fwd_{n}" for n in (21, 63, 252))}, {r('quantile_cont(fwd_21, 0.05)')} AS p05_fwd_21,
    {r('quantile_cont(fwd_21, 0.95)')} AS p95_fwd_21, bin/10.0::DOUBLE AS rank_lo, (bin+1)/10.0::DOUBLE AS rank_hi, (bin+0.5::DOUBLE)/10.0::DOUBLE AS rank_mid FROM
    (SELECT *, CAST(least(floor(final_rank*10), 9) AS INT) AS bin FROM sig JOIN fwd USING (tk,d)) GROUP BY bin""",
    "sig", "fwd",
)


def outcomes(spark, sf, sig=None):
    f = adj(spark, sf).select("tk", "d", *[E.forward_return(TK, "adj", n).alias(f"fwd_{n}") for n in (21, 63, 252)])
    return (signals(spark, sf) if sig is None else sig).join(f, ["tk", "d"])


@query("sig_calibration_table", "SELECT * FROM calib", ("calib",))
def sig_calibration_table(spark, sf):
    return SG.calibration_table(staged(outcomes(spark, sf), "outcomes"))


@query(
    "sig_calibrate",
    f"""SELECT tk, d, {', '.join(SG.CALIBRATED)} FROM (SELECT s.tk, s.d, c.*,
    row_number() OVER (PARTITION BY s.tk, s.d ORDER BY CASE WHEN rank_lo <= final_rank AND final_rank <= rank_hi THEN 0 ELSE 1 END,
     CASE WHEN rank_lo <= final_rank AND final_rank <= rank_hi THEN rank_lo ELSE abs(rank_mid-final_rank) END) AS k
    FROM sig s CROSS JOIN calib c) WHERE k=1""",
    ("sig", "calib"),
)
def sig_calibrate(spark, sf):
    sig = signals(spark, sf)
    table = SG.calibration_table(staged(outcomes(spark, sf, sig), "outcomes"))
    return SG.calibrate(sig, table).select("tk", "d", *SG.CALIBRATED)


@query(
    "sig_rank_quantiles",
    "SELECT " + ", ".join(f"{r(f'quantile_cont(final_rank, {p})')} AS {n}" for n, p in (("min_rank", 0.0), ("p10", 0.1), ("p50", 0.5), ("p82", 0.82), ("max_rank", 1.0)))
    + f", count(*) FILTER (WHERE final_rank >= 0.85) AS n_above, {r('count(*) FILTER (WHERE final_rank >= 0.85)/CAST(count(*) AS DOUBLE)')} AS share_above, count(DISTINCT d) AS n_dates FROM sig",
    ("sig",),
)
def sig_rank_quantiles(spark, sf):
    return SG.rank_distribution(signals(spark, sf))


@query("sig_regime_breakdown", f"SELECT regime_int, count(*) AS n_rows, {_CASE[0]} AS w1, {_CASE[1]} AS w2, {_CASE[2]} AS w3 FROM sblend GROUP BY regime_int", ("sblend",))
def sig_regime_breakdown(spark, sf):
    return SG.regime_breakdown(blended(spark, sf))


@query(
    "rpt_signal_screen",
    f"""WITH s AS (SELECT * FROM sig WHERE d=(SELECT max(d) FROM sig) AND signal=1), n AS (SELECT p_brand AS tk, min(p_name) AS name FROM part GROUP BY 1),
    p AS (SELECT tk, cl, vol FROM (SELECT *, row_number() OVER (PARTITION BY tk ORDER BY d DESC) AS k FROM bars WHERE d <= DATE '2001-09-30') WHERE k=1)
    SELECT s.tk, n.name, s.sector, {r('final_rank')} AS final_rank, 'BUY' AS kind, p.cl, p.vol AS volume FROM s JOIN n USING (tk) LEFT JOIN p USING (tk)
    WHERE contains(upper(s.tk),'E') OR contains(upper(n.name),'E') OR contains(upper(s.sector),'E')""",
    ("sig", "bars"),
)
def rpt_signal_screen(spark, sf):
    names = P.table(spark, sf, "part").groupBy(F.col("p_brand").alias("tk")).agg(F.min("p_name").alias("name"))
    last = SG.on_last_date(signals(spark, sf))
    out = SG.screen(last.drop("vol"), names, P.bars(spark, sf), F.lit("2001-09-30").cast("date"), 1, "e")
    return out.withColumn("final_rank", floor_round("final_rank"))


@query(
    "rpt_sector_counts",
    "SELECT CASE signal WHEN 1 THEN 'BUY' ELSE 'SELL' END AS kind, sector, count(*) AS n FROM sig WHERE d=(SELECT max(d) FROM sig) AND signal<>0 GROUP BY 1,2",
    ("sig",),
)
def rpt_sector_counts(spark, sf):
    return SG.sector_counts(SG.on_last_date(signals(spark, sf)))


@query(
    "rpt_signal_kpis",
    """SELECT d, count(*) FILTER (WHERE signal=1) AS n_buy, count(*) FILTER (WHERE signal=-1) AS n_sell, count(*) FILTER (WHERE signal=0) AS n_hold,
    min(regime_int) AS regime_int FROM sig WHERE d=(SELECT max(d) FROM sig) GROUP BY d""",
    ("sig",),
)
def rpt_signal_kpis(spark, sf):
    return SG.signal_kpis(signals(spark, sf))


# ---- sizing --------------------------------------------------------------------------------------

view("cands", "SELECT *, CASE WHEN final_rank >= 0.82 THEN 'long' ELSE 'short' END AS direction FROM sig WHERE final_rank >= 0.82 OR final_rank <= 0.08", "sig")
view(
    "slots",
    """SELECT * EXCLUDE (nl, ns, pos), CAST(pos AS INT) AS pos FROM (
    SELECT *, row_number() OVER (PARTITION BY d, direction ORDER BY CASE WHEN direction='long' THEN -final_rank ELSE final_rank END, tk) AS pos,
    count(*) FILTER (WHERE direction='long') OVER (PARTITION BY d) AS nl, count(*) FILTER (WHERE direction='short') OVER (PARTITION BY d) AS ns FROM cands)
    WHERE pos <= CASE WHEN direction='short' THEN least(9, ns) ELSE greatest(least(45-least(9, ns), nl), least(5, nl)) END""",
    "cands",
)
view("atrp", "SELECT tk, d, greatest(coalesce(a.atr_14/nullif(j.adj,0), 0.02), 0.005) AS atr_pct, j.adj AS price FROM adj j JOIN ind_wild a USING (tk,d)", "adj", "ind_wild")
view(
    "pool",
    "SELECT s.*, a.atr_pct, a.price, CASE s.regime_int WHEN 0 THEN 0.97::DOUBLE WHEN 1 THEN 0.88 WHEN 2 THEN 0.90 ELSE 0.94 END AS deploy_cap FROM slots s JOIN atrp a USING (tk,d)",
    "slots", "atrp",
)


def with_price(spark, sf, df):
    """Attach price and ATR share to signal rows."""
    rec = grouped(adj(spark, sf).select("tk", "d", "hi", "lo", "cl", "adj"), TK, [I.atr_step()])
    rec = rec.select("tk", "d", F.col("adj").alias("price"), Z.atr_pct("atr_14", "adj").alias("atr_pct"))
    return df.join(rec, ["tk", "d"])


def pool(spark, sf):
    picked = Z.slots(Z.candidates(signals(spark, sf)))
    return with_price(spark, sf, picked).withColumn("deploy_cap", Z.deploy_cap(F.col("regime_int")))


@query("port_candidates", f"SELECT tk, d, direction, {r('final_rank')} AS final_rank FROM cands", ("cands",))
def port_candidates(spark, sf):
    return Z.candidates(signals(spark, sf)).select("tk", "d", "direction", floor_round("final_rank").alias("final_rank"))


@query("port_slots", "SELECT tk, d, direction, pos FROM slots", ("slots",))
def port_slots(spark, sf):
    return Z.slots(Z.candidates(signals(spark, sf))).select("tk", "d", "direction", "pos")


@query("port_atr_pct", f"SELECT tk, d, {r('atr_pct')} AS atr_pct FROM atrp", ("atrp",))
def port_atr_pct(spark, sf):
    return recursive(spark, sf).select("tk", "d", floor_round(Z.atr_pct("atr_14", "adj")).alias("atr_pct"))


_POOL = "OVER (PARTITION BY d, direction)"
view(
    "psize",
    f"""SELECT * FROM (SELECT *, CASE WHEN sum(s1z) {_POOL} > 0 THEN least(s1z*least(target/sum(s1z) {_POOL}, 1.0), cap) ELSE s1z END AS size FROM (
    SELECT *, least(w/sum(w) {_POOL}*target, cap) AS s1z FROM (
    SELECT *, 0.6::DOUBLE*inv + 0.4::DOUBLE*coalesce(conv/nullif(sum(conv) {_POOL},0)*count(*) {_POOL}, 0) AS w FROM (
    SELECT *, 1.0/greatest(0.5::DOUBLE*atr_pct + 0.5::DOUBLE*coalesce(vol, atr_pct), 0.005::DOUBLE) AS inv, greatest(least(CASE WHEN direction='long' THEN final_rank ELSE 1-final_rank END, 1.0), 0.0) AS conv,
    least(CASE WHEN direction='long' THEN 1.3::DOUBLE ELSE 0.1::DOUBLE END, deploy_cap) AS target,
    CASE WHEN direction='short' THEN 0.025::DOUBLE WHEN tier IN (2,3) THEN 0.05::DOUBLE ELSE 0.08::DOUBLE END AS cap FROM pool)))) WHERE size >= 0.005""",
    "pool",
)
view("proxy", "SELECT tk, d, greatest(coalesce(stddev_samp(return_1d) OVER (PARTITION BY tk ORDER BY d ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 0.02), 0.005) AS vol_proxy FROM feat", "feat")
view(
    "vsize",
    f"""SELECT * FROM (SELECT *, CASE WHEN sum(sz2) {_POOL} > 0 THEN least(sz2*least(target/sum(sz2) {_POOL}, 1.0), cap) ELSE sz2 END AS size FROM (
    SELECT *, least(s1z*greatest(least(0.15::DOUBLE/greatest(coalesce(vol, 0.15::DOUBLE/sqrt(252.0::DOUBLE))*sqrt(252.0::DOUBLE), 0.01::DOUBLE), 1.5), 0.5), cap) AS sz2 FROM (
    SELECT *, least(w/(sum(w) {_POOL}+1e-9)*target, cap) AS s1z FROM (
    SELECT *, 0.6::DOUBLE*inv + 0.4::DOUBLE*(conv/(sum(conv) {_POOL}+1e-9)*count(*) {_POOL}) AS w FROM (
    SELECT *, 1.0/greatest(vol_proxy, 0.005::DOUBLE) AS inv, greatest(least(CASE WHEN direction='long' THEN final_rank ELSE 1-final_rank END, 1.0), 0.0) AS conv,
    least(CASE WHEN direction='long' THEN greatest(dc-0.02::DOUBLE, 0) ELSE least(0.1::DOUBLE, dc*0.1::DOUBLE) END, dc) AS target,
    CASE WHEN direction='short' THEN 0.025::DOUBLE WHEN tier IN (2,3) THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END AS cap
    FROM (SELECT s.*, p.vol_proxy, CASE s.regime_int WHEN 0 THEN 0.99::DOUBLE WHEN 1 THEN 0.88 WHEN 2 THEN 0.90 ELSE 0.94 END AS dc FROM slots s JOIN proxy p USING (tk,d)))))))
    WHERE size >= 0.003""",
    "slots", "proxy",
)


@published("sized")
def sized(spark, sf):
    """Sized book per date, written once."""
    return Z.sizes(pool(spark, sf))


@query("port_sizes", f"SELECT tk, d, direction, {r('size')} AS size FROM psize", ("psize",))
def port_sizes(spark, sf):
    return Z.sizes(pool(spark, sf)).select("tk", "d", "direction", floor_round("size").alias("size"))


def proxy(spark, sf):
    b = adj(spark, sf).withColumn("return_1d", TK.pct_change("adj"))
    return b.select("tk", "d", Z.vol_proxy(TK, "return_1d").alias("vol_proxy"))


@query("port_vol_proxy", f"SELECT tk, d, {r('vol_proxy')} AS vol_proxy FROM proxy", ("proxy",))
def port_vol_proxy(spark, sf):
    return proxy(spark, sf).withColumn("vol_proxy", floor_round("vol_proxy"))


def vol_target_sized(spark, sf, sig=None):
    picked = Z.slots(Z.candidates(signals(spark, sf) if sig is None else sig)).join(proxy(spark, sf).withColumnRenamed("vol_proxy", "atr_pct"), ["tk", "d"])
    return Z.sizes_vol_target(picked.withColumn("deploy_cap", Z.deploy_cap(F.col("regime_int"), Z.DEPLOY_CAP_BACKTEST)))


@query("port_sizes_vol_target", f"SELECT tk, d, direction, {r('size')} AS size FROM vsize", ("vsize",))
def port_sizes_vol_target(spark, sf):
    return vol_target_sized(spark, sf).select("tk", "d", "direction", floor_round("size").alias("size"))


_BOOK = "OVER (PARTITION BY d, direction)"
view(
    "csize",
    f"""SELECT * EXCLUDE (size, t, p), CASE WHEN p/t > 0.3 THEN size*(0.3::DOUBLE*t)/p ELSE size END AS size FROM
    (SELECT *, sum(size) {_BOOK} AS t, sum(size) OVER (PARTITION BY d, direction, sector) AS p FROM psize)""",
    "psize",
)


# a share of exactly 0.3 may fall on either side of the limit in floating point, but scaling it then changes nothing
@query("port_sector_cap", f"SELECT tk, d, direction, {r('size')} AS size FROM csize", ("csize",))
def port_sector_cap(spark, sf):
    return Z.cap_sectors(sized(spark, sf)).select("tk", "d", "direction", floor_round("size").alias("size"))


@query(
    "port_deploy_cap",
    f"""SELECT d, CASE WHEN defence THEN {r('cap*(1-0.2::DOUBLE)')} ELSE {r('cap')} END AS deploy_cap FROM (SELECT d,
    CASE regime_int WHEN 0 THEN 0.97::DOUBLE WHEN 1 THEN 0.88 WHEN 2 THEN 0.90 ELSE 0.94 END AS cap,
    ix500/max(ix500) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 < -0.12 AS defence FROM macro JOIN reg USING (d))""",
    ("macro", "reg"),
)
def port_deploy_cap(spark, sf):
    from panelforge.functions.windows import MARKET, drawdown

    m = P.macro(spark, sf).select("d", "ix500").join(regimes(spark, sf).select("d", "regime_int"), "d")
    dd = drawdown(m, MARKET, "ix500")
    return dd.select("d", floor_round(Z.deploy_cap(F.col("regime_int"), in_defence=F.col("drawdown") < -0.12)).alias("deploy_cap"))


view(
    "bstats",
    """SELECT d, coalesce(sum(size) FILTER (WHERE direction='long'),0) AS gl, coalesce(sum(size) FILTER (WHERE direction='short'),0) AS gs,
    count(*) FILTER (WHERE direction='long') AS n_longs, count(*) FILTER (WHERE direction='short') AS n_shorts,
    count(DISTINCT CASE WHEN direction='long' THEN sector END) AS long_sectors FROM psize GROUP BY d""",
    "psize",
)


@query(
    "port_book_stats",
    f"""SELECT d, {r('gl')} AS gross_long, {r('gs')} AS gross_short, {r('gl-gs')} AS net, {r('gl+gs')} AS gross, {r('1-gl-gs')} AS cash,
    n_longs, n_shorts, long_sectors, n_longs+n_shorts AS n_total, n_longs+n_shorts < 25 AS below_min FROM bstats""",
    ("bstats",),
)
def port_book_stats(spark, sf):
    st = Z.book_stats(sized(spark, sf))
    return st.withColumns({c: floor_round(c) for c in ("gross_long", "gross_short", "net", "gross", "cash")})


@query("rpt_sector_nav", f"SELECT d, sector, {r('sum(size)')} AS nav_share, count(*) AS n FROM psize GROUP BY 1,2", ("psize",))
def rpt_sector_nav(spark, sf):
    return Z.sector_nav(sized(spark, sf)).withColumn("nav_share", floor_round("nav_share"))


@query(
    "rpt_holdings",
    f"SELECT tk, d, direction, round(size*1e7) AS alloc, CASE WHEN price > 0 THEN CAST(floor(round(size*1e7)/price) AS BIGINT) END AS quantity FROM psize",
    ("psize",),
)
def rpt_holdings(spark, sf):
    return Z.holdings(sized(spark, sf), 1e7).select("tk", "d", "direction", "alloc", "quantity")
