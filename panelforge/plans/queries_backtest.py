"""Rebalance, NAV and performance queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.numeric import floor_round, safe_ratio
from panelforge.functions.staging import published
from panelforge.functions.windows import Axis
from panelforge.operators import backtest as BT
from panelforge.plans.oracle_views import r, view
from panelforge.plans.queries_bars import adj
from panelforge.plans.queries_signals import signals
from panelforge.plans.registry import query
from panelforge.sources import panel as P

TK = Axis(("tk",), "d")
K = 5

view("dret", "SELECT tk, d, CASE WHEN x > 0.5 THEN 0.5::DOUBLE WHEN x < -0.5 THEN -0.5::DOUBLE ELSE x END AS ret FROM (SELECT tk, d, adj/nullif(lag(adj) OVER (PARTITION BY tk ORDER BY d),0)-1 AS x FROM adj)", "adj")
view("dts", "SELECT DISTINCT d FROM bars", "bars")
view("nxt", "SELECT a.d, b.d AS n FROM dts a ASOF JOIN dts b ON a.d + 14 <= b.d", "dts")
view("reb", "SELECT min(d) AS d FROM dts UNION ALL SELECT n FROM reb JOIN nxt USING (d)", "dts", "nxt")
view("sdate", "SELECT r.d, s.d AS signal_d FROM reb r ASOF LEFT JOIN (SELECT DISTINCT d FROM sig) s ON r.d > s.d", "reb", "sig")
view(
    "topk",
    f"""SELECT tk, d, CAST(pos AS INT) AS pos, n_above, CASE WHEN n_above >= 3 THEN 'above' ELSE 'top' END AS reason FROM (
    SELECT *, row_number() OVER (PARTITION BY d ORDER BY final_rank DESC, tk) AS pos, count(*) OVER (PARTITION BY d) AS n,
    count(*) FILTER (WHERE final_rank >= 0.85) OVER (PARTITION BY d) AS n_above FROM sig) WHERE pos <= {K}
    AND CASE WHEN n_above >= 3 THEN final_rank >= 0.85 ELSE n >= 3 END""",
    "sig",
)
view(
    "wts",
    "SELECT q.d, q.end_d, t.tk, 1.0::DOUBLE/count(*) OVER (PARTITION BY q.d) AS w, t.reason, t.n_above FROM (SELECT *, lead(d) OVER (ORDER BY d) AS end_d FROM sdate) q JOIN topk t ON t.d=q.signal_d",
    "sdate", "topk",
)


def returns(spark, sf):
    return adj(spark, sf).select("tk", "d", BT.clipped_returns(TK, "adj").alias("ret"))


def trading_dates(spark, sf):
    return P.bars(spark, sf).select("d").distinct()


@published("rebalances")
def rebalances(spark, sf):
    reb = BT.rebalance_dates(trading_dates(spark, sf))
    out = BT.signal_date_before(reb, signals(spark, sf))
    return out.withColumn("end_d", F.lead("d").over(Window.orderBy("d")))


@published("weights")
def weights(spark, sf):
    picks = BT.top_k(signals(spark, sf), K).select(F.col("d").alias("signal_d"), "tk", "reason", "n_above")
    w = rebalances(spark, sf).join(picks, "signal_d")
    return w.withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("d"))).select("d", "end_d", "tk", "w", "reason", "n_above")


@published("nav")
def nav(spark, sf):
    return BT.nav_series(weights(spark, sf), returns(spark, sf))


@query("bt_clipped_returns", f"SELECT tk, d, {r('ret')} AS ret FROM dret", ("dret",))
def bt_clipped_returns(spark, sf):
    return returns(spark, sf).withColumn("ret", floor_round("ret"))


@query("bt_rebalance_dates", "SELECT d FROM reb", ("reb",))
def bt_rebalance_dates(spark, sf):
    return BT.rebalance_dates(trading_dates(spark, sf))


@query("bt_signal_asof", "SELECT d, signal_d FROM sdate", ("sdate",))
def bt_signal_asof(spark, sf):
    return rebalances(spark, sf).select("d", "signal_d")


@query("bt_topk_fallback", "SELECT tk, d, pos, reason FROM topk", ("topk",))
def bt_topk_fallback(spark, sf):
    return BT.top_k(signals(spark, sf), K).select("tk", "d", "pos", "reason")


@query(
    "bt_short_pick",
    """SELECT tk, d, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY final_rank, tk) AS pos FROM sig WHERE regime_int IN (1,2) AND final_rank <= 0.1)
    WHERE pos <= 6 AND tk IN (SELECT tk FROM eligible)""",
    ("sig", "eligible"),
)
def bt_short_pick(spark, sf):
    return BT.short_picks(signals(spark, sf), P.eligible(spark, sf), at=0.1).select("tk", "d", "pos")


view(
    "paths",
    """SELECT *, stop_d IS NULL OR d < stop_d AS is_open FROM (SELECT *, min(CASE WHEN dd <= -0.12 AND d > entry_d THEN d END) OVER (PARTITION BY hid) AS stop_d FROM (
    SELECT *, value/high_water - 1 AS dd FROM (SELECT *, greatest(max(value) OVER h, alloc) AS high_water FROM (
    SELECT *, alloc*(1 + sum(CASE WHEN d > entry_d THEN coalesce(ret,0) ELSE 0 END) OVER (PARTITION BY hid ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS value FROM (
    SELECT x.tk, x.d, x.ret, w.d AS entry_d, w.end_d, w.w*1e6 AS alloc, w.tk || ' ' || CAST(w.d AS VARCHAR) AS hid FROM dret x ASOF JOIN wts w ON x.tk=w.tk AND x.d >= w.d) WHERE end_d IS NULL OR d < end_d)
    WINDOW h AS (PARTITION BY hid ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))))""",
    "dret", "wts",
)


def paths(spark, sf):
    h = weights(spark, sf).select(
        F.concat_ws(" ", "tk", F.col("d").cast("string")).alias("hid"), "tk", F.col("d").alias("entry_d"), F.col("end_d").alias("exit_d"), (F.col("w") * 1e6).alias("alloc")
    )
    return BT.holding_paths(h, returns(spark, sf))


@query("bt_trailing_stop", f"SELECT hid, d, {r('value', 2)} AS value, {r('high_water', 2)} AS high_water, stop_d FROM paths", ("paths",))
def bt_trailing_stop(spark, sf):
    return paths(spark, sf).select("hid", "d", floor_round("value", 2).alias("value"), floor_round("high_water", 2).alias("high_water"), "stop_d")


@query("bt_worst_position_dd", f"SELECT d, {r('min(dd)')} AS worst_dd FROM paths WHERE is_open GROUP BY d", ("paths",))
def bt_worst_position_dd(spark, sf):
    return BT.worst_open_drawdown(paths(spark, sf)).withColumn("worst_dd", floor_round("worst_dd"))


view(
    "navraw",
    """WITH g AS (SELECT day, sum(w*coalesce(ret,0)) AS gross FROM (SELECT x.tk, x.d AS day, x.ret, s.d AS set_d FROM dret x ASOF JOIN (SELECT DISTINCT d FROM wts) s ON x.d > s.d) q
      JOIN wts w ON w.d=q.set_d AND w.tk=q.tk GROUP BY day),
    m AS (SELECT *, lag(end_d) OVER o AS le, lag(w) OVER o AS lw, lead(d) OVER o AS nd FROM wts WINDOW o AS (PARTITION BY tk ORDER BY d)),
    t AS (SELECT day, sum(t) AS turnover FROM (SELECT d AS day, abs(w - CASE WHEN le=d THEN lw ELSE 0 END) AS t FROM m UNION ALL SELECT end_d, CASE WHEN nd=end_d THEN 0 ELSE w END FROM m) WHERE day IS NOT NULL GROUP BY day)
    SELECT day AS d, coalesce(gross,0) - coalesce(turnover,0)*19.5::DOUBLE/10000 AS ret FROM g FULL JOIN t USING (day)""",
    "dret", "wts",
)
view(
    "nav",
    """SELECT d, ret, CASE WHEN min(ret) OVER w > -1 THEN exp(sum(CASE WHEN ret > -1 THEN ln(1+ret) ELSE 0 END) OVER w) ELSE 0 END AS nav FROM navraw
    WINDOW w AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "navraw",
)


@query("bt_nav", f"SELECT d, {r('ret')} AS ret, {r('nav', 4)} AS nav, {r('CASE WHEN nav > 0 THEN ln(nav) END')} AS log_nav FROM nav", ("nav",))
def bt_nav(spark, sf):
    line = nav(spark, sf).withColumn("log_nav", F.when(F.col("nav") > 0, F.ln("nav")))
    return line.select("d", floor_round("ret").alias("ret"), floor_round("nav", 4).alias("nav"), floor_round("log_nav").alias("log_nav"))


view("navdd", "SELECT *, nav/max(nav) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)-1 AS dd, nav/lag(nav) OVER (ORDER BY d)-1 AS rr FROM nav", "nav")
view("posdd", "SELECT d, sum(value)/nullif(sum(high_water),0) - 1 AS true_dd FROM paths WHERE is_open GROUP BY d", "paths")
_M = ("total_return", "cagr", "vol_ann", "max_dd", "true_max_dd", "win_rate", "sharpe", "calmar", "true_calmar")


@query(
    "perf_metrics",
    f"""SELECT start_date, end_date, days, {', '.join(f'{r(c, 5)} AS {c}' for c in _M)} FROM (SELECT *, CASE WHEN vol_ann > 0 THEN (cagr-0.065::DOUBLE)/vol_ann ELSE 0 END AS sharpe,
    CASE WHEN max_dd <> 0 THEN cagr/abs(max_dd) ELSE 0 END AS calmar, CASE WHEN true_max_dd IS NULL OR true_max_dd <> 0 THEN cagr/abs(true_max_dd) ELSE 0 END AS true_calmar FROM (SELECT *, pow(1+total_return, 1/greatest(days/252.0::DOUBLE, 0.001)) - 1 AS cagr FROM (
    SELECT min(d) AS start_date, max(d) AS end_date, count(rr) AS days, arg_max(nav, d)/arg_min(nav, d)-1 AS total_return, stddev_samp(rr)*sqrt(252.0::DOUBLE) AS vol_ann,
    min(dd) AS max_dd, min(true_dd) AS true_max_dd, count(*) FILTER (WHERE rr > 1e-12)/CAST(count(rr) AS DOUBLE) AS win_rate FROM navdd LEFT JOIN posdd USING (d))))""",
    ("navdd", "posdd"),
)
def perf_metrics(spark, sf):
    m = BT.metrics(nav(spark, sf).join(BT.position_drawdown(paths(spark, sf)), "d", "left"))
    return m.select("start_date", "end_date", "days", *[floor_round(c, 5).alias(c) for c in _M])


@query("perf_drawdown", f"SELECT d, {r('dd')} AS drawdown FROM navdd", ("navdd",))
def perf_drawdown(spark, sf):
    return BT.drawdown_series(nav(spark, sf)).select("d", floor_round("drawdown").alias("drawdown"))


@query("perf_yearly", f"SELECT CAST(year(d) AS INT) AS year, count(*) AS days, {r('arg_max(nav,d)/arg_min(nav,d)-1', 5)} AS ret FROM nav GROUP BY 1 HAVING count(*) >= 2", ("nav",))
def perf_yearly(spark, sf):
    return BT.yearly_returns(nav(spark, sf)).withColumn("ret", floor_round("ret", 5))


@query(
    "perf_benchmark",
    f"""SELECT 'ix50' AS name, {r('arg_max(v,d)/arg_min(v,d)-1')} AS total_return, {r('min(dd)')} AS max_dd FROM (SELECT d, ix50 AS v, ix50/max(ix50) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)-1 AS dd
    FROM macro WHERE d BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' AND ix50 IS NOT NULL)""",
    ("macro",),
)
def perf_benchmark(spark, sf):
    m = P.macro(spark, sf).withColumn("none", F.lit(None).cast("double"))
    b = BT.benchmark(m, F.lit("1998-01-01").cast("date"), F.lit("2000-12-31").cast("date"), ["none", "ix50", "ix500"])
    return b.select("name", floor_round("total_return").alias("total_return"), floor_round("max_dd").alias("max_dd"))


@query(
    "perf_index100",
    f"""SELECT n.d, {r('n.nav/(SELECT arg_min(nav,d) FROM nav)*100', 4)} AS portfolio_idx, {r('m.ix500/(SELECT arg_min(ix500,d) FROM macro WHERE ix500 IS NOT NULL)*100', 4)} AS bench_idx FROM nav n LEFT JOIN macro m USING (d)""",
    ("nav", "macro"),
)
def perf_index100(spark, sf):
    i = BT.index_100(nav(spark, sf), P.macro(spark, sf).select("d", F.col("ix500").alias("bench")))
    return i.select("d", floor_round("portfolio_idx", 4).alias("portfolio_idx"), floor_round("bench_idx", 4).alias("bench_idx"))


@query(
    "perf_rolling_sharpe",
    f"SELECT d, {r('CASE WHEN count(rr) OVER w >= 63 THEN avg(rr) OVER w/nullif(stddev_samp(rr) OVER w,0)*sqrt(252.0::DOUBLE) END', 5)} AS sharpe FROM navdd WINDOW w AS (ORDER BY d ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)",
    ("navdd",),
)
def perf_rolling_sharpe(spark, sf):
    return BT.rolling_sharpe(nav(spark, sf)).withColumn("sharpe", floor_round("sharpe", 5))


@query(
    "perf_mc_drawdown",
    f"""SELECT {', '.join(f"{r(f'quantile_cont(dd, {p})')} AS {n}" for n, p in (("p05", 0.05), ("median", 0.5), ("p95", 0.95)))},
    {r('count(*) FILTER (WHERE dd <= (SELECT min(dd) FROM navdd))*100.0::DOUBLE/count(*)')} AS real_percentile FROM (SELECT sim, min(nav/top-1) AS dd FROM (
    SELECT sim, o, nav, max(nav) OVER (PARTITION BY sim ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM (
    SELECT sim, o, exp(sum(ln(1+rr)) OVER (PARTITION BY sim ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS nav FROM (
    SELECT rr, sim, md5(CAST(d AS VARCHAR) || '|' || sim || '|42') AS o FROM navdd, range(1000) t(sim) WHERE rr IS NOT NULL))) GROUP BY sim)""",
    ("navdd",),
)
def perf_mc_drawdown(spark, sf):
    m = BT.monte_carlo(nav(spark, sf).select("d", "nav"), 1000)
    return m.select(*[floor_round(c).alias(c) for c in m.columns])


GRID = [{"buy": b, "k": k, "inv_vol": v} for b in (0.82, 0.83, 0.85, 0.87) for k in (15, 20, 25, 35) for v in (0.5, 0.6, 0.7)]
_SETS = ", ".join(f"({i}, {g['buy']}::DOUBLE, {g['k']}, {g['inv_vol']}::DOUBLE)" for i, g in enumerate(GRID))


@query(
    "bt_param_grid",
    f"""WITH grid(param_id, buy, k, inv_vol) AS (VALUES {_SETS}),
    best AS (SELECT q.d, q.end_d, s.tk, s.final_rank, 1/greatest(s.vol, 0.005::DOUBLE) AS inv, row_number() OVER (PARTITION BY q.d ORDER BY s.final_rank DESC, s.tk) AS pos
      FROM (SELECT *, lead(d) OVER (ORDER BY d) AS end_d FROM sdate) q JOIN sig s ON s.d=q.signal_d),
    kept AS (SELECT * FROM (SELECT g.*, b.*, count(*) FILTER (WHERE final_rank >= buy) OVER (PARTITION BY param_id, b.d) AS above FROM best b, grid g WHERE pos <= k) WHERE above < 3 OR final_rank >= buy),
    w AS (SELECT param_id, d, end_d, tk, inv_vol*inv/sum(inv) OVER p + (1-inv_vol)*final_rank/sum(final_rank) OVER p AS w FROM kept WINDOW p AS (PARTITION BY param_id, d)),
    g AS (SELECT param_id, day, sum(w*coalesce(ret,0)) AS gross FROM (SELECT x.tk, x.d AS day, x.ret, s.d AS set_d FROM dret x ASOF JOIN (SELECT DISTINCT d FROM w) s ON x.d > s.d) q
      JOIN w ON w.d=q.set_d AND w.tk=q.tk GROUP BY 1, 2),
    m AS (SELECT *, lag(end_d) OVER o AS le, lag(w) OVER o AS lw, lead(d) OVER o AS nd FROM w WINDOW o AS (PARTITION BY param_id, tk ORDER BY d)),
    t AS (SELECT param_id, day, sum(t) AS turnover FROM (SELECT param_id, d AS day, abs(w - CASE WHEN le=d THEN lw ELSE 0 END) AS t FROM m
      UNION ALL SELECT param_id, end_d, CASE WHEN nd=end_d THEN 0 ELSE w END FROM m) WHERE day IS NOT NULL GROUP BY 1, 2),
    n AS (SELECT param_id, day AS d, exp(sum(ln(1+coalesce(gross,0) - coalesce(turnover,0)*19.5::DOUBLE/10000)) OVER (PARTITION BY param_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS nav
      FROM g FULL JOIN t USING (param_id, day)),
    e AS (SELECT param_id, pow(arg_max(nav, d)/arg_min(nav, d), 1/greatest(count(rr)/252.0::DOUBLE, 0.001)) - 1 AS cagr, stddev_samp(rr)*sqrt(252.0::DOUBLE) AS vol
      FROM (SELECT *, nav/lag(nav) OVER (PARTITION BY param_id ORDER BY d) - 1 AS rr FROM n) GROUP BY 1)
    SELECT CAST(param_id AS INT) AS param_id, buy, CAST(k AS INT) AS k, inv_vol, {r('cagr', 5)} AS cagr, {r('CASE WHEN vol > 0 THEN (cagr-0.065::DOUBLE)/vol ELSE 0 END', 5)} AS sharpe FROM e JOIN grid USING (param_id)""",
    ("sdate", "sig", "dret"),
)
def bt_param_grid(spark, sf):
    """All parameter sets in one job: the order of names does not depend on a set, so rows repeat only after the largest top-k."""
    reb = rebalances(spark, sf).select("d", "end_d", "signal_d")
    s = signals(spark, sf).select(F.col("d").alias("signal_d"), "tk", "final_rank", "vol").join(reb, "signal_d")
    first = Window.partitionBy("d").orderBy(F.desc("final_rank"), "tk")
    best = s.withColumn("pos", F.row_number().over(first)).where(F.col("pos") <= max(g["k"] for g in GRID))
    pool = Window.partitionBy("param_id", "d")
    g = BT.with_grid(best, GRID).where("pos <= k")
    g = g.withColumn("_a", F.count_if(F.col("final_rank") >= F.col("buy")).over(pool)).where((F.col("_a") < 3) | (F.col("final_rank") >= F.col("buy")))
    inv = 1.0 / F.greatest(F.col("vol"), F.lit(0.005))
    share = safe_ratio(inv, F.sum(inv).over(pool))
    g = g.withColumn("_w", F.col("inv_vol") * share + (1 - F.col("inv_vol")) * F.coalesce(safe_ratio("final_rank", F.sum("final_rank").over(pool)), F.lit(0.0)))
    w = g.select("param_id", "d", "end_d", "tk", F.col("_w").alias("w"))
    m = BT.metrics(BT.nav_series(w, returns(spark, sf), ["param_id"]), ["param_id"])
    sets = BT.with_grid(spark.range(1).select("id"), GRID).drop("id")
    return sets.join(m.select("param_id", floor_round("cagr", 5).alias("cagr"), floor_round("sharpe", 5).alias("sharpe")), "param_id")


@query(
    "dq_date_overlap",
    """SELECT (SELECT count(DISTINCT d) FROM sig) AS n_a, (SELECT count(*) FROM dts) AS n_b, (SELECT count(*) FROM dts WHERE d IN (SELECT d FROM sig)) AS n_both, (SELECT count(*) FROM (SELECT d FROM paths GROUP BY d HAVING count(*) > 1)) AS n_duplicates""",
    ("sig", "dts", "paths"),
)
def dq_date_overlap(spark, sf):
    return BT.date_overlap(signals(spark, sf), P.bars(spark, sf), paths(spark, sf))


@query(
    "dq_return_summary",
    f"SELECT count(ret) AS n_returns, count(*) AS n_rows, count(DISTINCT tk) AS tickers, min(d) AS first_date, max(d) AS last_date, {r('avg(ret)')} AS mean_ret, {r('stddev_samp(ret)')} AS std_ret FROM dret",
    ("dret",),
)
def dq_return_summary(spark, sf):
    s = BT.return_summary(returns(spark, sf))
    return s.withColumns({"mean_ret": floor_round("mean_ret"), "std_ret": floor_round("std_ret")})


@query(
    "out_pivot",
    f"SELECT d, {', '.join(f'{r(chr(109) + f"ax(CASE WHEN tk={chr(39)}Brand#{i}{chr(39)} THEN ret END)")} AS b{i}' for i in range(1, 26))} FROM dret GROUP BY d",
    ("dret",),
)
def out_pivot(spark, sf):
    w = BT.wide(returns(spark, sf).withColumn("ret", floor_round("ret")), "ret")
    return w.select("d", *[F.col(f"`{n}`").alias(n.replace("Brand#", "b")) for n in w.columns if n != "d"])


@query(
    "bt_rebalance_summary",
    f"""SELECT reason, count(*) AS rebalances, {r('avg(n)', 4)} AS mean_names, {r('avg(a)', 4)} AS mean_above FROM (SELECT d, reason, count(*) AS n, max(n_above) AS a FROM wts GROUP BY 1,2) GROUP BY reason""",
    ("wts",),
)
def bt_rebalance_summary(spark, sf):
    s = BT.rebalance_summary(weights(spark, sf))
    return s.withColumns({"mean_names": floor_round("mean_names", 4), "mean_above": floor_round("mean_above", 4)})
