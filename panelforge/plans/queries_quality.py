"""Data-quality and regime queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.numeric import floor_round
from panelforge.functions.staging import published, staged
from panelforge.operators import quality as Q
from panelforge.operators import regimes as R
from panelforge.plans.oracle_views import r, view
from panelforge.plans.queries_macro import market
from panelforge.plans.registry import query
from panelforge.sources import panel as P

# looser than the published thresholds, so that the test tables spread over the tiers
RULES = Q.TierRules(a=(5.0, 0.90, 0.1), b=(2.0, 0.80, 0.05), min_days=120, value_unit=1e6)


def he(x: str, n: int) -> str:
    """Half-even rounding."""
    return f"round_even({x}, {n})"


view(
    "dqc",
    f"""SELECT *, {he('days/252.0::DOUBLE', 2)} AS coverage_years, {he('least(1.0::DOUBLE, days/CAST(expected_days AS DOUBLE))', 4)} AS coverage_ratio FROM
    (SELECT tk, count(*) AS days, min(d) AS start_date, max(d) AS end_date,
     CAST(greatest(1, {he('(max(d)-min(d))*252/365.0::DOUBLE', 0)}) AS BIGINT) AS expected_days FROM bars GROUP BY tk)""",
    "bars",
)
view(
    "dqadv",
    f"""SELECT tk, {he('CAST(sum(CAST(round(cl*vol,4) AS DECIMAL(28,4))) AS DOUBLE)/count(*)/1e6', 4)} AS adv FROM
    (SELECT *, row_number() OVER (PARTITION BY tk ORDER BY d DESC) AS k FROM bars) WHERE k <= 90 GROUP BY tk""",
    "bars",
)
view(
    "dqt",
    """SELECT c.*, a.adv, CAST(c.tk IN (SELECT tk FROM eligible) AS INT) AS eligible,
    CASE WHEN days < 120 THEN 'X' WHEN coverage_years >= 5 AND coverage_ratio >= 0.9 AND adv >= 0.1 THEN 'A'
    WHEN coverage_years >= 2 AND coverage_ratio >= 0.8 AND adv >= 0.05 THEN 'B' ELSE 'C' END AS tier FROM dqc c JOIN dqadv a USING (tk)""",
    "dqc", "dqadv", "eligible",
)


def tiers(spark, sf):
    return Q.assess(P.bars(spark, sf), P.eligible(spark, sf), RULES)


@query("dq_coverage", f"SELECT tk, days, start_date, end_date, expected_days, coverage_years, coverage_ratio, {he('(1-coverage_ratio)*100', 2)} AS gap_pct FROM dqc", ("dqc",))
def dq_coverage(spark, sf):
    return Q.coverage(P.bars(spark, sf))


@query("dq_adv", "SELECT tk, adv FROM dqadv", ("dqadv",))
def dq_adv(spark, sf):
    return Q.average_daily_value(P.bars(spark, sf), unit=1e6)


@query("dq_tiers", "SELECT tk, days, coverage_years, coverage_ratio, adv, eligible, tier FROM dqt", ("dqt",))
def dq_tiers(spark, sf):
    return tiers(spark, sf).select("tk", "days", "coverage_years", "coverage_ratio", "adv", "eligible", "tier")


@query("dq_tier_counts", "SELECT tier, count(*) AS n_keys, CAST(sum(eligible) AS BIGINT) AS n_eligible FROM dqt GROUP BY tier", ("dqt",))
def dq_tier_counts(spark, sf):
    return Q.tier_counts(tiers(spark, sf))


@query("dq_tier_int", "SELECT tk, CAST(CASE tier WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END AS INT) AS tier FROM dqt WHERE tier <> 'X'", ("dqt",))
def dq_tier_int(spark, sf):
    return Q.tier_int(tiers(spark, sf).select("tk", "tier"))


@query("dq_missing_keys", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def dq_missing_keys(spark, sf):
    held = P.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return Q.missing_keys(P.table(spark, sf, "lineitem"), held, "l_suppkey")


@query("dq_export_summary", "SELECT tier, count(*) AS n_rows, count(DISTINCT tk) AS n_keys FROM bars JOIN dqt USING (tk) GROUP BY tier", ("bars", "dqt"))
def dq_export_summary(spark, sf):
    return Q.export_summary(P.bars(spark, sf).join(tiers(spark, sf).select("tk", "tier"), "tk"))


@query(
    "dq_table_counts",
    "SELECT 'lineitem' AS name, count(*) AS n_rows, count(*) >= 1 AS passed FROM lineitem UNION ALL SELECT 'orders', count(*), count(*) >= 1 FROM orders"
    " UNION ALL SELECT 'events', count(*), count(*) >= 1000000000 FROM events",
)
def dq_table_counts(spark, sf):
    return Q.table_counts({n: P.table(spark, sf, n) for n in ("lineitem", "orders", "events")}, {"events": 1_000_000_000})


@query(
    "dq_last_dates",
    "SELECT 'bars' AS name, max(CAST(l_shipdate AS DATE)) AS last_date FROM lineitem UNION ALL SELECT 'orders', max(CAST(o_orderdate AS DATE)) FROM orders"
    " UNION ALL SELECT 'events', max(CAST(ts AS DATE)) FROM events",
)
def dq_last_dates(spark, sf):
    src = {"bars": ("lineitem", "l_shipdate"), "orders": ("orders", "o_orderdate"), "events": ("events", "ts")}
    return Q.last_dates({n: (P.table(spark, sf, t).select(F.to_date(c).alias("x")), "x") for n, (t, c) in src.items()})


# ---- regimes -------------------------------------------------------------------------------------

view(
    "reg_feat",
    f"""SELECT d, ret_1, ret_5, vix, CASE WHEN n20 >= 15 THEN sd*sqrt(252.0::DOUBLE) END AS vol_20,
    CASE WHEN 1 - count(fz) OVER ()/CAST(count(*) OVER () AS DOUBLE) <= 0.2 THEN fz END AS flow_z FROM
    (SELECT d, ret_1, ret_5, vix, fz, stddev_samp(ret_1) OVER w AS sd, count(ret_1) OVER w AS n20 FROM
     (SELECT m.d, ln(ix500/lag(ix500) OVER (ORDER BY m.d)) AS ret_1, ln(ix500/lag(ix500,5) OVER (ORDER BY m.d)) AS ret_5,
      last_value(vix IGNORE NULLS) OVER (ORDER BY m.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vix,
      last_value(ret_fii IGNORE NULLS) OVER (ORDER BY m.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fz FROM macro m JOIN mkt k ON m.d=k.d)
     WINDOW w AS (ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
    "macro", "mkt",
)
view("reg_state", f"SELECT *, CAST(ntile(4) OVER (ORDER BY {r('vol_20')}, d) AS INT) AS state FROM reg_feat WHERE ret_1 IS NOT NULL AND ret_5 IS NOT NULL AND vix IS NOT NULL AND vol_20 IS NOT NULL", "reg_feat")
view("reg_stats", f"SELECT state, {r('avg(ret_1)')} AS mean_return, {r('avg(vix)')} AS mean_vix, {r('avg(vol_20)')} AS mean_vol, {r('avg(ret_5)')} AS mean_ret_5, count(ret_1) AS n FROM reg_state GROUP BY 1", "reg_state")
view(
    "reg_map",
    """SELECT state, label, CAST(CASE label WHEN 'Bull' THEN 0 WHEN 'Bear' THEN 1 WHEN 'HighVol' THEN 2 ELSE 3 END AS INT) AS regime_int FROM (
    SELECT state, CASE WHEN kb=1 THEN 'Bull' WHEN kr=1 THEN 'Bear' WHEN kh=1 THEN 'HighVol' ELSE 'Sideways' END AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY kb=1, kr=1 ORDER BY mean_vix DESC, state) AS kh FROM (
    SELECT *, row_number() OVER (PARTITION BY kb=1 ORDER BY -mean_return + 0.5::DOUBLE*(mean_vix-lo)/CASE WHEN hi>lo THEN hi-lo ELSE 1.0::DOUBLE END DESC, state) AS kr FROM (
    SELECT *, min(mean_vix) OVER (PARTITION BY kb=1) AS lo, max(mean_vix) OVER (PARTITION BY kb=1) AS hi FROM (
    SELECT *, row_number() OVER (ORDER BY mean_return DESC, state) AS kb FROM reg_stats)))))""",
    "reg_stats",
)
view("reg", "SELECT s.*, m.label, m.regime_int FROM reg_state s JOIN reg_map m USING (state)", "reg_state", "reg_map")


def states(spark, sf, mkt=None):
    """Raw states stand in for the output of a state model: quarters of the volatility order."""
    f = R.regime_features(market(spark, sf) if mkt is None else mkt).dropna(subset=["ret_1", "ret_5", "vix", "vol_20"])
    return f.withColumn("state", F.ntile(4).over(Window.orderBy(floor_round("vol_20"), "d")))


def regimes(spark, sf, mkt=None):
    s = staged(states(spark, sf, mkt), "states")
    return s.join(R.label_states(R.state_stats(s)), "state")


@query("regime_of_day", "SELECT d, coalesce(regime_int, 3) AS regime_int FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) LEFT JOIN reg USING (d)", ("reg",))
def regime_of_day(spark, sf):
    days = P.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return R.regime_of_day(regimes(spark, sf), days)


@published("regimes")
def regimes_table(spark, sf):
    return regimes(spark, sf)


@query("regime_features", "SELECT d, " + ", ".join(f"{r(c)} AS {c}" for c in ("ret_1", "ret_5", "vol_20", "vix", "flow_z")) + " FROM reg_feat", ("reg_feat",))
def regime_features(spark, sf):
    return R.regime_features(market(spark, sf)).select("d", *[floor_round(c).alias(c) for c in ("ret_1", "ret_5", "vol_20", "vix", "flow_z")])


@query("regime_state_stats", "SELECT * FROM reg_stats", ("reg_stats",))
def regime_state_stats(spark, sf):
    return R.state_stats(states(spark, sf))


@query("regime_labels", "SELECT * FROM reg_map", ("reg_map",))
def regime_labels(spark, sf):
    return R.label_states(R.state_stats(states(spark, sf)))


@query(
    "regime_segments",
    """SELECT CAST(segment AS BIGINT) AS segment, label, min(d) AS start_date, max(d) AS end_date, count(*) AS days FROM (
    SELECT d, label, sum(n) OVER (ORDER BY d) AS segment FROM (
    SELECT d, label, CASE WHEN lag(label) OVER (ORDER BY d) IS NOT DISTINCT FROM label THEN 0 ELSE 1 END AS n FROM reg)) GROUP BY 1,2""",
    ("reg",),
)
def regime_segments(spark, sf):
    return R.segments(regimes(spark, sf))


@query(
    "regime_transitions",
    f"""SELECT from_label, to_label, n, {r("n/CAST(sum(n) OVER (PARTITION BY from_label) AS DOUBLE)")} AS share FROM (
    SELECT label AS from_label, nxt AS to_label, count(*) AS n FROM (SELECT label, lead(label) OVER (ORDER BY d) AS nxt FROM reg) WHERE nxt IS NOT NULL GROUP BY 1,2)""",
    ("reg",),
)
def regime_transitions(spark, sf):
    return R.transitions(regimes(spark, sf))


@query(
    "regime_distribution",
    f"""SELECT label, count(*) AS days, {r('avg(ret_1)')} AS mean_return, {r('avg(vix)', 4)} AS mean_vix, {r('avg(vol_20)')} AS mean_vol,
    {r('count(*)/CAST((SELECT count(*) FROM reg) AS DOUBLE)')} AS share FROM reg GROUP BY label""",
    ("reg",),
)
def regime_distribution(spark, sf):
    return R.distribution(regimes(spark, sf))


view("regday", "SELECT b.d, coalesce(r.regime_int, 3) AS regime_int FROM (SELECT DISTINCT d FROM bars) b LEFT JOIN reg r USING (d)", "bars", "reg")


@query(
    "dq_yearly_nulls",
    f"""WITH j AS (SELECT year(b.d) AS year, r.regime_int AS value FROM bars b LEFT JOIN reg r USING (d)),
    y AS (SELECT year, count(*) AS year_rows, {he("count(*) FILTER (WHERE value IS NULL)*100.0::DOUBLE/count(*)", 2)} AS null_pct FROM j GROUP BY 1)
    SELECT CAST(year AS INT) AS year, value, count(*) AS n, year_rows, null_pct FROM j JOIN y USING (year) GROUP BY ALL""",
    ("bars", "reg"),
)
def dq_yearly_nulls(spark, sf):
    j = P.bars(spark, sf).select("d").join(regimes(spark, sf).select("d", "regime_int"), "d", "left")
    return Q.yearly_nulls(j, "regime_int")
