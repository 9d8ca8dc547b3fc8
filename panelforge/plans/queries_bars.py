"""Calendar, bar and corporate-action queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.numeric import floor_round
from panelforge.functions.windows import Axis
from panelforge.operators import bars as B
from panelforge.plans.oracle_views import r, view
from panelforge.plans.registry import query
from panelforge.sources import panel as P

TK = Axis(("tk",), "d")

view(
    "factors",
    "SELECT tk, d, 1.0::DOUBLE/product(ratio) OVER (PARTITION BY tk ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor FROM splits",
    "splits",
)
view(
    "adj",
    f"""SELECT b.*, {r("b.cl*coalesce(f.factor,1.0)", 4)} AS adj FROM bars b
  ASOF LEFT JOIN factors f ON b.tk=f.tk AND b.d < f.d""",
    "bars", "factors",
)


def adj(spark, sf):
    """Bars with adjusted close."""
    return B.adjust_close(P.bars(spark, sf), B.split_factors(P.splits(spark, sf)))


def _order_calendar(spark, sf):
    o = P.order_facts(spark, sf)
    bounds = o.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    holidays = P.bars(spark, sf).groupBy("d").agg(F.count_distinct("tk").alias("n")).where("n < 5").select("d")
    return B.trading_calendar(bounds, "a", "b", holidays)


view("cal", """SELECT d FROM (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM ofacts)
  WHERE isodow(d) < 6 AND d NOT IN (SELECT d FROM bars GROUP BY 1 HAVING count(DISTINCT tk) < 5)""", "ofacts", "bars")


@query("cal_trading_days", "SELECT d FROM cal", ("cal",))
def cal_trading_days(spark, sf):
    return _order_calendar(spark, sf)


@query(
    "feat_price_gap",
    """SELECT tk, d, CAST(CASE WHEN d - lag(d) OVER (PARTITION BY tk ORDER BY d) > 5 THEN 1 ELSE 0 END AS INT) AS price_gap_flag
    FROM bars""",
    ("bars",),
)
def feat_price_gap(spark, sf):
    return P.bars(spark, sf).select("tk", "d", B.price_gap_flag(TK).alias("price_gap_flag"))


@query(
    "bars_universe_semi",
    """SELECT p_brand AS tk, count(*) AS n_rows FROM lineitem JOIN part ON l_partkey=p_partkey
    WHERE l_returnflag='N' AND p_brand IN (SELECT tk FROM eligible) GROUP BY 1""",
    ("eligible",),
)
def bars_universe_semi(spark, sf):
    line = P.table(spark, sf, "lineitem").select("l_partkey", F.col("l_returnflag").alias("series"))
    kept = B.keep_series(line.join(P.part_brands(spark, sf), "l_partkey"), P.eligible(spark, sf), "N")
    return kept.groupBy("tk").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "bars_build",
    f"""SELECT tk, d, op, hi, lo, cl, vol, {r("(hi+lo+cl)/3", 4)} AS typical, {r("(hi+lo+cl)/3", 4)} AS vwap FROM bars""",
    ("bars",),
)
def bars_build(spark, sf):
    return B.build_bars(P.bars(spark, sf))


@query("ca_cum_factor", f"SELECT tk, d, {r('factor', 9)} AS factor FROM factors", ("factors",))
def ca_cum_factor(spark, sf):
    return B.split_factors(P.splits(spark, sf)).withColumn("factor", floor_round("factor", 9))


@query("ca_adj_close", "SELECT tk, d, cl, adj FROM adj", ("adj",))
def ca_adj_close(spark, sf):
    return adj(spark, sf).select("tk", "d", "cl", "adj")


view("divs", f"SELECT tk, period AS d, {r('net_income/1e6', 4)} AS amount FROM fund WHERE net_income IS NOT NULL", "fund")


def dividends(spark, sf):
    f = P.fund(spark, sf).where("net_income is not null")
    return f.select("tk", F.col("period").alias("d"), floor_round(F.col("net_income") / 1e6, 4).alias("amount"))


@query(
    "ca_unpivot_actions",
    f"""SELECT tk, d, 'split' AS action_type, {r("ratio")} AS ratio, CAST(NULL AS DOUBLE) AS amount FROM splits
    UNION ALL SELECT tk, d, 'dividend', NULL, {r("amount", 4)} FROM divs""",
    ("splits", "divs"),
)
def ca_unpivot_actions(spark, sf):
    return B.action_rows(P.splits(spark, sf), dividends(spark, sf))


@query(
    "dq_ingest_summary",
    f"""SELECT min(d) AS min_date, max(d) AS max_date, count(DISTINCT tk) AS tickers, count(*) AS total_rows,
    count(DISTINCT d) AS ingested_days, (SELECT count(*) FROM cal) AS expected_days,
    {r("count(DISTINCT d)*100.0::DOUBLE/(SELECT count(*) FROM cal)", 4)} AS coverage_pct FROM bars""",
    ("bars", "cal"),
)
def dq_ingest_summary(spark, sf):
    return B.ingest_summary(P.bars(spark, sf), _order_calendar(spark, sf))


@query(
    "dq_thin_keys",
    """SELECT l_suppkey, count(*) AS days FROM lineitem GROUP BY 1 HAVING count(*) < 580 ORDER BY days, l_suppkey LIMIT 15""",
)
def dq_thin_keys(spark, sf):
    return B.thin_keys(P.table(spark, sf, "lineitem").select("l_suppkey"), "l_suppkey", 580, 15)


@query(
    "dq_issues",
    """WITH s AS (SELECT max(d) AS m, count(DISTINCT tk) AS n FROM bars)
    SELECT 'stale' AS issue, CAST(DATE '2001-12-31' - m AS BIGINT) AS value FROM s WHERE DATE '2001-12-31' - m > 5
    UNION ALL SELECT 'few_tickers', CAST(n AS BIGINT) FROM s WHERE n < 450""",
    ("bars",),
)
def dq_issues(spark, sf):
    s = P.bars(spark, sf).agg(F.max("d").alias("max_date"), F.count_distinct("tk").alias("tickers"))
    return B.ingest_issues(s, F.lit("2001-12-31").cast("date"))


@query(
    "latest_per_key",
    """SELECT tk, d, cl, vol FROM (SELECT *, row_number() OVER (PARTITION BY tk ORDER BY d DESC) AS k FROM bars
    WHERE d <= DATE '2000-06-30') WHERE k=1""",
    ("bars",),
)
def latest_per_key(spark, sf):
    b = P.bars(spark, sf).select("tk", "d", "cl", "vol")
    return B.latest_per_key(b, ["tk"], "d", F.lit("2000-06-30").cast("date"))
