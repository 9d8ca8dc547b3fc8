"""Market-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.asof import asof_join
from panelforge.functions.numeric import floor_round
from panelforge.functions.windows import MARKET
from panelforge.operators import macro as M
from panelforge.plans.oracle_views import r, view
from panelforge.plans.registry import query
from panelforge.sources import panel as P

view(
    "mac",
    """SELECT m.*, p.rate, fm.fii AS fii_m, fm.dii AS dii_m, fd.fii AS fii_d, fd.dii AS dii_d,
    CASE WHEN fd.fii IS NOT NULL THEN 'daily' WHEN fm.fii IS NOT NULL THEN 'monthly' END AS flow_flag
    FROM macro m ASOF LEFT JOIN policy p ON m.d >= p.d
    LEFT JOIN flow_m fm ON fm.y=year(m.d) AND fm.m=month(m.d) LEFT JOIN flow_d fd ON fd.d=m.d""",
    "macro", "policy", "flow_m", "flow_d",
)
view("mac_best", "SELECT *, CASE WHEN flow_flag='daily' THEN fii_d ELSE fii_m END AS flow_best FROM mac", "mac")


@query("macro_rescale", f"SELECT d, {r('ix50*0.01::DOUBLE')} AS ix50 FROM macro", ("macro",))
def macro_rescale(spark, sf):
    return P.macro(spark, sf).select("d", floor_round(M.rescale("ix50", 0.01)).alias("ix50"))


def macro_full(spark, sf):
    """Market series with policy rate and flows, one row per date."""
    base = M.attach_low_frequency(P.macro(spark, sf), P.policy(spark, sf), ["rate"])
    return M.with_flow_source(base, P.flow_monthly(spark, sf), P.flow_daily(spark, sf))


def pad(c: str) -> str:
    return f"last_value({c} IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def chg(c: str, n: int = 1) -> str:
    return f"{c}/nullif(lag({c},{n}) OVER (ORDER BY d),0)-1"


def zs(c: str, n: int = 252, k: int = 63) -> str:
    w = f"OVER (ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN count({c}) {w} >= {k} THEN ({c} - avg({c}) {w})/nullif(stddev_samp({c}) {w},0) END")


_SRC = ("ix50", "ix500", "fx", "vix", "crude", "gold")
view(
    "mkt",
    "SELECT d, " + ", ".join(f"{chg('p_' + c)} AS ret_{c}" for c in _SRC)
    + f", {chg('p_ix500', 21)} AS ix500_return_21d, {chg('p_ix500', 60)} AS ix500_return_60d, flow_best,"
    + f" {zs('flow_best')} AS ret_fii, {zs('dii_m')} AS ret_dii, rate - lag(rate) OVER (ORDER BY d) AS rate_change"
    + " FROM (SELECT *, " + ", ".join(f"{pad(c)} AS p_{c}" for c in _SRC) + " FROM mac_best)",
    "mac_best",
)
MKT_COLS = ("ret_ix50", "ret_ix500", "ret_fx", "ret_vix", "ret_crude", "ret_gold", "ix500_return_21d",
            "ix500_return_60d", "ret_fii", "ret_dii", "rate_change")


def market(spark, sf):
    return M.market_features(macro_full(spark, sf))


@query("macro_align_pivot", "SELECT d, ix50, vix, gold FROM macro WHERE coalesce(ix50,vix,gold) IS NOT NULL", ("macro",))
def macro_align_pivot(spark, sf):
    m = P.macro(spark, sf)
    long = m.select("d", F.explode(F.create_map(*[x for c in ("ix50", "vix", "gold") for x in (F.lit(c), F.col(c))])).alias("name", "value"))
    wide = M.align_series(long.where("value is not null"), ["ix50", "vix", "gold"])
    return M.drop_empty_rows(wide, ["ix50", "vix", "gold"])


@query(
    "macro_ffill_lowfreq",
    """SELECT m.d, f.fii AS fii_low FROM macro m ASOF LEFT JOIN
    (SELECT make_date(y,m,15) AS t, fii FROM flow_m) f ON m.d >= f.t""",
    ("macro", "flow_m"),
)
def macro_ffill_lowfreq(spark, sf):
    low = P.flow_monthly(spark, sf).select(F.make_date("y", "m", F.lit(15)).alias("t"), F.col("fii").alias("fii_low"))
    return M.attach_low_frequency(P.macro(spark, sf).select("d"), low, ["fii_low"], "t")


@query(
    "macro_yoy",
    f"""SELECT d, {r("(amt/nullif(lag(amt,12) OVER (ORDER BY d),0)-1)*100", 4)} AS yoy_pct FROM
    (SELECT CAST(date_trunc('month', d) AS DATE) AS d, CAST(sum(amt) AS DOUBLE) AS amt FROM ofacts GROUP BY 1)""",
    ("ofacts",),
)
def macro_yoy(spark, sf):
    m = P.order_facts(spark, sf).groupBy(F.trunc("d", "month").alias("d")).agg(P.total(F.col("amt")).alias("amt"))
    return m.select("d", floor_round(M.year_over_year("amt"), 4).alias("yoy_pct"))


@query("macro_step_series", "SELECT b.d, p.rate FROM (SELECT DISTINCT d FROM bars) b ASOF LEFT JOIN policy p ON b.d >= p.d", ("bars", "policy"))
def macro_step_series(spark, sf):
    return asof_join(P.bars(spark, sf).select("d").distinct(), P.policy(spark, sf), [], "d", "d", ["rate"], left_unique=True)


@query("flow_join", "SELECT y, m, fii AS net_fii, dii AS net_dii FROM flow_m", ("flow_m",))
def flow_join(spark, sf):
    f = P.flow_monthly(spark, sf)
    return M.join_flows(
        f.select("y", "m", F.col("fii").alias("net")), f.select("y", "m", F.col("dii").alias("net")), ["y", "m"], "net", ("_fii", "_dii")
    )


@query(
    "flow_expand_month",
    "SELECT b.d, f.fii, f.dii FROM (SELECT DISTINCT d FROM bars) b JOIN flow_m f ON f.y=year(b.d) AND f.m=month(b.d)",
    ("bars", "flow_m"),
)
def flow_expand_month(spark, sf):
    return M.expand_months(P.flow_monthly(spark, sf), P.bars(spark, sf))


@query("flow_best", "SELECT d, flow_flag, flow_best FROM mac_best", ("mac_best",))
def flow_best(spark, sf):
    return macro_full(spark, sf).select("d", "flow_flag", M.best_flow().alias("flow_best"))


@query("macro_rolling_z", f"SELECT d, {r(zs('flow_best'))} AS z FROM mac_best", ("mac_best",))
def macro_rolling_z(spark, sf):
    m = macro_full(spark, sf).select("d", M.best_flow().alias("flow_best"))
    return m.select("d", floor_round(MARKET.zscore("flow_best")).alias("z"))


@query("macro_returns", "SELECT d, " + ", ".join(f"{r(c)} AS {c}" for c in MKT_COLS) + " FROM mkt", ("mkt",))
def macro_returns(spark, sf):
    return market(spark, sf).select("d", *[floor_round(c).alias(c) for c in MKT_COLS])


@query("macro_diff", "SELECT d, rate, rate - lag(rate) OVER (ORDER BY d) AS rate_change FROM mac", ("mac",))
def macro_diff(spark, sf):
    base = M.attach_low_frequency(P.macro(spark, sf), P.policy(spark, sf), ["rate"])
    return base.select("d", "rate", MARKET.diff("rate").alias("rate_change"))


_AUDIT = ("fii_m", "fii_d", "dii_m", "dii_d", "rate", "vix")


@query(
    "dq_null_audit",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count({c}) AS filled, min(CASE WHEN {c} IS NOT NULL THEN d END) AS first_date,"
        f" max(CASE WHEN {c} IS NOT NULL THEN d END) AS last_date FROM mac" for c in _AUDIT
    ),
    ("mac",),
)
def dq_null_audit(spark, sf):
    return M.fill_audit(macro_full(spark, sf), _AUDIT)


@query(
    "dq_spot_check",
    """SELECT d, fii_m, fii_m IS NOT NULL AND fii_m < -60000 AS passed FROM mac
    WHERE year(d)=2000 AND month(d)=3 ORDER BY d LIMIT 1""",
    ("mac",),
)
def dq_spot_check(spark, sf):
    return M.month_below(macro_full(spark, sf), 2000, 3, "fii_m", -60000.0)


@query("macro_asof_row", "SELECT d, ix500, vix, rate FROM mac WHERE d <= DATE '2000-02-29' ORDER BY d DESC LIMIT 1", ("mac",))
def macro_asof_row(spark, sf):
    return M.row_at_or_before(macro_full(spark, sf), F.lit("2000-02-29").cast("date")).select("d", "ix500", "vix", "rate")


@query(
    "macro_first_nonnull",
    """SELECT d, coalesce(fii_d, fii_m, ix50) AS value, CASE WHEN fii_d IS NOT NULL THEN 'D' WHEN fii_m IS NOT NULL THEN 'M'
    WHEN ix50 IS NOT NULL THEN 'I' END AS label FROM mac""",
    ("mac",),
)
def macro_first_nonnull(spark, sf):
    value, label = M.first_present([("fii_d", "D"), ("fii_m", "M"), ("ix50", "I")])
    return macro_full(spark, sf).select("d", value.alias("value"), label.alias("label"))
