"""Technical-indicator queries (prices: adjusted close; ranges: raw bars)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.numeric import floor_round
from panelforge.functions.staging import staged
from panelforge.functions.windows import Axis
from panelforge.operators import indicators as I
from panelforge.plans.oracle_views import r, view
from panelforge.plans.queries_bars import adj
from panelforge.plans.registry import query
from panelforge.streaming import smoothers

TK = Axis(("tk",), "d")


def bars_vwap(spark, sf):
    b = adj(spark, sf)
    return b.withColumn("vwap", floor_round((F.col("hi") + F.col("lo") + F.col("cl")) / 3, 4))


def recursive(spark, sf):
    return I.with_recursive(adj(spark, sf).select("tk", "d", "hi", "lo", "cl", "adj"), TK, "adj")


def ma(fn: str, c: str, n: int, k: int | None = None) -> str:
    w = f"OVER (PARTITION BY tk ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {w} >= {n if k is None else k} THEN {fn}({c}) {w} END"


def mean_sql(c: str, n: int) -> str:
    """Mean of a four-decimal column from exact integer sums."""
    w = f"OVER (PARTITION BY tk ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {w} >= {n} THEN CAST(sum(CAST(round({c}*10000) AS BIGINT)) {w} AS DOUBLE)/{n * 10000}.0::DOUBLE END"


def ema_sql(c: str, span: int) -> str:
    a = f"(2.0::DOUBLE/{span + 1})"
    return f"list_reduce(list({c}) OVER hist, lambda a, v: a*(1-{a}) + v*{a})"


def wilder_sql(c: str, n: int = 14) -> str:
    lst = f"list({c}) FILTER (WHERE {c} IS NOT NULL) OVER hist"
    return (f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER hist >= {n} THEN list_reduce(list_prepend(list_avg(({lst})[1:{n}]),"
            f" ({lst})[{n + 1}:]), lambda a, v: a*({n - 1}.0::DOUBLE/{n}) + v/{n}.0::DOUBLE) END")


HIST = "WINDOW hist AS (PARTITION BY tk ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

view(
    "ind_w",
    f"""SELECT *, {ma('avg', 'stoch_k', 3)} AS stoch_d,
    sum(step) OVER (PARTITION BY tk ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv,
    bb_middle + 2*dev AS bb_upper, bb_middle - 2*dev AS bb_lower FROM (
    SELECT *, {mean_sql('adj', 20)} AS sma_20, {mean_sql('adj', 50)} AS sma_50, {mean_sql('adj', 200)} AS sma_200,
    {mean_sql('adj', 20)} AS bb_middle, {ma('stddev_pop', 'adj', 20)} AS dev,
    (cl - {ma('min', 'lo', 14)})*100/nullif({ma('max', 'hi', 14)} - {ma('min', 'lo', 14)},0) AS stoch_k,
    (adj-vwap)/nullif(vwap,0)*100 AS vwap_dev,
    coalesce(sign(cl - lag(cl) OVER (PARTITION BY tk ORDER BY d))*vol, 0)::DOUBLE AS step
    FROM (SELECT *, {r('(hi+lo+cl)/3', 4)} AS vwap FROM adj))""",
    "adj",
)
view(
    "ind_moves",
    """SELECT tk, d, adj, CASE WHEN pa IS NOT NULL THEN greatest(adj-pa,0) END AS up, CASE WHEN pa IS NOT NULL THEN greatest(pa-adj,0) END AS down,
    greatest(hi-lo, abs(hi-pc), abs(lo-pc)) AS tr, CASE WHEN pc IS NOT NULL THEN greatest(hi-lo, abs(hi-pc), abs(lo-pc)) END AS tr1,
    CASE WHEN ph IS NULL THEN NULL WHEN hi-ph > pl-lo AND hi-ph > 0 THEN hi-ph ELSE 0 END AS plus,
    CASE WHEN ph IS NULL THEN NULL WHEN pl-lo > hi-ph AND pl-lo > 0 THEN pl-lo ELSE 0 END AS minus FROM
    (SELECT *, lag(adj) OVER o AS pa, lag(cl) OVER o AS pc, lag(hi) OVER o AS ph, lag(lo) OVER o AS pl FROM adj
     WINDOW o AS (PARTITION BY tk ORDER BY d))""",
    "adj",
)
view("ind_ema", f"SELECT tk, d, {ema_sql('adj', 9)} AS ema_9, {ema_sql('adj', 21)} AS ema_21, {ema_sql('adj', 12)} - {ema_sql('adj', 26)} AS macd FROM adj {HIST}", "adj")
view("ind_macd", f"SELECT *, {ema_sql('macd', 9)} AS macd_signal FROM ind_ema {HIST}", "ind_ema")
view(
    "ind_wild",
    f"""SELECT tk, d, CASE WHEN wdn = 0 THEN 100.0 ELSE 100.0 - 100.0/(1.0 + wup/wdn) END AS rsi_14, atr_14, CASE WHEN dip+din <> 0 THEN abs(dip-din)/(dip+din)*100.0 END AS dx FROM
    (SELECT tk, d, wup, wdn, atr_14, wp/nullif(wt,0)*100.0 AS dip, wm/nullif(wt,0)*100.0 AS din FROM
     (SELECT tk, d, {wilder_sql('up')} AS wup, {wilder_sql('down')} AS wdn, {wilder_sql('tr')} AS atr_14, {wilder_sql('tr1')} AS wt,
      {wilder_sql('plus')} AS wp, {wilder_sql('minus')} AS wm FROM ind_moves {HIST}))""",
    "ind_moves",
)
view("ind_adx", f"SELECT *, {wilder_sql('dx')} AS adx_14 FROM ind_wild {HIST}", "ind_wild")
view(
    "ind",
    "SELECT w.*, e.ema_9, e.ema_21, e.macd, e.macd_signal, e.macd-e.macd_signal AS macd_hist, a.rsi_14, a.atr_14, a.adx_14"
    " FROM ind_w w JOIN ind_macd e USING (tk,d) JOIN ind_adx a USING (tk,d)",
    "ind_w", "ind_macd", "ind_adx",
)


def _pick(cols, src, digits=4):
    return "SELECT tk, d, " + ", ".join(f"{r(c, digits)} AS {c}" for c in cols) + f" FROM {src}"


def _out(df, cols, digits=4):
    return df.select("tk", "d", *[floor_round(c, digits).alias(c) for c in cols])


@query("ind_sma", _pick(("sma_20", "sma_50", "sma_200"), "ind_w"), ("ind_w",))
def ind_sma(spark, sf):
    return _out(I.smas(adj(spark, sf), TK, "adj"), ("sma_20", "sma_50", "sma_200"))


@query("ind_ema", _pick(("ema_9", "ema_21"), "ind_ema"), ("ind_ema",))
def ind_ema(spark, sf):
    return _out(recursive(spark, sf), ("ema_9", "ema_21"))


@query("ind_macd", "SELECT tk, d, " + ", ".join(f"{r(e, 4)} AS {n}" for e, n in (("macd", "macd"), ("macd_signal", "macd_signal"), ("macd-macd_signal", "macd_hist"))) + " FROM ind_macd", ("ind_macd",))
def ind_macd(spark, sf):
    return _out(recursive(spark, sf), ("macd", "macd_signal", "macd_hist"))


@query("ind_rsi", _pick(("rsi_14",), "ind_wild"), ("ind_wild",))
def ind_rsi(spark, sf):
    return _out(recursive(spark, sf), ("rsi_14",))


@query("ind_bollinger", _pick(("bb_upper", "bb_middle", "bb_lower"), "ind_w"), ("ind_w",))
def ind_bollinger(spark, sf):
    return _out(I.bollinger(adj(spark, sf), TK, "adj"), ("bb_upper", "bb_middle", "bb_lower"))


# five decimals: a mean of fourteen four-decimal ranges can end in exactly half a unit of the fourth
@query("ind_atr", _pick(("atr_14",), "ind_wild", 5), ("ind_wild",))
def ind_atr(spark, sf):
    return _out(recursive(spark, sf), ("atr_14",), 5)


@query("ind_stochastic", _pick(("stoch_k", "stoch_d"), "ind_w"), ("ind_w",))
def ind_stochastic(spark, sf):
    return _out(I.stochastic(adj(spark, sf), TK), ("stoch_k", "stoch_d"))


@query("ind_adx", _pick(("adx_14",), "ind_adx"), ("ind_adx",))
def ind_adx(spark, sf):
    return _out(recursive(spark, sf), ("adx_14",))


@query("ind_obv", _pick(("obv",), "ind_w"), ("ind_w",))
def ind_obv(spark, sf):
    return _out(I.on_balance_volume(adj(spark, sf), TK), ("obv",))


@query("ind_vwap_dev", _pick(("vwap_dev",), "ind_w"), ("ind_w",))
def ind_vwap_dev(spark, sf):
    return bars_vwap(spark, sf).select("tk", "d", floor_round(I.vwap_deviation("adj", "vwap"), 4).alias("vwap_dev"))


@query(
    "ind_warmup_filter",
    "SELECT tk, count(*) AS kept, min(d) AS first_date FROM (SELECT *, count(*) OVER (PARTITION BY tk) AS n FROM ind)"
    " WHERE n >= 30 AND sma_20 IS NOT NULL AND sma_50 IS NOT NULL AND sma_200 IS NOT NULL AND ema_9 IS NOT NULL"
    " AND ema_21 IS NOT NULL AND macd IS NOT NULL AND rsi_14 IS NOT NULL GROUP BY tk",
    ("ind",),
)
def ind_warmup_filter(spark, sf):
    kept = I.warmed_up(I.indicators(bars_vwap(spark, sf), TK, "adj"), TK)
    return kept.groupBy("tk").agg(F.count(F.lit(1)).alias("kept"), F.min("d").alias("first_date"))


#: Last dates of the daily loads of ``incremental_indicators``; the third holds the rest.
LOADS = ("1998-06-30", "2000-03-31")


@query(
    "incremental_indicators",
    "SELECT tk, d, " + ", ".join(f"{r(c, 3)} AS {c}" for c in ("ema_9", "ema_21", "macd", "macd_signal", "rsi_14", "atr_14", "adx_14")) + " FROM ind",
    ("ind",),
)
def incremental_indicators(spark, sf):
    """Three loads, each resumed from the state of the one before. One row in nine of the last weeks of a load comes late, with the next one."""
    rows = staged(adj(spark, sf).select("tk", "d", F.col("adj").alias("price"), "hi", "lo", "cl"), "rows")
    load = F.lit(len(LOADS))
    for i, end in reversed(list(enumerate(LOADS))):
        end = F.lit(end).cast("date")
        late = (F.col("d") > F.date_sub(end, 40)) & (F.pmod(F.xxhash64("tk", "d"), F.lit(9)) == 0)
        load = F.when((F.col("d") <= end) & ~late, i).otherwise(F.when(F.col("d") <= end, i + 1).otherwise(load))
    rows = staged(rows.withColumn("load", load), "loads")
    stored = None
    for i in range(len(LOADS) + 1):
        here, arrived = rows.where(F.col("load") <= i).drop("load"), rows.where(F.col("load") == i).select("tk", "d")
        if stored is None:
            stored = staged(smoothers.advanced(here, spark.createDataFrame([], f"tk string, state {smoothers.STATE_TYPE}"), TK), "indicators")
        else:
            changed = staged(smoothers.update(here, arrived, stored, staged(smoothers.latest(stored, TK), "states"), TK), "changed")
            stored = staged(smoothers.merged(stored, changed, TK), "indicators")
    return _out(stored, ("ema_9", "ema_21", "macd", "macd_signal", "rsi_14", "atr_14", "adx_14"), 3)
