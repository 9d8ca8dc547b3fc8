"""Ledger, realised results and capital report queries on the monthly books."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import numeric as N
from panelforge.functions.numeric import floor_round
from panelforge.functions.staging import published
from panelforge.operators import ledger as LG
from panelforge.plans.oracle_views import r, view
from panelforge.plans.queries_bars import adj
from panelforge.plans.queries_risk import book_dates, positions
from panelforge.plans.queries_signals import signals
from panelforge.plans.registry import query
from panelforge.sources import panel as P

MAXPOS = 5

view(
    "lbook",
    f"""SELECT pid, tk, direction, sector, is_midcap, size, d AS entry_date, t, entry_price, current_price, CAST(floor(round(size*1e7)/entry_price) AS BIGINT) AS shares,
    {r("entry_price*CASE WHEN direction='long' THEN 0.85::DOUBLE ELSE 1.1::DOUBLE END", 4)} AS stop_price FROM posn""",
    "posn",
)
view("lprop", "SELECT b.pid, p.tk, p.direction, p.d, p.size, round(p.size*1e7) AS alloc, p.entry_price AS price, p.is_midcap FROM pos p JOIN bookd b ON p.pid=b.next_pid", "pos", "bookd")


def book(spark, sf):
    p = positions(spark, sf)
    return p.select(
        "pid", "tk", "direction", "sector", "is_midcap", "size", F.col("d").alias("entry_date"), "t", "entry_price", "current_price",
        F.floor(F.round(F.col("size") * 1e7) / F.col("entry_price")).alias("shares"),
        floor_round(F.col("entry_price") * F.when(F.col("direction") == "long", 0.85).otherwise(1.1), 4).alias("stop_price"), F.lit("open").alias("status"),
    )


def proposed(spark, sf):
    nxt = book_dates(spark, sf).select(F.col("pid").alias("book"), F.col("next_pid").alias("pid"))
    return positions(spark, sf).join(nxt, "pid").select(
        F.col("book").alias("pid"), "tk", "direction", "d", "size", F.round(F.col("size") * 1e7).alias("alloc"), F.col("entry_price").alias("price"), "is_midcap"
    )


@query(
    "led_mark_to_market",
    """SELECT b.pid, b.tk, coalesce(l.adj, b.entry_price) AS current_price FROM lbook b LEFT JOIN (SELECT tk, arg_max(adj, d) AS adj FROM adj GROUP BY tk) l USING (tk)""",
    ("lbook", "adj"),
)
def led_mark_to_market(spark, sf):
    return LG.mark_to_market(book(spark, sf).drop("current_price"), adj(spark, sf), "adj").select("pid", "tk", "current_price")


_LOSS = "CASE WHEN direction='long' THEN current_price < entry_price ELSE current_price > entry_price END"
_STOP = "CASE WHEN direction='long' THEN current_price <= stop_price ELSE current_price >= stop_price END"
view(
    "lflag",
    f"SELECT *, CASE WHEN {_STOP} THEN 'stop_loss' WHEN {_LOSS} THEN 'underperforming' END AS reason FROM lbook b WHERE NOT EXISTS (SELECT 1 FROM lprop p WHERE p.pid=b.pid AND p.tk=b.tk)",
    "lbook", "lprop",
)
view(
    "ltrim",
    f"""SELECT * EXCLUDE (reason, k, ov, pnl), 'capacity_trim' AS reason FROM (SELECT f.*, o.ov, row_number() OVER (PARTITION BY f.pid ORDER BY pnl, tk) AS k FROM
    (SELECT *, (current_price-entry_price)/nullif(entry_price,0)*CASE WHEN direction='short' THEN -1 ELSE 1 END AS pnl FROM lflag WHERE reason IS NULL) f JOIN
    (SELECT pid, count(*) - (SELECT count(*) FROM lflag x WHERE x.pid=b.pid AND x.reason IS NOT NULL) + (SELECT count(*) FROM lprop p WHERE p.pid=b.pid AND p.tk NOT IN (SELECT tk FROM lbook y WHERE y.pid=b.pid)) - {MAXPOS} AS ov
     FROM lbook b GROUP BY pid) o USING (pid)) WHERE k <= ov""",
    "lflag", "lprop", "lbook",
)
view(
    "lreal",
    f"""SELECT *, {r('pnl-tax', 2)} AS net_pnl FROM (SELECT *, CASE WHEN pnl > 0 THEN {r('pnl*CASE WHEN holding_days < 365 THEN 0.2::DOUBLE ELSE 0.125::DOUBLE END', 2)} ELSE 0 END AS tax FROM (
    SELECT *, {r("(current_price-entry_price)*shares*CASE WHEN direction='long' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END", 2)} AS pnl, CAST(t-entry_date AS INT) AS holding_days FROM
    (SELECT * FROM lflag WHERE reason IS NOT NULL UNION ALL BY NAME SELECT * FROM ltrim)))""",
    "lflag", "ltrim",
)


@query(
    "led_committed",
    "SELECT pid FROM (SELECT pid, count(*) AS have FROM lbook GROUP BY 1) JOIN (SELECT pid, count(*) AS want FROM lprop GROUP BY 1) USING (pid) WHERE have >= want*0.8::DOUBLE",
    ("lbook", "lprop"),
)
def led_committed(spark, sf):
    return LG.already_committed(book(spark, sf), proposed(spark, sf))


@query("led_close_flags", "SELECT pid, tk, reason FROM lflag", ("lflag",))
def led_close_flags(spark, sf):
    return LG.close_flags(book(spark, sf), proposed(spark, sf)).select("pid", "tk", "reason")


@query("led_capacity_trim", "SELECT pid, tk, reason FROM ltrim", ("ltrim",))
def led_capacity_trim(spark, sf):
    b, p = book(spark, sf), proposed(spark, sf)
    return LG.capacity_trim(LG.close_flags(b, p), b, p, MAXPOS).select("pid", "tk", "reason")


@published("realised")
def realised(spark, sf):
    b, p = book(spark, sf), proposed(spark, sf)
    flagged = LG.close_flags(b, p)
    closing = flagged.where("reason is not null").unionByName(LG.capacity_trim(flagged, b, p, MAXPOS))
    return LG.realise(closing, F.col("t"))


@query("led_realise", "SELECT pid, tk, reason, pnl, holding_days, tax, net_pnl FROM lreal", ("lreal",))
def led_realise(spark, sf):
    return realised(spark, sf).select("pid", "tk", "reason", "pnl", "holding_days", "tax", "net_pnl")


@query("led_credits", "SELECT t AS tx_date, 'pnl_credit' AS tx_type, net_pnl AS amount, pid || ' ' || tk || ' ' || direction AS reference FROM lreal WHERE net_pnl <> 0", ("lreal",))
def led_credits(spark, sf):
    return LG.credits(realised(spark, sf))


def first_row(spark):
    return spark.range(1).select(F.lit("1995-01-01").cast("date").alias("tx_date"), F.lit("initial").alias("tx_type"), F.lit(1e7).alias("amount"), F.lit("seed").alias("reference"))


@query(
    "led_balances",
    f"SELECT {r('(SELECT sum(net_pnl) FROM lreal) + 1e7::DOUBLE', 2)} AS cash, {r('(SELECT sum(entry_price*shares) FROM lbook)', 1)} AS deployed",
    ("lreal", "lbook"),
)
def led_balances(spark, sf):
    ledger = LG.credits(realised(spark, sf)).unionByName(first_row(spark))
    cash = LG.cash_balance(ledger).scalar()
    return LG.deployed(book(spark, sf)).select(floor_round(cash, 2).alias("cash"), floor_round("deployed", 1).alias("deployed"))


@query(
    "led_seed",
    """SELECT 'full' AS ledger, t AS tx_date, 'pnl_credit' AS tx_type, net_pnl AS amount, pid || ' ' || tk || ' ' || direction AS reference FROM lreal WHERE net_pnl <> 0
    UNION ALL SELECT 'empty', DATE '1995-01-01', 'initial', 1e7::DOUBLE, 'seed' WHERE (SELECT count(*) FROM lreal WHERE net_pnl > 1e15) = 0""",
    ("lreal",),
)
def led_seed(spark, sf):
    """A ledger with rows stays as it is, one without rows gets its first."""
    rows = LG.credits(realised(spark, sf))
    cols = ["tx_date", "tx_type", "amount", "reference"]
    full = LG.seed_ledger(rows, first_row(spark)).select(F.lit("full").alias("ledger"), *cols)
    return full.unionByName(LG.seed_ledger(rows.where("amount > 1e15"), first_row(spark)).select(F.lit("empty").alias("ledger"), *cols))


@query(
    "led_open_new",
    f"""SELECT pid, tk, direction, d AS entry_date, CASE WHEN price > 0 THEN price END AS entry_price, CASE WHEN direction='short' THEN 'short' WHEN is_midcap THEN 'alpha_long' ELSE 'core_long' END AS position_class,
    CASE WHEN price > 0 THEN {r("price*CASE WHEN direction='long' THEN 0.85::DOUBLE ELSE 1.1::DOUBLE END", 4)} END AS stop_price, CASE WHEN floor(alloc/price) > 0 THEN CAST(floor(alloc/price) AS BIGINT) END AS shares, 'open' AS status
    FROM lprop p WHERE NOT EXISTS (SELECT 1 FROM lbook b WHERE b.pid=p.pid AND b.tk=p.tk)""",
    ("lprop", "lbook"),
)
def led_open_new(spark, sf):
    return LG.open_new(proposed(spark, sf), book(spark, sf))


@query(
    "led_tax_rates",
    "SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-07-23' THEN 0.2::DOUBLE ELSE 0.15::DOUBLE END AS short_rate, CASE WHEN ts >= TIMESTAMP '2024-07-23' THEN 0.125::DOUBLE ELSE 0.1::DOUBLE END AS long_rate FROM (SELECT event_id, ts + to_days(CAST(event_id % 400 AS INT)) AS ts FROM events)",
)
def led_tax_rates(spark, sf):
    e = P.table(spark, sf, "events").select("event_id", F.date_add(F.to_date("ts"), (F.col("event_id") % 400).cast("int")).alias("d"))
    short, long = LG.tax_rates(F.col("d"))
    return e.select("event_id", short.alias("short_rate"), long.alias("long_rate"))


def _horner(x, k):
    out = f"({k[0]!r})::DOUBLE"
    for c in k[1:]:
        out = f"({out}*{x} + ({c!r})::DOUBLE)"
    return out


def ppf_sql(p: str) -> str:
    q = f"({p}-0.5::DOUBLE)"
    rr = f"({q}*{q})"
    lo, hi = f"sqrt(-2.0::DOUBLE*ln({p}))", f"sqrt(-2.0::DOUBLE*ln(1.0::DOUBLE-{p}))"
    tail = lambda u: f"({_horner(u, N.NORM_C)}/({_horner(u, N.NORM_D)}*{u}+1.0::DOUBLE))"
    return f"(CASE WHEN {p} < 0.02425 THEN {tail(lo)} WHEN {p} > 0.97575 THEN -{tail(hi)} ELSE {_horner(rr, N.NORM_A)}*{q}/({_horner(rr, N.NORM_B)}*{rr}+1.0::DOUBLE) END)"


view(
    "expret",
    f"""SELECT *, {r(f"greatest(least(least({ppf_sql('p')}/{ppf_sql('0.925::DOUBLE')}, 1.2::DOUBLE)*15.0::DOUBLE, 60), -60)")} AS ann_return FROM (
    SELECT *, greatest(least(CASE WHEN signal >= 0 THEN final_rank ELSE 1.0::DOUBLE-final_rank END, 0.99::DOUBLE), 0.01::DOUBLE) AS p FROM sig)""",
    "sig",
)


@query("rpt_expected_return", "SELECT tk, d, ann_return FROM expret", ("expret",))
def rpt_expected_return(spark, sf):
    side = F.when(F.col("signal") >= 0, "long").otherwise("short")
    return signals(spark, sf).select("tk", "d", floor_round(LG.expected_return(side, F.col("final_rank"))).alias("ann_return"))


view(
    "proj",
    f"""SELECT *, gain-tax AS net_gain FROM (SELECT *, greatest(gain,0)*tax_rate AS tax FROM (SELECT *, alloc*ann_return/100 AS gain, CASE WHEN days_held+21 >= 365 THEN 0.1::DOUBLE ELSE 0.15::DOUBLE END AS tax_rate FROM (
    SELECT q.pid, q.tk, q.direction, q.alloc, q.d, b.tk IS NULL AS is_new, coalesce(greatest(CAST(DATE '2001-12-31'-b.entry_date AS INT), 0), 0) AS days_held,
    {r(f"greatest(least(least({ppf_sql('q.p')}/{ppf_sql('0.925::DOUBLE')}, 1.2::DOUBLE)*15.0::DOUBLE, 60), -60)")} AS ann_return FROM
    (SELECT p.*, greatest(least(CASE WHEN p.direction='long' THEN coalesce(s.final_rank,0.5) ELSE 1.0::DOUBLE-coalesce(s.final_rank,0.5) END, 0.99::DOUBLE), 0.01::DOUBLE) AS p
     FROM lprop p LEFT JOIN sig s ON s.tk=p.tk AND s.d=p.d) q LEFT JOIN lbook b ON b.pid=q.pid AND b.tk=q.tk)))""",
    "lprop", "sig", "lbook",
)


def projected(spark, sf):
    ranks = signals(spark, sf).select("tk", "d", "final_rank")
    rows = proposed(spark, sf).join(ranks, ["tk", "d"], "left")
    return LG.project(rows, book(spark, sf), F.lit("2001-12-31").cast("date"))


@query("rpt_position_projection", f"SELECT pid, tk, direction, is_new, days_held, tax_rate, ann_return, {r('gain', 2)} AS gain, {r('tax', 2)} AS tax, {r('net_gain', 2)} AS net_gain FROM proj", ("proj",))
def rpt_position_projection(spark, sf):
    p = projected(spark, sf)
    return p.select("pid", "tk", "direction", "is_new", "days_held", "tax_rate", "ann_return", *[floor_round(c, 2).alias(c) for c in ("gain", "tax", "net_gain")])


view(
    "capsum",
    f"""SELECT *, 1e7::DOUBLE-deployed AS remaining, deployed*19.845::DOUBLE/10000 AS entry_cost, deployed*19.845::DOUBLE/10000 AS exit_cost, gain/nullif(deployed,0)*100 AS expected_pct FROM (
    SELECT pid, sum(alloc) AS deployed, coalesce(sum(alloc) FILTER (WHERE direction='long'),0) AS long_book, coalesce(sum(alloc) FILTER (WHERE direction='short'),0) AS short_book, CAST(sum(CAST({r('gain', 2)} AS DECIMAL(18,2))) AS DOUBLE) AS gain, CAST(sum(CAST({r('tax', 2)} AS DECIMAL(18,2))) AS DOUBLE) AS tax FROM proj GROUP BY pid)""",
    "proj",
)
_C = ("deployed", "long_book", "short_book", "gain", "tax", "remaining", "entry_cost", "exit_cost", "expected_pct")


@query("rpt_capital_summary", f"SELECT pid, {', '.join(f'{r(c, 3)} AS {c}' for c in _C)} FROM capsum", ("capsum",))
def rpt_capital_summary(spark, sf):
    s = LG.capital_summary(projected(spark, sf), 1e7)
    return s.select("pid", *[floor_round(c, 3).alias(c) for c in _C])


@query(
    "rpt_capital_waterfall",
    f"""SELECT pid, CAST(step AS INT) AS step, name, {r('value', 3)} AS value FROM (SELECT pid, unnest([{{'step':0,'name':'available_cash','value':1e7::DOUBLE}}, {{'step':1,'name':'cash_held','value':-remaining}}, {{'step':2,'name':'gross_gain','value':gain}},
    {{'step':3,'name':'transaction_costs','value':-deployed*38.19::DOUBLE/10000}}, {{'step':4,'name':'tax','value':-tax}}, {{'step':5,'name':'final_nav','value':1e7::DOUBLE+gain-tax}}], recursive := true) FROM capsum)""",
    ("capsum",),
)
def rpt_capital_waterfall(spark, sf):
    w = LG.capital_waterfall(LG.capital_summary(projected(spark, sf), 1e7), 1e7)
    return w.withColumn("value", floor_round("value", 3))
