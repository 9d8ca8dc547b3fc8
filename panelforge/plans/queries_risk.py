"""Risk-rule queries: every month's book screened against the next month's candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.asof import asof_join
from panelforge.functions.numeric import floor_round
from panelforge.functions.staging import published
from panelforge.functions.windows import MARKET, drawdown
from panelforge.operators import risk as RK
from panelforge.operators import sizing as Z
from panelforge.plans.oracle_views import r, view
from panelforge.plans.queries_bars import adj
from panelforge.plans.queries_macro import market
from panelforge.plans.queries_signals import pool, sized
from panelforge.plans.registry import query
from panelforge.sources import panel as P

LIM = RK.Limits(financial=("S0",), net_min=0.10, sector_long=0.15, sector_long_fin=0.18, flow_sell=500_000.0)

# a book per month: the sized positions of the month's last signal date, proposed again one month later at 1.6 times
view("bookd", "SELECT strftime(d, '%Y-%m') AS pid, max(d) AS d, strftime(max(d) + INTERVAL 1 MONTH, '%Y-%m') AS next_pid FROM psize GROUP BY strftime(d, '%Y-%m')", "psize")
view("pos", f"SELECT b.pid, p.d, tk, direction, {r('size')} AS size, sector, tier IN (2,3) AS is_midcap, price AS entry_price FROM psize p JOIN bookd b ON p.d=b.d", "psize", "bookd")
view(
    "posn",
    "SELECT q.*, coalesce(j.adj, q.entry_price) AS current_price FROM (SELECT p.*, CAST(date_trunc('month', p.d) + INTERVAL 2 MONTH - INTERVAL 1 DAY AS DATE) AS t FROM pos p) q"
    " ASOF LEFT JOIN adj j ON q.tk=j.tk AND q.t >= j.d",
    "pos", "adj",
)
view(
    "prop",
    f"""SELECT b.pid, p.tk, p.direction, {r('p.size*1.6::DOUBLE')} AS size, p.sector, p.is_midcap, p.tk IN (SELECT tk FROM eligible) AS eligible,
    p.entry_price*100 AS market_cap, CAST(CASE WHEN p.entry_price > 500 THEN 2 ELSE 0 END AS INT) AS circuit_hits FROM pos p JOIN bookd b ON p.pid=b.next_pid""",
    "pos", "bookd", "eligible",
)
view(
    "state",
    f"""SELECT b.pid, 1e7::DOUBLE AS nav, {r('1e7::DOUBLE/(1+m.dd/8)', 2)} AS peak_nav, {r('1e7::DOUBLE*greatest(1-s.used,0)', 2)} AS cash, {r('k.ix500_return_21d/8')} AS nav_return_21d,
    k.flow_best AS flow_today, CAST(CASE WHEN k.flow_best < 0 THEN 5 ELSE 0 END AS INT) AS flow_negative_days, month(b.d)=2 AS is_budget, day(b.d) >= 31 AS is_expiry
    FROM bookd b JOIN (SELECT pid, sum(size) AS used FROM pos GROUP BY 1) s USING (pid)
    ASOF LEFT JOIN (SELECT d, ix500/max(ix500) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)-1 AS dd FROM macro) m ON b.d >= m.d
    ASOF LEFT JOIN mkt k ON b.d >= k.d""",
    "bookd", "pos", "macro", "mkt",
)


@published("book_dates")
def book_dates(spark, sf):
    dates = sized(spark, sf).groupBy(F.date_format("d", "yyyy-MM").alias("pid")).agg(F.max("d").alias("d"))
    return dates.withColumn("next_pid", F.date_format(F.add_months("d", 1), "yyyy-MM"))


@published("positions")
def positions(spark, sf):
    """Monthly books with the price one month later."""
    pos = sized(spark, sf).join(book_dates(spark, sf).select("pid", "d"), "d").select(
        "pid", "d", "tk", "direction", floor_round("size").alias("size"), "sector", F.col("tier").isin(2, 3).alias("is_midcap"),
        F.col("price").alias("entry_price"),
    )
    pos = pos.withColumn("t", F.last_day(F.add_months(F.trunc("d", "month"), 1)))
    px = adj(spark, sf).select("tk", F.col("d").alias("px_d"), F.col("adj").alias("current_price"))
    hit = asof_join(pos, px, ["tk"], "t", "px_d", ["current_price"])
    return hit.withColumn("current_price", F.coalesce("current_price", "entry_price"))


@published("proposals")
def proposals(spark, sf):
    ok = P.eligible(spark, sf).withColumn("ok", F.lit(True))
    nxt = book_dates(spark, sf).select(F.col("pid").alias("book"), F.col("next_pid").alias("pid"))
    return positions(spark, sf).join(nxt, "pid").join(ok, "tk", "left").select(
        F.col("book").alias("pid"), "tk", "direction", floor_round(F.col("size") * 1.6).alias("size"), "sector", "is_midcap",
        F.coalesce("ok", F.lit(False)).alias("eligible"), (F.col("entry_price") * 100).alias("market_cap"),
        F.when(F.col("entry_price") > 500, 2).otherwise(0).alias("circuit_hits"),
    )


@published("state")
def state(spark, sf):
    used = positions(spark, sf).groupBy("pid").agg(F.sum("size").alias("used"))
    mac = drawdown(P.macro(spark, sf).select("d", "ix500"), MARKET, "ix500")
    mk = market(spark, sf).select("d", "ix500_return_21d", "flow_best").join(mac, "d").withColumnRenamed("d", "md")
    st = asof_join(
        book_dates(spark, sf).select("pid", "d"), mk, [], "d", "md", ["ix500_return_21d", "flow_best", "drawdown"], left_unique=True
    )
    return st.join(used, "pid").select(
        "pid", F.lit(1e7).alias("nav"), floor_round(1e7 / (1 + F.col("drawdown") / 8), 2).alias("peak_nav"),
        floor_round(1e7 * F.greatest(1 - F.col("used"), F.lit(0.0)), 2).alias("cash"), floor_round(F.col("ix500_return_21d") / 8).alias("nav_return_21d"),
        F.col("flow_best").alias("flow_today"), F.when(F.col("flow_best") < 0, 5).otherwise(0).alias("flow_negative_days"),
        (F.month("d") == 2).alias("is_budget"), (F.day("d") >= 31).alias("is_expiry"),
    )


def risk_frames(spark, sf):
    """(positions, proposals, state) of all monthly books."""
    return positions(spark, sf), proposals(spark, sf), state(spark, sf)


view(
    "expo",
    """SELECT s.*, gl AS gross_long, gs AS gross_short, ml AS mid_long, long_sectors, gl-gs AS net, gl+gs AS gross, cash/nav AS cash_pct, coalesce(ml/nullif(gl,0),0) AS midcap_share FROM state s JOIN
    (SELECT pid, coalesce(sum(size) FILTER (WHERE direction='long'),0) AS gl, coalesce(sum(size) FILTER (WHERE direction='short'),0) AS gs,
     coalesce(sum(size) FILTER (WHERE direction='long' AND is_midcap),0) AS ml, count(DISTINCT CASE WHEN direction='long' THEN sector END) AS long_sectors FROM pos GROUP BY 1) USING (pid)""",
    "state", "pos",
)
view(
    "rctx",
    """SELECT p.*, e.* EXCLUDE (pid), coalesce(x.sl,0) AS sector_long, coalesce(x.ss,0) AS sector_short, h.entry_price, h.current_price, (h.current_price-h.entry_price)/nullif(h.entry_price,0) AS move,
    p.direction='long' AS lg, p.size AS now FROM prop p JOIN expo e USING (pid) LEFT JOIN (SELECT pid, sector, coalesce(sum(size) FILTER (WHERE direction='long'),0) AS sl,
    coalesce(sum(size) FILTER (WHERE direction='short'),0) AS ss FROM pos GROUP BY 1,2) x ON x.pid=p.pid AND x.sector=p.sector
    LEFT JOIN posn h ON h.pid=p.pid AND h.tk=p.tk""",
    "prop", "expo", "pos", "posn",
)
L = LIM


def _rej(code):
    return f"{{'s':'REJECTED','l':{code},'z':0.0::DOUBLE}}"


def _red(code, z):
    return f"{{'s':'REDUCED','l':{code},'z':({z})::DOUBLE}}"


def _fit(code, room):
    return f"CASE WHEN {room} < {L.min_size} THEN {_rej(code)} ELSE {_red(code, room)} END"


_CAP = f"(CASE WHEN lg THEN CASE WHEN is_midcap THEN {L.mid_long} ELSE {L.core_long} END ELSE {L.short} END)::DOUBLE"
_SCAP = f"(CASE WHEN sector='S0' THEN {L.sector_long_fin} ELSE {L.sector_long} END)::DOUBLE"
_NET = "(CASE WHEN lg THEN net+now ELSE net-now END)"
SQL_RULES = {
    "fo": f"CASE WHEN now <= 0 THEN {_rej('NULL')} WHEN NOT lg AND NOT eligible THEN {_rej(chr(39) + 'FO' + chr(39))} END",
    "position": f"""CASE WHEN now < {L.min_size} THEN {_rej("'P6'")} WHEN now > {_CAP} THEN {_red("CASE WHEN lg THEN CASE WHEN is_midcap THEN 'P2' ELSE 'P1' END ELSE 'P3' END", _CAP)}
      WHEN lg AND move <= {L.long_stop} THEN {_rej("'P4'")} WHEN NOT lg AND move >= {L.short_stop} THEN {_rej("'P5'")} END""",
    "sector": f"""CASE WHEN lg AND sector_long+now > {_SCAP} THEN {_fit("'S1'", f'({_SCAP}-sector_long)')}
      WHEN NOT lg AND sector_short+now > {L.sector_short} THEN {_fit("'S2'", f'({L.sector_short}::DOUBLE-sector_short)')} END""",
    "portfolio": f"""CASE WHEN (nav-peak_nav)/peak_nav <= {L.peak_stop} THEN {_rej("'PT6'")} WHEN nav_return_21d <= {L.review_return} THEN {_rej("'PT5'")}
      WHEN cash_pct-now < {L.cash_min} THEN {_fit("'PT3'", f'(cash_pct-{L.cash_min}::DOUBLE)')} WHEN gross+now > {L.gross_max} THEN {_fit("'PT2'", f'({L.gross_max}::DOUBLE-gross)')}
      WHEN {_NET} > {L.net_max} THEN {_rej("'PT1'")} WHEN {_NET} < {L.net_min} AND gross_long > 0 AND NOT lg THEN {_rej("'PT1'")} END""",
    "midcap": f"""CASE WHEN lg AND is_midcap AND (midcap_share*gross_long+now)/(gross_long+now) > {L.midcap_max}
      THEN {_fit("'PT4'", f'greatest(({L.midcap_max}::DOUBLE*gross_long-midcap_share*gross_long)/(1-{L.midcap_max}::DOUBLE),0.0)')} END""",
    "seasonal": f"""CASE WHEN is_expiry AND NOT lg THEN {_rej("'IR1'")} WHEN is_budget THEN {_fit("'IR2'", f'(now*(1-{L.budget_cut}::DOUBLE))')}
      WHEN lg AND (coalesce(flow_today < -{L.flow_sell}, false) OR flow_negative_days >= 5) AND net+now > {L.flow_net_max} THEN {_fit("'IR4'", f'greatest({L.flow_net_max}::DOUBLE-net,0.0)')}
      WHEN NOT lg AND circuit_hits >= 2 THEN {_rej("'IR5'")} WHEN NOT lg AND market_cap < {L.min_cap} THEN {_rej("'IR5'")} END""",
}


def _one(rule: str) -> str:
    return (f"SELECT pid, tk, direction, coalesce(x.s,'APPROVED') AS status, x.l AS limit_code, {r('coalesce(x.z, now)')} AS approved_size"
            f" FROM (SELECT *, {SQL_RULES[rule]} AS x FROM rctx)")


def _chain() -> str:
    src = "SELECT *, NULL::STRUCT(s VARCHAR, l VARCHAR, z DOUBLE) AS fin, NULL::VARCHAR AS fst FROM rctx"
    for rule in ("fo", "position", "sector", "portfolio", "midcap", "seasonal"):
        stop = "x IS NOT NULL" if rule == "midcap" else "x.s='REJECTED'"
        src = (f"SELECT * EXCLUDE (x, fin, now, fst), CASE WHEN {stop} THEN x ELSE fin END AS fin, CASE WHEN x.s='REDUCED' THEN x.z ELSE now END AS now,"
               f" CASE WHEN x.s='REDUCED' THEN coalesce(fst, x.l) ELSE fst END AS fst FROM (SELECT *, CASE WHEN fin IS NULL THEN {SQL_RULES[rule]} END AS x FROM ({src}))")
    return src


view(
    "rdec",
    f"""SELECT pid, tk, direction, size, CASE WHEN fin IS NOT NULL THEN fin.s WHEN now < size THEN 'REDUCED' ELSE 'APPROVED' END AS status,
    CASE WHEN fin IS NOT NULL THEN fin.l WHEN now < size THEN fst END AS limit_code, {r('CASE WHEN fin IS NOT NULL THEN fin.z ELSE now END')} AS approved_size FROM ({_chain()})""",
    "rctx",
)


@query(
    "risk_exposures",
    f"SELECT pid, {', '.join(f'{r(c)} AS {c}' for c in ('gross_long', 'gross_short', 'net', 'gross', 'cash_pct', 'midcap_share'))}, long_sectors FROM expo",
    ("expo",),
)
def risk_exposures(spark, sf):
    pos, _, st = risk_frames(spark, sf)
    cols = ("gross_long", "gross_short", "net", "gross", "cash_pct", "midcap_share")
    return RK.exposures(pos, st).select("pid", *[floor_round(c).alias(c) for c in cols], "long_sectors")


def _rule_query(key: str, name: str, rule):
    @query(key, _one(name), ("rctx",))
    def run(spark, sf):
        pos, prop, st = risk_frames(spark, sf)
        out = RK.apply_rule(RK.with_context(prop, pos, st), rule())
        return out.select("pid", "tk", "direction", "status", "limit_code", floor_round("approved_size").alias("approved_size"))

    return run


risk_fo_rule = _rule_query("risk_fo_rule", "fo", RK.eligibility_rule)
risk_position_rules = _rule_query("risk_position_rules", "position", lambda: RK.position_rule(LIM))
risk_sector_rules = _rule_query("risk_sector_rules", "sector", lambda: RK.sector_rule(LIM))
risk_portfolio_rules = _rule_query("risk_portfolio_rules", "portfolio", lambda: RK.portfolio_rule(LIM))
risk_midcap_rule = _rule_query("risk_midcap_rule", "midcap", lambda: RK.midcap_rule(LIM))
risk_seasonal_rules = _rule_query("risk_seasonal_rules", "seasonal", lambda: RK.seasonal_rule(LIM))


@query("risk_decision", "SELECT * FROM rdec", ("rdec",))
def risk_decision(spark, sf):
    pos, prop, st = risk_frames(spark, sf)
    out = RK.decide(RK.with_context(prop, pos, st), LIM)
    return out.select("pid", "tk", "direction", "size", "status", "limit_code", floor_round("approved_size").alias("approved_size"))


@query("risk_rejected", "SELECT pid, tk, limit_code FROM rdec WHERE status = 'REJECTED'", ("rdec",))
def risk_rejected(spark, sf):
    pos, prop, st = risk_frames(spark, sf)
    return RK.rejected(prop, pos, st, LIM).select("pid", "tk", "limit_code")


@query("risk_screen", "SELECT pid, tk, status, approved_size FROM rdec WHERE status <> 'REJECTED'", ("rdec",))
def risk_screen(spark, sf):
    pos, prop, st = risk_frames(spark, sf)
    out = RK.screen(prop, pos, st, LIM)
    return out.select("pid", "tk", "status", floor_round("approved_size").alias("approved_size"))
