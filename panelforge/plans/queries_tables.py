"""Source, sink, table-maintenance and resume queries.

Files that the readers need are written by Spark from the given tables first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.numeric import bare_ticker, clean_number, coerce_numeric, floor_round, period_start
from panelforge.functions.staging import stage_path
from panelforge.functions.windows import Axis
from panelforge.operators import features as E
from panelforge.operators import tables as TB
from panelforge.operators.versioned import VersionedTable, by_month
from panelforge.plans.oracle_views import r, view
from panelforge.plans.queries_features import pc
from panelforge.plans.queries_quality import tiers
from panelforge.plans.registry import query
from panelforge.sources import panel as P
from panelforge.sources import readers as S
from panelforge.streaming import incremental as INC

TK = Axis(("tk",), "d")


def scratch(spark, name):
    return stage_path(spark, name)


def as_csv(df, name):
    path = scratch(df.sparkSession, name)
    S.write_csv(df, path)
    return path


@query("src_universe", "SELECT DISTINCT p_brand || '.NS' AS tk FROM part WHERE p_brand <> 'Brand#7'")
def src_universe(spark, sf):
    raw = P.table(spark, sf, "part").select(F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("Symbol "))
    return S.read_universe(spark, as_csv(raw, "universe"), ".NS", ["Brand#7"])


@query("src_sector_map", "SELECT p_partkey, p_brand AS tk, coalesce(CASE WHEN sector <> 'S3' THEN sector END, 'Others') AS sector FROM part JOIN sector ON tk=p_brand", ("sector",))
def src_sector_map(spark, sf):
    raw = P.sector(spark, sf).where("sector <> 'S3'").select(F.col("tk").alias("Ticker"), F.col("sector").alias("Industry"))
    parts = P.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("tk"))
    return S.with_sector(parts, S.read_sector_map(spark, as_csv(raw, "sectors")))


@query("src_eligible_flag", "SELECT p_partkey, p_brand AS tk, CAST(p_brand IN (SELECT tk FROM eligible) AS INT) AS eligible FROM part", ("eligible",))
def src_eligible_flag(spark, sf):
    listed = S.read_universe(spark, as_csv(P.eligible(spark, sf).select(F.col("tk").alias("SYMBOL")), "eligible"))
    return S.eligible_flag(P.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("tk")), listed)


@query("src_bars_layouts", "SELECT tk, d, op, hi, lo, cl, vol FROM bars", ("bars",))
def src_bars_layouts(spark, sf):
    b = P.bars(spark, sf).withColumn("s", F.lit("EQ "))
    old_names = ("SYMBOL", "SERIES", "OPEN", "HIGH", "LOW", "CLOSE", "TOTTRDQTY")
    new_names = ("TckrSymb", "SctySrs", "OpnPric", "HghPric", "LwPric", "ClsPric", "TtlTradgVol")

    def layout(rows, names):
        cols = [F.col(c).alias(n) for c, n in zip(("tk", "s", "op", "hi", "lo", "cl", "vol"), names)]
        return S.read_csv(spark, as_csv(rows.select("d", *cols), "bars"))

    return S.unify_bar_layouts([layout(b.where("d < date'1999-01-01'"), old_names), layout(b.where("d >= date'1999-01-01'"), new_names)])


@query(
    "scan_project_filter",
    """SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_returnflag='R' AND l_quantity BETWEEN 10 AND 20
    AND l_shipdate >= TIMESTAMP '1998-01-01' AND l_linestatus IN ('O','F')""",
)
def scan_project_filter(spark, sf):
    t = P.table(spark, sf, "lineitem")
    keep = (F.col("l_returnflag") == "R") & F.col("l_quantity").between(10, 20) & (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp"))
    return t.where(keep & F.col("l_linestatus").isin("O", "F")).select("l_orderkey", "l_partkey", "l_extendedprice")


@query("sink_tier_export", "SELECT tk, d, cl, tier FROM bars JOIN dqt USING (tk) WHERE tier IN ('A','B')", ("bars", "dqt"))
def sink_tier_export(spark, sf):
    panel = P.bars(spark, sf).join(tiers(spark, sf).select("tk", "tier"), "tk").select("tk", "d", "cl", "tier")
    root = scratch(spark, "export")
    S.export_tiers(panel.where("tier = 'C'"), root, "20240101")
    S.export_tiers(panel, root, "20240201", ["A", "B"])
    return S.read_latest(spark, root)


@query("sink_replace", "SELECT p_partkey, p_brand FROM part WHERE p_size >= 10")
def sink_replace(spark, sf):
    """The second load stays, whatever the first one held."""
    part, path = P.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), scratch(spark, "replace")
    TB.replace_table(part.where("p_size < 10").select("p_partkey", "p_brand"), path)
    TB.replace_table(part.where("p_size >= 10").select("p_partkey", "p_brand"), path)
    return spark.read.parquet(path)


@query("src_coerced", "SELECT CAST(p_partkey AS DOUBLE) AS number, p_brand AS brand, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS tail, TRY_CAST(p_type AS DOUBLE) AS kind FROM part")
def src_coerced(spark, sf):
    t = P.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("number"), F.col("p_brand").alias("brand"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("tail"), F.col("p_type").alias("kind"))
    return coerce_numeric(t, ("brand",))


@query("src_bare_ticker", "SELECT DISTINCT p_brand || '.NS' AS ticker, p_brand AS bare, p_brand AS plain FROM part")
def src_bare_ticker(spark, sf):
    t = P.table(spark, sf, "part").select(F.concat("p_brand", F.lit(".NS")).alias("ticker"), "p_brand").distinct()
    return t.select("ticker", bare_ticker("ticker").alias("bare"), bare_ticker("p_brand").alias("plain"))


@query("json_parse_monthly", "SELECT y, m, fii AS net FROM flow_m WHERE fii IS NOT NULL", ("flow_m",))
def json_parse_monthly(spark, sf):
    f = P.flow_monthly(spark, sf)
    item = F.struct(F.date_format(F.make_date("y", "m", F.lit(1)), "MMM yyyy").alias("DateText"), F.col("fii").alias("NetValue"))
    payload = f.groupBy("y").agg(F.to_json(F.collect_list(item)).alias("payload"))
    return S.parse_monthly(payload)


@query(
    "json_infer_year",
    "SELECT CAST(year(d) // 3 AS INT) AS feed, d, fii AS net FROM flow_all",
    ("flow_all",),
)
def json_infer_year(spark, sf):
    """All order days, one payload for every three years."""
    f = P.flow_days(spark, sf)
    item = F.struct(F.date_format("d", "MMM d").alias("DateText"), F.col("fii").alias("NetValue"))
    listed = f.groupBy(F.floor(F.year("d") / 3).cast("int").alias("feed")).agg(
        F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("d", item.alias("i"))))), lambda x: x["i"]).alias("a"), F.max("d").alias("asof")
    )
    return S.parse_daily(listed.select("feed", "asof", F.to_json("a").alias("payload")), "feed", F.col("asof"))


def statement_pages(spark, sf):
    """HTML statement pages rendered from the statements table."""
    f = P.fund(spark, sf)

    def cells(c):
        return F.concat_ws("", F.transform("y", lambda x: F.concat(F.lit("<td>"), F.coalesce(F.format_number(x[c], 2), F.lit("--")), F.lit("</td>"))))

    years = f.groupBy("tk").agg(F.array_sort(F.collect_list(F.struct("period", "revenue", "net_income", "ebitda"))).alias("y"))
    head = F.concat_ws("", F.transform("y", lambda x: F.concat(F.lit("<th>"), F.date_format(x["period"], "MMM yyyy"), F.lit("</th>"))))
    html = F.concat(
        F.lit('<html><section id="profit-loss"><table><thead><tr><th></th>'), head, F.lit("</tr></thead><tbody><tr><td>Sales +</td>"),
        cells("revenue"), F.lit("</tr><tr><td>Net Profit</td>"), cells("net_income"), F.lit("</tr><tr><td>Operating Profit %</td>"),
        cells("ebitda"), F.lit("</tr></tbody></table></section></html>"),
    )
    return years.select("tk", html.alias("html"))


@query(
    "html_table_long",
    """SELECT tk, 'profit-loss' AS section, 'Sales' AS row_name, make_date(year(period)::INT,12,1) AS period, revenue AS value FROM fund WHERE revenue IS NOT NULL
    UNION ALL SELECT tk, 'profit-loss', 'Net Profit', make_date(year(period)::INT,12,1), net_income FROM fund WHERE net_income IS NOT NULL
    UNION ALL SELECT tk, 'profit-loss', 'Operating Profit %', make_date(year(period)::INT,12,1), ebitda FROM fund WHERE ebitda IS NOT NULL""",
    ("fund",),
)
def html_table_long(spark, sf):
    v = S.statement_values(S.statement_cells(statement_pages(spark, sf), "tk", "html"))
    return v.select("tk", "section", "row_name", period_start("label").alias("period"), "value")


@query("html_row_lookup", "SELECT tk, make_date(year(period)::INT,12,1) AS period, ebitda AS value FROM fund WHERE ebitda IS NOT NULL", ("fund",))
def html_row_lookup(spark, sf):
    v = S.statement_values(S.statement_cells(statement_pages(spark, sf), "tk", "html"))
    hit = S.pick_row(v, ["tk", "label"], ["EBITDA", "Operating Profit"])
    return hit.select("tk", period_start("label").alias("period"), "value")


@query(
    "html_list_items",
    """SELECT page_id, CAST(i-1 AS INT) AS pos, trim(regexp_replace(li, '<[^>]*>', '', 'g')) AS name, regexp_extract(li, 'href="([^"]*)"', 1) AS value FROM
    (SELECT page_id, unnest(x) AS li, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) AS x FROM pages))""",
)
def html_list_items(spark, sf):
    return S.list_items(P.table(spark, sf, "pages").select("page_id", "html"), "page_id", "html")


@query("scalar_clean_number", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS value FROM orders")
def scalar_clean_number(spark, sf):
    o = P.table(spark, sf, "orders")
    text = F.when(F.col("o_orderstatus") == "P", "--").otherwise(F.concat(F.lit("₹ "), F.format_number("o_totalprice", 2), F.lit("+ ")))
    return o.select("o_orderkey", clean_number(text).alias("value"))


@query(
    "scalar_period_label",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS period FROM orders",
)
def scalar_period_label(spark, sf):
    o = P.table(spark, sf, "orders")
    label = F.date_format("o_orderdate", "MMM yyyy")
    text = F.when(F.col("o_orderstatus") == "P", "TTM").when(F.col("o_orderstatus") == "O", F.concat(label, F.lit("9m"))).otherwise(label)
    return o.select("o_orderkey", period_start(text).alias("period"))


# ---- table maintenance ---------------------------------------------------------------------------


def _halves(spark, sf):
    b = P.bars(spark, sf).select("tk", "d", "cl", "vol")
    return b.where("d < date'2000-07-01'"), b.where("d >= date'2000-01-01'").withColumn("vol", F.col("vol") + 1)


@query(
    "merge_insert_ignore",
    "SELECT tk, d, cl, CASE WHEN d < DATE '2000-07-01' THEN vol ELSE vol+1 END AS vol FROM bars",
    ("bars",),
)
def merge_insert_ignore(spark, sf):
    old, new = _halves(spark, sf)
    twice = new.unionByName(new.withColumn("vol", F.col("vol") + 5))
    return TB.insert_ignore(old, twice, ["tk", "d"], "vol")


@query(
    "merge_upsert",
    "SELECT tk, d, CASE WHEN d < DATE '2000-07-01' THEN cl END AS cl, CASE WHEN d < DATE '2000-01-01' THEN vol ELSE vol+1 END AS vol FROM bars",
    ("bars",),
)
def merge_upsert(spark, sf):
    old, new = _halves(spark, sf)
    return TB.upsert(old, new, ["tk", "d"], ["vol"])


@query(
    "merge_upsert_partitions",
    "SELECT tk, d, CASE WHEN d < DATE '2000-07-01' THEN cl END AS cl, CASE WHEN d < DATE '2000-01-01' THEN vol ELSE vol+1 END AS vol FROM bars",
    ("bars",),
)
def merge_upsert_partitions(spark, sf):
    """The same through a table in months: only months from 2000 on are rewritten."""
    old, new = _halves(spark, sf)
    table = VersionedTable(spark, stage_path(spark, "bars_by_month"), by_month("d")).create(old)
    table.merge(new, lambda rows, more: TB.upsert(rows, more, ["tk", "d"], ["vol"]))
    return table.read()


@query("merge_fill_null_partitions", "SELECT d, coalesce(ix50, ix500) AS ix50, ix500 FROM macro", ("macro",))
def merge_fill_null_partitions(spark, sf):
    """The same through a table in months: only months with a null are rewritten."""
    m = P.macro(spark, sf).select("d", "ix50", "ix500")
    table = VersionedTable(spark, stage_path(spark, "macro_by_month"), by_month("d")).create(m)
    holes = m.where("ix50 IS NULL").select("d", F.col("ix500").alias("ix50"))
    table.merge(holes, lambda rows, more: TB.fill_null(rows, more, ["d"], ["ix50"]))
    return table.read()


@query("merge_fill_null", "SELECT d, coalesce(ix50, ix500) AS ix50, ix500 FROM macro", ("macro",))
def merge_fill_null(spark, sf):
    m = P.macro(spark, sf)
    return TB.fill_null(m.select("d", "ix50", "ix500"), m.select("d", F.col("ix500").alias("ix50")), ["d"], ["ix50"])


@query(
    "merge_join_update",
    "SELECT tk, d, CASE WHEN d >= DATE '2000-01-01' THEN vol+1 ELSE vol END AS vol, CASE WHEN d >= DATE '2000-01-01' THEN 1 END AS touched FROM bars WHERE d < DATE '2000-07-01'",
    ("bars",),
)
def merge_join_update(spark, sf):
    old, new = _halves(spark, sf)
    return TB.join_update(old.select("tk", "d", "vol"), new.withColumn("touched", F.lit(1)), ["tk", "d"], ["vol", "touched"])


@query(
    "dedup_keep_last",
    """SELECT o_custkey, d, o_orderkey, o_totalprice FROM (SELECT *, CAST(o_orderdate AS DATE) AS d,
    row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k=1""",
)
def dedup_keep_last(spark, sf):
    o = P.table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), "o_orderkey", "o_totalprice")
    return TB.keep_last(o, ["o_custkey", "d"], "o_orderkey")


@query("anti_exclusion", "SELECT tk, d, cl FROM bars WHERE tk NOT IN (SELECT tk FROM eligible)", ("bars", "eligible"))
def anti_exclusion(spark, sf):
    return TB.drop_excluded(P.bars(spark, sf).select("tk", "d", "cl"), P.eligible(spark, sf), "tk")


@query("resume_pending_dates", "SELECT DISTINCT d FROM ofacts WHERE d NOT IN (SELECT d FROM bars WHERE d < DATE '2001-01-01')", ("ofacts", "bars"))
def resume_pending_dates(spark, sf):
    return INC.pending(P.order_facts(spark, sf), P.bars(spark, sf).where("d < date'2001-01-01'"), "d")


@query("resume_overlap", "SELECT tk, d, cl FROM bars WHERE d >= (SELECT max(d) - 5 FROM ofacts)", ("bars", "ofacts"))
def resume_overlap(spark, sf):
    return INC.since_high_water(P.bars(spark, sf).select("tk", "d", "cl"), P.order_facts(spark, sf))


@query(
    "resume_rewrite_latest",
    """SELECT 'month' AS kind, y*100+m AS k, fii FROM flow_m WHERE y*100+m >= 200006
    UNION ALL SELECT 'day', year(d)*10000+month(d)*100+day(d), fii FROM flow_d WHERE d > DATE '2000-12-31'""",
    ("flow_m", "flow_d"),
)
def resume_rewrite_latest(spark, sf):
    m = P.flow_monthly(spark, sf).select(F.lit("month").alias("kind"), (F.col("y") * 100 + F.col("m")).cast("bigint").alias("k"), "fii")
    v = P.flow_daily(spark, sf)
    day = INC.rewrite_latest(v, v.where("d <= date'2000-12-31'").groupBy().agg((F.lit("2000-12-31").cast("date")).alias("d")), "d", True)
    day = day.select(F.lit("day").alias("kind"), (F.year("d") * 10000 + F.month("d") * 100 + F.day("d")).cast("bigint").alias("k"), "fii")
    return INC.rewrite_latest(m, m.where("k <= 200006"), "k", False).unionByName(day)


@query(
    "incremental_with_context",
    f"SELECT tk, d, {r('x')} AS return_21d FROM (SELECT tk, d, {pc('cl', 21)} AS x FROM bars) WHERE d > DATE '2001-06-30' OR tk NOT IN (SELECT tk FROM eligible)",
    ("bars", "eligible"),
)
def incremental_with_context(spark, sf):
    b = P.bars(spark, sf).select("tk", "d", "cl")
    stored = b.join(P.eligible(spark, sf), "tk", "left_semi").where("d <= date'2001-06-30'")
    # eligible keys have history up to the stored date; their last stored row may be earlier
    out = INC.with_context(b, stored, TK, 22, lambda df: df.withColumns(E.simple_returns(TK, "cl", (21,))))
    return out.select("tk", "d", floor_round("return_21d").alias("return_21d"))
