"""SQL text of the panel views, for the independent checks in another SQL engine.

Each view lists the views it needs; :func:`with_views` puts them in order in one WITH clause.
"""

from __future__ import annotations


def r(x: str, n: int = 6) -> str:
    """Same rounding as ``floor_round`` for values of less than 2^52 units."""
    return f"(floor(({x})*1e{n}+0.5)/1e{n})"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (needs, sql)


def with_views(*names: str, body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in VIEWS[n][0]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(
        f"{n} AS ({VIEWS[n][1]})" if f"FROM {n} " in VIEWS[n][1] else f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order
    )
    head = "WITH RECURSIVE" if any("UNION ALL" in VIEWS[n][1] and f"FROM {n} " in VIEWS[n][1] for n in order) else "WITH"
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"{head} {ctes},\n{body[5:]}"
    return f"{head} {ctes}\n{body}"


view(
    "bars",
    f"""SELECT p_brand AS tk, CAST(l_shipdate AS DATE) AS d,
  {r("min(CASE WHEN l_linenumber=1 THEN l_extendedprice/l_quantity END)", 4)} AS op,
  {r("max(l_extendedprice/l_quantity)", 4)} AS hi, {r("min(l_extendedprice/l_quantity)", 4)} AS lo,
  {r("CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)/CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)", 4)} AS cl,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS vol
FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2""",
)
view(
    "sector",
    "SELECT DISTINCT p_brand AS tk, 'S' || CAST(CAST(regexp_extract(p_brand,'(\\d+)$',1) AS INT) % 5 AS VARCHAR) AS sector FROM part",
)
view("eligible", "SELECT p_brand AS tk FROM part GROUP BY 1 HAVING sum(p_size) > 25*count(*)")
view(
    "ofacts",
    """SELECT o_orderkey, 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS tk, CAST(o_orderdate AS DATE) AS d,
  o_orderstatus AS st, substr(o_orderpriority,1,1) AS pr, o_totalprice AS total,
  CAST(o_totalprice AS DECIMAL(18,2)) AS amt FROM orders""",
)
view(
    "splits",
    """SELECT tk, d, CASE st WHEN 'F' THEN 2.0::DOUBLE WHEN 'O' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS ratio FROM
  (SELECT *, row_number() OVER (PARTITION BY tk, year(d) ORDER BY total DESC, o_orderkey DESC) AS k FROM ofacts) WHERE k=1""",
    "ofacts",
)


def _psum(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN amt END) AS DOUBLE)"


view(
    "fund",
    f"""SELECT *, {r("net_income/nullif(total_assets,0)", 4)} AS roa,
  {r("total_debt/nullif(total_equity,0)", 4)} AS debt_to_equity FROM (
  SELECT tk, make_date(year(d)::INT,12,31) AS period, CAST(sum(amt) AS DOUBLE) AS revenue,
  {_psum("st='F'")} AS net_income, {_psum("pr IN ('1','2')")} AS ebitda,
  {_psum("st='O' AND pr<>'5'")} AS gross_profit, {_psum("pr<>'5'")} AS total_assets,
  {_psum("pr='5'")} AS total_debt, {_psum("st='P'")} AS total_equity, {_psum("pr='3'")} AS operating_cf,
  {_psum("pr='4' AND st<>'O'")} AS free_cash_flow, count(*) AS n_orders
  FROM ofacts GROUP BY 1,2)""",
    "ofacts",
)


def _mean(cond: str) -> str:
    return r(f"{_psum(cond)}/CAST(nullif(count(CASE WHEN {cond} THEN 1 END),0) AS DOUBLE)", 4)


view(
    "macro",
    f"""SELECT d, {_mean("st='F'")} AS ix50, {_mean("true")} AS ix500, CAST(count(*) AS DOUBLE) AS fx,
  {_mean("pr='1'")} AS vix, {_mean("pr='3'")} AS crude, {_mean("pr='4'")} AS gold FROM ofacts GROUP BY 1""",
    "ofacts",
)
view(
    "policy",
    "SELECT min(d) AS d, 4.0::DOUBLE + ((year(d)*4+quarter(d)) % 5)*0.25::DOUBLE AS rate FROM ofacts GROUP BY year(d)*4+quarter(d)",
    "ofacts",
)
_NET = """CAST(sum(CASE WHEN st='F' THEN amt ELSE 0 END) - sum(CASE WHEN st='O' THEN amt ELSE 0 END) AS DOUBLE) AS fii,
  CAST(sum(CASE WHEN st='P' THEN amt ELSE 0 END) - sum(CASE WHEN st='O' THEN amt ELSE 0 END) AS DOUBLE) AS dii"""
view("flow_m", f"SELECT CAST(year(d) AS INT) AS y, CAST(month(d) AS INT) AS m, {_NET} FROM ofacts GROUP BY 1,2", "ofacts")
view("flow_all", f"SELECT d, {_NET} FROM ofacts GROUP BY 1", "ofacts")
view("flow_d", f"SELECT d, {_NET} FROM ofacts WHERE d >= DATE '2000-01-01' GROUP BY 1", "ofacts")
