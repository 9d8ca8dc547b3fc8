"""Rebalance selection, holding paths, NAV series and performance statistics.

NAV and benchmark series have one row per date; paths are bounded by the length of one holding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.asof import asof_join
from panelforge.functions.numeric import clip, floor_round, safe_ratio
from panelforge.functions.ranking import quantiles
from panelforge.functions.windows import MARKET, Axis

COST_BPS = 19.5
RISK_FREE = 0.065


def clipped_returns(axis: Axis, c: str, bound: float = 0.5) -> Column:
    return clip(axis.pct_change(c), -bound, bound)


def rebalance_dates(dates: DataFrame, gap_days: int = 14) -> DataFrame:
    """Greedy choice: the first date, then each first date at least ``gap_days`` after the last chosen one."""
    listed = dates.select("d").distinct().agg(F.array_sort(F.collect_list("d")).alias("ds"))
    none = F.array().cast("array<date>")
    chosen = F.aggregate(
        "ds",
        none,
        lambda acc, x: F.when(
            (F.size(acc) == 0) | (F.date_diff(x, F.element_at(acc, F.when(F.size(acc) == 0, 1).otherwise(F.size(acc)))) >= gap_days),
            F.array_append(acc, x),
        ).otherwise(acc),
    )
    return listed.select(F.explode(F.filter(chosen, lambda x: x.isNotNull())).alias("d"))


def signal_date_before(rebalances: DataFrame, signal_dates: DataFrame) -> DataFrame:
    """Last signal date strictly before each rebalance date."""
    right = signal_dates.select(F.col("d").alias("signal_d")).distinct()
    return asof_join(rebalances.select("d").distinct(), right, [], "d", "signal_d", ["signal_d"], strict=True, left_unique=True)


def top_k(signals: DataFrame, k: int = 35, threshold: float = 0.85, least: int = 3) -> DataFrame:
    """Best ``k`` above the threshold, else best ``k`` at all, else nothing when fewer than ``least`` names exist."""
    counts = signals.groupBy("d").agg(
        F.count("final_rank").alias("_n"), F.count_if(F.col("final_rank") >= threshold).alias("n_above")
    )
    w = Window.partitionBy("d").orderBy(F.desc("final_rank"), "tk")
    best = signals.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).join(counts, "d")
    enough = F.col("n_above") >= least
    keep = F.when(enough, F.col("final_rank") >= threshold).otherwise(F.col("_n") >= least)
    reason = F.when(enough, "above").otherwise("top")
    return best.where(keep).withColumn("reason", reason).drop("_n")


def short_picks(signals: DataFrame, eligible: DataFrame, k: int = 6, at: float = 0.05, regimes: Sequence[int] = (1, 2)) -> DataFrame:
    """Lowest ranks in falling regimes; the eligibility list applies after the pick."""
    w = Window.partitionBy("d").orderBy("final_rank", "tk")
    low = signals.where(F.col("regime_int").isin(*regimes) & (F.col("final_rank") <= at))
    return low.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).join(eligible.select("tk"), "tk", "left_semi")


def holding_paths(holdings: DataFrame, returns: DataFrame, stop: float = -0.12) -> DataFrame:
    """Value, high-water mark and stop flag of each holding from entry to exit date.

    ``holdings``: (hid, tk, entry_d, exit_d, alloc), not overlapping per ticker, so each return row belongs to the last
    entry at or before it. Profit adds up, none on the entry date or a missing return; after
    the first breach the holding is closed.
    """
    hit = asof_join(returns, holdings, ["tk"], "d", "entry_d", ["hid", "entry_d", "exit_d", "alloc"], left_unique=True)
    path = hit.where(F.col("hid").isNotNull() & (F.col("exit_d").isNull() | (F.col("d") < F.col("exit_d"))))
    axis = Axis(("hid",), "d")
    gain = F.when(F.col("d") > F.col("entry_d"), F.coalesce("ret", F.lit(0.0))).otherwise(0.0)
    path = path.withColumn("_gain", gain)
    path = path.withColumn("value", F.col("alloc") * (1 + axis.running(F.sum, "_gain")))
    path = path.withColumn("high_water", F.greatest(axis.running(F.max, "value"), F.col("alloc")))
    path = path.withColumn("drawdown", safe_ratio("value", "high_water") - 1)
    breach = F.when((F.col("drawdown") <= stop) & (F.col("d") > F.col("entry_d")), F.col("d"))
    path = path.withColumn("_breach", breach)
    path = path.withColumn("stop_d", F.min("_breach").over(axis.whole()))
    return path.withColumn("is_open", F.col("stop_d").isNull() | (F.col("d") < F.col("stop_d"))).drop("_gain", "_breach")


def position_drawdown(paths: DataFrame) -> DataFrame:
    """Drawdown of all open positions together, against the sum of their high-water marks."""
    return paths.where("is_open").groupBy("d").agg((safe_ratio(F.sum("value"), F.sum("high_water")) - 1).alias("true_dd"))


def worst_open_drawdown(paths: DataFrame) -> DataFrame:
    return paths.where("is_open").groupBy("d").agg(F.min("drawdown").alias("worst_dd"))


def nav_series(weights: DataFrame, returns: DataFrame, by: Sequence[str] = (), cost_bps: float = COST_BPS) -> DataFrame:
    """NAV of target weights held from their date to the next one, with costs on turnover.

    ``weights``: (*by, d, end_d, tk, w), one set per rebalance date (``end_d`` NULL for the last). Every day is mapped
    to the last set strictly before it, on distinct dates, and then meets that set by an equi-join.
    """
    sets = weights.select(F.col("d").alias("set_d")).distinct()
    days = asof_join(returns.select("d").distinct(), sets, [], "d", "set_d", ["set_d"], strict=True, left_unique=True)
    moved = returns.join(days, "d").where("set_d is not null").withColumnRenamed("d", "day")
    held = weights.select(*by, F.col("d").alias("set_d"), "tk", "w").join(moved, ["set_d", "tk"])
    daily = held.groupBy(*by, "day").agg(F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("gross"))
    axis = Axis((*by, "tk"), "d")
    same = F.lag("end_d").over(axis.ordered()) == F.col("d")
    before = F.when(same, axis.shift("w")).otherwise(0.0)
    follow = F.lead("d").over(axis.ordered()) == F.col("end_d")
    moves = weights.withColumns({"_in": F.abs(F.col("w") - F.coalesce(before, F.lit(0.0))), "_out": F.when(F.coalesce(follow, F.lit(False)), 0.0).otherwise(F.col("w"))})
    enter = moves.groupBy(*by, F.col("d").alias("day")).agg(F.sum("_in").alias("t"))
    leave = moves.groupBy(*by, F.col("end_d").alias("day")).agg(F.sum("_out").alias("t"))
    turn = enter.unionByName(leave).where("day is not null").groupBy(*by, "day").agg(F.sum("t").alias("turnover"))
    out = daily.join(turn, [*by, "day"], "full_outer")
    net = F.coalesce("gross", F.lit(0.0)) - F.coalesce("turnover", F.lit(0.0)) * cost_bps / 10_000
    out = out.withColumn("ret", net)
    return out.select(*by, F.col("day").alias("d"), "ret", compounded("ret", Axis(tuple(by), "day")).alias("nav"))


def compounded(ret: str, axis: Axis) -> Column:
    """Running product of 1 + return; a loss of everything or more leaves zero for good."""
    alive = axis.running(F.min, F.coalesce(F.col(ret), F.lit(0.0))) > -1
    logs = F.when(F.col(ret) > -1, F.ln(1 + F.col(ret))).otherwise(0.0)
    return F.when(alive, F.exp(axis.running(F.sum, logs))).otherwise(0.0)


def drawdown_series(nav: DataFrame, by: Sequence[str] = (), c: str = "nav") -> DataFrame:
    return nav.withColumn("drawdown", safe_ratio(c, Axis(tuple(by), "d").running(F.max, c)) - 1)


def max_drawdown(nav: DataFrame, by: Sequence[str] = (), c: str = "nav") -> DataFrame:
    dd = drawdown_series(nav, by, c)
    return dd.groupBy(*by).agg(F.min("drawdown").alias("max_dd"), F.min_by("d", F.struct("drawdown", "d")).alias("max_dd_date"))


def metrics(nav: DataFrame, by: Sequence[str] = (), rf: float = RISK_FREE) -> DataFrame:
    """Return, annual growth and volatility, Sharpe of growth over the risk-free rate, drawdown, Calmar, win rate (days
    that gain more than rounding noise).

    With a column ``true_dd`` (drawdown at position level) also its minimum and the Calmar ratio against it.
    """
    true_dd = F.min("true_dd") if "true_dd" in nav.columns else F.lit(None).cast("double")
    axis = Axis(tuple(by), "d")
    d = drawdown_series(nav, by).withColumn("_r", axis.pct_change("nav"))
    g = d.groupBy(*by).agg(
        F.min("d").alias("start_date"), F.max("d").alias("end_date"),
        F.min_by("nav", "d").alias("_first"), F.max_by("nav", "d").alias("_last"),
        F.count("_r").alias("days"), F.stddev_samp("_r").alias("_sd"), F.min("drawdown").alias("max_dd"), true_dd.alias("true_max_dd"),
        (F.count_if(F.col("_r") > 1e-12) / F.nullif(F.count("_r"), F.lit(0))).alias("win_rate"),
    )
    g = g.withColumn("total_return", safe_ratio("_last", "_first") - 1)
    years = F.greatest(F.col("days") / F.lit(252.0), F.lit(0.001))
    g = g.withColumns({"cagr": F.pow(1 + F.col("total_return"), 1 / years) - 1, "vol_ann": F.col("_sd") * F.sqrt(F.lit(252.0))})
    return g.withColumns(
        {
            "sharpe": F.when(F.col("vol_ann") > 0, (F.col("cagr") - rf) / F.col("vol_ann")).otherwise(0.0),
            "calmar": F.when(F.col("max_dd") != 0, F.col("cagr") / F.abs("max_dd")).otherwise(0.0),
            "true_calmar": F.when(F.col("true_max_dd").isNull() | (F.col("true_max_dd") != 0), F.col("cagr") / F.abs("true_max_dd")).otherwise(0.0),
        }
    ).drop("_first", "_last", "_sd")


def yearly_returns(nav: DataFrame) -> DataFrame:
    """First-to-last return of each year with at least two rows."""
    y = nav.groupBy(F.year("d").alias("year")).agg(F.min_by("nav", "d").alias("a"), F.max_by("nav", "d").alias("b"), F.count(F.lit(1)).alias("days"))
    return y.where("days >= 2").select("year", "days", (safe_ratio("b", "a") - 1).alias("ret"))


def benchmark(series: DataFrame, start: Column, end: Column, candidates: Sequence[str]) -> DataFrame:
    """Return and worst drawdown of the first candidate column that has data in the window."""
    rows = series.where(F.col("d").between(start, end))
    items = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("name"), F.col(c).cast("double").alias("nav")) for i, c in enumerate(candidates)])
    long = rows.select("d", F.explode(items).alias("i")).select("d", "i.*").where("nav is not null")
    dd = drawdown_series(long, ("ord", "name"))
    per = dd.groupBy("ord", "name").agg(
        (safe_ratio(F.max_by("nav", "d"), F.min_by("nav", "d")) - 1).alias("total_return"), F.min("drawdown").alias("max_dd")
    )
    return per.orderBy("ord").limit(1).select("name", "total_return", "max_dd")


def monte_carlo(nav: DataFrame, sims: int = 1000, seed: int = 42) -> DataFrame:
    """Drawdown distribution over shuffles of the daily returns, and the place of the real drawdown in it.

    Every shuffle orders the dates by the MD5 of "date|simulation|seed", so the result does not depend on tasks or engine.
    """
    rets = nav.withColumn("ret", MARKET.pct_change("nav")).where("ret is not null").select("d", "ret")
    sim = rets.select("*", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim"))
    sim = sim.withColumn("_o", F.md5(F.concat_ws("|", F.col("d").cast("string"), "sim", F.lit(seed)).cast("binary")))
    order = Axis(("sim",), "_o")
    sim = sim.withColumn("nav", compounded("ret", order))
    sim = sim.withColumn("dd", safe_ratio("nav", order.running(F.max, "nav")) - 1)
    worst = sim.groupBy("sim").agg(F.min("dd").alias("dd"))
    real = max_drawdown(nav).select("max_dd").scalar()
    q = F.percentile("dd", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return worst.agg(q.alias("q"), (F.count_if(F.col("dd") <= real) * 100.0 / F.count("dd")).alias("real_percentile")).select(
        F.col("q")[0].alias("p05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p95"), "real_percentile"
    )


def index_100(nav: DataFrame, bench: DataFrame) -> DataFrame:
    """Both series rebased to 100 at their first row, joined on date."""
    def rebase(df: DataFrame, c: str, out: str) -> DataFrame:
        return df.where(F.col(c).isNotNull()).select("d", (safe_ratio(c, F.first(c).over(MARKET.rows(Window.unboundedPreceding, 0))) * 100).alias(out))

    return rebase(nav, "nav", "portfolio_idx").join(rebase(bench, "bench", "bench_idx"), "d", "left")


def rolling_sharpe(nav: DataFrame, n: int = 63) -> DataFrame:
    r = nav.withColumn("ret", MARKET.pct_change("nav"))
    full = MARKET.roll(F.avg, "ret", n) / F.nullif(MARKET.roll(F.stddev_samp, "ret", n), F.lit(0.0))
    return r.select("d", (full * F.sqrt(F.lit(252.0))).alias("sharpe"))


def return_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("ret").alias("n_returns"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("tk").alias("tickers"), F.min("d").alias("first_date"),
        F.max("d").alias("last_date"), F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("std_ret"),
    )


def date_overlap(a: DataFrame, b: DataFrame, nav: DataFrame) -> DataFrame:
    """Dates of two frames and in both, and dates that occur twice in a series."""
    da, db = a.select("d").distinct(), b.select("d").distinct()
    both = da.withColumn("a", F.lit(1)).join(db.withColumn("b", F.lit(1)), "d", "full_outer")
    twice = nav.groupBy("d").count().where("count > 1").agg(F.count(F.lit(1))).scalar()
    return both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("n_both")).withColumn("n_duplicates", twice)


def wide(df: DataFrame, value: str, limit: int = 2000) -> DataFrame:
    """One column per ticker in the data, one row per date; more tickers than ``limit`` are an error, use the long form then."""
    names = [x.tk for x in df.select("tk").distinct().orderBy("tk").limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} tickers")
    return df.groupBy("d").pivot("tk", names).agg(F.first(value))


def rebalance_summary(picks: DataFrame) -> DataFrame:
    per = picks.groupBy("d", "reason").agg(F.count(F.lit(1)).alias("n"), F.max("n_above").alias("n_above"))
    return per.groupBy("reason").agg(F.count(F.lit(1)).alias("rebalances"), F.avg("n").alias("mean_names"), F.avg("n_above").alias("mean_above"))


def with_grid(df: DataFrame, grid: Sequence[dict[str, float]]) -> DataFrame:
    """Repeat every row for each parameter set of a fixed grid, as columns ``param_id`` and the parameters."""
    sets = F.array(*[F.struct(F.lit(i).alias("param_id"), *[F.lit(v).alias(k) for k, v in g.items()]) for i, g in enumerate(grid)])
    return df.withColumn("_g", F.explode(sets)).select(*df.columns, "_g.*")
