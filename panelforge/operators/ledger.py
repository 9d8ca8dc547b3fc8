"""Position book, cash ledger, realised results and capital reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.numeric import clip, floor_round, norm_ppf, safe_ratio
from panelforge.operators.bars import latest_per_key

# One-way cost items in basis points, tax rates before and from the cut-off date, and day limits.
COST_ITEMS = {"brokerage": 3.0, "stamp_duty": 1.5, "transaction_tax": 10.0, "slippage": 5.0, "exchange": 0.345}
ENTRY_ONLY = ("stamp_duty",)
TAX_CUTOFF = "2024-07-23"
TAX_OLD, TAX_NEW = (0.15, 0.10), (0.20, 0.125)
LONG_TERM_DAYS = 365
TOTAL_BPS = sum(COST_ITEMS.values())


def cash_balance(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("cash"))


def deployed(book: DataFrame) -> DataFrame:
    return book.where("status = 'open'").agg(F.coalesce(F.sum(F.col("entry_price") * F.col("shares")), F.lit(0.0)).alias("deployed"))


def seed_ledger(ledger: DataFrame, first: DataFrame) -> DataFrame:
    """Add the initial row only to an empty ledger."""
    empty = ledger.agg(F.count(F.lit(1)) == 0).scalar()
    return ledger.unionByName(first.where(empty))


def mark_to_market(book: DataFrame, prices: DataFrame, price: str = "cl") -> DataFrame:
    """Open positions at the latest price, the entry price where there is none."""
    last = latest_per_key(prices.select("tk", "d", price), ["tk"], "d").select("tk", F.col(price).alias("_p"))
    return book.where("status = 'open'").join(last, "tk", "left").withColumn("current_price", F.coalesce("_p", "entry_price")).drop("_p")


def _stopped() -> Column:
    p, stop, long = F.col("current_price"), F.col("stop_price"), F.col("direction") == "long"
    return F.coalesce(F.when(long, p <= stop).otherwise(p >= stop), F.lit(False))


def _losing() -> Column:
    p, e, long = F.col("current_price"), F.col("entry_price"), F.col("direction") == "long"
    return F.coalesce(F.when(long, p < e).otherwise(p > e), F.lit(False))


def close_flags(marked: DataFrame, proposed: DataFrame) -> DataFrame:
    """Open positions not proposed again, with the reason to close them (NULL: keep)."""
    gone = marked.join(proposed.select("pid", "tk").distinct(), ["pid", "tk"], "left_anti")
    return gone.withColumn("reason", F.when(_stopped(), "stop_loss").when(_losing(), "underperforming"))


def capacity_trim(flagged: DataFrame, marked: DataFrame, proposed: DataFrame, max_positions: int = 45) -> DataFrame:
    """Close the worst of the positions that would be kept, as far as new names need their slots."""
    names = proposed.select("pid", "tk").distinct()
    new = names.join(marked.select("pid", "tk"), ["pid", "tk"], "left_anti").groupBy("pid").agg(F.count(F.lit(1)).alias("_new"))
    open_ = marked.groupBy("pid").agg(F.count(F.lit(1)).alias("_open"))
    closing = flagged.where("reason is not null").groupBy("pid").agg(F.count(F.lit(1)).alias("_closing"))
    over = open_.join(new, "pid", "left").join(closing, "pid", "left").fillna(0).select(
        "pid", (F.col("_open") - F.col("_closing") + F.col("_new") - max_positions).alias("_over")
    )
    sign = F.when(F.col("direction") == "short", -1.0).otherwise(1.0)
    pnl = safe_ratio(F.col("current_price") - F.col("entry_price"), "entry_price") * sign
    rest = flagged.where("reason is null").withColumn("_pnl", pnl)
    w = Window.partitionBy("pid").orderBy("_pnl", "tk")
    worst = rest.withColumn("_k", F.row_number().over(w)).join(over, "pid").where(F.col("_k") <= F.col("_over"))
    return worst.withColumn("reason", F.lit("capacity_trim")).drop("_k", "_over", "_pnl")


def tax_rates(when: Column) -> tuple[Column, Column]:
    """(short-term, long-term) rate at a date."""
    new = when >= F.lit(TAX_CUTOFF).cast("date")
    return F.when(new, TAX_NEW[0]).otherwise(TAX_OLD[0]), F.when(new, TAX_NEW[1]).otherwise(TAX_OLD[1])


def realise(closing: DataFrame, when: Column) -> DataFrame:
    """Profit, holding days, tax and net result of positions closed at their current price."""
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    pnl = floor_round((F.col("current_price") - F.col("entry_price")) * F.col("shares") * sign, 2)
    out = closing.withColumns({"pnl": pnl, "holding_days": F.date_diff(when, "entry_date"), "exit_date": when})
    rate = F.when(F.col("holding_days") < LONG_TERM_DAYS, TAX_NEW[0]).otherwise(TAX_NEW[1])
    tax = F.when(F.col("pnl") > 0, floor_round(F.col("pnl") * rate, 2)).otherwise(0.0)
    return out.withColumn("tax", tax).withColumn("net_pnl", floor_round(F.col("pnl") - F.col("tax"), 2))


def credits(realised: DataFrame) -> DataFrame:
    """Ledger rows for non-zero net results."""
    return realised.where("net_pnl <> 0").select(
        F.col("exit_date").alias("tx_date"), F.lit("pnl_credit").alias("tx_type"), F.col("net_pnl").alias("amount"),
        F.concat_ws(" ", "pid", "tk", "direction").alias("reference"),
    )


def open_new(proposed: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows for proposed names not yet open: whole shares, stop price and position class.

    ``proposed``: (pid, tk, direction, d, size, alloc, price, is_midcap).
    """
    new = proposed.join(marked.select("pid", "tk"), ["pid", "tk"], "left_anti")
    long, price = F.col("direction") == "long", F.col("price")
    ok = price > 0
    shares = F.when(ok, F.floor(safe_ratio("alloc", price)))
    return new.select(
        "pid", "tk", "direction", F.col("d").alias("entry_date"), F.when(ok, price).alias("entry_price"),
        F.when(F.col("direction") == "short", "short").when(F.col("is_midcap"), "alpha_long").otherwise("core_long").alias("position_class"),
        F.when(ok, floor_round(price * F.when(long, 0.85).otherwise(1.10), 4)).alias("stop_price"),
        F.when(shares > 0, shares).alias("shares"), F.lit("open").alias("status"),
    )


def already_committed(book: DataFrame, proposed: DataFrame, share: float = 0.8) -> DataFrame:
    """Portfolios whose proposals of the date are mostly in the book already."""
    have = book.groupBy("pid").agg(F.count(F.lit(1)).alias("_have"))
    want = proposed.groupBy("pid").agg(F.count(F.lit(1)).alias("_want"))
    return have.join(want, "pid").where(F.col("_have") >= F.col("_want") * share).select("pid")


Z_ANCHOR = 0.925


def expected_return(direction: Column, rank: Column) -> Column:
    """Annual return in percent from the rank's normal quantile: 15 at the anchor rank, capped at 18."""
    p = clip(F.when(direction == "long", rank).otherwise(1.0 - rank), 0.01, 0.99)
    z = norm_ppf(p) / norm_ppf(F.lit(Z_ANCHOR))
    return clip(F.least(z, F.lit(18.0 / 15.0)) * 15.0, -60.0, 60.0)


def project(positions: DataFrame, entries: DataFrame, today: Column, horizon: int = 21) -> DataFrame:
    """Days held, new flag, expected gain, tax and net gain of each position (pid, tk, direction, alloc, final_rank, d)."""
    known = entries.select("pid", "tk", F.col("entry_date").alias("_e"))
    df = positions.join(known, ["pid", "tk"], "left").withColumn("final_rank", F.coalesce("final_rank", F.lit(0.5)))
    held = F.greatest(F.date_diff(today, "_e"), F.lit(0))
    df = df.withColumns({"is_new": F.col("_e").isNull(), "days_held": F.coalesce(held, F.lit(0))})
    short, long = tax_rates(F.col("d"))
    df = df.withColumn("tax_rate", F.when(F.col("days_held") + horizon >= LONG_TERM_DAYS, long).otherwise(short))
    df = df.withColumn("ann_return", floor_round(expected_return(F.col("direction"), F.col("final_rank")), 6))
    df = df.withColumn("gain", F.col("alloc") * F.col("ann_return") / 100)
    return df.withColumn("tax", F.greatest(F.col("gain"), F.lit(0.0)) * F.col("tax_rate")).withColumn("net_gain", F.col("gain") - F.col("tax")).drop("_e")


def capital_summary(projected: DataFrame, nav: float) -> DataFrame:
    """Deployed capital by side, cash left, entry and exit cost and the expected percentage per portfolio."""

    def cents(c: str, cond: Column | None = None) -> Column:
        """Exact sum of two-decimal amounts."""
        x = floor_round(c, 2).cast("decimal(18,2)")
        return F.coalesce(F.sum(x if cond is None else F.when(cond, x)).cast("double"), F.lit(0.0))

    g = projected.groupBy("pid").agg(
        cents("alloc").alias("deployed"), cents("alloc", F.col("direction") == "long").alias("long_book"),
        cents("alloc", F.col("direction") == "short").alias("short_book"), cents("gain").alias("gain"), cents("tax").alias("tax"),
    )
    cost = F.col("deployed") * TOTAL_BPS / 10_000
    return g.withColumns(
        {"remaining": F.lit(nav) - F.col("deployed"), "entry_cost": cost, "exit_cost": cost, "expected_pct": safe_ratio("gain", "deployed") * 100}
    )


def capital_waterfall(summary: DataFrame, nav: float) -> DataFrame:
    """Steps from available cash to the final value as rows; stamp duty is paid on entry only."""
    both = sum(v for k, v in COST_ITEMS.items() if k not in ENTRY_ONLY) * 2 + sum(COST_ITEMS[k] for k in ENTRY_ONLY)
    fees = F.col("deployed") * both / 10_000
    steps = [
        ("available_cash", F.lit(nav)), ("cash_held", -F.col("remaining")), ("gross_gain", F.col("gain")),
        ("transaction_costs", -fees), ("tax", -F.col("tax")), ("final_nav", F.lit(nav) + F.col("gain") - F.col("tax")),
    ]
    items = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), v.alias("value")) for i, (n, v) in enumerate(steps)])
    return summary.select("pid", F.explode(items).alias("i")).select("pid", "i.*")
