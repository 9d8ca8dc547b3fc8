"""Panel views over the driver's star-schema tables.

They stand in for price bars, corporate actions, statements and market series, so that every operator runs on
the whole given tables: lineitem is the bar feed, orders the statements, flows and market series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.numeric import floor_round
from panelforge.functions.staging import published


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def money(c: str | Column) -> Column:
    """Exact two-decimal amount, so that sums do not depend on the order of addition."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def total(c: Column) -> Column:
    return F.sum(c).cast("double")


def part_brands(spark: SparkSession, sf: str) -> DataFrame:
    """Brand of every part, for joins with the feed. It is the one side that grows with the input, so it meets the feed in a shuffle and is not sent through the driver."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("tk")).hint("merge")


@published("bars")
def bars(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (brand, ship date). The feed is shuffled by part, narrow and once; partial aggregation runs before the shuffle by brand and date.

    Written once: every plan that holds it would read and shuffle the feed again, each time it names it.
    """
    line = table(spark, sf, "lineitem").select(
        "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", F.to_date("l_shipdate").alias("d")
    )
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        line.join(part_brands(spark, sf), "l_partkey")
        .groupBy("tk", "d")
        .agg(
            floor_round(F.min(F.when(F.col("l_linenumber") == 1, px)), 4).alias("op"),
            floor_round(F.max(px), 4).alias("hi"),
            floor_round(F.min(px), 4).alias("lo"),
            floor_round(total(money("l_extendedprice")) / total(money("l_quantity")), 4).alias("cl"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("vol"),
        )
    )


def sector(spark: SparkSession, sf: str) -> DataFrame:
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("tk")).distinct()
    n = F.regexp_extract("tk", r"(\d+)$", 1).cast("int")
    return brands.select("tk", F.concat(F.lit("S"), (n % 5).cast("string")).alias("sector"))


def eligible(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "part")
        .groupBy(F.col("p_brand").alias("tk"))
        .agg(F.sum("p_size").alias("s"), F.count(F.lit(1)).alias("n"))
        .where("s > 25 * n")
        .select("tk")
    )


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("tk"),
        F.to_date("o_orderdate").alias("d"),
        F.col("o_orderstatus").alias("st"),
        F.substring("o_orderpriority", 1, 1).alias("pr"),
        F.col("o_totalprice").alias("total"),
        money("o_totalprice").alias("amt"),
    )


def splits(spark: SparkSession, sf: str) -> DataFrame:
    """One corporate action per ticker and year: the day of the year's largest order."""
    top = order_facts(spark, sf).groupBy("tk", F.year("d").alias("y")).agg(
        F.max_by(F.struct("d", "st"), F.struct("total", "o_orderkey")).alias("e")
    )
    ratio = F.when(F.col("e.st") == "F", 2.0).when(F.col("e.st") == "O", 1.5).otherwise(1.0)
    return top.select("tk", F.col("e.d").alias("d"), ratio.alias("ratio"))


def fund(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly statements per ticker."""
    o = order_facts(spark, sf)

    def part_sum(cond: Column) -> Column:
        return total(F.when(cond, F.col("amt")))

    st, pr = F.col("st"), F.col("pr")
    f = o.groupBy("tk", F.make_date(F.year("d"), F.lit(12), F.lit(31)).alias("period")).agg(
        total(F.col("amt")).alias("revenue"),
        part_sum(st == "F").alias("net_income"),
        part_sum(pr.isin("1", "2")).alias("ebitda"),
        part_sum((st == "O") & (pr != "5")).alias("gross_profit"),
        part_sum(pr != "5").alias("total_assets"),
        part_sum(pr == "5").alias("total_debt"),
        part_sum(st == "P").alias("total_equity"),
        part_sum(pr == "3").alias("operating_cf"),
        part_sum((pr == "4") & (st != "O")).alias("free_cash_flow"),
        F.count(F.lit(1)).alias("n_orders"),
    )
    return f.withColumns(
        {
            "roa": floor_round(F.try_divide("net_income", "total_assets"), 4),
            "debt_to_equity": floor_round(F.try_divide("total_debt", "total_equity"), 4),
        }
    )


def macro(spark: SparkSession, sf: str) -> DataFrame:
    """Market series, one row per order day; a series is NULL on days without matching orders."""
    o = order_facts(spark, sf)
    st, pr = F.col("st"), F.col("pr")

    def mean(cond: Column) -> Column:
        hit = F.when(cond, F.col("amt"))
        return floor_round(total(hit) / F.nullif(F.count(hit), F.lit(0)).cast("double"), 4)

    return o.groupBy("d").agg(
        mean(st == "F").alias("ix50"),
        mean(F.lit(True)).alias("ix500"),
        F.count(F.lit(1)).cast("double").alias("fx"),
        mean(pr == "1").alias("vix"),
        mean(pr == "3").alias("crude"),
        mean(pr == "4").alias("gold"),
    )


def policy(spark: SparkSession, sf: str) -> DataFrame:
    """Policy rate change points: first order day of each quarter."""
    q = F.year("d") * 4 + F.quarter("d")
    return (
        order_facts(spark, sf)
        .groupBy(q.alias("q"))
        .agg(F.min("d").alias("d"))
        .select("d", (F.lit(4.0) + (F.col("q") % 5) * 0.25).alias("rate"))
    )


def flow_monthly(spark: SparkSession, sf: str) -> DataFrame:
    net = _net_flows()
    return order_facts(spark, sf).groupBy(F.year("d").alias("y"), F.month("d").alias("m")).agg(*net)


def flow_days(spark: SparkSession, sf: str) -> DataFrame:
    return order_facts(spark, sf).groupBy("d").agg(*_net_flows())


def flow_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily flows exist from 2000 on."""
    return order_facts(spark, sf).where("d >= date'2000-01-01'").groupBy("d").agg(*_net_flows())


def _net_flows() -> list[Column]:
    st = F.col("st")
    zero = F.lit(0).cast("decimal(18,2)")
    buy_f, sell, buy_d = (F.when(st == s, F.col("amt")).otherwise(zero) for s in ("F", "O", "P"))
    return [
        (F.sum(buy_f) - F.sum(sell)).cast("double").alias("fii"),
        (F.sum(buy_d) - F.sum(sell)).cast("double").alias("dii"),
    ]
