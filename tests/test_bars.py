"""The bar table is written once and read by every plan that names it."""

import datetime as dt

from panelforge.plans import queries_bars
from panelforge.sources import panel as P

LINE = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate date"


def lines(spark, folder, rows, mode="overwrite"):
    spark.createDataFrame(rows, LINE).write.mode(mode).parquet(f"{folder}/lineitem.parquet")


def test_bars_are_written_once_and_follow_their_input(spark, tmp_path):
    sf, day = str(tmp_path), dt.date(2000, 1, 3)
    spark.createDataFrame([(1, "Brand#11"), (2, "Brand#11"), (2, "Brand#12"), (3, None)], "p_partkey long, p_brand string").write.parquet(f"{sf}/part.parquet")
    lines(spark, sf, [(1, 1, 1, 2.0, 20.0, day), (1, 2, 2, 1.0, 30.0, day), (2, 3, 1, 1.0, 5.0, day), (3, None, 1, 1.0, 7.0, day), (4, 1, 1, 1.0, 9.0, None)])
    one, two = P.bars(spark, sf), P.bars(spark, sf)
    assert one.inputFiles() and sorted(one.inputFiles()) == sorted(two.inputFiles())
    assert not any("part.parquet" in f or "lineitem.parquet" in f for f in one.inputFiles())  # neither joined nor sent to the driver again
    want = {("Brand#11", day, 10.0, 30.0, 10.0, 16.6667, 3), ("Brand#12", day, None, 30.0, 30.0, 30.0, 1), (None, day, 5.0, 5.0, 5.0, 5.0, 1), ("Brand#11", None, 9.0, 9.0, 9.0, 9.0, 1)}
    assert {tuple(r) for r in one.collect()} == want
    lines(spark, sf, [(5, 2, 1, 1.0, 40.0, day)], "append")
    assert {tuple(r) for r in P.bars(spark, sf).where("tk = 'Brand#12'").collect()} == {("Brand#12", day, 40.0, 40.0, 30.0, 35.0, 2)}


def test_parts_meet_the_feed_without_the_driver(spark):
    """However few the parts are, they are shuffled: what the driver gets must not grow with them."""
    sf = "/root/testdata/sf0.001"
    for df in (P.bars.__wrapped__(spark, sf), queries_bars.bars_universe_semi(spark, sf).select("tk")):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        with_part = [line for line in plan.splitlines() if "l_partkey" in line and "Join" in line]
        assert with_part and all("SortMergeJoin" in line for line in with_part)
