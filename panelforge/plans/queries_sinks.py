"""Checked CSV sinks of signals, NAV and metrics, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.numeric import floor_round
from panelforge.functions.staging import stage_path
from panelforge.plans.oracle_views import r
from panelforge.plans.queries_backtest import bt_nav, perf_metrics
from panelforge.plans.queries_signals import signals
from panelforge.plans.registry import ORACLE, query
from panelforge.sources.checked import CheckedCsv, Expect


def through(df, name, expect):
    """Write ``df`` to a checked sink and read the published load."""
    sink = CheckedCsv(df.sparkSession, stage_path(df.sparkSession, name))
    sink.write(df, expect)
    return sink.read()


@query("sink_signals", f"SELECT tk, d, {r('final_rank')} AS final_rank, signal FROM sig", ("sig",))
def sink_signals(spark, sf):
    rows = signals(spark, sf).select("tk", "d", floor_round("final_rank").alias("final_rank"), F.col("signal").cast("int").alias("signal"))
    return through(rows, "signals_csv", Expect(required=("tk", "d", "signal"), day="d", ranges={"signal": (-1, 1), "final_rank": (0, 1)}))


@query("sink_nav", ORACLE["bt_nav"])
def sink_nav(spark, sf):
    return through(bt_nav(spark, sf), "nav_csv", Expect(required=("d", "nav"), day="d", ranges={"nav": (0, float("inf"))}))


@query("sink_metrics", ORACLE["perf_metrics"])
def sink_metrics(spark, sf):
    return through(perf_metrics(spark, sf), "metrics_csv", Expect(max_rows=1, required=("days", "total_return"), day="end_date", ranges={"max_dd": (-1, 0)}))
