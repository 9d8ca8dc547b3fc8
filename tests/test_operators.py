"""Operator behaviour on small frames: invariants, edge cases and independent re-computation."""

import datetime as dt
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from panelforge.functions.asof import asof_join
from panelforge.functions.numeric import floor_round, half_even
from panelforge.functions.staging import published
from panelforge.functions.windows import Axis
from panelforge.operators import backtest as BT
from panelforge.operators import features as E
from panelforge.operators import mlprep as ML
from panelforge.operators import risk as RK
from panelforge.operators import tables as TB
from panelforge.sources import panel as P
from panelforge.sources import readers as S
from panelforge.streaming import incremental as INC

SMALL = "/root/testdata/sf0.001"
TK = Axis(("tk",), "d")


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def rows(df, *order):
    return sorted(tuple(r) for r in df.select(*order).collect())


def test_upsert_is_idempotent_and_insert_ignore_keeps_old(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "k int, v double, w string")
    new = spark.createDataFrame([(2, None, "x"), (3, 3.0, "y")], "k int, v double, w string")
    once = TB.upsert(old, new, ["k"], ["v"])
    assert rows(TB.upsert(once, new, ["k"], ["v"]), "k", "w") == rows(once, "k", "w")
    assert {r.k: (r.v, r.w) for r in once.collect()} == {1: (1.0, "a"), 2: (None, "b"), 3: (3.0, None)}
    assert {r.k: r.w for r in TB.insert_ignore(old, new, ["k"], "w").collect()} == {1: "a", 2: "b", 3: "y"}


def test_incremental_equals_full_rebuild(spark):
    b = P.bars(spark, SMALL).select("tk", "d", "cl")
    compute = lambda df: df.withColumns(E.simple_returns(TK, "cl", (5, 21)))
    stored = b.where("d <= date'2000-01-01'")
    part = INC.with_context(b, stored, TK, 22, compute)
    last = stored.groupBy("tk").agg(F.max("d").alias("last"))
    full = compute(b).join(last, "tk").where("d > last")
    assert rows(part.na.fill(9.0), "tk", "d", "return_21d") == rows(full.na.fill(9.0), "tk", "d", "return_21d")


def test_no_look_ahead(spark):
    b = P.bars(spark, SMALL)
    cut = "d <= date'1999-06-30'"
    feats = lambda df: E.range_position(df.withColumns(E.simple_returns(TK, "cl")), TK, "cl", "hi", "lo")
    cols = ("tk", "d", "return_21d", "price_to_52w_high")
    assert rows(feats(b).where(cut).na.fill(9.0), *cols) == rows(feats(b.where(cut)).na.fill(9.0), *cols)


def test_half_even_rounding(spark):
    got = [r[0] for r in spark.createDataFrame([(2.5,), (3.5,), (0.125,)], "x double").select(half_even("x", 0)).collect()]
    assert got == [2.0, 4.0, 0.0]


def test_ic_of_constant_series_is_absent(spark):
    df = spark.createDataFrame([(f"k{i}", day(0), float(i), 1.0) for i in range(6)] + [(f"k{i}", day(1), float(i), float(-i)) for i in range(6)], "tk string, d date, y double, p double")
    got = ML.daily_ic(df, "y", "p").collect()
    assert [(r.d, round(r.ic, 9)) for r in got] == [(day(1), -1.0)]


def test_rebalance_dates_greedy(spark):
    offsets = [0, 3, 13, 14, 20, 27, 28, 29, 60, 73, 75]
    df = spark.createDataFrame([(day(i),) for i in offsets], "d date")
    want, last = [], None
    for i in offsets:
        if last is None or i - last >= 14:
            want.append(day(i))
            last = i
    assert [r.d for r in BT.rebalance_dates(df).orderBy("d").collect()] == want


def test_nav_costs_and_turnover(spark):
    w = spark.createDataFrame([(day(0), day(2), "a", 1.0), (day(2), None, "b", 1.0)], "d date, end_d date, tk string, w double")
    r = spark.createDataFrame([(t, day(i), 0.1) for t in "ab" for i in range(4)], "tk string, d date, ret double")
    got = {x.d: x.nav for x in BT.nav_series(w, r, cost_bps=100).collect()}
    want, nav = {}, 1.0
    for i, ret in enumerate([-0.01, 0.1, 0.1 - 0.02, 0.1]):
        nav *= 1 + ret
        want[day(i)] = nav
    assert got == pytest.approx(want)


def test_monte_carlo_is_repeatable(spark):
    nav = spark.createDataFrame([(day(i), 100.0 + (i * 7) % 13) for i in range(60)], "d date, nav double")
    a, b = BT.monte_carlo(nav, 50).first(), BT.monte_carlo(nav.repartition(5), 50).first()
    assert a == b and a.p05 <= a.median <= a.p95 <= 0


def test_risk_decision_order(spark):
    state = spark.createDataFrame([("p", 100.0, 100.0, 50.0, None, None, 0, False, False)],
                                  "pid string, nav double, peak_nav double, cash double, nav_return_21d double, flow_today double, flow_negative_days int, is_budget boolean, is_expiry boolean")
    pos = spark.createDataFrame([("p", "old", "long", 0.28, "T", False, 10.0, 8.0), ("p", "f", "long", 0.7, "F", False, 10.0, 10.0)],
                                "pid string, tk string, direction string, size double, sector string, is_midcap boolean, entry_price double, current_price double")
    prop = spark.createDataFrame(
        [("p", "a", "long", 0.2, "T", False, True, None, 0), ("p", "old", "long", 0.05, "T", False, True, None, 0), ("p", "s", "short", 0.02, "T", False, False, None, 0),
         ("p", "t", "short", 0.002, "T", False, True, None, 0), ("p", "u", "short", 0.02, "U", False, True, None, 3), ("p", "v", "long", 0.03, "U", False, True, None, 0)],
        "pid string, tk string, direction string, size double, sector string, is_midcap boolean, eligible boolean, market_cap double, circuit_hits int")
    got = {r.tk: (r.status, r.limit_code, round(r.approved_size, 6)) for r in RK.decide(RK.with_context(prop, pos, state)).collect()}
    assert got == {
        "a": ("REDUCED", "P1", 0.02),  # cut to the core cap, then to the sector headroom; the first code stays
        "old": ("REJECTED", "P4", 0.0), "s": ("REJECTED", "FO", 0.0), "t": ("REJECTED", "P6", 0.0), "u": ("REJECTED", "IR5", 0.0), "v": ("APPROVED", None, 0.03),
    }


def test_zipped_and_plain_bar_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "day.zip", "w") as z:
        z.writestr("a.csv", "TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol\nAAA,EQ,1,2,0.5,1.5,100\nBBB,BE,1,2,0.5,1.5,5\n")
    raw = S.read_zipped_bars(spark, str(tmp_path / "day.zip"))
    out = S.unify_bar_layouts([raw], extra=()).collect()
    assert [(r.tk, r.cl, r.vol) for r in out] == [("AAA", 1.5, 100)]
    S.write_csv(spark.createDataFrame([(" AAA ",), ("IDX",)], "Symbol string"), str(tmp_path / "u"))
    assert [r.tk for r in S.read_universe(spark, str(tmp_path / "u"), ".NS", ["IDX"]).collect()] == ["AAA.NS"]


def test_daily_payload_year_rollover(spark):
    payload = '[{"DateText":"Jan 2","NetValue":1.0},{"DateText":"Dec 31","NetValue":2.0},{"DateText":"Dec 30","NetValue":null},{"DateText":"Jan 5","NetValue":3.0}]'
    df = spark.createDataFrame([("f", payload)], "feed string, payload string")
    got = rows(S.parse_daily(df, "feed", F.lit("2024-01-03").cast("date")), "d", "net")
    assert got == [(dt.date(2023, 1, 5), 3.0), (dt.date(2023, 12, 31), 2.0), (dt.date(2024, 1, 2), 1.0)]


def test_a_lost_book_stays_lost(spark):
    days = [dt.date(2024, 1, i) for i in range(1, 7)]
    ret = dict(zip(days, [0.0, 0.1, -0.6, 0.5, 0.2, 0.1]))
    returns = spark.createDataFrame([("a", d, r) for d, r in ret.items()], "tk string, d date, ret double")
    weights = spark.createDataFrame([(days[0], None, "a", 2.0)], "d date, end_d date, tk string, w double")
    nav = {r.d: round(r.nav, 6) for r in BT.nav_series(weights, returns, cost_bps=0.0).collect()}
    assert nav == {days[0]: 1.0, days[1]: 1.2, days[2]: 0.0, days[3]: 0.0, days[4]: 0.0, days[5]: 0.0}
    m = BT.metrics(spark.createDataFrame(list(nav.items()), "d date, nav double")).first()
    assert m.total_return == -1.0 and m.max_dd == -1.0 and m.true_max_dd is None


def test_forward_match_cost_per_row_is_flat(spark):
    def seconds(n):
        left = spark.range(n * 8).select((F.col("id") % 8).alias("k"), F.floor(F.col("id") / 8).alias("t"))
        right = spark.range(8).select(F.col("id").alias("k"), F.lit(n).cast("long").alias("u"), F.lit(1).alias("x"))
        start = time.perf_counter()
        out = asof_join(left, right, ["k"], "t", "u", ["x"], direction="forward", left_unique=True)
        assert out.where("x = 1").count() == n * 8
        return time.perf_counter() - start

    seconds(2500)
    assert seconds(20_000) < 8 * max(seconds(2500), 0.5)


def test_fold_models_score_every_test_row(spark):
    rng = random.Random(4)
    rows = [(f"k{i % 5}", dt.date(2020, 1, 1) + dt.timedelta(days=i), f, part, 1, x if (x := rng.gauss(0, 1)) > -1.5 else None, 2 * (x or 0) + 0.01 * i)
            for f in (1, 2) for i, part in enumerate(["train"] * 80 + ["test"] * 20)]
    df = spark.createDataFrame(rows, "tk string, d date, fold int, part string, ok int, x double, y double")
    ready = ML.prepare_folds(df, ["x"], {"ok": (0, ["x"])})
    train = ready.where("fold = 1 AND part = 'train' AND x IS NOT NULL").agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(train[0]) < 1e-9 and abs(train[1] - 1) < 1e-9
    preds, gains = ML.fit_folds(ready, ["x"], "y", [1, 2], trees=3, depth=3)
    assert preds.where("prediction IS NOT NULL").count() == 40 and gains.count() == 2
    try:
        ML.feature_columns(df.withColumn("target_x", F.lit(1.0)), [])
        raise AssertionError("a target passed as a feature")
    except ValueError:
        pass


def test_large_values_are_not_cut_by_rounding(spark):
    got = spark.range(1).select(floor_round(F.lit(1.5e15), 6).alias("a"), floor_round(F.lit(-3e20), 4).alias("b"), floor_round(F.lit(1.23456789), 6).alias("c")).first()
    assert (got.a, got.b, got.c) == (1.5e15, -3e20, 1.234568)


def test_published_steps_follow_their_input(spark, tmp_path):
    @published("probe")
    def probe(s, folder):
        return s.read.parquet(f"{folder}/t.parquet")

    folder = str(tmp_path)
    spark.range(3).write.parquet(f"{folder}/t.parquet")
    assert probe(spark, folder).count() == 3 and probe(spark, folder) is probe(spark, folder)
    spark.range(5).write.mode("append").parquet(f"{folder}/t.parquet")
    assert probe(spark, folder).count() == 8
