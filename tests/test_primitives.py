"""Primitives against pandas and brute force, on frames with hot keys, ties, gaps and missing values."""

import datetime as dt
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions.asof import asof_join
from panelforge.functions.numeric import clean_number, floor_round, norm_ppf, nullify_nan, period_start, safe_ratio
from panelforge.functions.ranking import quantiles, rank_many, rank_pct
from panelforge.functions.recursive import beta_step, grouped, wilder
from panelforge.functions.windows import Axis, pct_change, rolling_extremes, rolling_means

TK = Axis(("tk",), "d")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def panel(seed=0, keys=3, n=400, gaps=True):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(keys):
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i in range(n):
            rows.append((f"k{k}", day(i), None if gaps and rng.random() < 0.05 else round(float(price[i]), 4), round(float(rng.normal()), 6)))
    return pd.DataFrame(rows, columns=["tk", "d", "c", "f"])


def to_spark(spark, pdf, schema):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


P = "tk string, d date, c double, f double"


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; q=e.queries(); o=e.oracle_sql(); assert len(q) > 150 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_rank_matches_pandas_with_hot_value(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(3000) < 0.35, 0.0, np.round(rng.normal(size=3000), 3))
    pdf = pd.DataFrame({"i": range(3000), "g": np.where(rng.random(3000) < 0.4, "hot", rng.integers(0, 9, 3000).astype(str)), "x": x})
    pdf.loc[rng.random(3000) < 0.1, "x"] = np.nan
    df = to_spark(spark, pdf, "i bigint, g string, x double")
    got = rank_pct(df, ["g"], "x", "p", digits=None).toPandas().set_index("i")["p"].sort_index()
    want = pdf.groupby("g")["x"].rank(method="average", pct=True)
    assert np.allclose(got.to_numpy(dtype=float), want.to_numpy(), equal_nan=True, atol=1e-12)
    many = rank_many(df, ["i"], [("a", "x", ["g"], 1), ("b", "x", [], 1)], digits=None).toPandas().set_index("i").sort_index()
    assert np.allclose(many["a"].to_numpy(dtype=float), want.to_numpy(), equal_nan=True, atol=1e-12)
    assert np.allclose(many["b"].to_numpy(dtype=float), pdf["x"].rank(pct=True).to_numpy(), equal_nan=True, atol=1e-12)


def test_rank_minimum_count(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "g string, x double")
    got = {(r.g, r.x): r.p for r in rank_pct(df, ["g"], "x", "p", 2).collect()}
    assert got == {("a", 1.0): None, ("a", None): None, ("b", 2.0): 0.5, ("b", 3.0): 1.0}


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 1001).astype(str), "x": np.where(rng.random(1001) < 0.4, 1.5, rng.normal(size=1001) * 30)})
    got = quantiles(to_spark(spark, pdf, "g string, x double"), ["g"], "x", {"m": 0.5, "q": 0.95}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert got.loc[g, "m"] == pytest.approx(np.quantile(part.x, 0.5), abs=1e-12)
        assert got.loc[g, "q"] == pytest.approx(np.quantile(part.x, 0.95), abs=1e-9)


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
@pytest.mark.parametrize("unique", [True, False])
def test_asof_matches_pandas(spark, direction, strict, unique):
    left = pd.DataFrame([(k, day(i)) for k in "ab" for i in range(0, 40, 2)], columns=["tk", "d"])
    right = pd.DataFrame([("a", day(i), float(i)) for i in (3, 4, 10, 38)] + [("c", day(1), 1.0)], columns=["tk", "t", "v"])
    got = asof_join(to_spark(spark, left, "tk string, d date"), to_spark(spark, right, "tk string, t date, v double"), ["tk"], "d", "t", ["v"], direction, strict, unique)
    got = got.toPandas().sort_values(["tk", "d"])["v"].to_numpy(dtype=float)
    a, b = left.assign(d=pd.to_datetime(left.d)).sort_values("d"), right.assign(t=pd.to_datetime(right.t)).sort_values("t")
    want = pd.merge_asof(a, b, left_on="d", right_on="t", by="tk", direction=direction, allow_exact_matches=not strict)
    assert np.allclose(got, want.sort_values(["tk", "d"])["v"].to_numpy(dtype=float), equal_nan=True)


def test_pct_change_both_fills(spark):
    pdf = panel(3)
    df = to_spark(spark, pdf, P)
    for fill in (None, "pad"):
        got = pct_change(df, TK, {"r": ("c", 5)}, fill).toPandas().sort_values(["tk", "d"])["r"].to_numpy(dtype=float)
        base = pdf.assign(c=pdf.groupby("tk")["c"].ffill()) if fill else pdf
        want = base.groupby("tk")["c"].transform(lambda s: s / s.shift(5) - 1)
        assert np.allclose(got, want.to_numpy(), equal_nan=True)


def test_rolling_means_and_extremes(spark):
    pdf = panel(4)
    df = to_spark(spark, pdf, P)
    got = rolling_means(df, TK, "c", {"m20": 20}).toPandas().sort_values(["tk", "d"])["m20"].to_numpy(dtype=float)
    want = pdf.groupby("tk")["c"].transform(lambda s: s.rolling(20, min_periods=20).mean())
    assert np.allclose(got, want.to_numpy(), equal_nan=True)
    ext = rolling_extremes(df, TK, {"hi": ("max", "c"), "lo": ("min", "c")}, 40, 15).toPandas().sort_values(["tk", "d"])
    for c, fn in (("hi", "max"), ("lo", "min")):
        want = pdf.groupby("tk")["c"].transform(lambda s: getattr(s.rolling(40, min_periods=15), fn)())
        assert np.allclose(ext[c].to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


def test_rolling_beta_masks_pairs_but_not_the_factor(spark):
    pdf = panel(5, keys=2, n=150)
    got = grouped(to_spark(spark, pdf, P), TK, [beta_step("c", {"b": "f"}, 60, 20)]).toPandas().sort_values(["tk", "d"])["b"].to_numpy(dtype=float)
    want = []
    for _, g in pdf.groupby("tk"):
        for i in range(len(g)):
            w = g.iloc[max(0, i - 59): i + 1]
            both = w.dropna()
            ok = len(both) >= 20
            want.append(np.cov(both.c, both.f)[0, 1] / np.var(w.f, ddof=1) if ok and len(w) >= 20 else np.nan)
    assert np.allclose(got, want, equal_nan=True)


def test_wilder_seed_and_recursion():
    s = pd.Series([np.nan, 1.0, 2.0, 3.0, 10.0, 4.0])
    out = wilder(s, 3)
    assert out[:3].isna().all() and out[3] == 2.0
    assert out[4] == pytest.approx(2.0 * 2 / 3 + 10 / 3) and out[5] == pytest.approx(out[4] * 2 / 3 + 4 / 3)


def test_scalars(spark):
    texts = [("₹ 1,234.50+",), ("12%",), ("--",), ("N/A",), ("abc",), (None,)]
    got = [r.v for r in spark.createDataFrame(texts, "t string").select(clean_number("t").alias("v")).collect()]
    assert got == [1234.5, 12.0, None, None, None, None]
    labels = [("Mar 2024",), ("Mar 20249m",), ("TTM",), ("2024",)]
    got = [r.v for r in spark.createDataFrame(labels, "t string").select(period_start("t").alias("v")).collect()]
    assert got == [dt.date(2024, 3, 1), dt.date(2024, 3, 1), None, None]
    row = spark.range(1).select(safe_ratio(F.lit(1.0), F.lit(0.0)).alias("a"), floor_round(F.lit(2.00005), 4).alias("b"), norm_ppf(F.lit(0.975)).alias("c")).first()
    assert row.a is None and row.b == pytest.approx(2.0001) and row.c == pytest.approx(1.959963985, abs=1e-7)
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert [r.x for r in nullify_nan(bad).collect()] == [None, None, 1.0]


def test_released_stage_tables(spark):
    import os

    from panelforge.functions import staging

    with staging.releasing(spark):
        inner = staging.staged(spark.range(10), "inner")
        kept = staging.staged(inner.groupBy((inner.id % 3).alias("k")).count(), "kept", keep=True)
        paths = [df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0] for df in (inner, kept)]
        assert all(map(os.path.isdir, paths))
    assert not os.path.exists(paths[0]) and kept.count() == 3
    assert spark.conf.get(staging._CLEANUP) == "false"


def _odd_values():
    rng = np.random.default_rng(5)
    close = 1.0 + rng.random(30_000) * 1e-12  # differ in the last bits only
    wide = np.ldexp(rng.random(5_000) - 0.5, rng.integers(-1060, 1000, 5_000))
    edge = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, -(2.0**-1022), 2.0**-1023, 1.0, np.nextafter(1, 0), np.nextafter(1, 2), 8.0, np.nextafter(8, 0), -8.0, 1.7976931348623157e308, float("inf"), float("-inf")]
    return np.concatenate([close, -close[:9_000], wide, rng.random(20_000) * 1e9, np.repeat([3.25], 50_000), edge])


def test_sort_key_keeps_the_order_of_doubles(spark):
    from panelforge.functions.ranking import sort_key

    x = np.unique(_odd_values())
    got = to_spark(spark, pd.DataFrame({"i": range(len(x)), "x": x}), "i long, x double").select("i", sort_key(F.col("x")).alias("k")).orderBy("i").toPandas()["k"].to_numpy()
    assert (np.diff(got) >= 0).all() and np.unique(got, return_counts=True)[1].max() <= 1600


def test_ranks_of_close_and_wide_values_without_a_large_task(spark):
    from panelforge.functions.ranking import position_table

    x = _odd_values()
    pdf = pd.DataFrame({"g": np.where(np.arange(len(x)) % 3 == 0, "a", "b"), "x": x})
    df = to_spark(spark, pdf, "g string, x double").repartition(8).cache()
    for by in ([], ["g"]):
        got = position_table(df, by, "x").toPandas()
        parts = [("", pdf)] if not by else list(pdf.groupby("g"))
        for g, part in parts:
            mine = got if not by else got[got.g == g]
            values, counts = np.unique(part.x.to_numpy(), return_counts=True)
            mine = mine.sort_values("_x")
            assert (mine._x.to_numpy() == values).all() and (mine._n.to_numpy() == counts).all()
            assert (mine._before.to_numpy() == np.r_[0, np.cumsum(counts)[:-1]]).all() and (mine._total == len(part)).all()


def test_cells_are_bounded(spark, monkeypatch):
    """No window of the rank table sees more than a cell, whatever the values."""
    from panelforge.functions import ranking

    monkeypatch.setattr(ranking, "CELL", 256)
    df = spark.range(60_000).select((1 + F.col("id") * 1e-13).alias("x"))
    plan = ranking.position_table(df, [], "x")
    got = plan.groupBy(F.col("_before")).count()
    assert got.count() == 60_000 and plan.agg(F.max("_before")).first()[0] == 59_999
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "_level" in text and "_cell" in text
