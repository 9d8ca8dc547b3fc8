"""Resumed smoothers and versioned tables."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions.windows import Axis
from panelforge.operators import indicators, tables
from panelforge.operators.versioned import VersionedTable, by_month
from panelforge.streaming import smoothers

TK = Axis(("tk",), "d")
ROWS = "tk string, d date, price double, hi double, lo double, cl double"


def bars(spark, tickers=3, n=90):
    rng, rows = np.random.default_rng(1), []
    for t in range(tickers):
        price = 100 + np.cumsum(rng.normal(size=n))
        for i in range(n):
            rows.append((f"T{t}", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(price[i]), float(price[i] + 1), float(price[i] - rng.random()), float(price[i] + 0.25)))
    rows += [("FLAT", dt.date(2024, 1, 1) + dt.timedelta(days=i), 5.0, 5.0, 5.0, 5.0) for i in range(40)]  # no range, no move
    return spark.createDataFrame(rows, ROWS)


def table(df, cols=smoothers.OUTPUT):
    return df.select("tk", "d", *cols).orderBy("tk", "d").toPandas()


def same(a, b):
    assert (a[["tk", "d"]] == b[["tk", "d"]]).all().all()
    for c in smoothers.OUTPUT:
        assert np.allclose(a[c].to_numpy(dtype=float), b[c].to_numpy(dtype=float), equal_nan=True, rtol=1e-9, atol=1e-9), c


def empty(spark):
    return spark.createDataFrame([], f"tk string, state {smoothers.STATE_TYPE}")


def test_state_gives_what_a_full_pass_gives(spark):
    rows = bars(spark)
    full = indicators.with_recursive(rows.withColumnRenamed("price", "adj"), TK, "adj")
    same(table(smoothers.advanced(rows, empty(spark), TK)), table(full))


def test_daily_loads_with_late_rows_gaps_and_new_entities(spark):
    rows = bars(spark).cache()
    cut = lambda day: F.lit(dt.date(2024, 1, 1) + dt.timedelta(days=day)).cast("date")
    late = (F.col("tk") == "T1") & F.col("d").isin([dt.date(2024, 2, 10), dt.date(2024, 2, 12)])
    new_entity = F.col("tk") == "FLAT"
    loads = [(F.col("d") < cut(50)) & ~late & ~new_entity, (F.col("d") < cut(70)) & (F.col("d") >= cut(50)) & (F.col("tk") != "T2"), late | new_entity, (F.col("d") >= cut(70)) | ((F.col("tk") == "T2") & (F.col("d") >= cut(50)))]
    seen = rows.where(loads[0])
    stored = smoothers.advanced(seen, empty(spark), TK).cache()
    for load in loads[1:]:
        arrived = rows.where(load).join(seen, ["tk", "d"], "left_anti").select("tk", "d").cache()
        seen = seen.unionByName(rows.join(arrived, ["tk", "d"], "left_semi")).cache()
        changed = smoothers.update(seen, arrived, stored, smoothers.latest(stored, TK), TK)
        stored = smoothers.merged(stored, changed, TK).cache()
    same(table(stored), table(smoothers.advanced(rows, empty(spark), TK)))


def test_a_plain_daily_load_reads_no_history(spark, tmp_path):
    rows = bars(spark)
    day = dt.date(2024, 3, 20)
    rows.where(F.col("d") < F.lit(day)).write.parquet(str(tmp_path / "bars/part=old"))
    rows.where(F.col("d") >= F.lit(day)).write.parquet(str(tmp_path / "bars/part=new"))
    stored = smoothers.advanced(rows.where(F.col("d") < F.lit(day)), empty(spark), TK).cache()
    last = spark.createDataFrame(smoothers.latest(stored, TK).collect(), f"tk string, _last date, state {smoothers.STATE_TYPE}")

    def forbidden(batches):
        raise RuntimeError("history was read")
        yield

    guard = stored.mapInPandas(forbidden, stored.schema)
    stock = spark.read.schema(ROWS).parquet(str(tmp_path / "bars/part=old"), str(tmp_path / "bars/part=new"))
    changed = smoothers.update(stock, rows.where(F.col("d") >= F.lit(day)).select("tk", "d"), guard, last, TK)
    want = smoothers.advanced(rows, empty(spark), TK).where(F.col("d") >= F.lit(day))
    same(table(changed), table(want))
    text = changed._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d" in text  # old days are not read from the bars


def test_missing_inputs_leave_the_state(spark):
    rows = bars(spark, 1, 40)
    holes = rows.unionByName(spark.createDataFrame([("T0", dt.date(2024, 6, 1), None, 1.0, 1.0, 1.0)], ROWS))
    got = table(smoothers.advanced(holes, empty(spark), TK))
    assert got[got.d == dt.date(2024, 6, 1)][list(smoothers.OUTPUT)].isna().all().all()
    same(got[got.d != dt.date(2024, 6, 1)].reset_index(drop=True), table(smoothers.advanced(rows, empty(spark), TK)))


def listing(path):
    return {os.path.join(a, f): os.stat(os.path.join(a, f)).st_mtime_ns for a, _, files in os.walk(path) for f in files if f.endswith(".parquet")}


def test_merge_touches_only_its_partitions_and_fails_whole(spark, tmp_path):
    rows = [(i, dt.date(2024, 1 + i % 6, 1 + i % 28), float(i)) for i in range(300)] + [(900, None, 1.0)]
    df = spark.createDataFrame(rows, "k long, d date, v double")
    t = VersionedTable(spark, str(tmp_path / "t"), by_month("d")).create(df)
    assert sorted(map(tuple, t.read().collect()), key=str) == sorted(rows, key=str)
    before, folders = listing(tmp_path), t.folders()
    new = spark.createDataFrame([(0, dt.date(2024, 1, 1), -1.0), (5000, dt.date(2024, 9, 9), 2.0)], df.schema)
    touched = t.merge(new, lambda old, more: tables.upsert(old, more, ["k", "d"], ["v"]))
    assert touched == {"2024-01", "2024-09"}
    assert {p: f for p, f in t.folders().items() if p not in touched} == {p: f for p, f in folders.items() if p not in touched}
    assert before.items() <= listing(tmp_path).items()  # no old file is changed
    want = sorted([(0, dt.date(2024, 1, 1), -1.0) if r[0] == 0 else r for r in rows] + [(5000, dt.date(2024, 9, 9), 2.0)], key=str)
    assert sorted(map(tuple, t.read().collect()), key=str) == want
    assert t.read({"2024-09"}).count() == 1

    def broken(old, more):
        return tables.upsert(old, more, ["k", "d"], ["v"]).withColumn("v", F.when(F.col("k") == 5000, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("double"))

    with pytest.raises(Exception, match="lost"):
        t.merge(new, broken)
    assert sorted(map(tuple, t.read().collect()), key=str) == want
    assert VersionedTable(spark, str(tmp_path / "e"), by_month("d")).create(df.limit(0)).read().count() == 0
