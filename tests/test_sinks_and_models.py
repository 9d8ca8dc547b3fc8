"""Checked sinks, stored forests and fold partitions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelforge.functions.staging import staged
from panelforge.operators import mlprep as ML
from panelforge.sources.checked import CheckedCsv, CheckFailed, Expect

DAY = dt.date(2024, 1, 1)


def load(spark, rows):
    return spark.createDataFrame(rows, "tk string, d date, x double")


def test_checked_sink(spark, tmp_path):
    sink = CheckedCsv(spark, str(tmp_path / "out"))
    assert sink.newest() is None
    good = [("a", DAY, 1.5), ("b, \"quoted\"", DAY + dt.timedelta(days=3), None), ("c", None, float("nan"))]
    strict = Expect(min_rows=2, max_rows=4, required=("tk",), day="d", first_day=DAY, last_day=DAY + dt.timedelta(days=9), ranges={"x": (0, 2)})
    seen = sink.write(load(spark, good), strict)
    assert (seen["n_rows"], seen["first_day"], seen["last_day"]) == (3, DAY, DAY + dt.timedelta(days=3))
    assert sorted(map(repr, sink.read().collect())) == sorted(map(repr, load(spark, good).collect()))
    bad = {
        "nulls tk": [(None, DAY, 1.0), ("a", DAY, 1.0)], "outside x": [("a", DAY, 3.0), ("b", DAY, 1.0)], "fewer than 2": [("a", DAY, 1.0)], "more than 4": [("a", DAY, 1.0)] * 5,
        "first day": [("a", DAY - dt.timedelta(days=1), 1.0)] * 2, "last day": [("a", DAY + dt.timedelta(days=10), 1.0)] * 2, "fewer": [],
    }
    for text, rows in bad.items():
        with pytest.raises(CheckFailed, match=text):
            sink.write(load(spark, rows), strict)
    assert sink.newest().version == 0 and sink.read().count() == 3
    assert len(list((tmp_path / "out" / "data").iterdir())) == 1
    sink.write(load(spark, good[:2]), strict)
    assert sink.newest().version == 1 and sink.newest().n_rows == 2 and sink.read().count() == 2


def test_checks_ride_on_the_writing_job(spark, tmp_path):
    """Every row is computed once: a counter of evaluated rows sees each a single time."""
    evaluated = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            evaluated.add(len(b))
            yield b

    rows = spark.range(1000).mapInPandas(counted, "id long")
    seen = CheckedCsv(spark, str(tmp_path / "out")).write(rows, Expect(min_rows=1000, required=("id",), ranges={"id": (0, 999)}))
    assert seen["n_rows"] == 1000 and evaluated.value == 1000


def test_failed_job_publishes_nothing(spark, tmp_path):
    sink = CheckedCsv(spark, str(tmp_path / "out"))
    with pytest.raises(Exception):
        sink.write(spark.range(10).select(F.raise_error(F.lit("lost")).cast("string").alias("x")), Expect())
    assert sink.newest() is None


def fold_frame(spark):
    rng, rows = random.Random(3), []
    for f in (1, 2):
        for i, part in enumerate(["train"] * 120 + ["test"] * 30):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            rows.append((f"k{i % 5}", DAY + dt.timedelta(days=i), f, part, a if i % 11 else None, b, 3 * a + 0.2 * b))
    return spark.createDataFrame(rows, "tk string, d date, fold int, part string, a double, b double, y double")


def test_stored_forests(spark, tmp_path):
    df = staged(fold_frame(spark), "folds", parts=("fold", "part"))
    assert df.columns == ["tk", "d", "fold", "part", "a", "b", "y"]
    preds, gains = ML.fit_folds(df, ["a", "b"], "y", [1, 2], trees=5, depth=3, store=str(tmp_path))
    paths = {r.fold: r.model for r in gains.collect()}
    assert set(paths) == {1, 2}
    rows = df.where("fold = 2 AND part = 'test'")
    scored = ML.score_stored(rows, paths[2], ["a", "b"])
    assert scored.columns == [*df.columns, "score"] and scored.where("a IS NULL").count() == rows.where("a IS NULL").count() > 0
    want = {(r.tk, r.d): r.prediction for r in preds.where("fold = 2").collect()}
    assert {(r.tk, r.d): r.score for r in scored.collect()} == want and len(want) == 30
    for features, frame in ((["b", "a"], rows), (["a"], rows), (["a", "b"], rows.drop("b"))):
        with pytest.raises(ValueError):
            ML.score_stored(frame, paths[2], features)
    gain = {(r.fold, r.name): r.gain for r in gains.collect()}
    assert all(gain[f, "a"] > gain[f, "b"] and abs(gain[f, "a"] + gain[f, "b"] - 1) < 1e-9 for f in (1, 2))  # a drives y; a split may look at b alone


def test_a_fold_reads_its_own_files(spark):
    df = staged(fold_frame(spark), "folds", parts=("fold", "part"))
    one = df.where("fold = 2 AND part = 'train'")
    text = one._jdf.queryExecution().executedPlan().toString()
    filters = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "fold#" in filters and "part#" in filters and one.count() == 120


def test_decay_of_all_folds_equals_decay_of_each(spark):
    df = fold_frame(spark).where("part = 'train'").where("fold = 1 OR d < '2024-03-01'")
    weights = df.join(ML.fold_decay(df, 40), "fold").withColumn("weight", ML.decayed(F.col("last"), F.col("mean"), 40))
    got = {(r.fold, r.tk, r.d): r.weight for r in weights.collect()}
    for f in (1, 2):
        for r in ML.time_decay(df.where(F.col("fold") == f), 40).collect():
            assert abs(got[f, r.tk, r.d] - r.weight) < 1e-12
