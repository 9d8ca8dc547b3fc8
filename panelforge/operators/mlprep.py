"""Training-table preparation, walk-forward folds and rank-IC evaluation."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.numeric import safe_ratio
from panelforge.functions.ranking import average_rank, order_statistics, position_table, quantiles, rank_many
from panelforge.functions.staging import staged
from panelforge.functions.windows import Axis, MARKET

TK = Axis(("tk",), "d")


def feature_columns(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    """Numeric columns that are not listed as keys, flags, prices or targets; a name that looks like a target is an error."""
    found = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in excluded]
    leaks = [c for c in found if c.startswith("target")]
    if leaks:
        raise ValueError(f"targets among the features: {leaks}")
    return found


def feature_summary(df: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Per selected feature column: name, n (values), lowest and highest, in one pass over the table."""
    names = feature_columns(df, excluded)
    cols = [F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.min(c).cast("double").alias("lowest"), F.max(c).cast("double").alias("highest")) for c in names]
    return df.agg(F.array(*cols).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def holdout_split(df: DataFrame, target: str, holdout: Column, tiers: Sequence[int] = (1, 2)) -> DataFrame:
    """Rows of the given tiers with a target, marked train before the holdout date and holdout from it on."""
    rows = df.where(F.col("tier").isin(*tiers) & F.col(target).isNotNull())
    return rows.withColumn("part", F.when(F.col("d") < holdout, "train").otherwise("holdout"))


FlagMap = dict[str, tuple[int, Sequence[str]]]


def flag_medians(df: DataFrame, flags: FlagMap) -> DataFrame:
    """Exact median of each column over rows whose flag says the value exists, as (flag, name, median) rows."""
    items = [
        F.when(F.col(flag) == 1 - missing, F.struct(F.lit(flag).alias("flag"), F.lit(c).alias("name"), F.col(c).alias("x")))
        for flag, (missing, cols) in flags.items() for c in cols
    ]
    long = df.select(F.explode(F.array_compact(F.array(*items))).alias("i")).select("i.*")
    return quantiles(long, ["flag", "name"], "x", {"median": 0.5}).drop("n_values")


def flag_impute(df: DataFrame, medians: DataFrame, flags: FlagMap) -> DataFrame:
    """Fill NULLs of rows flagged missing with the (flag, column) median; 0 when no median exists."""
    lookup = medians.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "flag", "name"), "median")))).scalar()
    out = df.withColumn("_m", lookup)
    for flag, (missing, cols) in flags.items():
        hit = F.col(flag) == missing
        out = out.withColumns(
            {c: F.when(hit & F.col(c).isNull(), F.coalesce(F.col("_m")[f"{flag}|{c}"], F.lit(0.0))).otherwise(F.col(c)) for c in cols}
        )
    return out.drop("_m")


def fill_both_ways(df: DataFrame, fills: dict[str, float], axis: Axis = TK) -> DataFrame:
    """Carry forward, then backward within the entity, then a constant."""
    return df.withColumns({c: F.coalesce(axis.ffill(c), axis.bfill(c), F.lit(v)) for c, v in fills.items()})


def winsorize(df: DataFrame, c: str, limit: float = 0.01) -> DataFrame:
    """Clip at the order statistics that cut ``limit`` of the rows on each side; NULLs count as the median, stay NULL."""
    med = quantiles(df, [], c, {"m": 0.5}).select("m").scalar()
    filled = df.select(F.coalesce(F.col(c), med).alias("x"))
    k = F.floor(F.lit(limit) * F.col("_total"))
    stats = order_statistics(filled, [], "x", {"lo": k, "hi": F.col("_total") - 1 - k})
    b = stats.select(F.struct("lo", "hi")).scalar()
    out = df.withColumn("_b", b)
    x = F.col(c)
    return out.withColumn(c, F.when(x < F.col("_b.lo"), F.col("_b.lo")).when(x > F.col("_b.hi"), F.col("_b.hi")).otherwise(x)).drop("_b")


def standardize(df: DataFrame, cols: Sequence[str], train: Column) -> DataFrame:
    """Population z-score fitted on the training rows, applied to all."""
    stats = df.where(train).agg(F.struct(*[a for c in cols for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])).scalar()
    out = df.withColumn("_s", stats)
    return out.withColumns({c: safe_ratio(F.col(c) - F.col(f"_s.m_{c}"), F.col(f"_s.s_{c}")) for c in cols}).drop("_s")


def walk_forward_folds(
    df: DataFrame, n: int = 8, test_months: int = 6, purge_days: int = 21, train_years: int = 5
) -> DataFrame:
    """Folds counted back from the last date; those reaching before the first date are left out, oldest is fold 1."""
    span = df.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    f = span.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    f = f.withColumn("test_end", F.add_months("hi", -test_months * F.col("i")))
    f = f.withColumn("test_start", F.add_months("test_end", -test_months))
    f = f.withColumn("train_end", F.date_sub("test_start", purge_days))
    f = f.withColumn("train_start", F.add_months("train_end", -12 * train_years)).where(F.col("train_start") >= F.col("lo"))
    fold = F.row_number().over(Window.orderBy(F.desc("i")))
    return f.select(fold.alias("fold"), "train_start", "train_end", "test_start", "test_end")


def assign_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row once per fold part it belongs to (half-open ranges); the few folds travel as one array value."""
    listed = folds.agg(F.collect_list(F.struct(*folds.columns))).scalar()
    tagged = df.withColumn("_f", listed)

    def part(name: str) -> Column:
        inside = F.filter("_f", lambda x: (F.col("d") >= x[f"{name}_start"]) & (F.col("d") < x[f"{name}_end"]))
        return F.transform(inside, lambda x: F.struct(x["fold"].alias("fold"), F.lit(name).alias("part")))

    return tagged.withColumn("_p", F.explode(F.concat(part("train"), part("test")))).select(*df.columns, "_p.*")


def time_decay(df: DataFrame, half_life_days: int) -> DataFrame:
    """Exponential weights by age, scaled to mean one."""
    last = df.agg(F.max("d")).scalar()
    raw = F.exp(-math.log(2.0) * F.date_diff(last, "d") / half_life_days)
    mean = df.select(raw.alias("w")).agg(F.avg("w")).scalar()
    return df.withColumn("weight", raw / mean)


def eligible_keys(df: DataFrame, targets: Sequence[str], min_rows: int = 500) -> DataFrame:
    ok = df.dropna(subset=list(targets)).groupBy("tk").agg(F.count(F.lit(1)).alias("usable"))
    return ok.where(F.col("usable") >= min_rows)


def sequences(df: DataFrame, features: Sequence[str], targets: Sequence[str], length: int, axis: Axis = TK) -> DataFrame:
    """The previous ``length`` feature rows of each labelled row, as an array of arrays."""
    w = axis.rows(-length, -1)
    seq = F.collect_list(F.array(*[F.col(c).cast("float") for c in features])).over(w)
    rows = df.withColumn("seq", seq).where(F.size("seq") == length)
    return rows.dropna(subset=list(targets)).select(*axis.by, axis.on, "seq", *targets)


def context_slice(df: DataFrame, start: Column, end: Column, length: int) -> DataFrame:
    """Rows of a window plus the last ``length`` rows before it, for entities that have rows in the window."""
    inside = F.col("d").between(start, end)
    present = df.where(inside).select("tk").distinct()
    w = Window.partitionBy("tk").orderBy(F.desc("d"))
    before = df.where(F.col("d") < start).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= length).drop("_k")
    before = before.join(present, "tk", "left_semi").withColumn("is_context", F.lit(True))
    return df.where(inside).withColumn("is_context", F.lit(False)).unionByName(before)


def clean_validation_window(folds: DataFrame, breaks: Sequence[tuple[str, str]], floor: Column, months: int = 6) -> DataFrame:
    """Six months before each training end, moved before a break period that would hold the window's end."""
    end = F.date_sub("train_end", 1)
    moved = end
    for lo, hi in reversed(list(breaks)):
        a, b = F.lit(lo).cast("date"), F.lit(hi).cast("date")
        moved = F.when(end.between(a, b), F.date_sub(a, 1)).otherwise(moved)
    out = folds.withColumn("val_end", moved)
    return out.withColumn("val_start", F.greatest(F.add_months("val_end", -months), floor)).select("fold", "val_start", "val_end")


def _pearson(x: str, y: str) -> Column:
    """Correlation from sums; NULL for a constant side."""
    n = F.count(F.lit(1))
    sx, sy = F.sum(x), F.sum(y)
    sxx, syy, sxy = F.sum(F.col(x) * F.col(x)), F.sum(F.col(y) * F.col(y)), F.sum(F.col(x) * F.col(y))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    ok = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(ok, F.try_divide(n * sxy - sx * sy, F.sqrt(F.when(ok, vx * vy))))


def daily_ic(df: DataFrame, target: str, pred: str, min_rows: int = 5) -> DataFrame:
    """Spearman correlation per date with at least ``min_rows`` complete rows."""
    rows = df.where(F.col(target).isNotNull() & F.col(pred).isNotNull()).select("tk", "d", target, pred)
    rk = rank_many(rows, ["tk", "d"], [("_x", pred, ["d"], min_rows), ("_y", target, ["d"], min_rows)], digits=None)
    rk = rk.where("_x is not null and _y is not null")
    return rk.groupBy("d").agg(_pearson("_x", "_y").alias("ic"), F.count(F.lit(1)).alias("n")).where("ic is not null")


def pooled_ic(df: DataFrame, target: str, pred: str) -> DataFrame:
    """Spearman correlation over all complete rows."""
    rows = df.where(F.col(target).isNotNull() & F.col(pred).isNotNull()).select(F.col(target).alias("y"), F.col(pred).alias("x"))
    for c in ("x", "y"):
        pos = position_table(rows, [], c).select(F.col("_x").alias(c), (average_rank() / F.col("_total")).alias(f"r{c}"))
        rows = rows.join(pos, c)
    return rows.agg(_pearson("rx", "ry").alias("ic"), F.count(F.lit(1)).alias("n"))


# Lower bounds of the grades of a mean information coefficient.
GRADES = ((0.06, "STRONG"), (0.04, "GOOD"), (0.02, "WEAK"))


def grade(ic: Column) -> Column:
    out = F.lit("POOR")
    for bound, name in reversed(GRADES):
        out = F.when(ic > bound, name).otherwise(out)
    return out


def ic_by_group(ic: DataFrame, group: Column, name: str = "fold") -> DataFrame:
    g = ic.groupBy(group.alias(name)).agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("icir", F.when(F.col("std_ic") > 1e-10, F.col("mean_ic") / F.col("std_ic")))


def ic_summary(by_fold: DataFrame, excluded: Sequence[int] = ()) -> DataFrame:
    """Mean, spread and range over folds, the mean without break folds and its grade."""
    kept = F.when(~F.col("fold").isin(*excluded), F.col("mean_ic")) if excluded else F.col("mean_ic")
    s = by_fold.agg(
        F.avg("mean_ic").alias("mean_ic"), F.stddev_pop("mean_ic").alias("std_ic"), F.min("mean_ic").alias("min_ic"), F.max("mean_ic").alias("max_ic"),
        F.avg("icir").alias("mean_icir"), F.avg(kept).alias("mean_kept"),
    )
    return s.withColumn("grade", grade(F.col("mean_kept")))


def ic_decay(baseline: Column, holdout: Column) -> Column:
    return safe_ratio(baseline - holdout, F.abs(baseline))


def monthly_ic(ic: DataFrame) -> DataFrame:
    m = ic.groupBy(F.trunc("d", "month").alias("d")).agg(F.avg("ic").alias("mean_ic"), F.sum("ic").alias("_s"))
    return m.withColumn("cum_ic", MARKET.running(F.sum, "_s")).drop("_s")


def checks(split: DataFrame, folds: DataFrame, pred: str, holdout: Column, bounds: tuple[float, float]) -> DataFrame:
    """Leak, range and coverage checks as (name, passed) rows."""
    s = split.agg(
        F.coalesce(F.max(F.when(F.col("part") == "train", F.col("d"))) < holdout, F.lit(False)).alias("train_before_holdout"),
        (F.min(pred) > bounds[0]).alias("prediction_floor"), (F.max(pred) < bounds[1]).alias("prediction_ceiling"),
        (F.count_if(F.col(pred).isNull()) == 0).alias("no_missing_prediction"),
    )
    f = folds.agg(
        (F.count_if(F.col("train_end") >= F.col("test_start")) == 0).alias("purge_gap"),
        (F.count_if(F.col("test_end") > holdout) == 0).alias("folds_before_holdout"),
    )

    def rows(df: DataFrame) -> DataFrame:
        items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("passed")) for c in df.columns])
        return df.select(F.explode(items).alias("i")).select("i.*")

    return rows(s).unionByName(rows(f))


def _lookup(stats: DataFrame, keys: Sequence[str], value: Column) -> Column:
    """One small table of statistics as a map value keyed by the joined keys. Written first: what is derived from it would compute it again at every use."""
    return staged(stats, "statistics").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", *keys), value)))).scalar()


def prepare_folds(rows: DataFrame, features: Sequence[str], flags: FlagMap, limit: float = 0.01) -> DataFrame:
    """Imputed, winsorized and scaled features of rows from :func:`assign_folds`.

    Medians (by flag) and scaling come from the fold's training part. Order statistics for clipping are those of the part
    itself, with missing values counted as its median; missing values without a rule stay NULL.
    """
    train = rows.where("part = 'train'")
    items = [
        F.when(F.col(flag) == 1 - missing, F.struct(F.lit(flag).alias("flag"), F.lit(c).alias("name"), F.col(c).alias("x")))
        for flag, (missing, cols) in flags.items() for c in cols
    ]
    known = train.select("fold", F.explode(F.array_compact(F.array(*items))).alias("i")).select("fold", "i.*")
    medians = _lookup(quantiles(known, ["fold", "flag", "name"], "x", {"m": 0.5}), ["fold", "flag", "name"], F.col("m"))
    filled = rows.withColumn("_m", medians)
    for flag, (missing, cols) in flags.items():
        value = lambda c: F.coalesce(F.try_element_at("_m", F.concat_ws("|", "fold", F.lit(flag), F.lit(c))), F.lit(0.0))
        filled = filled.withColumns({c: F.when((F.col(flag) == missing) & F.col(c).isNull(), value(c)).otherwise(F.col(c)) for c in cols})
    filled = filled.drop("_m")
    part = ["fold", "part", "name"]
    long = filled.select("fold", "part", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in features])).alias("i")).select("fold", "part", "i.*")
    middle = _lookup(quantiles(long, part, "x", {"m": 0.5}), part, F.col("m"))
    counted = long.withColumn("_m", middle).withColumn("x", F.coalesce("x", F.try_element_at("_m", F.concat_ws("|", *part)))).drop("_m")
    k = F.floor(F.lit(limit) * F.col("_total"))
    bounds = _lookup(order_statistics(counted, part, "x", {"lo": k, "hi": F.col("_total") - 1 - k}), part, F.struct("lo", "hi"))

    def clipped(name: Column | str, x: Column) -> Column:
        b = F.try_element_at("_b", F.concat_ws("|", "fold", "part", name))
        return F.when(x < b["lo"], b["lo"]).when(x > b["hi"], b["hi"]).otherwise(x)

    fitted = long.where("part = 'train'").withColumn("_b", bounds).select("fold", "name", clipped("name", F.col("x")).alias("x"))
    moments = fitted.groupBy("fold", "name").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    scale = _lookup(moments, ["fold", "name"], F.struct("m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))

    def scaled(c: str) -> Column:
        s = F.try_element_at("_s", F.concat_ws("|", "fold", F.lit(c)))
        return (clipped(F.lit(c), F.col(c)) - s["m"]) / s["s"]

    out = filled.withColumns({"_b": bounds, "_s": scale})
    return out.withColumns({c: scaled(c) for c in features}).drop("_b", "_s")


def fold_decay(df: DataFrame, half_life_days: int) -> DataFrame:
    """Last date and mean raw weight of every fold (fold, last, mean), from one count per fold and date; see ``decayed``."""
    w = Window.partitionBy("fold")  # one row per date of a fold
    days = df.groupBy("fold", "d").agg(F.count(F.lit(1)).alias("_n")).withColumn("last", F.max("d").over(w))
    age = F.exp(-math.log(2.0) * F.date_diff("last", "d") / half_life_days)
    return days.groupBy("fold").agg(F.max("last").alias("last"), (F.sum(F.col("_n") * age) / F.sum("_n")).alias("mean"))


def decayed(last: Column, mean: Column, half_life_days: int) -> Column:
    """The weight of ``time_decay`` for a row of a fold."""
    return F.exp(-math.log(2.0) * F.date_diff(last, "d") / half_life_days) / mean


def fit_folds(
    df: DataFrame, features: Sequence[str], target: str, folds: Sequence[int], half_life_days: int = 365, trees: int = 20, depth: int = 4, store: str | None = None
):
    """Weighted forest per fold on prepared fold rows; returns (a prediction for every test row, importances).

    ``trees`` and ``depth`` size the forest (published: 1000 and 6). Features still missing after preparation count as
    zero, which is the training mean; training rows need a target, test rows do not. A table partitioned by fold and part
    is read fold by fold. With ``store`` (a shared folder) each fold's fitted forest is written below it, and the importances
    carry its path in ``model``.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    whole = df.fillna(0.0, subset=list(features))
    learned = whole.where((F.col("part") == "train") & F.col(target).isNotNull())
    decays = {r.fold: decayed(F.lit(r.last), F.lit(r.mean), half_life_days) for r in fold_decay(learned, half_life_days).collect()}  # one row per fold
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    forest = RandomForestRegressor(featuresCol="_x", labelCol=target, weightCol="weight", numTrees=trees, maxDepth=depth, seed=7)
    preds, imps = None, None
    for fold in folds:
        model = Pipeline(stages=[assembler, forest]).fit(learned.where(F.col("fold") == fold).withColumn("weight", decays[fold]))
        path = f"{store.rstrip('/')}/fold={fold}" if store else None
        if path:
            model.write().save(path)
        test = model.transform(whole.where((F.col("fold") == fold) & (F.col("part") == "test"))).select("tk", "d", "fold", target, F.col("prediction"))
        weights = model.stages[-1].featureImportances.toArray()
        gain = df.sparkSession.createDataFrame([(fold, c, float(v), path) for c, v in zip(features, weights)], "fold int, name string, gain double, model string")
        preds = test if preds is None else preds.unionByName(test)
        imps = gain if imps is None else imps.unionByName(gain)
    return preds, imps


def score_stored(df: DataFrame, path: str, features: Sequence[str], out: str = "score") -> DataFrame:
    """Scores of a forest that ``fit_folds`` stored; each worker receives the forest once (its size is trees times leaves, not rows).

    ``features`` must be the stored list in its order, and every one a column of ``df``; missing values count as zero, as in fitting.
    """
    from pyspark.ml import PipelineModel

    model = PipelineModel.load(path)
    stored = model.stages[0].getInputCols()
    if list(features) != stored:
        raise ValueError(f"features {list(features)} are not the stored ones {stored}")
    if absent := [c for c in stored if c not in df.columns]:
        raise ValueError(f"columns missing: {absent}")
    kept = [F.col(c).alias(f"_keep_{c}") for c in stored]
    scored = model.transform(df.select("*", *kept).fillna(0.0, subset=stored))
    return scored.select(*[F.col(f"_keep_{c}").alias(c) if c in stored else F.col(c) for c in df.columns], F.col("prediction").alias(out))


def score_panel(df: DataFrame, features: Sequence[str], model: Callable[[pd.DataFrame], pd.Series], out: str = "score") -> DataFrame:
    """Scores of a user's fitted model, batch by batch; ``model`` maps a frame of the features to one number per row."""

    @F.pandas_udf("double")
    def scored(x: pd.DataFrame) -> pd.Series:
        return pd.Series(model(x), dtype="float64")

    return df.withColumn(out, scored(F.struct(*features)))
