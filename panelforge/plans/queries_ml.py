"""Training-table and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.numeric import floor_round
from panelforge.functions.staging import published, stage_path
from panelforge.functions.windows import Axis
from panelforge.operators import bars as B
from panelforge.operators import features as E
from panelforge.operators import mlprep as ML
from panelforge.plans.oracle_views import r, view
from panelforge.plans.queries_bars import adj
from panelforge.plans.queries_features import rank_sql, tiers3
from panelforge.plans.registry import query

TK = Axis(("tk",), "d")
HOLD = "2001-01-01"
FLAGS = {"vol_ok": (0, ["volatility_20d"]), "gap": (1, ["return_21d", "mom_12_1"])}

view(
    "mlb",
    f"""SELECT f.tk, f.d, ti.tier, {r('f.return_21d')} AS return_21d, {r('f.volatility_20d')} AS volatility_20d, {r('f.mom_12_1')} AS mom_12_1, {r('t.target_return_21d')} AS target,
    {r('-f.return_21d')} AS pred, CAST(f.volatility_20d IS NOT NULL AS INT) AS vol_ok, CAST(CASE WHEN f.d - lag(f.d) OVER (PARTITION BY f.tk ORDER BY f.d) > 5 THEN 1 ELSE 0 END AS INT) AS gap
    FROM feat f JOIN targ t USING (tk,d) JOIN tier3 ti USING (tk)""",
    "feat", "targ", "tier3",
)


@published("ml_base")
def base(spark, sf):
    b = adj(spark, sf).withColumn("log_return_1d", E.log_return(TK, "adj"))
    b = b.withColumns({**E.simple_returns(TK, "adj", (21,)), **E.momentum(TK, "adj"), "volatility_20d": E.realised_vol(TK, "log_return_1d"), "gap": B.price_gap_flag(TK)})
    b = E.targets(b, TK, "adj", "log_return_1d", dates=adj(spark, sf)).join(tiers3(spark, sf), "tk")
    return b.select(
        "tk", "d", "tier", *[floor_round(c).alias(c) for c in ("return_21d", "volatility_20d", "mom_12_1")], floor_round("target_return_21d").alias("target"),
        floor_round(-F.col("return_21d")).alias("pred"), E.present("volatility_20d").alias("vol_ok"), "gap",
    )


def hold():
    return F.lit(HOLD).cast("date")


view("mls", f"SELECT *, CASE WHEN d < DATE '{HOLD}' THEN 'train' ELSE 'holdout' END AS part FROM mlb WHERE tier IN (1,2) AND target IS NOT NULL", "mlb")


def split(spark, sf):
    return ML.holdout_split(base(spark, sf), "target", hold())


@query("ml_holdout_split", "SELECT tk, d, part FROM mls", ("mls",))
def ml_holdout_split(spark, sf):
    return split(spark, sf).select("tk", "d", "part")


view("mlmed", f"""SELECT 'vol_ok' AS flag, 'volatility_20d' AS name, median(volatility_20d) AS median FROM mlb WHERE vol_ok=1 UNION ALL
  SELECT 'gap', 'return_21d', median(return_21d) FROM mlb WHERE gap=0 UNION ALL SELECT 'gap', 'mom_12_1', median(mom_12_1) FROM mlb WHERE gap=0""", "mlb")


@query("ml_flag_medians", f"SELECT flag, name, {r('median')} AS median FROM mlmed", ("mlmed",))
def ml_flag_medians(spark, sf):
    return ML.flag_medians(base(spark, sf), FLAGS).withColumn("median", floor_round("median"))


def _fill(c, flag, miss):
    return f"{r(f'CASE WHEN {flag}={miss} AND {c} IS NULL THEN (SELECT median FROM mlmed WHERE name={chr(39)}{c}{chr(39)}) ELSE {c} END')} AS {c}"


@query("ml_flag_impute", f"SELECT tk, d, {_fill('volatility_20d', 'vol_ok', 0)}, {_fill('return_21d', 'gap', 1)}, {_fill('mom_12_1', 'gap', 1)} FROM mlb", ("mlb", "mlmed"))
def ml_flag_impute(spark, sf):
    b = base(spark, sf)
    out = ML.flag_impute(b, ML.flag_medians(b, FLAGS), FLAGS)
    return out.select("tk", "d", *[floor_round(c).alias(c) for c in ("volatility_20d", "return_21d", "mom_12_1")])


@query(
    "ml_ffill_bfill",
    """SELECT tk, d, coalesce(last_value(target IGNORE NULLS) OVER (PARTITION BY tk ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(target IGNORE NULLS) OVER (PARTITION BY tk ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS target,
    coalesce(last_value(mom_12_1 IGNORE NULLS) OVER (PARTITION BY tk ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(mom_12_1 IGNORE NULLS) OVER (PARTITION BY tk ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS mom_12_1 FROM mlb""",
    ("mlb",),
)
def ml_ffill_bfill(spark, sf):
    return ML.fill_both_ways(base(spark, sf), {"target": 0.0, "mom_12_1": 0.0}).select("tk", "d", "target", "mom_12_1")


@query(
    "ml_winsorize",
    f"""WITH q AS (SELECT coalesce(mom_12_1, (SELECT median(mom_12_1) FROM mlb)) AS x FROM mlb), o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM q),
    b AS (SELECT max(CASE WHEN i = floor(0.01::DOUBLE*n) THEN x END) AS lo, max(CASE WHEN i = n-1-floor(0.01::DOUBLE*n) THEN x END) AS hi FROM o)
    SELECT tk, d, {r('CASE WHEN mom_12_1 < lo THEN lo WHEN mom_12_1 > hi THEN hi ELSE mom_12_1 END')} AS mom_12_1 FROM mlb, b""",
    ("mlb",),
)
def ml_winsorize(spark, sf):
    return ML.winsorize(base(spark, sf), "mom_12_1").select("tk", "d", floor_round("mom_12_1").alias("mom_12_1"))


@query(
    "ml_standardize",
    f"SELECT tk, d, {r(f'(volatility_20d-(SELECT avg(volatility_20d) FROM mlb WHERE d < DATE {chr(39)}{HOLD}{chr(39)}))/(SELECT stddev_pop(volatility_20d) FROM mlb WHERE d < DATE {chr(39)}{HOLD}{chr(39)})')} AS volatility_20d FROM mlb",
    ("mlb",),
)
def ml_standardize(spark, sf):
    return ML.standardize(base(spark, sf), ["volatility_20d"], F.col("d") < hold()).select("tk", "d", floor_round("volatility_20d").alias("volatility_20d"))


view(
    "folds",
    """SELECT CAST(row_number() OVER (ORDER BY i DESC) AS INT) AS fold, train_start, train_end, test_start, test_end FROM (
    SELECT *, CAST(train_end - INTERVAL 24 MONTH AS DATE) AS train_start FROM (SELECT *, test_start - 21 AS train_end FROM (
    SELECT *, CAST(test_end - INTERVAL 6 MONTH AS DATE) AS test_start FROM (SELECT i, lo, CAST(hi - to_months(CAST(6*i AS INT)) AS DATE) AS test_end FROM
    (SELECT min(d) AS lo, max(d) AS hi FROM mls WHERE part='train'), range(8) t(i))))) WHERE train_start >= lo""",
    "mls",
)


def training(spark, sf):
    """Rows before the holdout date: everything that is fitted or cut into folds."""
    return split(spark, sf).where("part = 'train'").drop("part")


def folds(spark, sf):
    return ML.walk_forward_folds(training(spark, sf), 8, 6, 21, 2)


@query("ml_folds", "SELECT * FROM folds", ("folds",))
def ml_folds(spark, sf):
    return folds(spark, sf)


view(
    "frows",
    """SELECT fold, 'train' AS part, mls.* EXCLUDE (part) FROM mls JOIN folds ON d >= train_start AND d < train_end WHERE mls.part = 'train'
    UNION ALL SELECT fold, 'test', mls.* EXCLUDE (part) FROM mls JOIN folds ON d >= test_start AND d < test_end WHERE mls.part = 'train'""",
    "mls", "folds",
)


@query(
    "ml_fold_counts",
    "SELECT fold, part, count(*) AS n FROM frows GROUP BY fold, part",
    ("frows",),
)
def ml_fold_counts(spark, sf):
    return ML.assign_folds(training(spark, sf), folds(spark, sf)).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ml_time_decay",
    f"SELECT tk, d, {r('w/avg(w) OVER ()')} AS weight FROM (SELECT tk, d, exp(-ln(2.0::DOUBLE)*((SELECT max(d) FROM mlb)-d)/365) AS w FROM mlb)",
    ("mlb",),
)
def ml_time_decay(spark, sf):
    return ML.time_decay(base(spark, sf), 365).select("tk", "d", floor_round("weight").alias("weight"))


@query("ml_eligible_keys", "SELECT tk, count(*) AS usable FROM mlb WHERE target IS NOT NULL AND mom_12_1 IS NOT NULL GROUP BY tk HAVING count(*) >= 500", ("mlb",))
def ml_eligible_keys(spark, sf):
    return ML.eligible_keys(base(spark, sf), ["target", "mom_12_1"])


@query(
    "ml_sequences",
    """SELECT tk, d, target, len(a) AS n, md5(array_to_string(a, ',')) AS content FROM (SELECT tk, d, target,
    list(coalesce(CAST(CAST(CAST(round(return_21d*1e6) AS FLOAT) AS BIGINT) AS VARCHAR), 'x') || ':' || CAST(vol_ok AS VARCHAR)) OVER w AS a
    FROM mlb WINDOW w AS (PARTITION BY tk ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE len(a)=60 AND target IS NOT NULL""",
    ("mlb",),
)
def ml_sequences(spark, sf):
    """Whole sequences, as a digest of all their values (returns in millionths)."""
    b = base(spark, sf).withColumn("millionths", F.round(F.col("return_21d") * 1e6))
    s = ML.sequences(b, ["millionths", "vol_ok"], ["target"], 60)
    step = lambda x: F.concat(F.coalesce(x[0].cast("long").cast("string"), F.lit("x")), F.lit(":"), x[1].cast("int").cast("string"))
    content = F.md5(F.array_join(F.transform("seq", step), ",").cast("binary"))
    return s.select("tk", "d", "target", F.size("seq").cast("long").alias("n"), content.alias("content"))


@query(
    "ml_context_slice",
    f"""SELECT tk, d, d < DATE '{HOLD}' AS is_context FROM (SELECT *, row_number() OVER (PARTITION BY tk, d < DATE '{HOLD}' ORDER BY d DESC) AS k FROM mlb) WHERE (d BETWEEN DATE '{HOLD}' AND DATE '2001-06-30') OR (d < DATE '{HOLD}' AND k <= 60)""",
    ("mlb",),
)
def ml_context_slice(spark, sf):
    return ML.context_slice(base(spark, sf).select("tk", "d"), hold(), F.lit("2001-06-30").cast("date"), 60)


@query(
    "ml_clean_val_window",
    """SELECT fold, greatest(CAST(val_end - INTERVAL 6 MONTH AS DATE), DATE '1997-06-01') AS val_start, val_end FROM (SELECT fold, CASE WHEN e BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN DATE '1998-12-31'
    WHEN e BETWEEN DATE '2000-03-01' AND DATE '2000-06-30' THEN DATE '2000-02-29' ELSE e END AS val_end FROM (SELECT fold, train_end - 1 AS e FROM folds))""",
    ("folds",),
)
def ml_clean_val_window(spark, sf):
    return ML.clean_validation_window(folds(spark, sf), [("1999-01-01", "1999-12-31"), ("2000-03-01", "2000-06-30")], F.lit("1997-06-01").cast("date"))


view("icr", f"SELECT tk, d, {rank_sql('pred', 'd', raw=True)} AS x, {rank_sql('target', 'd', raw=True)} AS y FROM mlb WHERE pred IS NOT NULL AND target IS NOT NULL", "mlb")
view("icd", "SELECT d, count(*) AS n, corr(x, y) AS ic FROM icr GROUP BY d HAVING count(*) >= 5 AND count(DISTINCT x) > 1 AND count(DISTINCT y) > 1", "icr")


@query("eval_ic_daily", f"SELECT d, n, {r('ic')} AS ic FROM icd", ("icd",))
def eval_ic_daily(spark, sf):
    return ML.daily_ic(base(spark, sf), "target", "pred").withColumn("ic", floor_round("ic"))


@query("eval_ic_pooled", f"SELECT {r('corr(x,y)')} AS ic, count(*) AS n FROM (SELECT {rank_sql('pred', '1', raw=True)} AS x, {rank_sql('target', '1', raw=True)} AS y FROM mlb WHERE pred IS NOT NULL AND target IS NOT NULL)", ("mlb",))
def eval_ic_pooled(spark, sf):
    return ML.pooled_ic(base(spark, sf), "target", "pred").withColumn("ic", floor_round("ic"))


view("icf", "SELECT CAST(year(d) AS INT) AS fold, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(ic)/nullif(stddev_samp(ic),0) AS icir FROM icd GROUP BY 1", "icd")
_S = ("mean_ic", "std_ic", "min_ic", "max_ic", "mean_icir", "mean_kept")


@query(
    "eval_ic_summary",
    f"""SELECT {', '.join(f'{r(c)} AS {c}' for c in _S)}, CASE WHEN mean_kept > 0.06 THEN 'STRONG' WHEN mean_kept > 0.04 THEN 'GOOD' WHEN mean_kept > 0.02 THEN 'WEAK' ELSE 'POOR' END AS grade FROM
    (SELECT avg(mean_ic) AS mean_ic, stddev_pop(mean_ic) AS std_ic, min(mean_ic) AS min_ic, max(mean_ic) AS max_ic, avg(icir) AS mean_icir, avg(mean_ic) FILTER (WHERE fold NOT IN (1995, 1998)) AS mean_kept FROM icf)""",
    ("icf",),
)
def eval_ic_summary(spark, sf):
    f = ML.ic_by_group(ML.daily_ic(base(spark, sf), "target", "pred"), F.year("d"))
    s = ML.ic_summary(f, (1995, 1998))
    return s.select(*[floor_round(c).alias(c) for c in _S], "grade")


@query(
    "eval_ic_monthly",
    f"SELECT d, {r('mean_ic')} AS mean_ic, {r('sum(s) OVER (ORDER BY d)')} AS cum_ic FROM (SELECT CAST(date_trunc('month', d) AS DATE) AS d, avg(ic) AS mean_ic, sum(ic) AS s FROM icd GROUP BY 1)",
    ("icd",),
)
def eval_ic_monthly(spark, sf):
    m = ML.monthly_ic(ML.daily_ic(base(spark, sf), "target", "pred"))
    return m.select("d", floor_round("mean_ic").alias("mean_ic"), floor_round("cum_ic").alias("cum_ic"))


@query(
    "dq_ml_checks",
    f"""SELECT 'train_before_holdout' AS name, max(CASE WHEN part='train' THEN d END) < DATE '{HOLD}' AS passed FROM mls UNION ALL SELECT 'prediction_floor', min(pred) > -1.15 FROM mls
    UNION ALL SELECT 'prediction_ceiling', max(pred) < 1.15 FROM mls UNION ALL SELECT 'no_missing_prediction', count(*) FILTER (WHERE pred IS NULL) = 0 FROM mls
    UNION ALL SELECT 'purge_gap', count(*) FILTER (WHERE train_end >= test_start) = 0 FROM folds
    UNION ALL SELECT 'folds_before_holdout', count(*) FILTER (WHERE test_end > DATE '{HOLD}') = 0 FROM folds""",
    ("mls", "folds"),
)
def dq_ml_checks(spark, sf):
    return ML.checks(split(spark, sf), folds(spark, sf), "pred", hold(), (-1.15, 1.15))


FEATURES = ("return_21d", "volatility_20d", "mom_12_1")
#: Size of the test forest; the operator's arguments take the published 1000 trees of depth 6.
TREES, DEPTH = 20, 4


@published("fold_rows", parts=("fold", "part"))
def fold_rows(spark, sf):
    return ML.prepare_folds(ML.assign_folds(training(spark, sf), folds(spark, sf)), FEATURES, FLAGS)


def _prepared(c, flag=None, miss=None):
    """Long rows of one feature, prepared per fold."""
    fill = f"CASE WHEN {flag}={miss} AND {c} IS NULL THEN coalesce(med, 0) ELSE {c} END" if flag else c
    med = f"(SELECT median({c}) FROM frows t WHERE t.fold=f.fold AND t.part='train' AND t.{flag}={1 - miss})" if flag else "NULL"
    return f"""SELECT fold, part, tk, d, '{c}' AS name, {fill} AS x FROM frows JOIN (SELECT fold, {med} AS med FROM (SELECT DISTINCT fold FROM frows) f) USING (fold)"""


view("fimp", " UNION ALL ".join((_prepared("volatility_20d", "vol_ok", 0), _prepared("return_21d", "gap", 1), _prepared("mom_12_1", "gap", 1))), "frows")
view(
    "fwin",
    """SELECT i.fold, i.part, tk, d, i.name, CASE WHEN x < lo THEN lo WHEN x > hi THEN hi ELSE x END AS x FROM fimp i JOIN (
    SELECT fold, part, name, max(CASE WHEN k = floor(0.01::DOUBLE*n) THEN x END) AS lo, max(CASE WHEN k = n-1-floor(0.01::DOUBLE*n) THEN x END) AS hi FROM (
    SELECT fold, part, name, x, row_number() OVER (PARTITION BY fold, part, name ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY fold, part, name) AS n FROM (
    SELECT fold, part, name, coalesce(x, median(x) OVER (PARTITION BY fold, part, name)) AS x FROM fimp)) GROUP BY 1, 2, 3) b ON i.fold=b.fold AND i.part=b.part AND i.name=b.name""",
    "fimp",
)


@query(
    "ml_fold_prep",
    f"""SELECT fold, part, tk, d, {', '.join(f"max(CASE WHEN name='{c}' THEN z END) AS {c}" for c in FEATURES)} FROM (
    SELECT w.fold, part, tk, d, w.name, {r('(x-m)/CASE WHEN s > 0 THEN s ELSE 1 END')} AS z FROM fwin w JOIN (
    SELECT fold, name, avg(x) AS m, stddev_pop(x) AS s FROM fwin WHERE part='train' GROUP BY 1, 2) t ON w.fold=t.fold AND w.name=t.name) GROUP BY 1, 2, 3, 4""",
    ("fwin",),
)
def ml_fold_prep(spark, sf):
    return fold_rows(spark, sf).select("fold", "part", "tk", "d", *[floor_round(c).alias(c) for c in FEATURES])


@published("walk_forward")
def walk_forward(spark, sf):
    """Predictions (with a date) and importances (with a name) of every fold, fitted once."""
    rows = fold_rows(spark, sf)
    fitted = [x.fold for x in folds(spark, sf).orderBy("fold").collect()]
    preds, gains = ML.fit_folds(rows, FEATURES, "target", fitted, trees=TREES, depth=DEPTH, store=stage_path(spark, "forests"))
    return preds.unionByName(gains, allowMissingColumns=True)


@query("ml_walk_forward")
def ml_walk_forward(spark, sf):
    return walk_forward(spark, sf).where("d IS NOT NULL").select("tk", "d", "fold", "target", "prediction")


@query(
    "ml_walk_forward_coverage",
    "SELECT fold, count(*) AS n_test, count(*) AS n_predicted, count(DISTINCT tk || ' ' || CAST(d AS VARCHAR)) AS n_keys, true AS in_range FROM frows WHERE part='test' GROUP BY fold",
    ("frows",),
)
def ml_walk_forward_coverage(spark, sf):
    """Every test row of every fold has one prediction, inside the range of the fold's training targets."""
    rows = fold_rows(spark, sf)
    tests = rows.where("part = 'test'").groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"))
    seen = rows.where("part = 'train'").groupBy("fold").agg(F.min("target").alias("lo"), F.max("target").alias("hi"))
    told = ml_walk_forward(spark, sf).groupBy("fold").agg(
        F.count("prediction").alias("n_predicted"), F.count_distinct("tk", "d").alias("n_keys"), F.min("prediction").alias("a"), F.max("prediction").alias("b")
    )
    return tests.join(told, "fold").join(seen, "fold").select("fold", "n_test", "n_predicted", "n_keys", ((F.col("a") >= F.col("lo")) & (F.col("b") <= F.col("hi"))).alias("in_range"))


@query("ml_importance")
def ml_importance(spark, sf):
    imp = walk_forward(spark, sf).where("name IS NOT NULL").groupBy("name").agg(F.avg("gain").alias("mean_gain"))
    return imp.orderBy(F.desc("mean_gain")).limit(30)


@query(
    "ml_score_panel",
    f"SELECT tk, d, {r('0.5::DOUBLE*coalesce(return_21d,0) - 2.0::DOUBLE*coalesce(volatility_20d,0) + 0.25::DOUBLE*coalesce(mom_12_1,0)')} AS score FROM mlb",
    ("mlb",),
)
def ml_score_panel(spark, sf):
    model = lambda x: 0.5 * x["return_21d"].fillna(0.0) - 2.0 * x["volatility_20d"].fillna(0.0) + 0.25 * x["mom_12_1"].fillna(0.0)
    return ML.score_panel(base(spark, sf), FEATURES, model).select("tk", "d", floor_round("score").alias("score"))


@published("holdout_scores")
def holdout_scores(spark, sf):
    """Rows from the holdout date on, prepared with the last fold's training rows and scored by its stored forest."""
    last = walk_forward(spark, sf).where("model IS NOT NULL").select("fold", "model").orderBy(F.desc("fold")).first()
    train = ML.assign_folds(training(spark, sf), folds(spark, sf)).where((F.col("fold") == last.fold) & (F.col("part") == "train"))
    later = split(spark, sf).where("part = 'holdout'").withColumn("fold", F.lit(last.fold))
    ready = ML.prepare_folds(train.unionByName(later), FEATURES, FLAGS)
    return ML.score_stored(ready.where("part = 'holdout'"), last.model, FEATURES).select("tk", "d", "target", "score")


@query("ml_score_holdout")
def ml_score_holdout(spark, sf):
    return holdout_scores(spark, sf)


@query(
    "ml_score_holdout_coverage",
    "SELECT tier, count(*) AS n, count(*) AS n_scored, min(d) AS first_d, max(d) AS last_d FROM mls WHERE part = 'holdout' GROUP BY tier",
    ("mls",),
)
def ml_score_holdout_coverage(spark, sf):
    """Every holdout row has one score."""
    told = holdout_scores(spark, sf).join(base(spark, sf).select("tk", "d", "tier"), ["tk", "d"])
    return told.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))


@query(
    "ml_feature_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count({c}) AS n, CAST(min({c}) AS DOUBLE) AS lowest, CAST(max({c}) AS DOUBLE) AS highest FROM mlb" for c in ("return_21d", "volatility_20d", "mom_12_1", "pred", "vol_ok")
    ),
    ("mlb",),
)
def ml_feature_columns(spark, sf):
    return ML.feature_summary(base(spark, sf), ["tier", "target", "gap"])


@query(
    "eval_ic_decay",
    f"""SELECT {r('(a-b)/nullif(abs(a),0)')} AS decay FROM (SELECT avg(ic) FILTER (WHERE d < DATE '{HOLD}') AS a, avg(ic) FILTER (WHERE d >= DATE '{HOLD}') AS b FROM icd)""",
    ("icd",),
)
def eval_ic_decay(spark, sf):
    ic = ML.daily_ic(base(spark, sf), "target", "pred")
    before = F.avg(F.when(F.col("d") < hold(), F.col("ic")))
    return ic.agg(floor_round(ML.ic_decay(before, F.avg(F.when(F.col("d") >= hold(), F.col("ic"))))).alias("decay"))
