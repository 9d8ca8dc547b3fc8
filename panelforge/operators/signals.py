"""Model ranks, regime-weighted blend, final signals and their reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.numeric import floor_round
from panelforge.functions.ranking import quantiles, rank_many, rank_pct
from panelforge.operators.bars import latest_per_key
from panelforge.operators.regimes import DEFAULT_REGIME

# Blend weights of the three models per regime integer, tier multipliers and thresholds.
WEIGHTS = {0: (0.4568, 0.3432, 0.20), 1: (0.425, 0.425, 0.15), 2: (0.45, 0.45, 0.10), 3: (0.425, 0.425, 0.15)}
TIER_MULT = {1: 1.0, 2: 1.0, 3: 1.0}
UNKNOWN_TIER_MULT = 0.5
BUY_AT, SELL_AT = 0.80, 0.20
NEUTRAL = 0.5
SIGNAL_NAMES = {1: "BUY", -1: "SELL", 0: "NEUTRAL"}


def model_ranks(scores: DataFrame, models: Sequence[str] = ("s1", "s2", "s3")) -> DataFrame:
    """Percentile rank of each model score per date, as ``r1``, ``r2``, ...; missing scores have no rank."""
    specs = [(f"r{i}", c, ["d"], 1) for i, c in enumerate(models, 1)]
    return rank_many(scores, ["tk", "d"], specs, digits=None)


def add_missing_scores(df: DataFrame, expected: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.lit(value) for c in expected if c not in df.columns})


def _lookup(key: Column, table: dict[int, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def weight(regime: Column, model: int) -> Column:
    return _lookup(regime, {k: w[model] for k, w in WEIGHTS.items()}, WEIGHTS[DEFAULT_REGIME][model])


def blend(ranked: DataFrame, regimes: DataFrame) -> DataFrame:
    """Weighted rank score; a missing regime is the default one and a missing third rank is neutral."""
    day = regimes.select("d", "regime_int").dropDuplicates(["d"])
    df = ranked.join(day, "d", "left").withColumn("regime_int", F.coalesce("regime_int", F.lit(DEFAULT_REGIME)))
    w = [weight(F.col("regime_int"), i) for i in range(3)]
    third = F.coalesce("r3", F.lit(NEUTRAL))
    return df.withColumn("raw_score", w[0] * F.col("r1") + w[1] * F.col("r2") + w[2] * third)


def shrink_by_tier(df: DataFrame, multipliers: dict[int, float] = TIER_MULT) -> DataFrame:
    """Pull the score towards neutral by the tier multiplier."""
    mult = _lookup(F.col("tier"), multipliers, UNKNOWN_TIER_MULT)
    return df.withColumn("score", NEUTRAL + (F.col("raw_score") - NEUTRAL) * mult)


def sector_override(df: DataFrame, tier: int = 3) -> DataFrame:
    """Lowest-tier names take the mean first-tier score of their sector and date, neutral when there is none."""
    leaders = df.where("tier = 1").groupBy("d", "sector").agg(floor_round(F.avg("raw_score"), 9).alias("_lead"))
    out = df.join(leaders, ["d", "sector"], "left")
    swapped = NEUTRAL + (F.coalesce("_lead", F.lit(NEUTRAL)) - NEUTRAL) * TIER_MULT[tier]
    return out.withColumn("score", F.when(F.col("tier") == tier, swapped).otherwise(F.col("score"))).drop("_lead")


def final_signal(df: DataFrame, buy: float = BUY_AT, sell: float = SELL_AT) -> DataFrame:
    """Rank of the blended score per date and BUY/SELL/HOLD as 1/-1/0; the lowest tier is never sold.

    Scores are ranked at nine decimals, so that ties do not depend on the order of additions.
    """
    out = rank_pct(df.withColumn("_s", floor_round("score", 9)), ["d"], "_s", "final_rank", digits=None).drop("_s")
    p = F.col("final_rank")
    sig = F.when((p <= sell) & (F.coalesce("tier", F.lit(0)) != 3), -1).when((p >= buy) & (p > sell), 1).otherwise(0)
    return out.withColumn("signal", sig)


def fill_vol(df: DataFrame, c: str = "vol") -> DataFrame:
    """Missing volatility takes the exact global median."""
    med = quantiles(df, [], c, {"m": 0.5}).select("m").scalar()
    return df.withColumn(c, F.coalesce(F.col(c), med))


OUTCOMES = ("fwd_21", "fwd_63", "fwd_252")


def calibration_table(df: DataFrame, bins: int = 10) -> DataFrame:
    """Mean outcomes and the 5th/95th percentile of the first one per equal-width rank bin."""
    b = F.least(F.floor(F.col("final_rank") * bins), F.lit(bins - 1)).cast("int")
    keyed = df.withColumn("bin", b)
    means = keyed.groupBy("bin").agg(*[floor_round(F.avg(c)).alias(f"mean_{c}") for c in OUTCOMES])
    q = quantiles(keyed, ["bin"], "fwd_21", {"p05_fwd_21": 0.05, "p95_fwd_21": 0.95})
    q = q.select("bin", floor_round("p05_fwd_21").alias("p05_fwd_21"), floor_round("p95_fwd_21").alias("p95_fwd_21"))
    return means.join(q, "bin", "left").withColumns(
        {
            "rank_lo": F.col("bin") / F.lit(float(bins)),
            "rank_hi": (F.col("bin") + 1) / F.lit(float(bins)),
            "rank_mid": (F.col("bin") + 0.5) / F.lit(float(bins)),
        }
    )


CALIBRATED = ("mean_fwd_21", "mean_fwd_63", "mean_fwd_252", "p05_fwd_21", "p95_fwd_21")


def calibrate(df: DataFrame, table: DataFrame, cols: Sequence[str] = CALIBRATED) -> DataFrame:
    """First bin (by lower edge) that holds the rank, both edges included, else the bin with the nearest middle.

    The table has one row per bin, so it travels as one array value instead of a range join.
    """
    fields = ["rank_lo", "rank_hi", "rank_mid", *cols]
    bins = table.agg(F.array_sort(F.collect_list(F.struct(*fields)))).scalar()
    rows = df.withColumn("_bins", bins)
    inside = F.filter("_bins", lambda b: (b["rank_lo"] <= F.col("final_rank")) & (F.col("final_rank") <= b["rank_hi"]))
    nearest = F.array_min(
        F.transform("_bins", lambda b: F.struct(F.abs(b["rank_mid"] - F.col("final_rank")).alias("gap"), b.alias("b")))
    )["b"]
    rows = rows.withColumn("_hit", F.coalesce(F.get(inside, F.lit(0)), nearest))
    return rows.withColumns({c: F.col("_hit")[c] for c in cols}).drop("_bins", "_hit")


def rank_distribution(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Quantiles of the final rank, rows at or above a threshold and their share, and the number of dates."""
    probs = {"min_rank": 0.0, "p10": 0.10, "p50": 0.50, "p82": 0.82, "max_rank": 1.0}
    q = quantiles(df, [], "final_rank", probs).select(F.struct(*probs).alias("q")).scalar()
    above = F.count_if(F.col("final_rank") >= threshold)
    out = df.agg(above.alias("n_above"), floor_round(above / F.count("final_rank"), 6).alias("share_above"), F.count_distinct("d").alias("n_dates"))
    return out.withColumn("_q", q).select(*[floor_round(F.col("_q")[c], 6).alias(c) for c in probs], "n_above", "share_above", "n_dates")


def regime_breakdown(df: DataFrame) -> DataFrame:
    g = df.groupBy("regime_int").agg(F.count(F.lit(1)).alias("n_rows"))
    return g.withColumns({f"w{i + 1}": weight(F.col("regime_int"), i) for i in range(3)})


def on_last_date(df: DataFrame) -> DataFrame:
    return df.where(F.col("d") == df.agg(F.max("d")).scalar())


def screen(signals: DataFrame, names: DataFrame, prices: DataFrame, asof: Column, signal: int | None = None, text: str = "") -> DataFrame:
    """Signals of one kind whose ticker, name or sector contains a text, best first, with the price on or before a date."""
    df = signals.join(names, "tk", "left").withColumn("name", F.coalesce("name", "tk"))
    if signal is not None:
        df = df.where(F.col("signal") == signal)
    if text.strip():
        s = text.strip().upper()
        hit = F.lit(False)
        for c in ("tk", "name", "sector"):
            hit = hit | F.coalesce(F.upper(c).contains(s), F.lit(False))
        df = df.where(hit)
    last = latest_per_key(prices, ["tk"], "d", asof).select("tk", "cl", "vol")
    kind = _name(F.col("signal"))
    return df.join(last.withColumnRenamed("vol", "volume"), "tk", "left").select(
        "tk", "name", "sector", "final_rank", kind.alias("kind"), "cl", "volume"
    ).orderBy(F.desc("final_rank"), "tk")


def _name(signal: Column) -> Column:
    return F.when(signal == 1, "BUY").when(signal == -1, "SELL").otherwise("NEUTRAL")


def sector_counts(df: DataFrame) -> DataFrame:
    """BUY and SELL names per sector."""
    rows = df.where("signal <> 0").withColumn("kind", _name(F.col("signal")))
    return rows.groupBy("kind", "sector").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", F.desc("n"), "sector")


def signal_kpis(df: DataFrame) -> DataFrame:
    """Counts per signal, date and regime of the last date."""
    return on_last_date(df).groupBy("d").agg(
        F.count_if(F.col("signal") == 1).alias("n_buy"),
        F.count_if(F.col("signal") == -1).alias("n_sell"),
        F.count_if(F.col("signal") == 0).alias("n_hold"),
        F.min("regime_int").alias("regime_int"),
    )
