"""Market regimes: feature frame, state statistics, labels, segments and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.numeric import floor_round, safe_ln, safe_ratio
from panelforge.functions.windows import MARKET
from panelforge.operators.features import realised_vol

# Regime labels and their integers; a missing regime counts as Sideways.
REGIME_INT = {"Bull": 0, "Bear": 1, "HighVol": 2, "Sideways": 3}
DEFAULT_REGIME = 3


def regime_features(market: DataFrame, flow_z: str = "ret_fii", max_null_share: float = 0.2) -> DataFrame:
    """Index log returns over 1 and 5 rows, 20-row volatility, carried volatility index and flow z-score.

    The flow column is blanked as a whole when more than ``max_null_share`` of it is missing after carrying.
    """
    a = market.withColumns(
        {
            "ret_1": safe_ln(safe_ratio("ix500", MARKET.shift("ix500"))),
            "ret_5": safe_ln(safe_ratio("ix500", MARKET.shift("ix500", 5))),
            "vix": MARKET.ffill("vix"),
            "flow_z": MARKET.ffill(flow_z),
        }
    ).withColumn("vol_20", realised_vol(MARKET, "ret_1", 20, 15))
    share = a.agg((1 - F.count("flow_z") / F.count(F.lit(1))).alias("s")).scalar()
    return a.select("d", "ret_1", "ret_5", "vol_20", "vix", F.when(share <= max_null_share, F.col("flow_z")).alias("flow_z"))


def state_stats(states: DataFrame) -> DataFrame:
    """Means per raw state."""
    return states.groupBy("state").agg(
        floor_round(F.avg("ret_1")).alias("mean_return"),
        floor_round(F.avg("vix")).alias("mean_vix"),
        floor_round(F.avg("vol_20")).alias("mean_vol"),
        floor_round(F.avg("ret_5")).alias("mean_ret_5"),
        F.count("ret_1").alias("n"),
    )


def label_states(stats: DataFrame) -> DataFrame:
    """Name four raw states: best return, then worst return-plus-fear score, then highest fear, then the rest."""

    # the frame has one row per state, so these windows order a handful of rows
    bull = F.row_number().over(Window.orderBy(F.desc("mean_return"), "state")) == 1
    out = stats.withColumn("_bull", bull)
    rest = Window.partitionBy("_bull")
    low, high = F.min("mean_vix").over(rest), F.max("mean_vix").over(rest)
    fear = (F.col("mean_vix") - low) / F.when(high > low, high - low).otherwise(1.0)
    out = out.withColumn("_score", -F.col("mean_return") + 0.5 * fear)
    out = out.withColumn("_bear", ~F.col("_bull") & (F.row_number().over(rest.orderBy(F.desc("_score"), "state")) == 1))
    last_two = Window.partitionBy("_bull", "_bear").orderBy(F.desc("mean_vix"), "state")
    label = (
        F.when(F.col("_bull"), "Bull")
        .when(F.col("_bear"), "Bear")
        .when(F.row_number().over(last_two) == 1, "HighVol")
        .otherwise("Sideways")
    )
    out = out.withColumn("label", label)
    code = F.create_map(*[F.lit(v) for kv in REGIME_INT.items() for v in kv])
    return out.select("state", "label", code[F.col("label")].alias("regime_int"))


def segments(series: DataFrame, label: str = "label") -> DataFrame:
    """Runs of equal labels: start, end and length."""
    changed = F.when(MARKET.shift(label).eqNullSafe(F.col(label)), 0).otherwise(1)
    runs = series.withColumn("_new", changed).withColumn("segment", MARKET.running(F.sum, "_new"))
    return runs.groupBy("segment", label).agg(
        F.min("d").alias("start_date"), F.max("d").alias("end_date"), F.count(F.lit(1)).alias("days")
    )


def transitions(series: DataFrame, label: str = "label") -> DataFrame:
    """Share of moves from each label to each next label."""
    step = series.select(F.col(label).alias("from_label"), MARKET.shift(label, -1).alias("to_label")).where("to_label is not null")
    pair = step.groupBy("from_label", "to_label").agg(F.count(F.lit(1)).alias("n"))
    return pair.withColumn("share", floor_round(F.col("n") / F.sum("n").over(Window.partitionBy("from_label")), 6))


def distribution(series: DataFrame, label: str = "label") -> DataFrame:
    """Days, share and mean features per label."""
    n = series.agg(F.count(F.lit(1))).scalar()
    return series.groupBy(label).agg(
        F.count(F.lit(1)).alias("days"),
        floor_round(F.avg("ret_1")).alias("mean_return"),
        floor_round(F.avg("vix"), 4).alias("mean_vix"),
        floor_round(F.avg("vol_20")).alias("mean_vol"),
    ).withColumn("share", floor_round(F.col("days") / n, 6))


def regime_of_day(series: DataFrame, days: DataFrame) -> DataFrame:
    """One regime integer per date, missing dates taking the default."""
    one = series.groupBy("d").agg(F.min("regime_int").alias("regime_int"))
    return days.select("d").distinct().join(one, "d", "left").withColumn(
        "regime_int", F.coalesce("regime_int", F.lit(DEFAULT_REGIME))
    )
