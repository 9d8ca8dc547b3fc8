"""The full feature panel.

Point-in-time joins come first, while rows are narrow; then one exchange by entity serves every window and the
grouped map. The resulting table is written once (it is what downstream jobs read anyway), and the rank pass reads
only the ranked columns of it, in a narrow long form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.numeric import floor_round
from panelforge.functions.ranking import rank_many
from panelforge.functions.recursive import beta_step, grouped
from panelforge.functions.staging import staged
from panelforge.functions.windows import Axis
from panelforge.operators import bars as B
from panelforge.operators import crosssection as X
from panelforge.operators import features as E
from panelforge.operators import fundamentals as FU
from panelforge.operators import indicators as I

TK = Axis(("tk",), "d")

BETAS = {
    "beta_to_ix50": "ret_ix50", "beta_to_ix500": "ret_ix500", "beta_to_fx": "ret_fx", "beta_to_vix": "ret_vix",
    "beta_to_crude": "ret_crude", "beta_to_gold": "ret_gold", "beta_to_fii": "ret_fii", "beta_to_dii": "ret_dii",
}
MARKET_COLUMNS = (*BETAS.values(), "ix500_return_21d", "ix500_return_60d", "rate_change")
RANKS = (
    ("mom_1m_rank", "return_21d", ("d",), 2),
    ("mom_12_1_rank", "mom_12_1", ("d",), 2),
    ("mom_6_1_rank", "mom_6_1", ("d",), 2),
    ("rs_21d_rank", "rs_21d", ("d",), 2),
    ("roa_sector_rank", "roa", ("d", "sector"), 3),
    ("ebitda_margin_sector_rank", "ebitda_margin", ("d", "sector"), 3),
    ("revenue_growth_sector_rank", "revenue_yoy_growth", ("d", "sector"), 3),
    ("_target_rank", "_target_pool", ("d",), 1),
)

# Published column groups in order; values are rounded to six decimals.
PRICE = ("return_1d", "log_return_1d", "return_5d", "return_21d", "return_60d", "volatility_20d", "volume_ratio_20d",
         "rs_21d", "rs_60d", "mom_12_1", "mom_6_1")
POSITION = ("price_to_sma20", "price_to_sma50", "price_to_sma200", "price_to_52w_high", "price_to_52w_low")
TECHNICAL = ("macd_hist", "rsi_14", "bb_width", "bb_pctb", "atr_14", "stoch_k", "adx_14", "obv_change_5d", "vwap_dev")
VALUES = (*PRICE, *POSITION, *TECHNICAL, *FU.RATIOS, *FU.RELATIVE, *BETAS, "rate_change", "fx_x_revenue_growth",
          "target_return_21d", "target_vol_5d")
RANK_OUT = tuple(r[0] for r in RANKS if not r[0].startswith("_"))
FLAGS = ("price_gap_flag", "sma200_available", "sma50_available", "adx14_available", "volatility20d_available",
         "fundamentals_available", "tier", "regime_int")
TARGETS = ("target_rank_21d", "target_direction_median", "target_direction_tertile")
COLUMNS = ("tk", "d", *VALUES, *RANK_OUT, *FLAGS, *TARGETS)


def feature_panel(
    bars: DataFrame,
    splits: DataFrame,
    statements: DataFrame,
    sectors: DataFrame,
    tiers: DataFrame,
    market: DataFrame,
    regimes: DataFrame,
    financial_sectors: Sequence[str] = (),
) -> DataFrame:
    """Wide (entity, date) feature table with ranks and targets, ready for training and scoring."""
    ratio = staged(FU.ratios(statements, sectors, financial_sectors), "ratios")
    medians = staged(FU.sector_medians(ratio), "sector_medians")
    base = B.adjust_close(bars, B.split_factors(splits))
    base = base.withColumn("vwap", floor_round((F.col("hi") + F.col("lo") + F.col("cl")) / 3, 4))
    base = base.join(sectors.select("tk", "sector"), "tk", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    narrow = staged(base.join(tiers.select("tk", "tier"), "tk"), "bars")
    base = FU.point_in_time(narrow, ratio, medians)
    base = base.join(market.select("d", *MARKET_COLUMNS), "d", "left")
    base = base.join(regimes.select("d", F.col("regime_int").cast("int").alias("regime_int")), "d", "left")

    # Everything below is ordered by date within the entity. The stage is heavy per row, so its partition count is
    # fixed: adaptive coalescing looks at bytes only and would leave most cores idle.
    base = base.repartition(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tk")
    # The recursive pass comes before the windows, whose results it would only carry through.
    base = grouped(base.withColumns(E.simple_returns(TK, "adj", (1,))), TK, [I.recursive_step("adj"), beta_step("return_1d", BETAS)])
    feats = E.add_price_features(I.windowed(base, TK, "adj"), TK, "adj")
    feats = E.targets(feats, TK, "adj", "log_return_1d", dates=narrow)
    feats = feats.withColumns(
        {
            "price_gap_flag": B.price_gap_flag(TK),
            "sma200_available": E.present("sma_200"),
            "sma50_available": E.present("sma_50"),
            "volatility20d_available": E.present("volatility_20d"),
            "rs_21d": E.relative_strength("return_21d", "ix500_return_21d"),
            "rs_60d": E.relative_strength("return_60d", "ix500_return_60d"),
            "fx_x_revenue_growth": F.col("ret_fx") * F.col("revenue_yoy_growth"),
        }
    )
    feats = feats.withColumn("adx14_available", E.present("adx_14"))
    feats = feats.select("tk", "d", "sector", *[floor_round(c, 6).alias(c) for c in VALUES], *FLAGS)
    feats = staged(feats, "features")

    # stored values are what ranks compare, so they are rounded before ranking
    pool = F.when(F.col("tier").isin(1, 2), F.col("target_return_21d"))
    ranked = rank_many(feats.withColumn("_target_pool", pool), ["tk", "d"], RANKS, digits=None)
    p = F.col("_target_rank")
    return ranked.withColumns(
        {
            **{c: floor_round(c, 6) for c in RANK_OUT},
            "target_rank_21d": floor_round(p, 6),
            "target_direction_median": (p > 0.5).cast("int"),
            "target_direction_tertile": F.when(p > 2.0 / 3.0, 1).when(p < 1.0 / 3.0, 0).cast("int"),
        }
    ).select(*COLUMNS)
