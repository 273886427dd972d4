"""Ten component scores as linear blends over the standardised and raw panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwave import config
from panelwave.functions.expr import clip, flag, lookup, weighted
from panelwave.operators import xsection as xs

col = F.col


def zc(name: str) -> Column:
    return col(f"z_{name}")


def z0(name: str) -> Column:
    """Standardised feature with NULL read as 0 (features that are undefined for small peer groups)."""
    return F.coalesce(zc(name), F.lit(0.0))


#: features whose z-scores the ten components blend, and features that they or the states read as they are
Z_INPUTS = (
    "sharpe_rank_252d", "gain_to_pain_ratio_252d", "information_ratio_252d", "sortino_rank_126d", "rs_rating_slope_60d", "rs_rating_slope_120d",
    "rs_line_spy_new_high_252d", "rs_line_spy_slope_60d", "rs_line_spy_r_squared_60d", "rs_line_qqq_new_high_252d", "mtf_rs_coherence",
    "within_basket_z_63d", "rs_rating_spy", "adx_14", "trend_r_squared_60d", "trend_rsquared_252d", "hurst_exponent_252d",
    "return_autocorrelation_60d_lag1", "trend_slope_60d", "weekly_stack_alignment", "weekly_higher_highs", "weekly_rs_rising",
    "monthly_close_above_sma_10", "monthly_higher_highs_3m", "vol_normalized_extension", "pct_ma_50", "price_z_score_vs_trend",
    "sharpe_momentum_rank_126d", "within_basket_z_21d", "rs_line_spy_new_high_60d", "rs_line_spy_slope_20d", "sma_stack_score", "ema_stack_score",
    "hh_count_60d", "hl_count_60d", "supertrend_direction", "new_252d_high", "pct_up_days_21", "momentum_21d_pct", "rs_line_spy_slope_21d",
)
RAW_INPUTS = (
    "residual_momentum_126d", "low_rel_vol_10d", "volume_buzz_50", "supertrend_days_since_flip", "plus_di", "minus_di", "weekly_macd_posture",
    "weekly_trend_slope_sign", "macd_posture", "rsi_14", "bullish_divergence_20d", "bearish_divergence_20d", "up_down_vol_ratio_50",
    "volume_leadership_confirmed", "trend_slope_t_stat", "atr_x_50", "bb_width_pct_252d", "vcp_quality_score", "bb_squeeze_flag",
    "days_near_52w_high_60d", "distribution_days_25",
)

_ROBUST = {
    "x_resid": "residual_momentum_126d", "x_super": "_super", "x_di": "_di", "x_low": "low_rel_vol_10d", "x_buzz": "volume_buzz_50",
    "x_ud": "_ln_ud",
}
_STANDARD = {"x_wmacd": "_wmacd", "x_wslope": "_wslope", "x_macd": "_macd", "x_rsi": "_rsi", "x_div": "_div"}


def extra_matrix(x: np.ndarray) -> np.ndarray:
    """z-scores of one date's derived inputs (robust ones first) and of the volume blend made of two of them."""
    k = len(_ROBUST)
    robust, rest = xs.matrix_robust_z(x[:, :k]), x[:, k:]
    _, mean, sd = xs.matrix_moments(rest)
    standard = np.where(sd < 1e-10, 0.0, (rest - mean) / np.where(sd == 0, np.nan, sd))
    low, buzz = (list(_ROBUST).index(c) for c in ("x_low", "x_buzz"))
    blend = robust[:, low] * 0.5 + robust[:, buzz] * 0.5
    return np.concatenate([robust, standard, xs.matrix_robust_z(blend[:, None])], axis=1)


#: derived inputs, what ``extra_matrix`` makes of them, and features that the blends read as they are
EXTRA_INPUTS = (*_ROBUST.values(), *_STANDARD.values())
EXTRA_OUTPUTS = (*_ROBUST, *_STANDARD, "x_vol")
READ_RAW = ("volume_leadership_confirmed", "trend_slope_t_stat", "pct_ma_50")


def derived_inputs(df: DataFrame) -> DataFrame:
    """The row's own part of the derived inputs."""
    rsi = col("rsi_14")
    return df.withColumns({
        "_super": col("supertrend_direction") * col("supertrend_days_since_flip"),
        "_di": col("plus_di") - col("minus_di"),
        "_wmacd": flag(col("weekly_macd_posture") == "Positive"),
        "_wslope": flag(col("weekly_trend_slope_sign") > 0),
        "_macd": lookup(col("macd_posture"), config.MACD_SCORE, 50.0),
        "_rsi": F.when(rsi > 75, 20.0).when(rsi < 30, 80.0).otherwise(50.0),
        "_div": (F.coalesce("bullish_divergence_20d", F.lit(0.0)) - F.coalesce("bearish_divergence_20d", F.lit(0.0))) * 15.0,
        "_ln_ud": F.ln(clip(col("up_down_vol_ratio_50"), lo=1e-10)),
    })


def extra_inputs(df: DataFrame, bound: xs.Bound = xs.Bound(), dealt: bool = False) -> DataFrame:
    """Derived inputs that need their own cross-section on each date."""
    raw = derived_inputs(df)
    if xs._fits(bound, len(_ROBUST) + len(_STANDARD)):
        return xs.matrix_columns(raw, ["date"], EXTRA_INPUTS, EXTRA_OUTPUTS, extra_matrix, dealt)
    rz = xs.robust_z(raw, ["date"], _ROBUST, bound)
    sz = xs.standard_z(rz, ["date"], _STANDARD, bound=bound)
    return xs.robust_z(
        sz.withColumn("_vol", col("x_low") * 0.5 + col("x_buzz") * 0.5), ["date"], {"x_vol": "_vol"}, bound
    )


class Columns:
    """What the blends are made of, as Spark columns."""

    z, z0, raw = staticmethod(zc), staticmethod(z0), staticmethod(col)
    weighted, clip = staticmethod(weighted), staticmethod(clip)

    @staticmethod
    def when(cond: Column, x, other) -> Column:
        """x where the condition holds; an unknown one does not."""
        return F.when(cond, x).otherwise(other)

    @staticmethod
    def abs(x: Column) -> Column:
        return F.abs(x)


class Arrays:
    """The same over one date's matrix, NaN being null."""

    def __init__(self, columns: Mapping[str, np.ndarray]):
        self.raw = columns.__getitem__

    def z(self, name: str) -> np.ndarray:
        return self.raw(f"z_{name}")

    def z0(self, name: str) -> np.ndarray:
        return np.nan_to_num(self.z(name))

    @staticmethod
    def weighted(terms: Sequence[tuple[float, np.ndarray]]) -> np.ndarray:
        out = None
        for w, x in terms:
            out = w * x if out is None else out + w * x
        return out

    @staticmethod
    def clip(x: np.ndarray, lo: float = -np.inf, hi: float = np.inf) -> np.ndarray:
        return np.maximum(np.minimum(x, hi), lo)

    when, abs = staticmethod(np.where), staticmethod(np.abs)


def component_columns(of: type[Columns] | Arrays = Columns) -> dict[str, Column] | dict[str, np.ndarray]:
    """The ten components, as columns or over the arrays of one date."""
    zc, z0, col, weighted, clip = of.z, of.z0, of.raw, of.weighted, of.clip
    quality = weighted([(.30, zc("sharpe_rank_252d")), (.30, zc("gain_to_pain_ratio_252d")),
                        (.30, zc("information_ratio_252d")), (.10, zc("sortino_rank_126d"))])
    accel = weighted([(.5, zc("rs_rating_slope_60d")), (.5, z0("rs_rating_slope_120d"))])
    line = weighted([(.20, zc("rs_line_spy_new_high_252d")), (.15, zc("rs_line_spy_slope_60d")),
                     (.50, zc("rs_line_spy_r_squared_60d")), (.15, zc("rs_line_qqq_new_high_252d"))])
    confluence = weighted([(.55, zc("mtf_rs_coherence")), (.45, z0("within_basket_z_63d"))])
    leadership = weighted([(.30, zc("rs_rating_spy")), (.15, quality), (.10, accel), (.20, line), (.15, confluence),
                           (.10, zc("information_ratio_252d"))])
    trend = weighted([
        (.20, zc("adx_14")), (.15, zc("trend_r_squared_60d")), (.10, zc("trend_rsquared_252d")),
        (.15, zc("hurst_exponent_252d")), (.15, zc("return_autocorrelation_60d_lag1")), (.10, zc("trend_slope_60d")),
        (.10, col("x_super")), (.05, col("x_di")),
    ])
    weekly = weighted([(.30, zc("weekly_stack_alignment")), (.20, zc("weekly_higher_highs")),
                       (.20, zc("weekly_rs_rising")), (.15, col("x_wmacd")), (.15, col("x_wslope"))])
    monthly = weighted([(.5, zc("monthly_close_above_sma_10")), (.5, zc("monthly_higher_highs_3m"))])
    pct50 = col("pct_ma_50")
    stretched = weighted([(-.55, zc("vol_normalized_extension")), (-.30, zc("pct_ma_50")),
                          (-.15, zc("price_z_score_vs_trend"))])
    return {
        "s_rs": weighted([(.55, zc("rs_rating_spy")), (.30, zc("sharpe_momentum_rank_126d")), (.15, z0("within_basket_z_21d"))]),
        "s_rs_leadership": of.when(col("volume_leadership_confirmed") == 1.0, leadership, clip(leadership, hi=config.CAP_Z)),
        "s_residual_momentum": clip(col("x_resid"), -10, 10),
        "s_rsl": weighted([(.40, zc("rs_line_spy_new_high_252d")), (.25, zc("rs_line_spy_new_high_60d")),
                           (.20, zc("rs_line_spy_slope_20d")), (.15, zc("rs_line_spy_r_squared_60d"))]),
        "s_trend_slope": of.when(of.abs(col("trend_slope_t_stat")) < 1.96, trend * 0.5, trend),
        "s_structure": weighted([
            (.20, zc("sma_stack_score")), (.20, zc("ema_stack_score")), (-.10, zc("hh_count_60d")),
            (.25, zc("hl_count_60d")), (.10, zc("supertrend_direction")), (.10, zc("new_252d_high")),
            (.05, zc("pct_up_days_21")),
        ]),
        "s_mtf": weighted([(.80, weekly), (.20, monthly)]),
        "s_extension": of.when(pct50 < -10, -1.0, of.when((pct50 >= -10) & (pct50 < -3), -0.5, stretched)),
        "s_momentum": weighted([(.40, zc("momentum_21d_pct")), (.20, zc("rs_line_spy_slope_21d")), (.20, col("x_macd")),
                                (.10, col("x_rsi")), (.10, col("x_div"))]),
        "s_volume": clip(col("x_vol"), -10, 10),
    }


def retired_demand() -> Column:
    """Demand blend kept for comparison; not part of the composite."""
    return weighted([(.30, col("x_ud")), (-.25, zc("distribution_days_25")), (.20, zc("ad_line_slope_20")),
                     (.15, zc("cmf_21")), (.10, zc("volume_z_20_252"))])


def components(standardized: DataFrame, bound: xs.Bound = xs.Bound(), demand: bool = False, dealt: bool = False) -> DataFrame:
    """Append the ten component columns (and optionally the retired ``s_demand``). ``dealt``: rows are partitioned by date already."""
    df = extra_inputs(standardized, bound, dealt)
    cols = component_columns()
    if demand:
        cols["s_demand"] = retired_demand()
    return df.select(*standardized.columns, *[c.alias(n) for n, c in cols.items()])
