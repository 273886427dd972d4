"""Per-entity time-series features and their cross-sectional ratings.

Stages and exchanges:

* E1 (partitioned by entity): recursion stage, then window layers that all share one partitioning and sort;
* X1 (partitioned by date): percentile ratings and peer-group z / rank;
* E2 (partitioned by entity): row shifts of a rating.

Inside E1 each layer is one ``withColumns``; a layer only reads columns of earlier layers, so Spark plans one
Window operator per layer and drops the window expressions nobody selects.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwave import config
from panelwave.functions.expr import clip, div, flag
from panelwave.functions.rolling import TimeAxis, ols_last_residual_z, ols_r2, ols_tstat
from panelwave.operators import xsection as xs
from panelwave.operators.entity_kernel import kernel_features
from panelwave.operators.sizing import materialize, spread
from panelwave.operators.recursive import period_indicators, recursive_indicators

YEAR = math.sqrt(252.0)
col = F.col

RATED = {  # rating -> raw input; every one but rs_rating_spy is rounded
    "sharpe_momentum_rank_126d": "sharpe_126", "sortino_rank_126d": "sortino_126", "sharpe_rank_60d": "sharpe_ratio_60d",
    "sharpe_rank_252d": "sharpe_252", "tail_ratio_252d": "tail_raw_252", "momentum_21d_pct": "ret_21_pct",
    "max_drawdown_pct_60d": "max_drawdown_raw_60", "vol_percentile_21d": "realized_vol_21",
}


def above(a: Column, b: Column) -> Column:
    """a > b by more than the rounding of an average: flat prices meet their averages but for the last bits."""
    return F.round(a - b, 9) > 0


# ---- weekly / monthly branch --------------------------------------------------------------------
def week_zero() -> Column:
    """A Friday: label of week 0."""
    return F.lit("1970-01-02").cast("date")


def week_index(date: Column) -> Column:
    """Index of the Friday that closes the date's week."""
    return F.ceil(F.datediff(date, week_zero()) / 7.0).cast("int")


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def period_bars(panel: DataFrame, index: Column) -> DataFrame:
    """Dense period bars per entity: last non-null close, max high, min low, summed volume, benchmark close.

    A period with no calendar day gets a row of NULLs (volume 0), so row shifts count periods.
    """
    agg = panel.groupBy("entity", index.alias("p")).agg(
        F.max_by("close", F.when(col("close").isNotNull(), col("date"))).alias("close"),
        F.max("high").alias("high"), F.min("low").alias("low"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        F.max_by("b1_close", "date").alias("b1_close"),
    )
    w = Window.partitionBy("entity").orderBy("p")
    fields = ["close", "high", "low", "volume", "b1_close"]
    spread = agg.withColumn("_until", F.coalesce(F.lead("p").over(w) - 1, col("p"))).select(
        "entity", col("p").alias("_p"), *fields, F.explode(F.sequence("p", "_until")).alias("p")
    )
    here = col("p") == col("_p")
    return spread.select(
        "entity", "p",
        *[F.when(here, col(f)).otherwise(F.lit(0.0) if f == "volume" else F.lit(None)).alias(f) for f in fields],
    )


def weekly_features(panel: DataFrame) -> DataFrame:
    """Weekly features keyed (entity, p = Friday index)."""
    w = TimeAxis("entity", "p")
    bars = period_indicators(period_bars(panel, week_index(col("date"))), "p")
    c, rs = col("close"), col("rs_line")
    x = bars.withColumns({
        "sma_30": w.mean(c, 30), "sma_40": w.mean(c, 40),
        "rs_line": div(c, col("b1_close")),
        "slope_26": w.slope(F.ln(c), 26),
        "high_8": w.max(col("high"), 8), "high_8_before": w.max(col("high"), 8, shift=8),
    })
    macd = col("ema_12") - col("ema_26")
    return x.select(
        "entity", "p",
        flag((c > col("ema_10")) & (col("ema_10") > col("sma_30")) & (col("sma_30") > col("sma_40"))).alias("weekly_stack_alignment"),
        flag(col("high_8") > col("high_8_before")).alias("weekly_higher_highs"),
        flag(rs > w.lag(rs, 5)).alias("weekly_rs_rising"),
        col("rsi_14").alias("weekly_rsi_14"),
        F.when(macd > 0, "Positive").when(macd.isNotNull(), "Negative").alias("weekly_macd_posture"),
        F.signum("slope_26").alias("weekly_trend_slope_sign"),
        flag(rs >= w.max(rs, 26, shift=1)).alias("weekly_rs_new_high_26w"),
        flag(rs > w.lag(rs, 1)).alias("_w_rising"),
    )


def monthly_features(panel: DataFrame) -> DataFrame:
    """Monthly features keyed (entity, p = month index)."""
    m = TimeAxis("entity", "p")
    c, h, rs = col("close"), col("high"), col("rs_line")
    x = period_bars(panel, month_index(col("date"))).withColumn("rs_line", div(c, col("b1_close")))
    return x.select(
        "entity", "p",
        flag(c > m.mean(c, 10)).alias("monthly_close_above_sma_10"),
        flag((h > m.lag(h, 1)) & (m.lag(h, 1) > m.lag(h, 2))).alias("monthly_higher_highs_3m"),
        flag(rs > m.lag(rs, 3)).alias("monthly_rs_rising_3m"),
        flag(rs > m.lag(rs, 6)).alias("monthly_rs_rising_6m"),
        flag(rs > m.lag(rs, 1)).alias("_m_rising"),
    )


def week_label(p: Column) -> Column:
    return F.date_add(week_zero(), p * 7)


def month_label(p: Column) -> Column:
    zero_based = p - 1
    return F.last_day(F.make_date(F.floor(zero_based / 12).cast("int"), F.pmod(zero_based, F.lit(12)) + 1, F.lit(1)))


def attach_as_of(panel: DataFrame, events: Mapping[str, DataFrame]) -> DataFrame:
    """As-of backward join of any number of event tables (entity, date, columns...) in one pass.

    Events join the entity's rows as extra rows; a running last-non-null carries each table's latest record.
    One exchange on entity serves this step and every window layer after it. A row sees the record of the
    same date, never a later one; before the first record its columns are NULL.
    """
    rows = panel.withColumn("_k", F.lit(1))
    for name, ev in events.items():
        record = F.struct(*[c for c in ev.columns if c not in ("entity", "date")]).alias(name)
        rows = rows.unionByName(ev.select("entity", "date", F.lit(0).alias("_k"), record), allowMissingColumns=True)
    w = Window.partitionBy("entity").orderBy("date", "_k").rowsBetween(Window.unboundedPreceding, 0)
    seen = spread(rows, "entity").withColumns({n: F.last(n, ignorenulls=True).over(w) for n in events}).where(col("_k") == 1)
    flat = [col(f"{n}.{c}").alias(c) for n, ev in events.items() for c in ev.columns if c not in ("entity", "date")]
    return seen.select(*panel.columns, *flat)


def calendar_events(panel: DataFrame) -> dict[str, DataFrame]:
    """Weekly and monthly features as event tables dated by their period label."""
    weekly = weekly_features(panel)
    monthly = monthly_features(panel)
    return {
        "_weekly": weekly.select("entity", week_label(col("p")).alias("date"), *weekly.columns[2:]),
        "_monthly": monthly.select("entity", month_label(col("p")).alias("date"), *monthly.columns[2:]),
    }


def vcp_events(panel: DataFrame, out: str = "vcp_quality_score") -> DataFrame:
    """Contracting-base score at each confirmed peak, from the last three peak-to-peak segments.

    A segment includes both of its peaks, so a peak row feeds two segments; segments are then one small
    aggregate per entity. The score holds until the next peak (attach with ``attach_as_of``).
    """
    w = TimeAxis("entity", "date")
    c = col("close")
    centred = w.frame(-10, 10)
    marked = panel.select("entity", "date", "t", "close", "volume").withColumns({
        "_peak": F.coalesce((F.count(c).over(centred) == 21) & (F.max(c).over(centred) == c), F.lit(False)),
        "_rows": F.max("t").over(w.whole) + 1,
    })
    numbered = marked.withColumn("_no", F.count_if("_peak").over(w.running))
    parts = numbered.withColumn("_seg", F.explode(
        F.when(col("_peak"), F.array(col("_no") - 1, col("_no"))).otherwise(F.array("_no")))).where(col("_seg") >= 1)
    segs = parts.groupBy("entity", "_seg").agg(
        F.count_if("_peak").alias("peaks"), F.count("*").alias("n"), F.count("close").alias("valid"),
        F.min("close").alias("low"), F.min_by("close", "date").alias("start"), F.percentile("volume", 0.5).alias("vol"),
        F.max("date").alias("date"), F.max("_rows").alias("rows"),
    ).where(col("peaks") == 2)
    usable = (col("n") >= 5) & (col("valid") == col("n"))
    s = TimeAxis("entity", "_seg")
    x = segs.withColumns({"d2": F.when(usable, (col("start") - col("low")) / col("start")), "v2": F.when(usable, col("vol"))})
    x = x.withColumns({f"{k}{1 - i}": s.lag(col(f"{k}2"), i + 1) for k in "dv" for i in (0, 1)})
    d0, d1, d2, v0, v1, v2 = (col(n) for n in ("d0", "d1", "d2", "v0", "v1", "v2"))
    known = d0.isNotNull() & d1.isNotNull() & d2.isNotNull() & v0.isNotNull() & v1.isNotNull() & v2.isNotNull()
    contracting, drying = (d0 > d1) & (d1 > d2) & (d2 > 0), (v0 > v1) & (v1 > v2)
    base = F.when(contracting & drying, 70.0).when(contracting, 50.0).when(drying, 30.0).otherwise(10.0)
    bonus = F.greatest(F.lit(0.0), F.lit(0.08) - d2) / 0.08 * 30.0
    score = F.when(known & (col("_seg") >= 3) & (col("rows") >= 80), F.least(F.lit(100.0), base + bonus)).otherwise(0.0)
    return x.select("entity", "date", score.alias(out))


# ---- E1: window layers --------------------------------------------------------------------------
def _base_layer(w: TimeAxis) -> dict[str, Column]:
    c, h, l, v = col("close"), col("high"), col("low"), col("volume")
    lnc = F.ln(c)
    o60 = w.ols(lnc, 60)
    line1, line2 = div(c, col("b1_close")), div(c, col("b2_close"))
    centred = w.frame(-5, 5)
    layer = {
        "prev_close": w.lag(c), "prev_volume": w.lag(v),
        "daily_ret": w.change(c, 1), "prev_ret": div(w.lag(c, 1), w.lag(c, 2)) - 1.0,
        "log_ret_diff": lnc - w.lag(lnc),
        "b1_log_ret": F.ln("b1_close") - w.lag(F.ln("b1_close")),
        "b1_ret": w.change(col("b1_close"), 1),
        "sma_50": w.mean(c, 50), "sma_200": w.mean(c, 200), "sma_20": w.mean(c, 20), "std_20": w.std(c, 20),
        "adr_pct_20": w.mean(F.ln(div(h, l)), 20) * 100.0,
        "high_max_20d": w.max(h, 20), "low_20": w.min(l, 20), "high_60": w.max(h, 60), "low_60": w.min(l, 60),
        "high_50": w.max(h, 50, 20), "low_50": w.min(l, 50, 20),
        "high_252": w.max(h, 252, 60), "low_252": w.min(l, 252, 60),
        "close_max_40d": w.max(c, 40), "close_min_40d": w.min(c, 40), "close_max_60": w.max(c, 60, 20),
        "high_20_prior": w.max(h, 20, shift=1), "high_252_prior": w.max(h, 252, shift=1),
        "vol_mean_20": w.mean(v, 20), "vol_mean_252": w.mean(v, 252), "vol_std_252": w.std(v, 252),
        "vol_avg_50": w.mean(v, 50, 20), "vma_50": w.mean(v, 50), "vol_min_10": w.min(v, 10),
        "ret_21": w.change(c, 21), "ret_63": w.change(c, 63), "ret_126": w.change(c, 126),
        "_rs1": line1, "_rs2": line2,
        "_rs1_base": F.first(line1, ignorenulls=True).over(w.whole),
        "_rs2_base": F.first(line2, ignorenulls=True).over(w.whole),
        "_is_ph": (F.count(h).over(centred) == 11) & (F.max(h).over(centred) == h),
        "_is_pl": (F.count(l).over(centred) == 11) & (F.min(l).over(centred) == l),
        "trend_rsquared_252d": w.r2(lnc, 252),
    }
    layer.update({f"_o60_{k}": v for k, v in o60.items()})
    return layer


def _second_layer(w: TimeAxis, recursive: bool) -> dict[str, Column]:
    c, h, l, v, r = col("close"), col("high"), col("low"), col("volume"), col("daily_ret")
    o60 = {k: col(f"_o60_{k}") for k in ("slope", "syy", "sxy", "ybar")}
    rs1, rs2 = col("_rs1") / col("_rs1_base") * 100.0, col("_rs2") / col("_rs2_base") * 100.0
    clv = div((c - l) - (h - c), h - l)
    up, down = F.when(r > 0, r), F.when(r < 0, r)
    excess = r - col("b1_ret")
    range_20, range_60 = col("high_max_20d") - col("low_20"), col("high_60") - col("low_60")
    log_ret = F.log1p(r)
    pivots_h, pivots_l = F.when(col("_is_ph"), h), F.when(col("_is_pl"), l)
    cross = col("log_ret_diff") * col("b1_log_ret")
    # order statistics come with the recursion stage
    tails = {} if recursive else {"p95_252": w.quantile(r, 0.95, 252, 200), "p5_252": w.quantile(r, 0.05, 252, 200)}
    return tails | {
        "rs_line_spy_value": rs1, "rs_line_qqq_value": rs2,
        "log_ret": log_ret, "clv": clv, "excess_ret": excess,
        "pct_ma_50": (c - col("sma_50")) / col("sma_50") * 100.0,
        "pct_ma_200": (c - col("sma_200")) / col("sma_200") * 100.0,
        "pct_from_20d_high": (c - col("high_max_20d")) / col("high_max_20d") * 100.0,
        "range_20d_pct_of_price": range_20 / c * 100.0, "range_60d_pct_of_price": range_60 / c * 100.0,
        "range_20d_to_60d_ratio": div(range_20, range_60),
        "position_in_60d_range": div(c - col("low_60"), range_60),
        "trend_slope_60d": (F.exp(o60["slope"] * 252.0) - 1.0) * 100.0,
        "trend_r_squared_60d": ols_r2(o60), "trend_slope_t_stat": ols_tstat(o60, 60),
        "price_z_score_vs_trend": ols_last_residual_z(o60, F.ln(c), 60),
        "realized_vol_20": w.std(r, 20) * YEAR * 100.0, "realized_vol_21": w.std(r, 21) * YEAR * 100.0,
        "realized_vol_60": w.std(r, 60) * YEAR * 100.0,
        "volume_z_20_252": div(col("vol_mean_20") - col("vol_mean_252"), col("vol_std_252")),
        "_up_volume": w.sum(F.when(r.isNull() | (r <= 0), 0.0).otherwise(v), 50, 20),
        "_down_volume": w.sum(F.when(r.isNull() | (r >= 0), 0.0).otherwise(v), 50, 20),
        "distribution_days_25": w.sum(flag((c < col("prev_close") * 0.998) & (v > col("prev_volume"))), 25, 10),
        "ad_line": F.sum(F.coalesce(clv * v, F.lit(0.0))).over(w.running),
        "cmf_21": div(w.sum(clv * v, 21), w.sum(v, 21)),
        "low_rel_vol_10d": F.when(col("vol_min_10").isNotNull(), flag(v <= col("vol_min_10"))),
        "volume_buzz_50": (div(v, col("vma_50")) - 1.0) * 100.0,
        "mean_126": w.mean(r, 126), "std_126": w.std(r, 126), "down_std_126": w.std(down, 126, 20),
        "mean_60": w.mean(r, 60, 40), "std_60": w.std(r, 60, 40),
        "mean_252": w.mean(r, 252, 200), "std_252": w.std(r, 252, 200),
        "excess_mean_252": w.mean(excess, 252, 200), "excess_std_252": w.std(excess, 252, 200),
        "excess_mean_60": w.mean(excess, 60, 40), "excess_std_60": w.std(excess, 60, 40),
        "upside_vol_60d": w.std(up, 60, 20) * 100.0, "downside_vol_60d": w.std(down, 60, 20) * 100.0,
        "_gain_252": w.sum(F.when(r > 0, r).otherwise(0.0), 252), "_pain_252": w.sum(F.when(r < 0, r).otherwise(0.0), 252),
        "return_autocorrelation_60d_lag1": w.pair_corr(r, col("prev_ret"), 60, 40),
        "return_autocorrelation_21d_lag1": w.pair_corr(r, col("prev_ret"), 21, 15),
        "_cov_252": (w.mean(cross, 252) - w.mean(col("log_ret_diff"), 252) * w.mean(col("b1_log_ret"), 252)) * (252.0 / 251.0),
        "_b1_var_252": w.roll(F.var_samp, col("b1_log_ret"), 252),
        "drawdown_pct": (div(c, col("close_max_60")) - 1.0) * 100.0,
        "_near_high": flag(c >= col("high_252") * 0.97), "_off_high": flag(c < col("high_252") * 0.90),
        "pct_from_52w_high": (div(c, col("high_252")) - 1.0) * 100.0,
        "pct_from_52w_low": (div(c, col("low_252")) - 1.0) * 100.0,
        "new_252d_high": flag(c >= col("high_252_prior")),
        "_broke_20": flag(c >= col("high_20_prior")),
        "pct_up_days_21": w.mean(flag(r > 0), 21),
        "bb_upper_20": col("sma_20") + col("std_20") * 2.0, "bb_lower_20": col("sma_20") - col("std_20") * 2.0,
        "_prior_max_40": w.lag(col("close_max_40d")), "_prior_min_40": w.lag(col("close_min_40d")),
        "_ph_up": F.when(col("_is_ph"), flag(h > F.last(pivots_h, ignorenulls=True).over(w.before))),
        "_pl_up": F.when(col("_is_pl"), flag(l > F.last(pivots_l, ignorenulls=True).over(w.before))),
    }


def _third_layer(w: TimeAxis, recursive: bool) -> dict[str, Column]:
    c, h, l, v, r = col("close"), col("high"), col("low"), col("volume"), col("daily_ret")
    rs1, rs2 = col("rs_line_spy_value"), col("rs_line_qqq_value")
    rng_50 = col("high_50") - col("low_50")
    place_50 = div(c - col("low_50"), rng_50)
    in_60 = w.frame(-59, 0)

    def rising_pivots(name: str) -> Column:
        pairs = F.coalesce(F.sum(name).over(in_60), F.lit(0.0))
        oldest = F.coalesce(F.first(col(name), ignorenulls=True).over(in_60), F.lit(0.0))
        return F.least(pairs - oldest, F.lit(3.0))

    out = {
        "trend_slope_significant": flag(F.abs("trend_slope_t_stat") > 1.96),
        "up_down_vol_ratio_50": div(col("_up_volume"), col("_down_volume")),
        "ad_line_slope_20": w.slope(col("ad_line"), 20), "ad_line_slope_21d": w.slope(col("ad_line"), 21),
        "ad_line_slope_60": w.slope(col("ad_line"), 60),
        "capitulation_volume_flag": flag((v > col("vol_avg_50") * 3.0) & (r < -0.02) & (place_50 < 0.20)),
        "climax_volume_flag": flag((v > col("vol_avg_50") * 4.0) & (r > 0.05) & (place_50 > 0.80)),
        "rs_composite": (
            (w.change(rs1, 63) * 100.0) * 0.40 + (w.change(rs1, 126) * 100.0) * 0.20
            + (w.change(rs1, 189) * 100.0) * 0.20 + (w.change(rs1, 252) * 100.0) * 0.20
        ),
        "sharpe_126": div(col("mean_126"), col("std_126")), "sortino_126": div(col("mean_126"), col("down_std_126")),
        "sharpe_ratio_60d": div(col("mean_60"), col("std_60")) * YEAR,
        "sharpe_252": div(col("mean_252"), col("std_252")) * YEAR,
        "tail_raw_252": div(col("p95_252"), F.abs("p5_252")),
        "information_ratio_252d": div(col("excess_mean_252"), col("excess_std_252")) * YEAR,
        "information_ratio_60d": div(col("excess_mean_60"), col("excess_std_60")) * YEAR,
        "sortino_ratio_60d": div(col("mean_60"), col("downside_vol_60d") / 100.0) * YEAR,
        "gain_to_pain_ratio_252d": div(col("_gain_252"), F.abs("_pain_252")),
        "return_smoothness_60d": div(F.abs("mean_60"), col("std_60")),
        "ret_21_pct": col("ret_21") * 100.0,
        "rs_line_spy_new_high_60d": w.new_high(rs1, 60), "rs_line_spy_new_high_252d": w.new_high(rs1, 252),
        "rs_line_qqq_new_high_60d": w.new_high(rs2, 60), "rs_line_qqq_new_high_252d": w.new_high(rs2, 252),
        "rs_line_spy_slope_20d": w.change(rs1, 20) * 100.0, "rs_line_spy_slope_60d": w.change(rs1, 60) * 100.0,
        "rs_line_spy_slope_21d": w.change(rs1, 21) * 100.0,
        "rs_line_qqq_slope_20d": w.change(rs2, 20) * 100.0, "rs_line_qqq_slope_60d": w.change(rs2, 60) * 100.0,
        "rs_line_spy_r_squared_60d": w.r2(F.ln(rs1), 60),
        "_d_rising": flag(rs1 > w.lag(rs1, 5)),
        "beta_252d": div(col("_cov_252"), col("_b1_var_252")),
        "_above_50": flag(above(c, col("sma_50"))), "_above_200": flag(above(c, col("sma_200"))),
        "_50_above_200": flag(above(col("sma_50"), col("sma_200"))),
        "hh_count_60d": rising_pivots("_ph_up"), "hl_count_60d": rising_pivots("_pl_up"),
        "failed_breakout_flag_10d": flag((F.max("_broke_20").over(w.frame(-9, 0)) == 1.0) & (c < col("high_20_prior"))),
        "_bb_width": div(col("bb_upper_20") - col("bb_lower_20"), col("sma_20")),
        "_bb_pos": div(c - col("bb_lower_20"), col("bb_upper_20") - col("bb_lower_20")),
        "ulcer_index_60d": F.sqrt(w.mean(col("drawdown_pct") * col("drawdown_pct"), 60, 20)),
        "max_drawdown_raw_60": w.min(col("drawdown_pct"), 60, 20),
        "base_duration_days": w.sum(col("_off_high"), 252, 60),
        "days_near_52w_high_60d": w.sum(col("_near_high"), 60, 20),
        "consecutive_high_intensity": w.sum(col("_near_high"), 5),
        "_breakdown_level": F.when((c < col("_prior_min_40")) & (c < col("sma_50")), col("_prior_min_40")),
    }
    if not recursive:
        out["pct_ma_50_p80_252d"] = w.quantile(col("pct_ma_50"), 0.8, 252)
    else:
        line, sig = col("macd_line"), col("macd_signal")
        hist = line - sig
        rsi = F.round("rsi_14", 9)  # flat closes leave it unchanged but for the last bits
        out |= {
            "atr_pct": col("atr_14") / c * 100.0,
            "atr_x_50": div(c - col("sma_50"), col("atr_14")), "atr_x_200": div(c - col("sma_200"), col("atr_14")),
            "true_range_x_atr14": div(col("true_range"), col("atr_14")),
            "_breakout_level": F.when(
                (c > col("_prior_max_40")) & (div(col("true_range"), col("atr_14")) > 1.3), col("_prior_max_40")),
            "adx_trend_direction": F.when(col("plus_di") > col("minus_di"), 1.0).when(
                col("plus_di").isNotNull() & col("minus_di").isNotNull(), -1.0),
            "ema_stack_score": (
                flag(above(c, col("ema_8"))) * 30 + flag(above(col("ema_8"), col("ema_21"))) * 30
                + flag(above(col("ema_21"), col("ema_50"))) * 30
                + flag(above(c, col("ema_8")) & above(col("ema_8"), col("ema_21")) & above(col("ema_21"), col("ema_50"))) * 10
            ),
            "macd_histogram": hist,
            "_hist_up": hist > w.lag(hist), "_hist_down": hist < w.lag(hist),
            "_hist_bar": w.mean(F.abs(hist), 50, 10) * 1.5,
            "bullish_divergence_20d": flag(
                (w.min(c, 10) < w.min(c, 10, shift=10)) & (w.min(rsi, 10) > w.min(rsi, 10, shift=10))),
            "bearish_divergence_20d": flag(
                (w.max(c, 10) > w.max(c, 10, shift=10)) & (w.max(rsi, 10) < w.max(rsi, 10, shift=10))),
            "bb_squeeze_flag": flag(
                (col("bb_upper_20") < col("ema_20") + col("atr_10") * 1.5)
                & (col("bb_lower_20") > col("ema_20") - col("atr_10") * 1.5)),
        }
    return out


def _fourth_layer(w: TimeAxis, recursive: bool) -> dict[str, Column]:
    c = col("close")
    prior5 = w.frame(-5, -1)
    out = {
        "failed_breakdown_flag_5d_v2": flag(c > F.min("_breakdown_level").over(prior5)),
        "_resid": col("log_ret_diff") - w.lag(col("beta_252d")) * col("b1_log_ret"),
        "sma_stack_score": (
            col("_above_50") * 30 + col("_above_200") * 30 + col("_50_above_200") * 30
            + flag((col("_above_50") == 1) & (col("_above_200") == 1) & (col("_50_above_200") == 1)) * 10
        ),
        "trend_integrity": flag((col("hh_count_60d") >= 2) & (col("hl_count_60d") >= 2)),
        "bb_position_21d": w.mean(col("_bb_pos"), 21, 15),
        "volume_leadership_confirmed": flag(
            (col("up_down_vol_ratio_50") >= 1.5) & (col("ad_line_slope_60") > 0.05) & (col("distribution_days_25") <= 3)),
        "pct_above_sma_50": col("_above_50"), "pct_above_sma_200": col("_above_200"),
    }
    if not recursive:
        out["bb_width_pct_252d"] = w.rank_in_window(col("_bb_width"), 252, 60) * 100.0
    else:
        line = col("macd_line")
        faster = ((line > 0) & col("_hist_up")) | ((line < 0) & col("_hist_down"))
        out |= {
            "vol_normalized_extension": col("atr_x_50") / clip(col("adr_pct_20"), lo=1.0),
            "failed_breakout_flag_5d_v2": flag(c < F.max("_breakout_level").over(prior5)),
            "macd_posture": F.when(line.isNotNull(), F.concat_ws(
                "/",
                F.when(line > 0, "Positive").otherwise("Negative"),
                F.when(faster, "Accelerating").otherwise("Decelerating"),
                F.when(F.abs("macd_histogram") > col("_hist_bar"), "Strong").otherwise("Weak"))),
        }
    return out


def _fifth_layer(w: TimeAxis) -> dict[str, Column]:
    return {f"residual_momentum_{n}d": w.sum(col("_resid"), n) for n in (63, 126, 252)}


#: most calendar days of a panel whose entities are held whole, one at a time (about 250 doubles a day)
KERNEL_DATES = 100_000
FROM_EVENTS = (
    "weekly_stack_alignment", "weekly_higher_highs", "weekly_rs_rising", "weekly_rsi_14", "weekly_macd_posture", "weekly_trend_slope_sign",
    "weekly_rs_new_high_26w", "monthly_close_above_sma_10", "monthly_higher_highs_3m", "monthly_rs_rising_3m", "monthly_rs_rising_6m",
    "vcp_quality_score",
)
PEER_RETURNS = ("ret_21", "ret_63", "ret_126")
RATING_INPUTS = ("rs_composite", *RATED.values(), *PEER_RETURNS)
CROSS = (
    "rs_rating_spy", *RATED, *[f"within_basket_z_{n}d" for n in (21, 63, 126)], "within_basket_rank", "within_basket_rank_pct",
    "rs_rating_slope_60d", "rs_rating_slope_120d",
)


def rating_inputs(only: Sequence[str] | None = None) -> list[str]:
    """Columns that the ratings among these features (all by default) are made from."""
    if only is None:
        return list(RATING_INPUTS)
    made = {"rs_rating_spy": "rs_composite", "rs_rating_slope_60d": "rs_composite", "rs_rating_slope_120d": "rs_composite", **RATED,
            "within_basket_rank": "ret_63", "within_basket_rank_pct": "ret_63", **{f"within_basket_z_{r[4:]}d": r for r in PEER_RETURNS}}
    return [c for c in RATING_INPUTS if any(made.get(f) == c for f in only)]


def time_features(panel: DataFrame, recursive: bool = True, periods: bool = True, bound: xs.Bound = xs.Bound(),
                  keep: Sequence[str] = (), only: Sequence[str] | None = None) -> DataFrame:
    """E1: every per-entity feature, or those in ``only`` where entities are held whole. ``recursive=False`` skips the Arrow stage and what depends on it;
    ``periods=False`` skips the weekly, monthly and peak-segment branches.

    A calendar that is proven short lets a task hold one entity's history: then all window layers are array operations on
    it (``entity_kernel``). Otherwise recursions stream and windows are planned by Spark. Both give the same columns.
    """
    w = TimeAxis("entity", "date", "t")
    if recursive and periods and bound.groups is not None and bound.groups <= KERNEL_DATES:
        wanted = set(config.FEATURES if only is None else only)
        events = calendar_events(panel)
        if "mtf_rs_coherence" not in wanted:  # the one column that reads both
            events = {n: e for n, e in events.items() if wanted & set(e.columns)}
        if "vcp_quality_score" in wanted:
            events["_vcp"] = vcp_events(panel)
        used = {n: e.select("entity", "date", *[c for c in e.columns[2:] if c in wanted or c.startswith("_")]) for n, e in events.items()}
        df = attach_as_of(panel, used)
        if "vcp_quality_score" in wanted:
            df = df.withColumn("vcp_quality_score", F.coalesce("vcp_quality_score", F.lit(0.0)))
        df = df.withColumns({c: F.lit(None).cast("double") for c in ("_w_rising", "_m_rising") if c not in df.columns})
        columns = [c for c in config.FEATURES if c in wanted and c not in FROM_EVENTS and c not in CROSS]
        return kernel_features(df, list(dict.fromkeys([*columns, *rating_inputs(only), *keep])))
    df = recursive_indicators(panel) if recursive else panel
    if periods:
        df = attach_as_of(df, {**calendar_events(panel), "_vcp": vcp_events(panel)})
        df = df.withColumn("vcp_quality_score", F.coalesce("vcp_quality_score", F.lit(0.0)))
    for layer in (_base_layer(w), _second_layer(w, recursive), _third_layer(w, recursive), _fourth_layer(w, recursive), _fifth_layer(w)):
        df = df.withColumns(layer)
    if periods:
        rising = [F.coalesce(col(c), F.lit(0.0)) for c in ("_w_rising", "_m_rising")]
        df = df.withColumn("mtf_rs_coherence", col("_d_rising") + rising[0] + rising[1])
    return df


def cross_features(df: DataFrame, bound: xs.Bound = xs.Bound(), rated: Sequence[str] | None = None) -> DataFrame:
    """X1 + E2: percentile ratings, peer-group z / rank, and shifts of the relative-strength rating.

    Only keys and rating inputs go to the dates and back; the other columns meet the ratings in one join on the key.
    """
    wanted = {k: v for k, v in RATED.items() if rated is None or k in rated}
    inputs = list(dict.fromkeys(["rs_composite", *wanted.values(), *PEER_RETURNS]))
    x = on_dates(spread(df.select("entity", "date", "t", "grp", "grp_size", *inputs), "date"), wanted, PEER_RETURNS, bound)
    return with_slopes(df, x)


def on_dates(x: DataFrame, rated: Mapping[str, str], returns: Sequence[str], bound: xs.Bound) -> DataFrame:
    """Ratings, and peer-group z and rank, of rows that are dealt by date."""
    if "rs_composite" in x.columns:
        x = xs.percentile_rating(x, ["date"], {"rs_rating_spy": "rs_composite"}, bound, rounded=False)
    if rated:
        x = xs.percentile_rating(x, ["date"], rated, bound)
    if returns:
        x = xs.group_z(x, ["date", "grp"], {f"within_basket_z_{r[4:]}d": r for r in returns}, "grp_size", bound=xs.Bound(bound.rows))
    if "ret_63" in x.columns:
        x = xs.group_rank(x, ["date", "grp"], "ret_63", "grp_size", "within_basket_rank", "within_basket_rank_pct", bound=bound)
    return x


def with_slopes(df: DataFrame, x: DataFrame) -> DataFrame:
    """E2: shifts of the relative-strength rating, and the join of the ratings with all other columns."""
    w = TimeAxis("entity", "date", "t")
    x = spread(x, "entity").withColumns({
        f"rs_rating_slope_{n}d": col("rs_rating_spy") - w.lag(col("rs_rating_spy"), n) for n in (60, 120)
    })
    made = [c for c in CROSS if c in x.columns]
    return df.drop(*made).join(x.select("entity", "date", *made), ["entity", "date"])


def selected_features(panel: DataFrame, benchmarks: Sequence[str], only: Sequence[str], bound: xs.Bound) -> DataFrame:
    """These features alone, as ``compute_features`` makes them. Without shifts of a rating, rows go to their dates once, stay
    there and are not written; otherwise they are written without what was not asked for."""
    only = [c for c in config.FEATURES if c in only]
    inputs, rated = rating_inputs(only), {k: v for k, v in RATED.items() if k in only}
    returns = [r for r in PEER_RETURNS if f"within_basket_z_{r[4:]}d" in only]
    cols = dict.fromkeys([*inputs, *[c for c in only if c not in CROSS]])
    own = time_features(panel, bound=bound, only=only).select("entity", "date", "t", "grp", "grp_size", *cols)
    if any(c.startswith("rs_rating_slope") for c in only):
        own = materialize(own)
        x = on_dates(spread(own.select("entity", "date", "t", "grp", "grp_size", *inputs), "date"), rated, returns, bound)
        df = with_slopes(own, x)
    else:
        df = on_dates(spread(own, "date"), rated, returns, bound)
    return df.where(~col("entity").isin(*benchmarks)).select("entity", "date", "t", "grp", "grp_size", *only)


def compute_features(panel: DataFrame, benchmarks: Sequence[str], bound: xs.Bound = xs.Bound(),
                     keep: Sequence[str] = ()) -> DataFrame:
    """The stored feature panel: keys, grp and the 108 feature columns, benchmarks removed."""
    own = materialize(time_features(panel, bound=bound, keep=keep).select(
        "entity", "date", "t", "grp", "grp_size", *dict.fromkeys([*keep, *RATING_INPUTS, *[c for c in config.FEATURES if c not in CROSS]])))
    df = cross_features(own, bound)
    return df.where(~col("entity").isin(*benchmarks)).select("entity", "date", "t", "grp", "grp_size", *keep, *config.FEATURES)
