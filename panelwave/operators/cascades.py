"""First-match label cascades over feature and score columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwave import config
from panelwave.functions.expr import all_matches, clip, first_match, lookup, normal_cdf
from panelwave.functions.rolling import TimeAxis
from panelwave.operators import xsection as xs

col = F.col


# ---- leadership ---------------------------------------------------------------------------------
def leadership_rules() -> list[tuple[str, Column]]:
    lead, r, s, m = col("s_rs_leadership_0_100"), col("rs_rating_spy"), col("rs_rating_slope_60d"), col("mtf_rs_coherence")
    confirmed, top = col("volume_leadership_confirmed") == 1.0, col("within_basket_rank") == 1.0
    second_up = col("rs_line_qqq_slope_60d") > 0
    return [
        ("ELITE_LEADER", (lead >= 90) & (r >= 95) & (m == 3) & confirmed & top & second_up),
        ("STRONG_LEADER", (lead >= 80) & (r >= 75) & (m >= 2)),
        ("EMERGING_LEADER", r.between(60, 85) & (s >= 10) & (m >= 2) & second_up),
        ("ESTABLISHED_LEADER", (r >= 75) & (col("rs_line_spy_new_high_252d") == 1.0)),
        ("STRONG_PERFORMER", r >= 60),
        ("DETERIORATING", (r < 40) & (s < -5)),
        ("WEAK_LAGGARD", (r < 25) & (s < 0)),
        ("WEAK_PERFORMER", (r >= 25) & (r < 45) & (s >= -5)),
        ("NEUTRAL", (r >= 45) & (r < 60)),
    ]


def leadership(df: DataFrame) -> DataFrame:
    """Append s_rs_leadership_0_100, leadership_tier (NULL without a rating) and is_basket_leader."""
    df = df.withColumn("s_rs_leadership_0_100", clip(normal_cdf("s_rs_leadership") * 100.0, 0, 100))
    return df.withColumns({
        "leadership_tier": F.when(col("rs_rating_spy").isNotNull(), first_match(leadership_rules(), "UNCLASSIFIED")),
        "is_basket_leader": F.coalesce(col("within_basket_rank") == 1.0, F.lit(False)),
    })


# ---- setups -------------------------------------------------------------------------------------
def bullish_stack() -> Column:
    return (col("close") > col("ema_21")) & (col("ema_21") > col("sma_50")) & (col("sma_50") > col("sma_200"))


def setup_rules() -> list[tuple[str, Column]]:
    """13 chart patterns in priority order; needs _adr_rank, _prior_max, _prior_min."""
    c, stack = col("close"), bullish_stack()
    calm = col("pct_ma_50") <= col("pct_ma_50_p80_252d")
    adr, below_high, dip = col("_adr_rank"), -col("pct_from_52w_high"), -col("pct_from_20d_high")
    place = col("position_in_60d_range")
    return [
        ("New High", (col("new_252d_high") == 1.0) & calm),
        ("Breakout", (c > col("_prior_max")) & (col("true_range_x_atr14") > 1.3)),
        ("Failed Breakout", col("failed_breakout_flag_5d_v2") == 1.0),
        ("Tight Base", stack & (adr <= 0.25) & (below_high <= 5)),
        ("Coiling", stack & (col("range_20d_to_60d_ratio") < 0.6) & (col("bb_width_pct_252d") <= 20)),
        ("Shallow Pullback", stack & (dip >= 3) & (dip <= 10) & (c >= col("ema_21")) & calm),
        ("Deep Pullback", stack & (dip > 10) & (dip <= 20) & (c >= col("sma_50")) & calm),
        ("Extended", stack & (col("pct_ma_50") > col("pct_ma_50_p80_252d"))),
        ("At Highs", stack & (below_high <= 5)),
        ("Basing Low", (col("pct_from_52w_low") <= 10) & (adr <= 0.40)),
        ("Breakdown", (c < col("_prior_min")) & (c < col("sma_50"))),
        ("Reclaim", col("failed_breakdown_flag_5d_v2") == 1.0),
        ("Sideways", (col("range_60d_pct_of_price") < 20) & (place >= 0.25) & (place <= 0.75)),
    ]


def setup_inputs(df: DataFrame, bound: xs.Bound = xs.Bound()) -> DataFrame:
    w = TimeAxis("entity", "date", "t")
    lagged = df.withColumns({"_prior_max": w.lag(col("close_max_40d")), "_prior_min": w.lag(col("close_min_40d"))})
    return xs.pct_rank(lagged, ["date"], {"_adr_rank": "adr_pct_20"}, bound)


def setups(df: DataFrame, bound: xs.Bound = xs.Bound(), every_match: bool = False) -> DataFrame:
    """Append setup ("" = none) and setup_confidence; optionally the list of every matching label."""
    x = setup_inputs(df, bound)
    extra = {"setup_matches": all_matches(setup_rules())} if every_match else {}
    out = x.withColumns({"setup": first_match(setup_rules(), ""), **extra})
    out = out.withColumn("setup_confidence", F.when(col("setup") != "", 1.0).otherwise(0.0))
    return out.drop("_prior_max", "_prior_min", "_adr_rank")


def legacy_setup_rules() -> list[tuple[str, float, Column]]:
    """27-label cascade with a confidence per label; needs atr_14 and failed_breakout_flag_10d."""
    x, p50, r = col("atr_x_50"), col("pct_ma_50"), col("rs_rating_spy")
    sma, ema, adx = col("sma_stack_score"), col("ema_stack_score"), col("adx_14")
    squeeze, width, vcp = col("bb_squeeze_flag") == 1.0, col("bb_width_pct_252d"), col("vcp_quality_score")
    near21 = F.try_divide(F.abs(col("close") - col("ema_21")), col("atr_14"))
    near50 = F.try_divide(F.abs(col("close") - col("sma_50")), col("atr_14"))
    elite, s = col("leadership_tier") == "ELITE_LEADER", col("primary_state")
    return [
        ("Extreme Extension", .95, x >= 6.5),
        ("Exhaustion w/ Bearish Divergence", .90, (x >= 4) & (col("bearish_divergence_20d") == 1.0) & (r >= 85)),
        ("Volume-Confirmed Exhaustion", .90, (x >= 4.5) & (col("climax_volume_flag") == 1.0)),
        ("Extended Exhaustion", .75, (x >= 4) & (col("days_near_52w_high_60d") >= 15) & (r >= 80)),
        ("Capitulation Selling", .85, (p50 < -8) & (col("capitulation_volume_flag") == 1.0)),
        ("Deteriorating w/ Bullish Divergence", .80, (p50 < -5) & (col("bullish_divergence_20d") == 1.0)),
        ("Distribution Pattern", .85, (p50 < -5) & (col("distribution_days_25") >= 8)),
        ("Sustained Weakness", .70, p50 < -8),
        ("Elite Leader Continuation", .95, (col("p_TRENDING") > .5) & elite),
        ("Elite Leader Pullback", .95, (col("p_PULLBACK") > .5) & elite),
        ("Premium Pullback", .95, (sma >= 85) & (ema >= 70) & (p50 > 0) & (p50 < 10) & (x < 2.5) & (r >= 80)
         & (col("up_down_vol_ratio_50") >= 1.3)),
        ("Theme Leader Pullback", .80, col("is_basket_leader") & (col("p_PULLBACK") > .4)),
        ("Trend Continuation", .90, (sma >= 85) & (adx >= 25) & (x < 4.5) & (r >= 80) & (col("supertrend_direction") == 1.0)),
        ("Trending Leadership", .85, (sma >= 75) & (r >= 80) & (adx >= 20)),
        ("Pullback to 21EMA", .85, (sma >= 80) & (near21 < .7) & (r >= 75)),
        ("Pullback to 50MA", .80, (sma >= 75) & (near50 < 1.2) & (r >= 70)),
        ("Tight Consolidation Pre-Breakout", .90, squeeze & (vcp >= 70) & (r >= 85) & (col("volume_z_20_252") >= .5)),
        ("VCP Setup", .80, (vcp >= 60) & (r >= 75) & (sma >= 75)),
        ("BB Squeeze with RS", .75, squeeze & (width < 20) & (r >= 70)),
        ("Range Consolidation", .70, squeeze | (width < 15)),
        ("Failed Breakout", .85, (col("failed_breakout_flag_10d") == 1.0) & (p50 < 0) & (r < 70)),
        ("Trending (Generic)", .65, s == "TRENDING"),
        ("Routine Pullback", .65, s == "PULLBACK"),
        ("Consolidating (Generic)", .65, s == "CONSOLIDATING"),
        ("Exhaustion (Generic)", .65, s == "EXHAUSTION"),
        ("Deteriorating (Generic)", .65, s == "DETERIORATING"),
    ]


def legacy_setups(df: DataFrame) -> DataFrame:
    """Append legacy_setup and legacy_confidence."""
    rules = legacy_setup_rules()
    label = first_match([(n, c) for n, _, c in rules], "Indeterminate Pattern")
    conf = {n: p for n, p, _ in rules} | {"Indeterminate Pattern": .55}
    return df.withColumn("legacy_setup", label).withColumn("legacy_confidence", lookup(col("legacy_setup"), conf))


# ---- display names ------------------------------------------------------------------------------
def display_state(c: Column) -> Column:
    """Internal state -> display name; NULL or empty -> ""; an unknown value passes through."""
    named = F.coalesce(lookup(c, config.STATE_DISPLAY), c)
    return F.when(c.isNull() | c.isin("", "nan", "NaN", "None"), "").otherwise(named)


def display_tier(c: Column) -> Column:
    """Internal tier -> display name; NULL or empty -> "No RS Signal"; an unknown value passes through."""
    named = F.coalesce(lookup(c, config.TIER_DISPLAY), c)
    return F.when(c.isNull() | c.isin("", "nan", "NaN", "None"), "No RS Signal").otherwise(named)


def internal_state(c: Column) -> Column:
    return F.coalesce(lookup(c, {v: k for k, v in config.STATE_DISPLAY.items()}), c)


def internal_tier(c: Column) -> Column:
    return F.coalesce(lookup(c, {v: k for k, v in config.TIER_DISPLAY.items()}), c)


# ---- themes -------------------------------------------------------------------------------------
def momentum_class(c30: Column, c60: Column) -> Column:
    """Change bands; exactly -7 and exactly -3 stay STABLE."""
    return F.when(c60.isNotNull(), first_match([
        ("WEAKENING", c60 < -7),
        ("DECELERATING", (c60 > -7) & (c60 < -3)),
        ("STRONG_ACCELERATING", (c60 >= 12) & (c30 >= 7)),
        ("MODERATE_ACCELERATING", c60 >= 7),
    ], "STABLE"))


def concentration_class(top3: Column) -> Column:
    return F.when(top3.isNotNull(), first_match([("BROAD", top3 <= 0.35), ("MODERATE", top3 <= 0.50)], "CONCENTRATED"))


def theme_class() -> Column:
    t, m, nh = col("theme_score"), col("momentum_class"), col("theme_rs_new_252d_high") == 1.0
    p50 = col("pct_above_50dma")
    return F.when(t.isNotNull(), first_match([
        ("ELITE_THEME", (t >= 90) & m.isin("STRONG_ACCELERATING", "MODERATE_ACCELERATING") & nh & (p50 >= 75)),
        ("STRONG_THEME", (t >= 80) & (p50 >= 60) & nh),
        ("EMERGING_THEME", (t >= 60) & (t < 80) & (m == "STRONG_ACCELERATING") & (p50 >= 50)),
        ("NARROW_LEADERSHIP", (t >= 75) & (col("leadership_concentration") == "CONCENTRATED")),
        ("STABLE", (t >= 50) & (t < 75)),
        ("WEAKENING", (t < 50) & m.isin("DECELERATING", "WEAKENING")),
        ("BROKEN_THEME", col("pct_deteriorating") >= 30),
    ], "MIXED"))
