"""Default configuration: feature families, model weights, thresholds and labels (fixed values)."""

# ---- stored feature columns, in order (fixed values) --------------------------------------------
FEATURES = (
    "close sma_50 sma_200 ema_21 adr_pct_20 realized_vol_60 pct_ma_50 pct_ma_200 atr_x_50 vol_normalized_extension "
    "trend_slope_60d trend_r_squared_60d trend_slope_t_stat trend_slope_significant price_z_score_vs_trend "
    "adx_14 plus_di minus_di adx_trend_direction supertrend_direction supertrend_days_since_flip "
    "volume volume_z_20_252 up_down_vol_ratio_50 distribution_days_25 ad_line_slope_20 cmf_21 capitulation_volume_flag "
    "low_rel_vol_10d volume_buzz_50 rs_rating_spy sharpe_momentum_rank_126d sortino_rank_126d within_basket_z_21d "
    "rs_line_spy_new_high_60d rs_line_spy_new_high_252d rs_line_spy_slope_20d rs_line_spy_slope_60d "
    "rs_line_spy_r_squared_60d rs_line_qqq_new_high_60d rs_line_qqq_new_high_252d rs_line_qqq_slope_60d "
    "rs_rating_slope_60d rs_rating_slope_120d residual_momentum_126d sma_stack_score ema_stack_score "
    "hh_count_60d hl_count_60d trend_integrity new_252d_high pct_up_days_21 failed_breakout_flag_10d "
    "weekly_stack_alignment weekly_higher_highs weekly_rs_rising weekly_rsi_14 weekly_macd_posture "
    "weekly_trend_slope_sign monthly_close_above_sma_10 monthly_higher_highs_3m mtf_rs_coherence "
    "rsi_14 macd_posture bullish_divergence_20d bearish_divergence_20d bb_width_pct_252d bb_squeeze_flag "
    "vcp_quality_score days_near_52w_high_60d climax_volume_flag within_basket_z_63d within_basket_rank "
    "within_basket_rank_pct volume_leadership_confirmed pct_above_sma_50 pct_above_sma_200 weekly_rs_new_high_26w "
    "monthly_rs_rising_3m monthly_rs_rising_6m pct_from_52w_high pct_from_52w_low hurst_exponent_252d "
    "return_autocorrelation_60d_lag1 trend_rsquared_252d upside_vol_60d downside_vol_60d gain_to_pain_ratio_252d "
    "sharpe_rank_60d sharpe_rank_252d tail_ratio_252d information_ratio_252d momentum_21d_pct rs_line_spy_slope_21d "
    "ad_line_slope_21d max_drawdown_pct_60d return_autocorrelation_21d_lag1 vol_percentile_21d close_max_40d "
    "close_min_40d pct_from_20d_high range_60d_pct_of_price range_20d_to_60d_ratio position_in_60d_range "
    "pct_ma_50_p80_252d true_range_x_atr14 failed_breakout_flag_5d_v2 failed_breakdown_flag_5d_v2"
).split()

# ---- standardisation families (fixed values) ----------------------------------------------------
CATEGORICAL = ("macd_posture", "weekly_macd_posture")
PERCENTILE = (
    "rs_rating_spy sharpe_momentum_rank_126d sortino_rank_126d within_basket_rank_pct sharpe_rank_60d "
    "sharpe_rank_252d tail_ratio_252d momentum_21d_pct max_drawdown_pct_60d vol_percentile_21d"
).split()
BOUNDED = (
    "rsi_14 weekly_rsi_14 adx_14 plus_di minus_di sma_stack_score ema_stack_score vcp_quality_score bb_width_pct_252d"
).split()
LOGIT = ("trend_r_squared_60d", "rs_line_spy_r_squared_60d", "hurst_exponent_252d", "trend_rsquared_252d")
CORRELATION = ("return_autocorrelation_60d_lag1", "return_autocorrelation_21d_lag1")
SIGNED_LOG = ("volume", "ad_line_slope_20", "ad_line_slope_21d", "upside_vol_60d", "downside_vol_60d")
BINARY = (
    "trend_slope_significant adx_trend_direction supertrend_direction capitulation_volume_flag climax_volume_flag "
    "rs_line_spy_new_high_60d rs_line_spy_new_high_252d rs_line_qqq_new_high_60d rs_line_qqq_new_high_252d "
    "trend_integrity new_252d_high failed_breakout_flag_10d weekly_stack_alignment weekly_higher_highs "
    "weekly_rs_rising weekly_trend_slope_sign monthly_close_above_sma_10 monthly_higher_highs_3m "
    "bullish_divergence_20d bearish_divergence_20d bb_squeeze_flag volume_leadership_confirmed pct_above_sma_50 "
    "pct_above_sma_200 weekly_rs_new_high_26w monthly_rs_rising_3m monthly_rs_rising_6m"
).split()

# ---- components and states (fixed values) -------------------------------------------------------
COMPONENTS = (
    "s_rs", "s_rs_leadership", "s_residual_momentum", "s_rsl", "s_trend_slope",
    "s_structure", "s_mtf", "s_extension", "s_momentum", "s_volume",
)
STATES = ("TRENDING", "PULLBACK", "CONSOLIDATING", "EXHAUSTION", "DETERIORATING", "INDETERMINATE")
STATE_WEIGHTS = {
    "TRENDING": (.271716, .271716, .048500, .008314, .008314, .195636, .163030, 0, .002771, .03),
    "PULLBACK": (.248517, .282405, .048500, .004850, .003233, .203331, .158147, .019400, .001617, .03),
    "CONSOLIDATING": (.230836, .253919, .048500, 0, 0, .253919, .173127, .009700, 0, .03),
    "EXHAUSTION": (.247959, .315585, .047549, 0, 0, .180335, .169063, .009510, 0, .03),
    "DETERIORATING": (.230375, .287969, .048500, 0, 0, .230375, .172781, 0, 0, .03),
    "INDETERMINATE": (.242381, .286450, .048500, .008314, .008314, .198311, .165259, .009700, .002771, .03),
}
# (feature, mean, width) Gaussian terms and (condition, probability) indicator terms
STATE_MODEL = {
    "TRENDING": ([("adx_14", 30, 12), ("trend_r_squared_60d", .65, .20), ("pct_ma_50", 10, 12)],
                 [("sma_stack_score >= 80", .85)]),
    "PULLBACK": ([("pct_ma_50", 5, 5), ("atr_x_50", 1.5, 1), ("rsi_14", 45, 15)], [("sma_stack_score >= 75", .80)]),
    "CONSOLIDATING": ([("bb_width_pct_252d", 15, 12), ("adx_14", 15, 8), ("vcp_quality_score", 55, 25)],
                      [("bb_squeeze_flag > 0", .60)]),
    "EXHAUSTION": ([("atr_x_50", 6, 2), ("rsi_14", 75, 8), ("rs_rating_spy", 92, 8)],
                   [("days_near_52w_high_60d >= 25", .70)]),
    "DETERIORATING": ([("pct_ma_50", -12, 10), ("distribution_days_25", 8, 4), ("rs_rating_spy", 25, 20)],
                      [("supertrend_direction = -1", .75)]),
}
INDETERMINATE_LL = -2.5
CAP_Z = 0.5244005  # inverse normal CDF of 0.70
MACD_SCORE = {
    "Positive/Accelerating/Strong": 100.0, "Positive/Accelerating/Weak": 80.0,
    "Positive/Decelerating/Strong": 65.0, "Positive/Decelerating/Weak": 50.0,
    "Negative/Decelerating/Weak": 40.0, "Negative/Decelerating/Strong": 30.0,
    "Negative/Accelerating/Weak": 20.0, "Negative/Accelerating/Strong": 0.0,
}
MIN_WEIGHT, MIN_COMPONENTS = 0.60, 6
GRADES = (("S", .92), ("A", .80), ("B", .55), ("C", .30))
GRADE_ORDER = {"S": 0, "A": 1, "B": 2, "C": 3, "D": 4}

# ---- labels (fixed values) ----------------------------------------------------------------------
TIERS = (
    "ELITE_LEADER", "STRONG_LEADER", "EMERGING_LEADER", "ESTABLISHED_LEADER", "STRONG_PERFORMER",
    "DETERIORATING", "WEAK_LAGGARD", "WEAK_PERFORMER", "NEUTRAL", "UNCLASSIFIED",
)
SETUPS = (
    "New High", "Breakout", "Failed Breakout", "Tight Base", "Coiling", "Shallow Pullback", "Deep Pullback",
    "Extended", "At Highs", "Basing Low", "Breakdown", "Reclaim", "Sideways",
)
STATE_DISPLAY = {
    "TRENDING": "Trending", "PULLBACK": "Pullback", "CONSOLIDATING": "Consolidating",
    "EXHAUSTION": "Parabolic", "DETERIORATING": "Breaking Down", "INDETERMINATE": "No Edge",
}
TIER_DISPLAY = {
    "ELITE_LEADER": "Elite Leader", "STRONG_LEADER": "Strong Leader", "EMERGING_LEADER": "Emerging Leader",
    "ESTABLISHED_LEADER": "Established Leader", "STRONG_PERFORMER": "Steady", "NEUTRAL": "Neutral",
    "WEAK_PERFORMER": "Weak Performer", "DETERIORATING": "Fading Leader", "WEAK_LAGGARD": "Weak Laggard",
    "UNCLASSIFIED": "No RS Signal",
}
HORIZONS = (1, 5, 20, 60, 126)
OOS_HORIZONS = (1, 5, 20, 60, 126, 252)
NON_ADJACENT_STATES = (("DETERIORATING", "TRENDING"), ("CONSOLIDATING", "EXHAUSTION"), ("EXHAUSTION", "TRENDING"))
PERIOD_DAYS = {"1W": 7, "1M": 30, "3M": 90, "6M": 180, "1Y": 365, "3Y": 1095, "5Y": 1825}
