"""SQL twin of standardisation, components, regime, score, labels and the group rollup."""

from __future__ import annotations

import math

from panelwave import config
from panelwave.operators.score import state_weights
from panelwave.operators.standardize import family
from panelwave.plans.oracle_base import clip, div, flag, lag, lead, pct_rank, phi, r2, roll

NUMERIC = [f for f in config.FEATURES if family(f) != "categorical"]


def standardized() -> str:
    """CTE zp: feat plus z_<feature>."""
    fam = {n: family(n) for n in NUMERIC}
    robust = [n for n in NUMERIC if fam[n] in ("robust", "logit", "correlation")]
    standard = [n for n in NUMERIC if fam[n] in ("bounded", "log")]

    def tx(n: str) -> str:
        if fam[n] == "logit":
            p = clip(n, "0.001", "0.999")
            return f"ln({p} / (1.0 - {p}))"
        if fam[n] == "correlation":
            p = f"(({clip(n, '-0.999', '0.999')} + 1.0) / 2.0)"
            return f"ln({p} / (1.0 - {p}))"
        if fam[n] == "log":
            return f"sign({n}) * ln(1.0 + abs({n}))"
        return n

    xs = ", ".join(f"{tx(n)} AS x_{n}" for n in robust + standard)
    stats = ", ".join([f"count({n}) AS n_{n}" for n in NUMERIC] + [f"stddev_pop(x_{n}) AS s_{n}" for n in robust + standard]
                      + [f"avg(x_{n}) AS m_{n}" for n in standard] + [f"median(x_{n}) AS md_{n}" for n in robust])
    mads = ", ".join(f"median(abs(x_{n} - md_{n})) AS mad_{n}" for n in robust)

    def z(n: str) -> str:
        f = fam[n]
        if f == "binary":
            return n
        if f == "percentile":
            return f"(0.5 - {n}) / 0.2887" if n == "within_basket_rank_pct" else f"({n} - 50.0) / 28.87"
        if f in ("bounded", "log"):
            mid = "50.0" if f == "bounded" else f"m_{n}"
            return f"CASE WHEN s_{n} < 1e-10 THEN 0.0 ELSE (x_{n} - {mid}) / nullif(s_{n}, 0) END"
        return (f"CASE WHEN mad_{n} < 1e-8 AND s_{n} < 1e-8 THEN 0.0 WHEN mad_{n} < 1e-8 THEN (x_{n} - md_{n}) / nullif(s_{n}, 0) "
                f"ELSE (x_{n} - md_{n}) / nullif(1.4826 * mad_{n}, 0) END")

    raw = ", ".join(f"({z(n)})::DOUBLE AS r_{n}" for n in NUMERIC)
    zs = ", ".join(f"CASE WHEN n_{n} >= 5 THEN {clip('r_' + n, '-10.0', '10.0')} END AS z_{n}" for n in NUMERIC)
    return (f"zx AS MATERIALIZED (SELECT *, {xs} FROM feat), zs AS MATERIALIZED (SELECT date, {stats} FROM zx GROUP BY date), "
            f"zm AS MATERIALIZED (SELECT date, {mads} FROM zx JOIN zs USING (date) GROUP BY date), "
            f"zr AS MATERIALIZED (SELECT zx.*, zs.* EXCLUDE (date), {raw} FROM zx JOIN zs USING (date) JOIN zm USING (date)), "
            f"zp AS MATERIALIZED (SELECT feat.*, zz.* EXCLUDE (entity, date) FROM feat JOIN (SELECT entity, date, {zs} FROM zr) zz USING (entity, date))")


def _robust(src: str, dst: str, items: dict[str, str]) -> str:
    med = ", ".join(f"median({x}) AS md_{o}, stddev_pop({x}) AS sd_{o}" for o, x in items.items())
    mad = ", ".join(f"median(abs({x} - md_{o})) AS mad_{o}" for o, x in items.items())
    z = ", ".join(
        f"CASE WHEN mad_{o} < 1e-8 AND sd_{o} < 1e-8 THEN 0.0 WHEN mad_{o} < 1e-8 THEN ({x} - md_{o}) / nullif(sd_{o}, 0) "
        f"ELSE ({x} - md_{o}) / nullif(1.4826 * mad_{o}, 0) END AS {o}" for o, x in items.items())
    return (f"{dst}_a AS MATERIALIZED (SELECT date, {med} FROM {src} GROUP BY date), "
            f"{dst}_b AS MATERIALIZED (SELECT date, {mad} FROM {src} JOIN {dst}_a USING (date) GROUP BY date), "
            f"{dst} AS MATERIALIZED (SELECT s.*, {z} FROM {src} s JOIN {dst}_a USING (date) JOIN {dst}_b USING (date))")


def components() -> str:
    """CTE cp: zp plus the component columns."""
    macd = " ".join(f"WHEN macd_posture = '{k}' THEN {v}" for k, v in config.MACD_SCORE.items())
    inp = (
        "ci AS MATERIALIZED (SELECT *, supertrend_direction * supertrend_days_since_flip AS i_super, plus_di - minus_di AS i_di, "
        f"{flag(chr(39) + 'Positive' + chr(39) + ' = weekly_macd_posture')} AS i_wmacd, {flag('weekly_trend_slope_sign > 0')} AS i_wslope, "
        f"CASE {macd} ELSE 50.0 END AS i_macd, CASE WHEN rsi_14 > 75 THEN 20.0 WHEN rsi_14 < 30 THEN 80.0 ELSE 50.0 END AS i_rsi, "
        "(coalesce(bullish_divergence_20d, 0.0) - coalesce(bearish_divergence_20d, 0.0)) * 15.0 AS i_div, "
        "CASE WHEN up_down_vol_ratio_50 IS NOT NULL THEN ln(greatest(up_down_vol_ratio_50, 1e-10)) END AS i_ud FROM zp), "
    )
    rob = _robust("ci", "cj", {"x_resid": "residual_momentum_126d", "x_super": "i_super", "x_di": "i_di", "x_low": "low_rel_vol_10d",
                               "x_buzz": "volume_buzz_50", "x_ud": "i_ud"})
    w = "OVER (PARTITION BY date)"
    std = ", ".join(f"CASE WHEN stddev_pop(i_{k}::DOUBLE) {w} < 1e-10 THEN 0.0 ELSE (i_{k} - avg(i_{k}::DOUBLE) {w}) / nullif(stddev_pop(i_{k}::DOUBLE) {w}, 0) END AS x_{k}"
                    for k in ("wmacd", "wslope", "macd", "rsi", "div"))
    z = lambda n: f"z_{n}"
    z0 = lambda n: f"coalesce(z_{n}, 0.0)"
    lead_ = (
        f".30 * {z('rs_rating_spy')} + .15 * (.30 * {z('sharpe_rank_252d')} + .30 * {z('gain_to_pain_ratio_252d')} + .30 * {z('information_ratio_252d')} + .10 * {z('sortino_rank_126d')})"
        f" + .10 * (.5 * {z('rs_rating_slope_60d')} + .5 * {z0('rs_rating_slope_120d')}) + .20 * (.20 * {z('rs_line_spy_new_high_252d')} + .15 * {z('rs_line_spy_slope_60d')}"
        f" + .50 * {z('rs_line_spy_r_squared_60d')} + .15 * {z('rs_line_qqq_new_high_252d')}) + .15 * (.55 * {z('mtf_rs_coherence')} + .45 * {z0('within_basket_z_63d')}) + .10 * {z('information_ratio_252d')}")
    trend = (f"(.20 * {z('adx_14')} + .15 * {z('trend_r_squared_60d')} + .10 * {z('trend_rsquared_252d')} + .15 * {z('hurst_exponent_252d')} + .15 * {z('return_autocorrelation_60d_lag1')}"
             f" + .10 * {z('trend_slope_60d')} + .10 * x_super + .05 * x_di)")
    cols = {
        "s_rs": f".55 * {z('rs_rating_spy')} + .30 * {z('sharpe_momentum_rank_126d')} + .15 * {z0('within_basket_z_21d')}",
        "s_rs_leadership": f"CASE WHEN volume_leadership_confirmed = 1.0 THEN {lead_} ELSE CASE WHEN ({lead_}) IS NOT NULL THEN least({lead_}, {config.CAP_Z}) END END",
        "s_residual_momentum": clip("x_resid", "-10.0", "10.0"),
        "s_rsl": f".40 * {z('rs_line_spy_new_high_252d')} + .25 * {z('rs_line_spy_new_high_60d')} + .20 * {z('rs_line_spy_slope_20d')} + .15 * {z('rs_line_spy_r_squared_60d')}",
        "s_trend_slope": f"CASE WHEN abs(trend_slope_t_stat) < 1.96 THEN {trend} * 0.5 ELSE {trend} END",
        "s_structure": f".20 * {z('sma_stack_score')} + .20 * {z('ema_stack_score')} - .10 * {z('hh_count_60d')} + .25 * {z('hl_count_60d')} + .10 * {z('supertrend_direction')} + .10 * {z('new_252d_high')} + .05 * {z('pct_up_days_21')}",
        "s_mtf": (f".80 * (.30 * {z('weekly_stack_alignment')} + .20 * {z('weekly_higher_highs')} + .20 * {z('weekly_rs_rising')} + .15 * x_wmacd + .15 * x_wslope)"
                  f" + .20 * (.5 * {z('monthly_close_above_sma_10')} + .5 * {z('monthly_higher_highs_3m')})"),
        "s_extension": f"CASE WHEN pct_ma_50 < -10 THEN -1.0 WHEN pct_ma_50 >= -10 AND pct_ma_50 < -3 THEN -0.5 ELSE -.55 * {z('vol_normalized_extension')} - .30 * {z('pct_ma_50')} - .15 * {z('price_z_score_vs_trend')} END",
        "s_momentum": f".40 * {z('momentum_21d_pct')} + .20 * {z('rs_line_spy_slope_21d')} + .20 * x_macd + .10 * x_rsi + .10 * x_div",
        "s_volume": clip("x_vol", "-10.0", "10.0"),
        "s_demand": f".30 * x_ud - .25 * {z('distribution_days_25')} + .20 * {z('ad_line_slope_20')} + .15 * {z('cmf_21')} + .10 * {z('volume_z_20_252')}",
    }
    sel = ", ".join(f"({e})::DOUBLE AS {k}" for k, e in cols.items())
    return (inp + rob + f", ck AS MATERIALIZED (SELECT *, {std}, .5 * x_low + .5 * x_buzz AS i_vol FROM cj), " + _robust("ck", "cl", {"x_vol": "i_vol"})
            + f", cp AS MATERIALIZED (SELECT *, {sel} FROM cl)")


def state(src: str = "cp", dst: str = "sp") -> str:
    """CTE sp: primary state, confidence, p_* and p_adj_*."""
    lls = []
    for s, (bells, signals) in config.STATE_MODEL.items():
        terms = [f"-0.5 * power(({f} - {m}) / {w}.0::DOUBLE, 2)" if isinstance(w, int) else f"-0.5 * power(({f} - {m}) / {w}, 2)" for f, m, w in bells]
        terms += [f"(CASE WHEN {c} THEN {math.log(p)!r} ELSE {math.log(1.0 - p)!r} END)" for c, p in signals]
        lls.append(f"({' + '.join(terms)}) AS ll_{s}")
    lls.append(f"{config.INDETERMINATE_LL}::DOUBLE AS ll_INDETERMINATE")
    names = [f"ll_{s}" for s in config.STATES]
    es = ", ".join(f"coalesce(exp({n} - greatest({', '.join(names)})), 0.0) AS e_{n[3:]}" for n in names)
    tot = " + ".join(f"e_{s}" for s in config.STATES)
    ps = ", ".join(f"e_{s} / ({tot}) AS p_{s}" for s in config.STATES)
    conf = f"greatest({', '.join('p_' + s for s in config.STATES)})"
    prim = "CASE " + " ".join(f"WHEN p_{s} = state_confidence THEN '{s}'" for s in config.STATES) + " END"
    adj = ", ".join(
        f"CASE WHEN state_confidence >= 0.7 THEN p_{s} WHEN state_confidence >= 0.5 THEN p_{s} * 0.7 + {0.3 if s == 'INDETERMINATE' else 0.0} "
        f"ELSE p_{s} * 0.5 + {0.5 if s == 'INDETERMINATE' else 0.0} END AS p_adj_{s}" for s in config.STATES)
    return (f"{dst}1 AS (SELECT *, {', '.join(lls)} FROM {src}), {dst}2 AS (SELECT *, {es} FROM {dst}1), {dst}3 AS (SELECT *, {ps} FROM {dst}2), "
            f"{dst}4 AS (SELECT *, {conf} AS state_confidence FROM {dst}3), {dst} AS MATERIALIZED (SELECT *, {prim} AS primary_state, {adj} FROM {dst}4)")


def score(src: str = "sp") -> str:
    """CTE sc: score columns and grade."""
    w = state_weights()
    eff = ", ".join("(" + " + ".join(f"coalesce(p_adj_{s}, 0.0) * {w[s][i]!r}" for s in config.STATES) + f") AS e_{c}" for i, c in enumerate(config.COMPONENTS))
    here = lambda c, x: f"CASE WHEN {c} IS NOT NULL THEN {x} ELSE 0.0 END"
    wp = " + ".join(here(c, f"e_{c}") for c in config.COMPONENTS)
    num = " + ".join(here(c, f"{c} * e_{c}") for c in config.COMPONENTS)
    n = " + ".join(f"({c} IS NOT NULL)::BIGINT" for c in config.COMPONENTS)
    win = "OVER (PARTITION BY date)"
    return (
        f"sa AS (SELECT *, {eff} FROM {src}), sb AS (SELECT *, {wp} AS weight_present, {n} AS n_valid_components, {num} AS num FROM sa), "
        f"sd0 AS (SELECT *, CASE WHEN weight_present >= 0.60 AND n_valid_components >= 6 THEN num / nullif(weight_present, 0) END AS cz FROM sb), "
        f"se AS (SELECT *, (cz - avg(cz) {win}) / (CASE WHEN stddev_samp(cz) {win} = 0 THEN 1.0 ELSE stddev_samp(cz) {win} END) AS score_z FROM sd0), "
        f"sf AS MATERIALIZED (SELECT *, {phi('score_z')} * 100.0 AS score_raw FROM se), "
        f"sg AS MATERIALIZED (SELECT *, {clip('score_raw', f'quantile_cont(score_raw, 0.01) {win}', f'quantile_cont(score_raw, 0.99) {win}')} AS score FROM sf), "
        f"sc AS MATERIALIZED (SELECT *, CASE WHEN score IS NULL THEN NULL WHEN score >= quantile_cont(score, 0.92) {win} THEN 'S' WHEN score >= quantile_cont(score, 0.80) {win} THEN 'A' "
        f"WHEN score >= quantile_cont(score, 0.55) {win} THEN 'B' WHEN score >= quantile_cont(score, 0.30) {win} THEN 'C' ELSE 'D' END AS grade, "
        "weight_present < 1.0 - 1e-9 AND score IS NOT NULL AS is_partial FROM sg)"
    )


def labels(src: str = "sc") -> str:
    """CTE lb: leadership tier, leader flag, setup and confidence."""
    tiers = [
        ("ELITE_LEADER", "ld >= 90 AND r >= 95 AND mtf_rs_coherence = 3 AND volume_leadership_confirmed = 1 AND within_basket_rank = 1 AND rs_line_qqq_slope_60d > 0"),
        ("STRONG_LEADER", "ld >= 80 AND r >= 75 AND mtf_rs_coherence >= 2"),
        ("EMERGING_LEADER", "r >= 60 AND r <= 85 AND rs_rating_slope_60d >= 10 AND mtf_rs_coherence >= 2 AND rs_line_qqq_slope_60d > 0"),
        ("ESTABLISHED_LEADER", "r >= 75 AND rs_line_spy_new_high_252d = 1"), ("STRONG_PERFORMER", "r >= 60"),
        ("DETERIORATING", "r < 40 AND rs_rating_slope_60d < -5"), ("WEAK_LAGGARD", "r < 25 AND rs_rating_slope_60d < 0"),
        ("WEAK_PERFORMER", "r >= 25 AND r < 45 AND rs_rating_slope_60d >= -5"), ("NEUTRAL", "r >= 45 AND r < 60"),
    ]
    b = "(close > ema_21 AND ema_21 > sma_50 AND sma_50 > sma_200)"
    calm = "pct_ma_50 <= pct_ma_50_p80_252d"
    setups = [
        ("New High", f"new_252d_high = 1 AND {calm}"), ("Breakout", "close > pmx AND true_range_x_atr14 > 1.3"), ("Failed Breakout", "failed_breakout_flag_5d_v2 = 1"),
        ("Tight Base", f"{b} AND ar <= 0.25 AND -pct_from_52w_high <= 5"), ("Coiling", f"{b} AND range_20d_to_60d_ratio < 0.6 AND bb_width_pct_252d <= 20"),
        ("Shallow Pullback", f"{b} AND -pct_from_20d_high >= 3 AND -pct_from_20d_high <= 10 AND close >= ema_21 AND {calm}"),
        ("Deep Pullback", f"{b} AND -pct_from_20d_high > 10 AND -pct_from_20d_high <= 20 AND close >= sma_50 AND {calm}"),
        ("Extended", f"{b} AND pct_ma_50 > pct_ma_50_p80_252d"), ("At Highs", f"{b} AND -pct_from_52w_high <= 5"),
        ("Basing Low", "pct_from_52w_low <= 10 AND ar <= 0.40"), ("Breakdown", "close < pmn AND close < sma_50"), ("Reclaim", "failed_breakdown_flag_5d_v2 = 1"),
        ("Sideways", "range_60d_pct_of_price < 20 AND position_in_60d_range >= 0.25 AND position_in_60d_range <= 0.75"),
    ]
    tc = " ".join(f"WHEN {c} THEN '{n}'" for n, c in tiers)
    scs = " ".join(f"WHEN {c} THEN '{n}'" for n, c in setups)
    every = "[" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in setups) + "]"
    return (
        f"la AS MATERIALIZED (SELECT *, {clip(phi('s_rs_leadership') + ' * 100.0', '0.0', '100.0')} AS ld, rs_rating_spy AS r, {lag('close_max_40d')} AS pmx, {lag('close_min_40d')} AS pmn, "
        f"{pct_rank('adr_pct_20')} AS ar FROM {src}), "
        f"lb AS MATERIALIZED (SELECT *, ld AS s_rs_leadership_0_100, CASE WHEN r IS NOT NULL THEN CASE {tc} ELSE 'UNCLASSIFIED' END END AS leadership_tier, "
        f"coalesce(within_basket_rank = 1, false) AS is_basket_leader, CASE {scs} ELSE '' END AS setup, "
        f"array_to_string(list_filter({every}, lambda x: x IS NOT NULL), '|') AS setup_matches FROM la), "
        "lc AS MATERIALIZED (SELECT *, CASE WHEN setup <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS setup_confidence FROM lb)"
    )


def themes(src: str = "lc") -> str:
    """CTE th: the full group rollup."""
    sh = lambda c: f"avg({flag(c)}) * 100.0"
    agg = {
        "n_constituents": "count(*)", "n_constituents_with_valid_score": "count(score)", "avg_score": "avg(score)", "median_score": "median(score)",
        "std_score": "stddev_samp(score)", "max_score": "max(score)", "min_score": "min(score)", "q25_score": "quantile_cont(score, 0.25)", "q75_score": "quantile_cont(score, 0.75)",
        "pct_above_50dma": "avg(pct_above_sma_50) * 100.0", "pct_above_200dma": "avg(pct_above_sma_200) * 100.0", "pct_at_60d_high": "avg(new_60d_high) * 100.0",
        "pct_at_252d_high": "avg(new_252d_high) * 100.0", "pct_rs_line_new_high": "avg(rs_line_spy_new_high_252d) * 100.0",
        "pct_full_sma_stack": sh("sma_stack_score >= 100"), "pct_full_ema_stack": sh("ema_stack_score >= 100"), "pct_supertrend_bull": sh("supertrend_direction = 1"),
        "pct_rs_rating_above_70": sh("rs_rating_spy >= 70"), "pct_rs_rating_above_85": sh("rs_rating_spy >= 85"), "pct_grade_s": sh("grade = 'S'"),
        "pct_grade_a_plus": sh("grade IN ('S', 'A')"), "pct_grade_d": sh("grade = 'D'"), "pct_exhaustion": sh("primary_state = 'EXHAUSTION'"), "pct_deteriorating": sh("primary_state = 'DETERIORATING'"),
        "n_elite_leaders": "count(*) FILTER (leadership_tier = 'ELITE_LEADER')", "n_strong_leaders": "count(*) FILTER (leadership_tier = 'STRONG_LEADER')",
        "n_emerging_leaders": "count(*) FILTER (leadership_tier = 'EMERGING_LEADER')",
        "theme_avg_ud_ratio": "avg(up_down_vol_ratio_50)", "theme_median_ud_ratio": "median(up_down_vol_ratio_50)", "theme_pct_strong_ud": sh("up_down_vol_ratio_50 >= 1.5"),
        "theme_pct_positive_ad": sh("ad_line_slope_20 > 0"), "theme_avg_cmf": "avg(cmf_21)", "theme_avg_dist_days": "avg(distribution_days_25)",
        "avg_rs": "avg(rs_rating_spy)", "basket_ret": "avg(close_ret)",
        "top3": "list_sum(list_sort(list(score) FILTER (score IS NOT NULL), 'DESC')[1:3])",
        "topq": "list_sum(list_sort(list(score) FILTER (score IS NOT NULL), 'DESC')[1:greatest(1, ceil(count(score) / 4.0))::INT])", "allsum": "sum(score)",
    }
    kw = {"part": "basket", "order": "date"}
    zin = ("avg_score pct_above_50dma pct_above_200dma pct_at_252d_high pct_rs_rating_above_85 pct_grade_a_plus theme_rs_new_252d_high theme_rs_slope_60d theme_rs_r_squared_60d "
           "theme_rs_pct_252d theme_rs_change_60d theme_rs_change_30d theme_pct_strong_ud theme_pct_positive_ad theme_avg_cmf theme_avg_dist_days pct_exhaustion pct_deteriorating").split()
    w = "OVER (PARTITION BY date)"
    zs = ", ".join(f"({c} - avg({c}) {w}) / (CASE WHEN stddev_samp({c}) {w} = 0 THEN 1.0 ELSE stddev_samp({c}) {w} END) AS z_{c}" for c in zin)
    line, x = "theme_rs_line_value", "(theme_rs_line_value / {} - 1.0) * 100.0"
    run = "OVER (PARTITION BY basket ORDER BY date ROWS UNBOUNDED PRECEDING)"
    w252 = "OVER (PARTITION BY basket ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
    h60, h252 = roll("max", line, 60, **kw), roll("max", line, 252, **kw)
    tcls = ("CASE WHEN theme_score IS NULL THEN NULL WHEN theme_score >= 90 AND momentum_class IN ('STRONG_ACCELERATING', 'MODERATE_ACCELERATING') AND theme_rs_new_252d_high = 1 AND pct_above_50dma >= 75 THEN 'ELITE_THEME' "
            "WHEN theme_score >= 80 AND pct_above_50dma >= 60 AND theme_rs_new_252d_high = 1 THEN 'STRONG_THEME' WHEN theme_score >= 60 AND theme_score < 80 AND momentum_class = 'STRONG_ACCELERATING' AND pct_above_50dma >= 50 THEN 'EMERGING_THEME' "
            "WHEN theme_score >= 75 AND leadership_concentration = 'CONCENTRATED' THEN 'NARROW_LEADERSHIP' WHEN theme_score >= 50 AND theme_score < 75 THEN 'STABLE' "
            "WHEN theme_score < 50 AND momentum_class IN ('DECELERATING', 'WEAKENING') THEN 'WEAKENING' WHEN pct_deteriorating >= 30 THEN 'BROKEN_THEME' ELSE 'MIXED' END")
    return (
        f"own AS MATERIALIZED (SELECT entity, date, CASE WHEN {roll('max', 'close', 60, order='date')} IS NOT NULL THEN {flag('close >= ' + roll('max', 'close', 60, order='date'))} END AS new_60d_high, "
        f"{div('adj_close', lag('adj_close', order='date'))} - 1.0 AS close_ret FROM bars), "
        "am0 AS (SELECT basket, entity, count(*) OVER (PARTITION BY basket) AS n FROM mem), "
        f"am1 AS (SELECT DISTINCT basket, entity FROM am0 WHERE n >= 3 AND entity IN (SELECT entity FROM {src})), "
        "am AS MATERIALIZED (SELECT basket, entity FROM (SELECT *, count(*) OVER (PARTITION BY basket) AS n FROM am1) WHERE n >= 3), "
        f"ta AS MATERIALIZED (SELECT basket, date, {', '.join(f'{e} AS {k}' for k, e in agg.items())} FROM {src} LEFT JOIN own USING (entity, date) JOIN am USING (entity) GROUP BY basket, date), "
        f"br AS (SELECT date, {div('adj_close', lag('adj_close', order='date'))} - 1.0 AS bench_ret, row_number() OVER (ORDER BY date) AS rn FROM bars WHERE entity = 'MKT'), "
        f"tb AS MATERIALIZED (SELECT *, exp(sum(ln(1.0 + coalesce(basket_ret, 0.0))) {run}) / exp(sum(ln(1.0 + coalesce(bench_ret, 0.0))) {run}) AS {line}, "
        "CASE WHEN allsum > 0 THEN top3 / allsum END AS basket_top_3_share, CASE WHEN allsum > 0 THEN topq / allsum END AS basket_top_quartile_share FROM ta LEFT JOIN br USING (date)), "
        f"tb2 AS MATERIALIZED (SELECT *, exp(ln({line}) - avg(ln({line})) OVER (PARTITION BY basket)) AS lvl FROM tb), "
        f"tc AS MATERIALIZED (SELECT *, theme_pct_strong_ud >= 40 AND theme_pct_positive_ad >= 50 AS theme_volume_confirmation, std_score / nullif(avg_score, 0) AS basket_score_cv, "
        "CASE WHEN basket_top_3_share IS NULL THEN NULL WHEN basket_top_3_share <= 0.35 THEN 'BROAD' WHEN basket_top_3_share <= 0.50 THEN 'MODERATE' ELSE 'CONCENTRATED' END AS leadership_concentration, "
        f"CASE WHEN {h60} IS NOT NULL THEN {flag(f'{line} >= {h60}')} END AS theme_rs_new_60d_high, CASE WHEN {h252} IS NOT NULL THEN {flag(f'{line} >= {h252}')} END AS theme_rs_new_252d_high, "
        f"{x.format(lag(line, 20, **kw))} AS theme_rs_slope_20d, {x.format(lag(line, 60, **kw))} AS theme_rs_slope_60d, {r2('lvl', 60, x='rn', **kw)} AS theme_rs_r_squared_60d, "
        f"CASE WHEN count({line}) {w252} >= 60 THEN len(list_filter(list({line}) {w252}, lambda q: q <= {line})) / count({line}) {w252} * 100.0 END AS theme_rs_pct_252d, "
        + ", ".join(f"avg_rs - {lag('avg_rs', k, **kw)} AS theme_rs_change_{k}d" for k in (30, 60, 90)) + " FROM tb2), "
        f"td AS MATERIALIZED (SELECT *, {zs} FROM tc), "
        "te AS (SELECT *, .30 * z_pct_above_50dma + .20 * z_pct_above_200dma + .15 * z_pct_at_252d_high + .20 * z_pct_rs_rating_above_85 + .15 * z_pct_grade_a_plus AS theme_breadth_score, "
        ".40 * z_theme_rs_new_252d_high + .30 * z_theme_rs_slope_60d + .15 * z_theme_rs_r_squared_60d + .15 * z_theme_rs_pct_252d AS theme_rs_composite, "
        ".60 * z_theme_rs_change_60d + .40 * z_theme_rs_change_30d AS theme_momentum_score, "
        ".40 * z_theme_pct_strong_ud + .30 * z_theme_pct_positive_ad + .20 * z_theme_avg_cmf - .10 * z_theme_avg_dist_days AS theme_volume_score, "
        "-.50 * z_pct_exhaustion - .50 * z_pct_deteriorating AS theme_health_score FROM td), "
        "tf0 AS MATERIALIZED (SELECT *, .25 * z_avg_score + .25 * theme_breadth_score + .20 * theme_rs_composite + .15 * theme_momentum_score + .10 * theme_volume_score + .05 * theme_health_score AS theme_score_z FROM te), "
        f"tg AS (SELECT *, {phi('theme_score_z')} * 100.0 AS theme_score, CASE WHEN theme_rs_change_60d IS NULL THEN NULL WHEN theme_rs_change_60d < -7 THEN 'WEAKENING' WHEN theme_rs_change_60d > -7 AND theme_rs_change_60d < -3 THEN 'DECELERATING' "
        "WHEN theme_rs_change_60d >= 12 AND theme_rs_change_30d >= 7 THEN 'STRONG_ACCELERATING' WHEN theme_rs_change_60d >= 7 THEN 'MODERATE_ACCELERATING' ELSE 'STABLE' END AS momentum_class FROM tf0), "
        f"th AS MATERIALIZED (SELECT *, {tcls} AS theme_class FROM tg)"
    )


__all__ = ["components", "labels", "lead", "score", "standardized", "state", "themes"]
