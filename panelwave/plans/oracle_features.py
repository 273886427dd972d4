"""SQL twin of the feature panel on the brands' five-day panel."""

from __future__ import annotations

from panelwave import config
from panelwave.plans.oracle_base import (
    NO_BENCH, clip, div, ema_recursion, flag, lag, panel, pct_rank, r2, rma_seed, roll, slope,
)

R = "daily_ret"


def _chg(x: str, k: int) -> str:
    return f"({div(x, lag(x, k))} - 1.0)"


def recursion(src: str = "panel") -> str:
    """CTEs rec (daily recursive indicators) and st (supertrend)."""
    moves = (
        f"mv0 AS (SELECT *, {lag('close')} AS pc, {lag('high')} AS ph, {lag('low')} AS pl FROM {src}), "
        "mv AS MATERIALIZED (SELECT *, CASE WHEN high IS NOT NULL AND pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, "
        "coalesce(CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph END, 0.0) AS pdm, "
        "coalesce(CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low END, 0.0) AS mdm, "
        "CASE WHEN close - pc IS NOT NULL THEN greatest(close - pc, 0.0) END AS gain, "
        "CASE WHEN close - pc IS NOT NULL THEN greatest(pc - close, 0.0) END AS loss FROM mv0), "
        f"seeded AS MATERIALIZED (SELECT *, {rma_seed('tr', 14)} AS s_tr14, {rma_seed('tr', 10)} AS s_tr10, {rma_seed('pdm', 14)} AS s_pdm, "
        f"{rma_seed('mdm', 14)} AS s_mdm, {rma_seed('gain', 14)} AS s_gain, {rma_seed('loss', 14)} AS s_loss FROM mv), "
    )
    a14 = 1.0 / 14
    first = ema_recursion("rec1", "seeded", "t", {
        "ema_8": ("close", 2 / 9, 8), "ema_20": ("close", 2 / 21, 20), "ema_21": ("close", 2 / 22, 21), "ema_50": ("close", 2 / 51, 50),
        "ema_12": ("close", 2 / 13, 12), "ema_26": ("close", 2 / 27, 26),
        "atr_14": ("s_tr14", a14, 1), "atr_10": ("s_tr10", 0.1, 1), "pdm14": ("s_pdm", a14, 1), "mdm14": ("s_mdm", a14, 1),
        "gain14": ("s_gain", a14, 1), "loss14": ("s_loss", a14, 1),
    })
    mid = (
        "di0 AS (SELECT entity, t, ema_12 - ema_26 AS macd_line, 100.0 * pdm14 / nullif(atr_14, 0) AS plus_di, "
        "100.0 * mdm14 / nullif(atr_14, 0) AS minus_di FROM rec1), "
        "di1 AS (SELECT *, 100.0 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM di0), "
        f"di AS MATERIALIZED (SELECT *, {rma_seed('dx', 14)} AS s_dx FROM di1), "
    )
    second = ema_recursion("rec2", "di", "t", {"macd_signal": ("macd_line", 0.2, 9), "adx_14": ("s_dx", a14, 1)})
    rec = (
        "rec AS MATERIALIZED (SELECT entity, t, ema_8, ema_20, ema_21, ema_50, macd_line, macd_signal, tr AS true_range, atr_14, atr_10, "
        "plus_di, minus_di, adx_14, 100.0 - 100.0 / (1.0 + gain14 / nullif(loss14, 0)) AS rsi_14 "
        "FROM rec1 JOIN rec2 USING (entity, t) JOIN di USING (entity, t) JOIN (SELECT entity, t, tr FROM mv) USING (entity, t)), "
    )
    st = (
        "sti AS MATERIALIZED (SELECT p.entity, p.t, close, atr_10, (high + low) / 2.0 + 3.0 * atr_10 AS ru, (high + low) / 2.0 - 3.0 * atr_10 AS rl, "
        f"{lag('close')} AS pc FROM (SELECT * FROM {src}) p JOIN rec USING (entity, t)), "
        "st_r AS (SELECT entity, t AS k, CASE WHEN atr_10 IS NOT NULL THEN ru END AS u, CASE WHEN atr_10 IS NOT NULL THEN rl END AS l, "
        "CASE WHEN atr_10 IS NOT NULL THEN 1.0::DOUBLE END AS side, CASE WHEN atr_10 IS NOT NULL THEN 1.0::DOUBLE END AS days "
        "FROM sti WHERE t = 0 UNION ALL "
        "SELECT entity, t, CASE WHEN ok THEN nu END, CASE WHEN ok THEN nl END, CASE WHEN ok THEN ns END, "
        "CASE WHEN ok THEN CASE WHEN fresh OR ns <> os THEN 1.0 ELSE od + 1.0 END END FROM ("
        "SELECT *, CASE WHEN fresh THEN 1.0 WHEN os = 1.0 AND close < nl THEN -1.0 WHEN os = -1.0 AND close > nu THEN 1.0 ELSE os END AS ns FROM ("
        "SELECT s.entity, s.t, s.close, s.atr_10 IS NOT NULL AS ok, r.u IS NULL AS fresh, r.side AS os, r.days AS od, "
        "CASE WHEN r.u IS NULL THEN s.ru WHEN s.ru < r.u OR s.pc > r.u THEN s.ru ELSE r.u END AS nu, "
        "CASE WHEN r.u IS NULL THEN s.rl WHEN s.rl > r.l OR s.pc < r.l THEN s.rl ELSE r.l END AS nl "
        "FROM st_r r JOIN sti s ON s.entity = r.entity AND s.t = r.k + 1))), "
        "st AS MATERIALIZED (SELECT entity, k AS t, side AS supertrend_direction, days AS supertrend_days_since_flip FROM st_r)"
    )
    return moves + first + ", " + mid + second + ", " + rec + st


def periods(src: str = "panel") -> str:
    """CTEs wk and mo: weekly / monthly features with dense period index p."""
    wk_index = "ceil(date_diff('day', DATE '1970-01-02', date) / 7.0)::INT"
    mo_index = "(year(date) * 12 + month(date))::INT"

    def bars(name: str, index: str) -> str:
        return (
            f"{name}0 AS (SELECT entity, {index} AS p, arg_max(close, date) FILTER (close IS NOT NULL) AS close, max(high) AS high, min(low) AS low, "
            f"coalesce(sum(volume), 0.0) AS volume, arg_max(b1_close, date) AS b1_close FROM {src} GROUP BY 1, 2), "
            f"{name}g AS (SELECT entity, unnest(range(min(p), max(p) + 1))::INT AS p FROM {name}0 GROUP BY entity), "
            f"{name}1 AS MATERIALIZED (SELECT g.entity, g.p, b.close, b.high, b.low, b.close / nullif(b.b1_close, 0) AS rs FROM {name}g g LEFT JOIN {name}0 b USING (entity, p)), "
        )

    kw = {"order": "p"}
    up = lambda x, k: f"{x} > {lag(x, k, order='p')}"
    wk = bars("wk", wk_index) + (
        f"wkm AS (SELECT *, {lag('close', order='p')} AS pc FROM wk1), "
        "wkn AS (SELECT *, CASE WHEN close - pc IS NOT NULL THEN greatest(close - pc, 0.0) END AS gain, CASE WHEN close - pc IS NOT NULL THEN greatest(pc - close, 0.0) END AS loss FROM wkm), "
        f"wks AS MATERIALIZED (SELECT *, {rma_seed('gain', 14, order='p')} AS s_gain, {rma_seed('loss', 14, order='p')} AS s_loss FROM wkn), "
        + ema_recursion("wkr", "wks", "p", {
            "e10": ("close", 2 / 11, 10), "e12": ("close", 2 / 13, 12), "e26": ("close", 2 / 27, 26), "g14": ("s_gain", 1 / 14, 1), "l14": ("s_loss", 1 / 14, 1)}) + ", "
        f"wkx AS (SELECT *, {roll('avg', 'close', 30, **kw)} AS s30, {roll('avg', 'close', 40, **kw)} AS s40, {slope('ln(close)', 26, x='p', **kw)} AS sl, "
        f"{roll('max', 'high', 8, **kw)} AS h8, {roll('max', 'high', 8, shift=8, **kw)} AS h8b, {roll('max', 'rs', 26, shift=1, **kw)} AS rs26, "
        f"{lag('rs', 5, order='p')} AS rs5, {lag('rs', 1, order='p')} AS rsl FROM wks JOIN wkr USING (entity, p)), "
        f"wk AS MATERIALIZED (SELECT entity, p, {flag('close > e10 AND e10 > s30 AND s30 > s40')} AS weekly_stack_alignment, {flag('h8 > h8b')} AS weekly_higher_highs, "
        f"{flag('rs > rs5')} AS weekly_rs_rising, 100.0 - 100.0 / (1.0 + g14 / nullif(l14, 0)) AS weekly_rsi_14, "
        "CASE WHEN e12 - e26 > 0 THEN 'Positive' WHEN e12 - e26 IS NOT NULL THEN 'Negative' END AS weekly_macd_posture, "
        f"sign(sl)::DOUBLE AS weekly_trend_slope_sign, {flag('rs >= rs26')} AS weekly_rs_new_high_26w, {flag('rs > rsl')} AS w_rising FROM wkx), "
    )
    mo = bars("mo", mo_index) + (
        f"mo AS MATERIALIZED (SELECT entity, p, {flag('close > ' + roll('avg', 'close', 10, **kw))} AS monthly_close_above_sma_10, "
        f"{flag(up('high', 1) + ' AND ' + lag('high', 1, order='p') + ' > ' + lag('high', 2, order='p'))} AS monthly_higher_highs_3m, "
        f"{flag(up('rs', 3))} AS monthly_rs_rising_3m, {flag(up('rs', 6))} AS monthly_rs_rising_6m, {flag(up('rs', 1))} AS m_rising FROM mo1)"
    )
    return wk + mo


SEEN_W = "floor(date_diff('day', DATE '1970-01-02', date) / 7.0)::INT"
SEEN_M = "(year(date) * 12 + month(date) - CASE WHEN last_day(date) = date THEN 0 ELSE 1 END)::INT"


def vcp(src: str = "panel") -> str:
    """CTE vc: contracting-base score per row."""
    w21 = "OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)"
    return (
        f"pk0 AS (SELECT entity, t, close, volume, coalesce(count(close) {w21} = 21 AND max(close) {w21} = close, false) AS peak FROM {src}), "
        "pk AS MATERIALIZED (SELECT *, (sum(CASE WHEN peak THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING))::INT AS no FROM pk0), "
        "seg0 AS (SELECT a.entity, a.no AS s, b.t AS tb, a.close AS c0, count(*) AS n, count(x.close) AS nv, min(x.close) AS lo, median(x.volume) AS vol "
        "FROM (SELECT * FROM pk WHERE peak) a JOIN (SELECT * FROM pk WHERE peak) b ON a.entity = b.entity AND b.no = a.no + 1 "
        "JOIN pk x ON x.entity = a.entity AND x.t BETWEEN a.t AND b.t GROUP BY 1, 2, 3, 4), "
        "seg1 AS (SELECT *, CASE WHEN n >= 5 AND nv = n THEN (c0 - lo) / c0 END AS d2, CASE WHEN n >= 5 AND nv = n THEN vol END AS v2 FROM seg0), "
        f"seg2 AS (SELECT *, {lag('d2', 1, order='s')} AS d1, {lag('d2', 2, order='s')} AS d0, {lag('v2', 1, order='s')} AS v1, {lag('v2', 2, order='s')} AS v0 FROM seg1), "
        "seg AS (SELECT entity, s + 1 AS no, CASE WHEN s >= 3 AND d0 IS NOT NULL AND d1 IS NOT NULL AND d2 IS NOT NULL AND v0 IS NOT NULL AND v1 IS NOT NULL AND v2 IS NOT NULL "
        f"AND (SELECT max(t) FROM {src}) >= 79 THEN least(100.0, "
        "(CASE WHEN d0 > d1 AND d1 > d2 AND d2 > 0 AND v0 > v1 AND v1 > v2 THEN 70.0 WHEN d0 > d1 AND d1 > d2 AND d2 > 0 THEN 50.0 WHEN v0 > v1 AND v1 > v2 THEN 30.0 ELSE 10.0 END) "
        "+ greatest(0.0, 0.08 - d2) / 0.08 * 30.0) ELSE 0.0 END AS vcp FROM seg2), "
        "vc AS MATERIALIZED (SELECT pk.entity, pk.t, coalesce(seg.vcp, 0.0)::DOUBLE AS vcp_quality_score FROM pk LEFT JOIN seg USING (entity, no))"
    )


def layers(src: str = "panel") -> str:
    """CTEs f1..f5: the window layers, ending in ``tf``."""
    c, h, l, v = "close", "high", "low", "volume"
    w11 = "OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
    whole = "OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    w60 = "OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    before = "OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    prior5 = "OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"

    def reg(fn: str, n: int) -> str:
        return f"CASE WHEN count(close) {w60} = 60 THEN {fn}(ln(close), t::DOUBLE) {w60} END"

    f1 = {
        "prev_close": lag(c), "prev_volume": lag(v), "daily_ret": _chg(c, 1), "lr": f"ln({c}) - {lag('ln(close)')}",
        "b1_lr": f"ln(b1_close) - {lag('ln(b1_close)')}", "b1_ret": _chg("b1_close", 1),
        "sma_50": roll("avg", c, 50), "sma_200": roll("avg", c, 200), "sma_20": roll("avg", c, 20), "std_20": roll("stddev_samp", c, 20),
        "adr_pct_20": roll("avg", "ln(high / nullif(low, 0))", 20) + " * 100.0",
        "high_20": roll("max", h, 20), "low_20": roll("min", l, 20), "high_60": roll("max", h, 60), "low_60": roll("min", l, 60),
        "high_50": roll("max", h, 50, 20), "low_50": roll("min", l, 50, 20), "high_252": roll("max", h, 252, 60), "low_252": roll("min", l, 252, 60),
        "close_max_40d": roll("max", c, 40), "close_min_40d": roll("min", c, 40), "close_max_60": roll("max", c, 60, 20),
        "high_20_prior": roll("max", h, 20, shift=1), "high_252_prior": roll("max", h, 252, shift=1),
        "vm20": roll("avg", v, 20), "vm252": roll("avg", v, 252), "vs252": roll("stddev_samp", v, 252),
        "va50": roll("avg", v, 50, 20), "vma_50": roll("avg", v, 50), "vmin10": roll("min", v, 10),
        "ret_21": _chg(c, 21), "ret_63": _chg(c, 63), "ret_126": _chg(c, 126),
        "l1": div(c, "b1_close"), "l2": div(c, "b2_close"),
        "is_ph": f"count(high) {w11} = 11 AND max(high) {w11} = high", "is_pl": f"count(low) {w11} = 11 AND min(low) {w11} = low",
        "o_slope": reg("regr_slope", 60), "o_syy": reg("regr_syy", 60), "o_sxy": reg("regr_sxy", 60),
        "o_ybar": f"CASE WHEN count(close) {w60} = 60 THEN avg(ln(close)) {w60} END", "trend_rsquared_252d": r2("ln(close)", 252),
    }
    ss = "greatest(o_syy - o_slope * o_sxy, 0.0)"
    sxx = 60 * (60 * 60 - 1) / 12.0
    f2 = {
        "rs1": f"l1 / first_value(l1 IGNORE NULLS) {whole} * 100.0", "rs2": f"l2 / first_value(l2 IGNORE NULLS) {whole} * 100.0",
        "prev_ret": lag(R), "excess": "daily_ret - b1_ret", "clv": div("(close - low) - (high - close)", "high - low"),
        "pct_ma_50": "(close - sma_50) / sma_50 * 100.0", "pct_ma_200": "(close - sma_200) / sma_200 * 100.0",
        "pct_from_20d_high": "(close - high_20) / high_20 * 100.0",
        "range_60d_pct_of_price": "(high_60 - low_60) / close * 100.0", "range_20d_to_60d_ratio": div("high_20 - low_20", "high_60 - low_60"),
        "position_in_60d_range": div("close - low_60", "high_60 - low_60"),
        "trend_slope_60d": "(exp(o_slope * 252.0) - 1.0) * 100.0",
        "trend_r_squared_60d": "CASE WHEN o_syy > 0 THEN 1.0 - (o_syy - o_slope * o_sxy) / o_syy END",
        "trend_slope_t_stat": div("o_slope", f"sqrt({ss} / 58.0 / {sxx!r})"),
        "price_z_score_vs_trend": div("ln(close) - (o_ybar + o_slope * 29.5)", f"sqrt({ss} / 58.0)"),
        "rv21": roll("stddev_samp", R, 21) + " * sqrt(252.0) * 100.0", "realized_vol_60": roll("stddev_samp", R, 60) + " * sqrt(252.0) * 100.0",
        "volume_z_20_252": div("vm20 - vm252", "vs252"),
        "upv": roll("sum", "(CASE WHEN daily_ret > 0 THEN volume ELSE 0.0 END)", 50, 20),
        "dnv": roll("sum", "(CASE WHEN daily_ret < 0 THEN volume ELSE 0.0 END)", 50, 20),
        "distribution_days_25": roll("sum", flag("close < prev_close * 0.998 AND volume > prev_volume"), 25, 10),
        "low_rel_vol_10d": f"CASE WHEN vmin10 IS NOT NULL THEN {flag('volume <= vmin10')} END",
        "volume_buzz_50": f"({div(v, 'vma_50')} - 1.0) * 100.0",
        "m126": roll("avg", R, 126), "s126": roll("stddev_samp", R, 126),
        "d126": roll("stddev_samp", "(CASE WHEN daily_ret < 0 THEN daily_ret END)", 126, 20),
        "m60": roll("avg", R, 60, 40), "s60": roll("stddev_samp", R, 60, 40), "m252": roll("avg", R, 252, 200), "s252": roll("stddev_samp", R, 252, 200),
        "p95": roll("quantile_cont({x}, 0.95) {w}", R, 252, 200), "p5": roll("quantile_cont({x}, 0.05) {w}", R, 252, 200),
        "upside_vol_60d": roll("stddev_samp", "(CASE WHEN daily_ret > 0 THEN daily_ret END)", 60, 20) + " * 100.0",
        "downside_vol_60d": roll("stddev_samp", "(CASE WHEN daily_ret < 0 THEN daily_ret END)", 60, 20) + " * 100.0",
        "gain252": roll("sum", "(CASE WHEN daily_ret > 0 THEN daily_ret ELSE 0.0 END)", 252),
        "pain252": roll("sum", "(CASE WHEN daily_ret < 0 THEN daily_ret ELSE 0.0 END)", 252),
        "cov252": f"({roll('avg', '(lr * b1_lr)', 252)} - {roll('avg', 'lr', 252)} * {roll('avg', 'b1_lr', 252)}) * (252.0 / 251.0)",
        "bvar": roll("var_samp", "b1_lr", 252),
        "drawdown_pct": f"({div(c, 'close_max_60')} - 1.0) * 100.0", "near_high": flag("close >= high_252 * 0.97"),
        "pct_from_52w_high": f"({div(c, 'high_252')} - 1.0) * 100.0", "pct_from_52w_low": f"({div(c, 'low_252')} - 1.0) * 100.0",
        "new_252d_high": flag("close >= high_252_prior"), "broke20": flag("close >= high_20_prior"), "pct_up_days_21": roll("avg", flag("daily_ret > 0"), 21),
        "bbu": "sma_20 + std_20 * 2.0", "bbl": "sma_20 - std_20 * 2.0",
        "pmax40": lag("close_max_40d"), "pmin40": lag("close_min_40d"),
        "ph_up": f"CASE WHEN is_ph THEN {flag(f'high > last_value(CASE WHEN is_ph THEN high END IGNORE NULLS) {before}')} END",
        "pl_up": f"CASE WHEN is_pl THEN {flag(f'low > last_value(CASE WHEN is_pl THEN low END IGNORE NULLS) {before}')} END",
    }
    f2b = {  # needs clv / excess / prev_ret
        "ad_line": "sum(coalesce(clv * volume, 0.0)) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING)",
        "cmf_21": div(roll("sum", "(clv * volume)", 21), roll("sum", v, 21)),
        "em252": roll("avg", "excess", 252, 200), "es252": roll("stddev_samp", "excess", 252, 200),
        **{f"return_autocorrelation_{n}d_lag1": _corr(n, m) for n, m in ((60, 40), (21, 15))},
    }
    place = div("close - low_50", "high_50 - low_50")
    piv = lambda n: (f"least(coalesce(sum({n}) {w60}, 0.0) - coalesce(first_value({n} IGNORE NULLS) {w60}, 0.0), 3.0)")
    nh = lambda x, n: flag(f"{x} >= {roll('max', x, n - 1, shift=1)}")
    rsi = "round(rsi_14, 9)"  # flat closes leave it unchanged but for the last bits
    f3 = {
        "pct_ma_50_p80_252d": roll("quantile_cont({x}, 0.8) {w}", "pct_ma_50", 252),
        "trend_slope_significant": flag("abs(trend_slope_t_stat) > 1.96"), "up_down_vol_ratio_50": div("upv", "dnv"),
        "ad_line_slope_20": slope("ad_line", 20), "ad_line_slope_21d": slope("ad_line", 21), "ad60": slope("ad_line", 60),
        "capitulation_volume_flag": flag(f"volume > va50 * 3.0 AND daily_ret < -0.02 AND {place} < 0.20"),
        "climax_volume_flag": flag(f"volume > va50 * 4.0 AND daily_ret > 0.05 AND {place} > 0.80"),
        "rs_composite": f"({_chg('rs1', 63)} * 100.0) * 0.40 + ({_chg('rs1', 126)} * 100.0) * 0.20 + ({_chg('rs1', 189)} * 100.0) * 0.20 + ({_chg('rs1', 252)} * 100.0) * 0.20",
        "sharpe_126": div("m126", "s126"), "sortino_126": div("m126", "d126"), "sharpe_60": div("m60", "s60") + " * sqrt(252.0)",
        "sharpe_252": div("m252", "s252") + " * sqrt(252.0)", "tail_raw": div("p95", "abs(p5)"),
        "information_ratio_252d": div("em252", "es252") + " * sqrt(252.0)", "gain_to_pain_ratio_252d": div("gain252", "abs(pain252)"),
        "ret_21_pct": "ret_21 * 100.0",
        "rs_line_spy_new_high_60d": nh("rs1", 60), "rs_line_spy_new_high_252d": nh("rs1", 252),
        "rs_line_qqq_new_high_60d": nh("rs2", 60), "rs_line_qqq_new_high_252d": nh("rs2", 252),
        "rs_line_spy_slope_20d": f"{_chg('rs1', 20)} * 100.0", "rs_line_spy_slope_60d": f"{_chg('rs1', 60)} * 100.0",
        "rs_line_spy_slope_21d": f"{_chg('rs1', 21)} * 100.0", "rs_line_qqq_slope_60d": f"{_chg('rs2', 60)} * 100.0",
        "rs_line_spy_r_squared_60d": r2("ln(rs1)", 60), "d_rising": flag(f"rs1 > {lag('rs1', 5)}"),
        "beta": div("cov252", "bvar"), "a50": flag("round(close - sma_50, 9) > 0"), "a200": flag("round(close - sma_200, 9) > 0"), "x50": flag("round(sma_50 - sma_200, 9) > 0"),
        "hh_count_60d": piv("ph_up"), "hl_count_60d": piv("pl_up"),
        "failed_breakout_flag_10d": flag(f"max(broke20) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 1.0 AND close < high_20_prior"),
        "bb_width": div("bbu - bbl", "sma_20"), "mdd_raw": roll("min", "drawdown_pct", 60, 20),
        "days_near_52w_high_60d": roll("sum", "near_high", 60, 20),
        "breakdown_level": "CASE WHEN close < pmin40 AND close < sma_50 THEN pmin40 END",
        "atr_x_50": div("close - sma_50", "atr_14"), "true_range_x_atr14": div("true_range", "atr_14"),
        "breakout_level": f"CASE WHEN close > pmax40 AND {div('true_range', 'atr_14')} > 1.3 THEN pmax40 END",
        "adx_trend_direction": "CASE WHEN plus_di > minus_di THEN 1.0 WHEN plus_di IS NOT NULL AND minus_di IS NOT NULL THEN -1.0 END",
        "ema_stack_score": (f"{flag('round(close - ema_8, 9) > 0')} * 30 + {flag('round(ema_8 - ema_21, 9) > 0')} * 30 + {flag('round(ema_21 - ema_50, 9) > 0')} * 30 + "
                            f"{flag('round(close - ema_8, 9) > 0 AND round(ema_8 - ema_21, 9) > 0 AND round(ema_21 - ema_50, 9) > 0')} * 10"),
        "hist": "macd_line - macd_signal",
        "bullish_divergence_20d": flag(f"{roll('min', c, 10)} < {roll('min', c, 10, shift=10)} AND {roll('min', rsi, 10)} > {roll('min', rsi, 10, shift=10)}"),
        "bearish_divergence_20d": flag(f"{roll('max', c, 10)} > {roll('max', c, 10, shift=10)} AND {roll('max', rsi, 10)} < {roll('max', rsi, 10, shift=10)}"),
        "bb_squeeze_flag": flag("bbu < ema_20 + atr_10 * 1.5 AND bbl > ema_20 - atr_10 * 1.5"),
    }
    w252 = "OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
    vals = f"list(bb_width) FILTER (bb_width IS NOT NULL) {w252}"
    f4 = {
        "failed_breakdown_flag_5d_v2": flag(f"close > min(breakdown_level) {prior5}"),
        "failed_breakout_flag_5d_v2": flag(f"close < max(breakout_level) {prior5}"),
        "resid": f"lr - {lag('beta')} * b1_lr",
        "sma_stack_score": f"a50 * 30 + a200 * 30 + x50 * 30 + {flag('a50 = 1 AND a200 = 1 AND x50 = 1')} * 10",
        "trend_integrity": flag("hh_count_60d >= 2 AND hl_count_60d >= 2"),
        "bbl_list": vals,
        "volume_leadership_confirmed": flag("up_down_vol_ratio_50 >= 1.5 AND ad60 > 0.05 AND distribution_days_25 <= 3"),
        "pct_above_sma_50": "a50", "pct_above_sma_200": "a200",
        "vol_normalized_extension": "atr_x_50 / (CASE WHEN adr_pct_20 IS NOT NULL THEN greatest(adr_pct_20, 1.0) END)",
        "hist_prev": lag("hist"), "hist_bar": roll("avg", "abs(hist)", 50, 10) + " * 1.5",
        "mtf_rs_coherence": "d_rising + coalesce(w_rising, 0.0) + coalesce(m_rising, 0.0)",
        "lr_list": f"CASE WHEN count({R}) {w252} = 252 THEN list(ln(1.0 + {R})) {w252} END",
    }
    dev = "list_transform(lr_list, lambda x: x - list_avg(lr_list))"
    f5 = {
        "residual_momentum_126d": roll("sum", "resid", 126),
        "bb_width_pct_252d": "CASE WHEN bb_width IS NOT NULL AND len(bbl_list) >= 60 THEN (len(list_filter(bbl_list, lambda x: x < bb_width)) + (len(list_filter(bbl_list, lambda x: x = bb_width)) + 1) / 2.0) / len(bbl_list) * 100.0 END",
        "macd_posture": ("CASE WHEN macd_line IS NOT NULL THEN (CASE WHEN macd_line > 0 THEN 'Positive' ELSE 'Negative' END) || '/' || "
                         "(CASE WHEN (macd_line > 0 AND hist > hist_prev) OR (macd_line < 0 AND hist < hist_prev) THEN 'Accelerating' ELSE 'Decelerating' END) || '/' || "
                         "(CASE WHEN abs(hist) > hist_bar THEN 'Strong' ELSE 'Weak' END) END"),
        "lr_dev": dev,
    }
    join = (f"f0 AS MATERIALIZED (SELECT p.*, rec.* EXCLUDE (entity, t), st.* EXCLUDE (entity, t), vc.vcp_quality_score, wk.* EXCLUDE (entity, p), mo.* EXCLUDE (entity, p) "
            f"FROM (SELECT *, {SEEN_W} AS pw, {SEEN_M} AS pm FROM {src}) p JOIN rec USING (entity, t) JOIN st USING (entity, t) JOIN vc USING (entity, t) "
            "LEFT JOIN wk ON wk.entity = p.entity AND wk.p = p.pw LEFT JOIN mo ON mo.entity = p.entity AND mo.p = p.pm)")
    out = [join]
    prev = "f0"
    for name, layer in (("f1", f1), ("f2", f2), ("f2b", f2b), ("f3", f3), ("f4", f4), ("f5", f5)):
        sel = ", ".join(f"{e} AS {k}" for k, e in layer.items())
        out.append(f"{name} AS MATERIALIZED (SELECT *, {sel} FROM {prev})")
        prev = name
    # running sums of the deviations: prefix sums through a window over the unnested list
    out.append("hu AS (SELECT entity, t, max(cs) - min(cs) AS rg, stddev_pop(d) AS sd FROM (SELECT entity, t, d, sum(d) OVER (PARTITION BY entity, t ORDER BY i) AS cs "
               "FROM (SELECT entity, t, unnest(lr_dev) AS d, generate_subscripts(lr_dev, 1) AS i FROM f5 WHERE lr_list IS NOT NULL)) GROUP BY 1, 2)")
    out.append("tf AS MATERIALIZED (SELECT f5.* EXCLUDE (bbl_list, lr_list, lr_dev), CASE WHEN rg > 0 AND sd > 0 THEN ln(rg / sd) / ln(252.0) END AS hurst_exponent_252d "
               "FROM f5 LEFT JOIN hu USING (entity, t))")
    return ", ".join(out)


def _corr(n: int, m: int) -> str:
    w = f"OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    a, b = ("(CASE WHEN daily_ret IS NOT NULL AND prev_ret IS NOT NULL THEN daily_ret END)",
            "(CASE WHEN daily_ret IS NOT NULL AND prev_ret IS NOT NULL THEN prev_ret END)")
    return f"CASE WHEN count({a}) {w} >= {m} THEN covar_pop({a}, {b}) {w} / nullif(stddev_pop({a}) {w} * stddev_pop({b}) {w}, 0) END"


def cross(src: str = "tf") -> str:
    """CTE feat: ratings, peer z / rank and rating shifts; benchmarks removed."""
    rate = lambda x: f"round_even({clip(pct_rank(x) + ' * 98.0 + 1.0', '1.0', '99.0')}, 0)"
    rated = {
        "sharpe_momentum_rank_126d": "sharpe_126", "sortino_rank_126d": "sortino_126", "sharpe_rank_60d": "sharpe_60", "sharpe_rank_252d": "sharpe_252",
        "tail_ratio_252d": "tail_raw", "momentum_21d_pct": "ret_21_pct", "max_drawdown_pct_60d": "mdd_raw", "vol_percentile_21d": "rv21",
    }
    sel = [f"{rate(x)} AS {o}" for o, x in rated.items()]
    sel.append(f"{clip(pct_rank('rs_composite') + ' * 98.0 + 1.0', '1.0', '99.0')} AS rs_rating_spy")
    g = "OVER (PARTITION BY date, grp)"
    for n in (21, 63):
        sel.append(f"CASE WHEN grp_size >= 3 THEN (ret_{n} - avg(ret_{n}) {g}) / nullif(stddev_samp(ret_{n}) {g}, 0) END AS within_basket_z_{n}d")
    rk = "rank() OVER (PARTITION BY date, grp ORDER BY ret_63 DESC NULLS LAST)::DOUBLE"
    ok = "ret_63 IS NOT NULL AND grp_size >= 2"
    sel += [f"CASE WHEN {ok} THEN {rk} END AS within_basket_rank", f"CASE WHEN {ok} THEN {rk} / count(ret_63) {g} END AS within_basket_rank_pct"]
    return (f"x1 AS MATERIALIZED (SELECT *, {', '.join(sel)} FROM {src}), "
            f"x2 AS (SELECT *, rs_rating_spy - {lag('rs_rating_spy', 60)} AS rs_rating_slope_60d, rs_rating_spy - {lag('rs_rating_spy', 120)} AS rs_rating_slope_120d FROM x1), "
            f"feat AS MATERIALIZED (SELECT * FROM x2 WHERE {NO_BENCH})")


def features(p: str = "bx") -> str:
    """All CTEs from the raw tables to ``feat``."""
    return ", ".join([panel(p), recursion(), periods(), vcp(), layers(), cross()])


FEATURES = config.FEATURES
