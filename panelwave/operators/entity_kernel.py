"""Every per-entity feature of one entity's whole history, in array operations.

Spark deals and sorts the panel; a task turns each entity's rows into columns here. This is the plan for panels whose
calendar is proven to fit a task; ``features.time_features`` keeps the window plan for any other. Windows never reach over
an entity's first row; NaN is null, and a statistic is null with fewer values than it needs. Each window is measured
from its latest value, so a window of equal values has a deviation of exactly zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelwave.operators.orderwin import Window, order_statistics
from panelwave.operators.recursive import NAN, hurst_column, indicators
from panelwave.operators.sizing import ship_package

YEAR = math.sqrt(252.0)
ROWS = 2048  # rows whose windows are laid out at once


def div(a, b):
    return np.divide(a, b, out=np.full(np.broadcast(a, b).shape, NAN), where=np.asarray(b) != 0)


def ln(x: np.ndarray) -> np.ndarray:
    return np.log(np.where(x > 0, x, NAN))


def flag(cond: np.ndarray) -> np.ndarray:
    return cond.astype(float)


def above(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a > b by more than the rounding of an average."""
    return np.round(a - b, 9) > 0


def lag(x: np.ndarray, k: int = 1) -> np.ndarray:
    return np.concatenate([np.full(min(k, len(x)), NAN), x[: max(len(x) - k, 0)]])


def change(x: np.ndarray, k: int) -> np.ndarray:
    return div(x, lag(x, k)) - 1.0


def filled(x: np.ndarray) -> np.ndarray:
    """Each null as the value before it."""
    at = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(len(x))))
    return np.where(at >= 0, x[np.maximum(at, 0)], NAN)


class Rolling:
    """Statistics over the last n rows of one column, and those shared between windows of one size."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.known = ~np.isnan(x)
        self.count = np.concatenate([[0], np.cumsum(self.known)])
        self.anchor = filled(x)
        self._moments: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def size(self, n: int, shift: int = 0) -> np.ndarray:
        """Values in each window."""
        end = np.maximum(np.arange(len(self.x)) + 1 - shift, 0)
        return self.count[end] - self.count[np.maximum(end - n, 0)]

    def windows(self, values: np.ndarray, n: int, empty: float) -> Iterator[tuple[slice, np.ndarray]]:
        padded = np.concatenate([np.full(n - 1, empty), values])
        every = sliding_window_view(padded, n)
        for k in range(0, len(values), ROWS):
            yield slice(k, k + ROWS), every[k : k + ROWS]

    def moments(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(sum, sum of squares) of distances to the window's latest value."""
        if n not in self._moments:
            first, second = np.zeros(len(self.x)), np.zeros(len(self.x))
            whole = self.known.all()
            anchors = np.where(np.isnan(self.anchor), 0.0, self.anchor)
            for part, w in self.windows(self.x, n, NAN):
                d = w - anchors[part, None]
                if not whole or part.start < n - 1:
                    d[np.isnan(d)] = 0.0
                first[part], second[part] = d.sum(axis=1), np.einsum("ij,ij->i", d, d)
            self._moments[n] = first, second
        return self._moments[n]

    def least(self, n: int, m: int | None, shift: int = 0) -> np.ndarray:
        return self.size(n, shift) >= max(n if m is None else m, 1)

    def mean(self, n: int, m: int | None = None) -> np.ndarray:
        k = np.maximum(self.size(n), 1)
        return np.where(self.least(n, m), self.anchor + self.moments(n)[0] / k, NAN)

    def var(self, n: int, m: int | None = None) -> np.ndarray:
        k, (s, q) = self.size(n), self.moments(n)
        ok = self.least(n, m) & (k > 1)
        return np.where(ok, np.maximum(q - s * s / np.maximum(k, 1), 0.0) / np.maximum(k - 1, 1), NAN)

    def std(self, n: int, m: int | None = None) -> np.ndarray:
        return np.sqrt(self.var(n, m))

    def sum(self, n: int, m: int | None = None) -> np.ndarray:
        out = np.zeros(len(self.x))
        for part, w in self.windows(np.where(self.known, self.x, 0.0), n, 0.0):
            out[part] = w.sum(axis=1)
        return np.where(self.least(n, m), out, NAN)

    def _extreme(self, n: int, m: int | None, shift: int, fn, empty: float) -> np.ndarray:
        out = np.empty(len(self.x))
        for part, w in self.windows(np.where(self.known, self.x, empty), n, empty):
            out[part] = fn(w, axis=1)
        if shift:
            out = np.concatenate([np.full(min(shift, len(out)), empty), out[: max(len(out) - shift, 0)]])
        return np.where(self.least(n, m, shift), out, NAN)

    def max(self, n: int, m: int | None = None, shift: int = 0) -> np.ndarray:
        return self._extreme(n, m, shift, np.max, -np.inf)

    def min(self, n: int, m: int | None = None, shift: int = 0) -> np.ndarray:
        return self._extreme(n, m, shift, np.min, np.inf)

    def trend(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(slope, syy, sxy, mean) of the regression on the row index, over full windows."""
        full, (s, q) = self.size(n) == n, self.moments(n)
        step = np.arange(n) - (n - 1) / 2.0
        sxy = np.zeros(len(self.x))
        for part, w in self.windows(self.x, n, NAN):
            sxy[part] = np.where(full[part], (w - self.anchor[part, None]) @ step, NAN)
        return (np.where(full, sxy / (n * (n * n - 1) / 12.0), NAN), np.where(full, np.maximum(q - s * s / n, 0.0), NAN), sxy,
                np.where(full, self.anchor + s / n, NAN))

    def slope(self, n: int) -> np.ndarray:
        return self.trend(n)[0]

    def r2(self, n: int) -> np.ndarray:
        _, syy, sxy, _ = self.trend(n)
        return np.where(syy > 0, div(sxy * sxy, syy * (n * (n * n - 1) / 12.0)), NAN)


def pair_corr(x: np.ndarray, y: np.ndarray, n: int, m: int) -> np.ndarray:
    """Correlation over the rows of the last n where both sides have values."""
    both = ~(np.isnan(x) | np.isnan(y))
    a, b = Rolling(np.where(both, x, NAN)), Rolling(np.where(both, y, NAN))
    (sx, qx), (sy, qy), k = a.moments(n), b.moments(n), np.maximum(a.size(n), 1)
    cross = np.zeros(len(x))
    ax, ay = np.nan_to_num(a.anchor), np.nan_to_num(b.anchor)
    for (part, w), (_, v) in zip(a.windows(a.x, n, NAN), b.windows(b.x, n, NAN)):
        d = (w - ax[part, None]) * (v - ay[part, None])
        cross[part] = np.nansum(d, axis=1)
    cov = cross - sx * sy / k
    sd = np.sqrt(np.maximum(qx - sx * sx / k, 0.0)) * np.sqrt(np.maximum(qy - sy * sy / k, 0.0))
    return np.where(a.size(n) >= m, div(cov, sd), NAN)


def pivots(x: np.ndarray, top: bool, around: int = 5) -> np.ndarray:
    """Rows that hold the extreme of the rows around them, all present."""
    wide = np.concatenate([np.full(around, NAN), x, np.full(around, NAN)])
    w = sliding_window_view(wide, 2 * around + 1)
    with np.errstate(invalid="ignore"):
        return (w.max(axis=1) if top else w.min(axis=1)) == x  # NaN in the window spreads to its extreme


def rising_count(x: np.ndarray, at: np.ndarray, n: int = 60) -> np.ndarray:
    """Pivots of the last n rows that rose over the pivot before them, the window's oldest left out; three at most."""
    place = np.arange(len(x))
    level = lag(filled(np.where(at, x, NAN)))
    up = np.where(at, flag(x > level), NAN)
    total = np.nan_to_num(Rolling(up).sum(n, 1))
    nxt = np.minimum.accumulate(np.where(at, place, len(x))[::-1])[::-1]
    oldest = nxt[np.maximum(place - (n - 1), 0)]
    first = np.where(oldest <= place, np.nan_to_num(up[np.minimum(oldest, len(x) - 1)]), 0.0)
    return np.minimum(total - first, 3.0)


def last_rows(x: np.ndarray, n: int, top: bool) -> np.ndarray:
    """Extreme of the n rows before each row, nulls left out."""
    r = Rolling(x)
    return r.max(n, 1, shift=1) if top else r.min(n, 1, shift=1)


POSTURE = "macd_posture"


def index_line(c: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Close over benchmark, 100 where it begins."""
    line = div(c, b)
    some = np.flatnonzero(~np.isnan(line))
    return line / (line[some[0]] if len(some) else NAN) * 100.0


def composite_strength(line: np.ndarray) -> np.ndarray:
    return sum((change(line, n) * 100.0) * w for n, w in ((63, 0.40), (126, 0.20), (189, 0.20), (252, 0.20)))


def entity_features(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray, b1: np.ndarray, b2: np.ndarray,
                    weekly_up: np.ndarray, monthly_up: np.ndarray, want: Iterable[str] | None = None) -> dict[str, np.ndarray]:
    """Feature columns, inputs of the cross-sectional ratings, and the MACD posture as text, of rows in time order.

    ``want``: columns that are needed; what only others are made from may be left out.
    """
    h, l, c, v = high, low, close, volume
    start = np.arange(len(c)) == 0
    wanted = None if want is None else set(want)
    ask = lambda *names: wanted is None or not wanted.isdisjoint(names)
    line_only = wanted == {"rs_composite"}
    f = {} if line_only else indicators(h, l, c, start, {}, ask("supertrend_direction", "supertrend_days_since_flip"))
    if line_only:
        line = index_line(c, b1)
        return {"rs_composite": composite_strength(line)}
    H, L, C, V = Rolling(h), Rolling(l), Rolling(c), Rolling(v)
    lnc, prev_c = ln(c), lag(c)
    r = change(c, 1)
    R = Rolling(r)
    b1_ret, lrd, b1_lr = change(b1, 1), lnc - lag(lnc), ln(b1) - lag(ln(b1))
    for n in (20, 50, 200):
        f[f"sma_{n}"] = C.mean(n)
    sma_20, sma_50, sma_200, std_20 = f.pop("sma_20"), f["sma_50"], f["sma_200"], C.std(20)
    f["adr_pct_20"] = Rolling(ln(div(h, l))).mean(20) * 100.0
    high_20, low_20, high_60, low_60 = H.max(20), L.min(20), H.max(60), L.min(60)
    high_252, low_252 = H.max(252, 60), L.min(252, 60)
    f["close_max_40d"], f["close_min_40d"] = C.max(40), C.min(40)
    prior_max, prior_min = lag(f["close_max_40d"]), lag(f["close_min_40d"])
    high_20_prior = H.max(20, shift=1)
    f |= {f"ret_{n}": change(c, n) for n in (21, 63, 126)}
    for name, n in (("pct_ma_50", 50), ("pct_ma_200", 200)):
        f[name] = (c - f[f"sma_{n}"]) / f[f"sma_{n}"] * 100.0
    f["pct_from_20d_high"] = (c - high_20) / high_20 * 100.0
    range_20, range_60 = high_20 - low_20, high_60 - low_60
    f["range_60d_pct_of_price"], f["range_20d_to_60d_ratio"] = range_60 / c * 100.0, div(range_20, range_60)
    f["position_in_60d_range"] = div(c - low_60, range_60)

    # trend
    LN = Rolling(lnc)
    if ask("trend_slope_60d", "trend_r_squared_60d", "trend_slope_t_stat", "trend_slope_significant", "price_z_score_vs_trend"):
        slope, syy, sxy, ybar = LN.trend(60)
        ss = np.maximum(syy - slope * sxy, 0.0)
        f["trend_slope_60d"] = (np.exp(slope * 252.0) - 1.0) * 100.0
        f["trend_r_squared_60d"] = np.where(syy > 0, 1.0 - (syy - slope * sxy) / np.where(syy > 0, syy, 1.0), NAN)
        f["trend_slope_t_stat"] = div(slope, np.sqrt(ss / 58 / (60 * (60 * 60 - 1) / 12.0)))
        f["trend_slope_significant"] = flag(np.abs(f["trend_slope_t_stat"]) > 1.96)
        f["price_z_score_vs_trend"] = div(lnc - (ybar + slope * 29.5), np.sqrt(ss / 58))
    if ask("trend_rsquared_252d"):
        f["trend_rsquared_252d"] = LN.r2(252)

    # volatility and return quality
    if ask("realized_vol_21", "realized_vol_60"):
        f["realized_vol_21"], f["realized_vol_60"] = R.std(21) * YEAR * 100.0, R.std(60) * YEAR * 100.0
    down = Rolling(np.where(r < 0, r, NAN))
    if ask("upside_vol_60d", "downside_vol_60d"):
        f["upside_vol_60d"], f["downside_vol_60d"] = Rolling(np.where(r > 0, r, NAN)).std(60, 20) * 100.0, down.std(60, 20) * 100.0
    if ask("sharpe_126", "sortino_126"):
        f["sharpe_126"], f["sortino_126"] = div(R.mean(126), R.std(126)), div(R.mean(126), down.std(126, 20))
    if ask("sharpe_ratio_60d"):
        f["sharpe_ratio_60d"] = div(R.mean(60, 40), R.std(60, 40)) * YEAR
    if ask("sharpe_252"):
        f["sharpe_252"] = div(R.mean(252, 200), R.std(252, 200)) * YEAR
    if ask("information_ratio_252d"):
        E = Rolling(r - b1_ret)
        f["information_ratio_252d"] = div(E.mean(252, 200), E.std(252, 200)) * YEAR
    if ask("gain_to_pain_ratio_252d"):
        gain, pain = (Rolling(np.where(np.sign(r) == s, r, 0.0)).sum(252) for s in (1, -1))
        f["gain_to_pain_ratio_252d"] = div(gain, np.abs(pain))
    first = np.zeros(len(c), np.int64)
    if ask("tail_raw_252"):
        tails = order_statistics(r, first, {"hi": Window("quantile", 252, 200, 0.95), "lo": Window("quantile", 252, 200, 0.05)})
        f["tail_raw_252"] = div(tails["hi"], np.abs(tails["lo"]))
    f |= {k: pair_corr(r, lag(r), n, m) for n, m in ((60, 40), (21, 15)) if ask(k := f"return_autocorrelation_{n}d_lag1")}
    if ask("hurst_exponent_252d"):
        f["hurst_exponent_252d"] = hurst_column(c, first, 252)
    if ask("max_drawdown_raw_60"):
        drawdown = (div(c, C.max(60, 20)) - 1.0) * 100.0
        f["max_drawdown_raw_60"] = Rolling(drawdown).min(60, 20)
    f["ret_21_pct"] = f["ret_21"] * 100.0
    if ask("pct_up_days_21"):
        f["pct_up_days_21"] = Rolling(flag(r > 0)).mean(21)

    # volume
    if ask("volume_z_20_252"):
        f["volume_z_20_252"] = div(V.mean(20) - V.mean(252), V.std(252))
    if ask("up_down_vol_ratio_50", "volume_leadership_confirmed"):
        f["up_down_vol_ratio_50"] = div(Rolling(np.where(r > 0, v, 0.0)).sum(50, 20), Rolling(np.where(r < 0, v, 0.0)).sum(50, 20))
    if ask("distribution_days_25", "volume_leadership_confirmed"):
        f["distribution_days_25"] = Rolling(flag((c < prev_c * 0.998) & (v > lag(v)))).sum(25, 10)
    if ask("ad_line_slope_20", "ad_line_slope_21d", "cmf_21", "volume_leadership_confirmed"):
        flow = div((c - l) - (h - c), h - l) * v
        ad = Rolling(np.cumsum(np.nan_to_num(flow)))
        f |= {k: ad.slope(n) for k, n in (("ad_line_slope_20", 20), ("ad_line_slope_21d", 21)) if ask(k)}
        if ask("cmf_21"):
            f["cmf_21"] = div(Rolling(flow).sum(21), V.sum(21))
        if ask("volume_leadership_confirmed"):
            f["volume_leadership_confirmed"] = flag((f["up_down_vol_ratio_50"] >= 1.5) & (ad.slope(60) > 0.05) & (f["distribution_days_25"] <= 3))
    if ask("capitulation_volume_flag", "climax_volume_flag"):
        vol_50, high_50, low_50 = V.mean(50, 20), H.max(50, 20), L.min(50, 20)
        place_50 = div(c - low_50, high_50 - low_50)
        f["capitulation_volume_flag"] = flag((v > vol_50 * 3.0) & (r < -0.02) & (place_50 < 0.20))
        f["climax_volume_flag"] = flag((v > vol_50 * 4.0) & (r > 0.05) & (place_50 > 0.80))
    if ask("low_rel_vol_10d"):
        least_10 = V.min(10)
        f["low_rel_vol_10d"] = np.where(np.isnan(least_10), NAN, flag(v <= least_10))
    if ask("volume_buzz_50"):
        f["volume_buzz_50"] = (div(v, V.mean(50)) - 1.0) * 100.0

    # strength against the benchmarks
    for name, b in (("spy", b1), ("qqq", b2)):
        line = index_line(c, b)
        X = Rolling(line)
        f |= {k: flag(line >= X.max(n - 1, shift=1)) for n in (60, 252) if ask(k := f"rs_line_{name}_new_high_{n}d")}
        f |= {f"rs_line_{name}_slope_{n}d": change(line, n) * 100.0 for n in (20, 21, 60)}
        if name == "spy":
            f["rs_composite"] = composite_strength(line)
            if ask("rs_line_spy_r_squared_60d"):
                f["rs_line_spy_r_squared_60d"] = Rolling(ln(line)).r2(60)
            f["mtf_rs_coherence"] = flag(line > lag(line, 5)) + np.nan_to_num(weekly_up) + np.nan_to_num(monthly_up)
    if ask("residual_momentum_126d"):
        market = Rolling(b1_lr)
        both = Rolling(lrd * b1_lr).mean(252) - Rolling(lrd).mean(252) * market.mean(252)
        beta = div(both * (252.0 / 251.0), market.var(252))
        f["residual_momentum_126d"] = Rolling(lrd - lag(beta) * b1_lr).sum(126)

    # structure
    a50, a200, cross = above(c, sma_50), above(c, sma_200), above(sma_50, sma_200)
    f["sma_stack_score"] = flag(a50) * 30 + flag(a200) * 30 + flag(cross) * 30 + flag(a50 & a200 & cross) * 10
    f["pct_above_sma_50"], f["pct_above_sma_200"] = flag(a50), flag(a200)
    e8, e21, e50 = f["ema_8"], f["ema_21"], f["ema_50"]
    up_8, up_21, up_50 = above(c, e8), above(e8, e21), above(e21, e50)
    f["ema_stack_score"] = flag(up_8) * 30 + flag(up_21) * 30 + flag(up_50) * 30 + flag(up_8 & up_21 & up_50) * 10
    if ask("hh_count_60d", "trend_integrity"):
        f["hh_count_60d"] = rising_count(h, pivots(h, True))
    if ask("hl_count_60d", "trend_integrity"):
        f["hl_count_60d"] = rising_count(l, pivots(l, False))
    if ask("trend_integrity"):
        f["trend_integrity"] = flag((f["hh_count_60d"] >= 2) & (f["hl_count_60d"] >= 2))
    if ask("new_252d_high"):
        f["new_252d_high"] = flag(c >= H.max(252, shift=1))
    if ask("failed_breakout_flag_10d"):
        f["failed_breakout_flag_10d"] = flag((Rolling(flag(c >= high_20_prior)).max(10, 1) == 1.0) & (c < high_20_prior))
    if ask("days_near_52w_high_60d"):
        f["days_near_52w_high_60d"] = Rolling(flag(c >= high_252 * 0.97)).sum(60, 20)
    f["pct_from_52w_high"], f["pct_from_52w_low"] = (div(c, high_252) - 1.0) * 100.0, (div(c, low_252) - 1.0) * 100.0
    if ask("pct_ma_50_p80_252d"):
        f |= order_statistics(f["pct_ma_50"], first, {"pct_ma_50_p80_252d": Window("quantile", 252, 252, 0.8)})

    # with recursive indicators
    atr = f["atr_14"]
    f["atr_x_50"], f["true_range_x_atr14"] = div(c - sma_50, atr), div(f["true_range"], atr)
    f["vol_normalized_extension"] = f["atr_x_50"] / np.maximum(f["adr_pct_20"], 1.0)
    plus, minus = f["plus_di"], f["minus_di"]
    f["adx_trend_direction"] = np.where(plus > minus, 1.0, np.where(np.isnan(plus) | np.isnan(minus), NAN, -1.0))
    if ask("failed_breakout_flag_5d_v2", "failed_breakdown_flag_5d_v2"):
        broke = np.where((c > prior_max) & (f["true_range_x_atr14"] > 1.3), prior_max, NAN)
        f["failed_breakout_flag_5d_v2"] = flag(c < last_rows(broke, 5, True))
        f["failed_breakdown_flag_5d_v2"] = flag(c > last_rows(np.where((c < prior_min) & (c < sma_50), prior_min, NAN), 5, False))
    if ask("bullish_divergence_20d", "bearish_divergence_20d"):
        rsi = Rolling(np.round(f["rsi_14"], 9))
        f["bullish_divergence_20d"] = flag((C.min(10) < C.min(10, shift=10)) & (rsi.min(10) > rsi.min(10, shift=10)))
        f["bearish_divergence_20d"] = flag((C.max(10) > C.max(10, shift=10)) & (rsi.max(10) < rsi.max(10, shift=10)))
    upper, lower = sma_20 + std_20 * 2.0, sma_20 - std_20 * 2.0
    f["bb_squeeze_flag"] = flag((upper < f["ema_20"] + f["atr_10"] * 1.5) & (lower > f["ema_20"] - f["atr_10"] * 1.5))
    if ask("bb_width_pct_252d"):
        width = order_statistics(div(upper - lower, sma_20), first, {"w": Window("rank", 252, 60)})
        f["bb_width_pct_252d"] = width["w"] * 100.0
    if not ask(POSTURE):
        return f | {"close": c, "volume": v}
    line = f["macd_line"]
    hist = line - f["macd_signal"]
    faster = ((line > 0) & (hist > lag(hist))) | ((line < 0) & (hist < lag(hist)))
    strong = np.abs(hist) > Rolling(np.abs(hist)).mean(50, 10) * 1.5
    words = np.array([f"{a}/{b}/{s}" for a in ("Negative", "Positive") for b in ("Decelerating", "Accelerating") for s in ("Weak", "Strong")], object)
    posture = words[4 * (line > 0) + 2 * faster + strong]
    posture[np.isnan(line)] = None
    return f | {"close": c, "volume": v, POSTURE: posture}


def kernel_features(panel: DataFrame, columns: Sequence[str], up: Sequence[str] = ("_w_rising", "_m_rising")) -> DataFrame:
    """A panel that is dealt by entity, with these columns of ``entity_features``; one entity is held at a time."""
    own = [f for f in panel.schema.fields if f.name not in columns and f.name not in up]
    types = [T.StructField(c, T.StringType() if c == POSTURE else T.DoubleType()) for c in columns]
    schema = T.StructType(own + types)
    kept = [f.name for f in own]

    def one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        number = lambda c: table.column(c).cast(pa.float64()).to_numpy()
        with np.errstate(invalid="ignore", divide="ignore"):
            made = entity_features(*(number(c) for c in ("high", "low", "close", "volume", "b1_close", "b2_close", *up)), columns)
        arrays = [table.column(c).chunk(0) for c in kept]
        for c in columns:
            arrays.append(pa.array(made[c], pa.string()) if c == POSTURE else pa.array(made[c], pa.float64(), mask=~np.isfinite(made[c])))
        return pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(batch.schema.get_field_index("entity"))
            code = names.dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                here = (names[a].as_py(),)
                if held and here != last:
                    yield one(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = here
        if held:
            yield one(held)

    ship_package(panel.sparkSession)
    return panel.sortWithinPartitions("entity", "t").mapInArrow(run, schema)
