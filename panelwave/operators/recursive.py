"""Recursive indicators: EMA, Wilder smoothing, ADX, RSI, MACD, supertrend, Hurst.

A ROWS frame cannot express a recursion, so these run in one Arrow stage. Every smoothing is an affine map of its last
value, y = a * y_before + b, and maps compose: a batch is scanned in doubling steps for all of its entities at once (a is
zero where an entity begins), so no row is visited by Python but by the supertrend's side. Rows arrive sorted by
(entity, t) and flow through in batches; only the open entity's state is kept, as named numbers, so a long history never
has to fit in one task's memory. The streaming version keeps the same state between micro-batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelwave.operators.orderwin import Window, order_statistics
from panelwave.operators.sizing import ship_package, spread

#: state of one entity: named numbers
State = dict[str, list[float]]
NAN = math.nan


def affine_scan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y[i] = a[i] * y[i - 1] + b[i] with y[-1] = 0, in doubling steps; |a| <= 1."""
    a, y, step = a.copy(), b.copy(), 1
    while step < len(y):
        # the composition of a row's last step maps with those of the row before them
        y[step:] += a[step:] * y[:-step]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return y


def smooth(x: np.ndarray, start: np.ndarray, alpha: float, need: int, state: State, name: str) -> np.ndarray:
    """Exponential average seeded with the first value; across nulls (NaN) the old weight keeps decaying.

    start marks first rows of entities; where the first row is none, the state continues. NaN before ``need`` values.
    """
    n = len(x)
    value, since, seen = state.get(name, (0.0, 0.0, 0.0)) if not start[0] else (0.0, 0.0, 0.0)
    place, known = np.arange(n), np.isfinite(x)
    first = np.maximum.accumulate(np.where(start, place, 0))
    count = np.cumsum(known)
    open_ = first == 0 if not start[0] else np.zeros(n, bool)  # rows of the entity that goes on
    number = count - np.where(first > 0, count[first - 1], 0) + np.where(open_, seen, 0.0)
    latest = np.maximum.accumulate(np.where(known, place, -1))
    before = np.concatenate([[-1], latest[:-1]])
    before = np.where(before < first, -1, before)
    # rows since the last value, and none if there is no value before
    gap = np.where(before >= 0, place - before, np.where(open_ & (seen > 0), place + 1 + since, 0.0))
    held = np.power(1.0 - alpha, gap)
    fresh = gap == 0
    a = np.where(known, np.where(fresh, 0.0, held / (held + alpha)), np.where(start, 0.0, 1.0))
    b = np.where(known, np.where(fresh, x, alpha * x / (held + alpha)), 0.0)
    b[0] += a[0] * value
    y = affine_scan(a, b)
    ago = n - 1 - latest[-1] if latest[-1] >= first[-1] else (n + since if open_[-1] else 0.0)
    state[name] = [float(y[-1]), float(ago), float(number[-1])]
    return np.where(number >= need, y, NAN)


def wilder(x: np.ndarray, start: np.ndarray, n: int, state: State, name: str) -> np.ndarray:
    """Wilder average: a simple-mean seed at the first full window (and after each null), then alpha = 1 / n."""
    run_before, *tail = state.get(f"{name}_run", [0.0, *[NAN] * (n - 1)]) if not start[0] else [0.0, *[NAN] * (n - 1)]
    place, known = np.arange(len(x)), np.isfinite(x)
    base = np.where(~known, place, np.where(start, place - 1, np.iinfo(np.int64).min))
    if known[0] and not start[0]:
        base[0] = -1 - int(run_before)
    run = place - np.maximum.accumulate(base)
    fed = np.where(run >= n, x, NAN)
    row = np.flatnonzero(run == n)
    wide = np.concatenate([tail, x])
    fed[row] = wide[row[:, None] + np.arange(n)].mean(axis=1)
    state[f"{name}_run"] = [float(run[-1]), *wide[len(wide) - (n - 1) :].tolist()]
    return smooth(fed, start, 1.0 / n, 1, state, name)


class Supertrend:
    """Band-following direction (+1 / -1) and rows since the last flip."""

    __slots__ = ("k", "up", "lo", "side", "days", "prev_close")

    def __init__(self, k: float = 3.0):
        self.k = k
        self.up = self.lo = self.side = self.days = self.prev_close = None

    def step(self, high, low, close, atr):
        prev, self.prev_close = self.prev_close, close
        if atr is None:
            self.up = self.lo = self.side = self.days = None
            return None, None
        raw_up = raw_lo = None
        if high is not None and low is not None:
            mid = (high + low) / 2.0
            raw_up, raw_lo = mid + self.k * atr, mid - self.k * atr
        if self.up is None:
            self.up, self.lo, self.side, self.days = raw_up, raw_lo, 1.0, 1.0
            return self.side, self.days
        if (raw_up is not None and raw_up < self.up) or (prev is not None and prev > self.up):
            new_up = raw_up
        else:
            new_up = self.up
        if self.lo is not None and (
            (raw_lo is not None and raw_lo > self.lo) or (prev is not None and prev < self.lo)
        ):
            new_lo = raw_lo
        else:
            new_lo = self.lo
        side = self.side
        if side == 1.0 and close is not None and new_lo is not None and close < new_lo:
            side = -1.0
        elif side == -1.0 and close is not None and new_up is not None and close > new_up:
            side = 1.0
        self.days = self.days + 1.0 if side == self.side else 1.0
        self.up, self.lo, self.side = new_up, new_lo, side
        return self.side, self.days


def follow_trend(high, low, close, atr, start: np.ndarray, state: State) -> tuple[np.ndarray, np.ndarray]:
    """Side and days of the supertrend: bands depend on comparisons with their own last value, so rows go one by one."""
    none = lambda v: None if v != v else v
    tool = Supertrend()
    if not start[0]:
        tool.up, tool.lo, tool.side, tool.days, tool.prev_close = (none(v) for v in state.get("trend", [NAN] * 5))
    columns = [[none(v) for v in c.tolist()] for c in (high, low, close, atr)]
    side, days = np.full(len(start), NAN), np.full(len(start), NAN)
    for i, (new, h, l, c, a) in enumerate(zip(start.tolist(), *columns)):
        if new:
            tool = Supertrend()
        s, d = tool.step(h, l, c, a)
        if s is not None:
            side[i], days[i] = s, d
    state["trend"] = [NAN if v is None else v for v in (tool.up, tool.lo, tool.side, tool.days, tool.prev_close)]
    return side, days


RECURSIVE_COLUMNS = (
    "ema_8", "ema_20", "ema_21", "ema_50", "macd_line", "macd_signal", "true_range", "atr_14", "atr_10",
    "plus_di", "minus_di", "adx_14", "rsi_14", "supertrend_direction", "supertrend_days_since_flip",
)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), NAN), where=b != 0)


def rsi(close: np.ndarray, before: np.ndarray, start: np.ndarray, state: State) -> np.ndarray:
    move = close - before
    rs = _ratio(wilder(np.maximum(move, 0.0), start, 14, state, "gain"), wilder(np.maximum(-move, 0.0), start, 14, state, "loss"))
    return 100.0 - 100.0 / (1.0 + rs)


def previous(x: np.ndarray, start: np.ndarray, last: float) -> np.ndarray:
    return np.where(start, NAN, np.concatenate([[last], x[:-1]]))


def indicators(high: np.ndarray, low: np.ndarray, close: np.ndarray, start: np.ndarray, state: State, trend: bool = True) -> dict[str, np.ndarray]:
    """RECURSIVE_COLUMNS of rows sorted by entity and time; state goes in where start[0] is False and out for the last entity.
    ``trend=False`` leaves the supertrend out, whose rows go one by one."""
    h0, l0, c0 = state.get("bar", [NAN] * 3)
    ph, pl, pc = previous(high, start, h0), previous(low, start, l0), previous(close, start, c0)
    out = {f"ema_{n}": smooth(close, start, 2.0 / (n + 1), n, state, f"ema_{n}") for n in (8, 20, 21, 50)}
    out["macd_line"] = smooth(close, start, 2.0 / 13, 12, state, "fast") - smooth(close, start, 2.0 / 27, 26, state, "slow")
    out["macd_signal"] = smooth(out["macd_line"], start, 2.0 / 10, 9, state, "signal")
    out["true_range"] = np.maximum(high - low, np.maximum(np.abs(high - pc), np.abs(low - pc)))
    out["atr_14"], out["atr_10"] = (wilder(out["true_range"], start, n, state, f"atr_{n}") for n in (14, 10))
    up, down = high - ph, pl - low  # comparisons with NaN are false: no move
    plus = wilder(np.where((up > down) & (up > 0), up, 0.0), start, 14, state, "plus")
    minus = wilder(np.where((down > up) & (down > 0), down, 0.0), start, 14, state, "minus")
    out["plus_di"], out["minus_di"] = 100.0 * _ratio(plus, out["atr_14"]), 100.0 * _ratio(minus, out["atr_14"])
    apart = _ratio(100.0 * np.abs(out["plus_di"] - out["minus_di"]), out["plus_di"] + out["minus_di"])
    out["adx_14"] = wilder(apart, start, 14, state, "adx")
    out["rsi_14"] = rsi(close, pc, start, state)
    if trend:
        out["supertrend_direction"], out["supertrend_days_since_flip"] = follow_trend(high, low, close, out["atr_10"], start, state)
    state["bar"] = [float(high[-1]), float(low[-1]), float(close[-1])]
    return out


def rolling_hurst(x: np.ndarray, n: int) -> np.ndarray:
    """Rescaled-range exponent of every full n-value window; NaN elsewhere."""
    out = np.full(len(x), np.nan)
    for lo in range(n - 1, len(x), 4096):
        hi = min(lo + 4096, len(x))
        win = np.lib.stride_tricks.sliding_window_view(x[lo - n + 1: hi], n)
        ok = ~np.isnan(win).any(axis=1)
        w = win[ok]
        if not len(w):
            continue
        cum = (w - w.mean(axis=1, keepdims=True)).cumsum(axis=1)
        rng, sd = cum.max(axis=1) - cum.min(axis=1), w.std(axis=1)
        good = (rng > 0) & (sd > 0)
        vals = np.full(len(w), np.nan)
        vals[good] = np.log(rng[good] / sd[good]) / math.log(n)
        part = np.full(len(win), np.nan)
        part[ok] = vals
        out[lo:hi] = part
    return out


ORDER_COLUMNS = ("p95_252", "p5_252", "pct_ma_50_p80_252d", "bb_width_pct_252d")
_DEEP = 252 + 50  # rows before a batch that its deepest window of windows reads


def _trailing(x: np.ndarray, first: np.ndarray, n: int, fn) -> np.ndarray:
    """fn over each full window of n rows inside an entity (NaN if one is null); equal windows give equal values."""
    out = np.full(len(x), NAN)
    if len(x) >= n:
        rows = np.flatnonzero(np.arange(len(x)) - first >= n - 1)
        for k in range(0, len(rows), 8192):
            part = rows[k : k + 8192]
            out[part] = fn(x[part[:, None] - np.arange(n - 1, -1, -1)])
    return out


def order_columns(close: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """252-row order statistics of returns, of the distance to the 50-row mean, and of the band width."""
    prev = previous(close, first == np.arange(len(close)), NAN)
    with np.errstate(divide="ignore", invalid="ignore"):
        ret = np.where(prev != 0, close / prev, NAN) - 1.0
        mean_50 = _trailing(close, first, 50, lambda w: w.mean(axis=1))
        mean_20 = _trailing(close, first, 20, lambda w: w.mean(axis=1))
        upper, lower = (mean_20 + f * _trailing(close, first, 20, lambda w: w.std(axis=1, ddof=1)) for f in (2.0, -2.0))
        far = (close - mean_50) / mean_50 * 100.0
        width = np.where(mean_20 != 0, (upper - lower) / mean_20, NAN)
    out = order_statistics(ret, first, {"p95_252": Window("quantile", 252, 200, 0.95), "p5_252": Window("quantile", 252, 200, 0.05)})
    out |= order_statistics(far, first, {"pct_ma_50_p80_252d": Window("quantile", 252, 252, 0.8)})
    rank = order_statistics(width, first, {"bb_width_pct_252d": Window("rank", 252, 60)})
    return out | {"bb_width_pct_252d": rank["bb_width_pct_252d"] * 100.0}


def hurst_column(close: np.ndarray, first: np.ndarray, rows: int) -> np.ndarray:
    prev = previous(close, first == np.arange(len(close)), NAN)
    with np.errstate(divide="ignore", invalid="ignore"):
        ret = np.log1p(close / prev - 1.0)
    ret[np.isinf(ret)] = NAN
    # windows that reach over an entity's first row hold its null return
    return rolling_hurst(ret, rows)


def recursive_indicators(panel: DataFrame, hurst_rows: int = 252) -> DataFrame:
    """Append RECURSIVE_COLUMNS, the Hurst exponent and ORDER_COLUMNS to a dense panel (entity, t, high, low, close, ...)."""
    added_names = (*RECURSIVE_COLUMNS, "hurst_exponent_252d", *ORDER_COLUMNS)
    schema = T.StructType(list(panel.schema.fields) + [T.StructField(c, T.DoubleType()) for c in added_names])
    keep = max(_DEEP, hurst_rows + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, tail = None, {}, np.empty(0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.column(batch.schema.get_field_index("entity"))
            code = names.dictionary_encode(null_encoding="encode").indices.to_numpy()
            high, low, close = (batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False)
                                for c in ("high", "low", "close"))
            start = np.concatenate([[last != (names[0].as_py(),)], code[1:] != code[:-1]])
            if start[0]:
                tail, state = np.empty(0), {}
            with np.errstate(invalid="ignore"):
                made = indicators(high, low, close, start, state)
            series, old = np.concatenate([tail, close]), len(tail)
            new = np.concatenate([np.zeros(old, bool), start])
            first = np.maximum.accumulate(np.where(new, np.arange(len(series)), 0))
            deep = {"hurst_exponent_252d": hurst_column(series, first, hurst_rows), **order_columns(series, first)}
            made |= {c: v[old:] for c, v in deep.items()}
            last, tail = (names[n - 1].as_py(),), series[max(int(first[-1]), len(series) - keep) :]
            arrays = [pa.array(made[c], mask=np.isnan(made[c])) for c in added_names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema.fieldNames())

    ship_package(panel.sparkSession)
    return spread(panel, "entity").sortWithinPartitions("entity", "t").mapInArrow(run, schema)


def period_indicators(bars: DataFrame, order: str = "label") -> DataFrame:
    """EMA 10 / 12 / 26 and RSI 14 on weekly (or any period) closes."""
    names = ("ema_10", "ema_12", "ema_26", "rsi_14")
    schema = T.StructType(list(bars.schema.fields) + [T.StructField(c, T.DoubleType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            entity = batch.column(batch.schema.get_field_index("entity"))
            code = entity.dictionary_encode(null_encoding="encode").indices.to_numpy()
            close = batch.column(batch.schema.get_field_index("close")).cast(pa.float64()).to_numpy(zero_copy_only=False)
            start = np.concatenate([[last != (entity[0].as_py(),)], code[1:] != code[:-1]])
            with np.errstate(invalid="ignore"):
                made = {f"ema_{k}": smooth(close, start, 2.0 / (k + 1), k, state, f"ema_{k}") for k in (10, 12, 26)}
                made["rsi_14"] = rsi(close, previous(close, start, state.get("bar", [NAN])[0]), start, state)
            last, state["bar"] = (entity[n - 1].as_py(),), [float(close[-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(made[c], mask=np.isnan(made[c])) for c in names]], schema.fieldNames())

    ship_package(bars.sparkSession)
    return spread(bars, "entity").sortWithinPartitions("entity", order).mapInArrow(run, schema)
