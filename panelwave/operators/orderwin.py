"""Order statistics over the last n rows of an entity: quantile, rank and share, in log work a row.

A batch's values become dense ranks in a wavelet matrix: one bit plane for each bit of the rank, each plane stably
partitioned. The k-th smallest value of any range of rows, and the number of smaller ones, follow from one descent
through the planes, for all rows of a batch at once. Work a row grows with the logarithm of the batch, not with the
window. Batches are streamed; only the last n - 1 values of the open entity are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelwave.operators.sizing import ship_package, spread


class Wavelet:
    """Planes of dense ranks of a sequence of numbers."""

    def __init__(self, values: np.ndarray):
        self.levels, code = np.unique(values, return_inverse=True)
        self.planes: list[tuple[int, np.ndarray, int]] = []  # (bit, ones before each place, zeros)
        for bit in range(max(len(self.levels) - 1, 0).bit_length() - 1, -1, -1):
            one = (code >> bit & 1).astype(bool)
            ones = np.concatenate([[0], np.cumsum(one)])
            self.planes.append((bit, ones, len(code) - int(ones[-1])))
            code = np.concatenate([code[~one], code[one]])

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """k-th smallest (from 0) of values[lo:hi]; k must be inside."""
        lo, hi, k, code = lo.copy(), hi.copy(), k.copy(), np.zeros(len(lo), np.int64)
        for bit, ones, zeros in self.planes:
            a, b = ones[lo], ones[hi]
            low = (hi - lo) - (b - a)
            up = k >= low
            k -= np.where(up, low, 0)
            code |= up.astype(np.int64) << bit
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return self.levels[code] if len(self.levels) else np.full(len(lo), np.nan)

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, equal: bool = False) -> np.ndarray:
        """How many of values[lo:hi] are smaller than x (or equal, too)."""
        code = np.searchsorted(self.levels, x, side="right" if equal else "left")
        every = code >= len(self.levels)
        code = np.minimum(code, max(len(self.levels) - 1, 0))
        lo, hi, size, found = lo.copy(), hi.copy(), hi - lo, np.zeros(len(lo), np.int64)
        for bit, ones, zeros in self.planes:
            a, b = ones[lo], ones[hi]
            up = (code >> bit & 1).astype(bool)
            found += np.where(up, (hi - lo) - (b - a), 0)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return np.where(every, size, found)


@dataclass(frozen=True)
class Window:
    """One order statistic of a column's last n rows; null with fewer than need values. kind: quantile, rank, share_le."""

    kind: str
    n: int
    need: int
    q: float = 0.0


def order_statistics(x: np.ndarray, first: np.ndarray, windows: Mapping[str, Window]) -> dict[str, np.ndarray]:
    """Values of each window at every row; first[i] is the row at which i's entity begins. NaN counts as null.

    quantile interpolates linearly; rank is the average-tie rank of the row's own value over the number of values;
    share_le is the share of values at or below it. A row without a value has neither of the last two.
    """
    known = ~np.isnan(x)
    upto = np.concatenate([[0], np.cumsum(known)])
    wave = Wavelet(x[known])
    place = np.arange(len(x))
    out = {}
    for name, w in windows.items():
        lo, hi = upto[np.maximum(place - (w.n - 1), first)], upto[place + 1]
        size = hi - lo
        rows = np.flatnonzero((size >= max(w.need, 1)) & (known if w.kind != "quantile" else True))
        lo, hi, m = lo[rows], hi[rows], size[rows]
        if w.kind == "quantile":
            at = (m - 1) * w.q
            low, up = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
            a = wave.kth(lo, hi, low)
            b = np.where(up > low, wave.kth(lo, hi, np.minimum(up, m - 1)), a)
            value = np.where(up > low, (up - at) * a + (at - low) * b, a)
        elif w.kind == "rank":
            value = (wave.below(lo, hi, x[rows]) + wave.below(lo, hi, x[rows], equal=True) + 1) / 2.0 / m
        else:
            value = wave.below(lo, hi, x[rows], equal=True) / m
        out[name] = np.full(len(x), math.nan)
        out[name][rows] = value
    return out


def order_windows(panel: DataFrame, column: str, windows: Mapping[str, Window], entity: str = "entity", order: str = "t") -> DataFrame:
    """The panel with one column for each window over ``column``: one exchange on entity, batches streamed.

    Nulls (and NaN) in the column are no values; rows of a null entity form one entity.
    """
    schema = T.StructType(list(panel.schema.fields) + [T.StructField(c, T.DoubleType()) for c in windows])
    keep = max(w.n for w in windows.values()) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, last = np.empty(0), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.column(batch.schema.get_field_index(entity))
            code = names.dictionary_encode(null_encoding="encode").indices.to_numpy()
            x = batch.column(batch.schema.get_field_index(column)).cast(pa.float64()).to_numpy(zero_copy_only=False)
            here = (names[0].as_py(),)
            if last != here:
                tail = np.empty(0)
            old = len(tail)
            x = np.concatenate([tail, x])
            new = np.concatenate([np.zeros(old, bool), [old == 0], code[1:] != code[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
            made = order_statistics(x, first, windows)
            last, tail = (names[n - 1].as_py(),), x[max(first[-1], len(x) - keep) :] if keep else np.empty(0)
            added = [pa.array(made[c][old:], mask=np.isnan(made[c][old:])) for c in windows]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema.fieldNames())

    ship_package(panel.sparkSession)
    return spread(panel, entity).sortWithinPartitions(entity, order).mapInArrow(run, schema)
