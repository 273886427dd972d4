"""Rolling-window column builders over (entity, t).

All frames are ROWS frames on one window specification, so Spark plans them as a single
Window operator per layer: one exchange, one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from panelwave.functions.expr import div, flag


class TimeAxis:
    """Row-frame helpers for one partition/order choice."""

    def __init__(self, entity="entity", order: str = "t", index: str | None = None):
        keys = [entity] if isinstance(entity, str) else list(entity)
        self.spec = Window.partitionBy(*keys).orderBy(order)
        self.whole = self.spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        self.running = self.spec.rowsBetween(Window.unboundedPreceding, 0)
        self.before = self.spec.rowsBetween(Window.unboundedPreceding, -1)
        self.index = F.col(index or order).cast("double")

    def frame(self, a: int, b: int):
        return self.spec.rowsBetween(a, b)

    def roll(self, fn: Callable[..., Column], x: Column, n: int, m: int | None = None, shift: int = 0) -> Column:
        """fn over the last n rows, NULL unless at least m of them are non-null."""
        w = self.frame(-(n - 1) - shift, -shift)
        return F.when(F.count(x).over(w) >= F.lit(n if m is None else m), fn(x).over(w))

    def mean(self, x, n, m=None, shift=0):
        return self.roll(F.avg, x, n, m, shift)

    def std(self, x, n, m=None):
        return self.roll(F.stddev_samp, x, n, m)

    def sum(self, x, n, m=None):
        return self.roll(F.sum, x, n, m)

    def max(self, x, n, m=None, shift=0):
        return self.roll(F.max, x, n, m, shift)

    def min(self, x, n, m=None, shift=0):
        return self.roll(F.min, x, n, m, shift)

    def quantile(self, x, q, n, m=None):
        return self.roll(lambda c: F.percentile(c, F.lit(q)), x, n, m)

    def lag(self, x, k=1):
        return F.lag(x, k).over(self.spec)

    def lead(self, x, k=1):
        return F.lead(x, k).over(self.spec)

    def change(self, x, k):
        """x / x[-k] - 1."""
        return div(x, self.lag(x, k)) - 1.0

    def slope(self, y, n):
        w = self.frame(-(n - 1), 0)
        return F.when(F.count(y).over(w) == n, F.regr_slope(y, self.index).over(w))

    def ols(self, y: Column, n: int) -> dict[str, Column]:
        """Moments of the full-window regression of y on the row index."""
        w = self.frame(-(n - 1), 0)
        x = self.index
        full = F.count(y).over(w) == n
        return {
            "slope": F.when(full, F.regr_slope(y, x).over(w)),
            "syy": F.when(full, F.regr_syy(y, x).over(w)),
            "sxy": F.when(full, F.regr_sxy(y, x).over(w)),
            "ybar": F.when(full, F.avg(y).over(w)),
        }

    def r2(self, y, n):
        w = self.frame(-(n - 1), 0)
        x = self.index
        full = (F.count(y).over(w) == n) & (F.regr_syy(y, x).over(w) > 0)
        return F.when(full, F.regr_r2(y, x).over(w))

    def pair_corr(self, x, y, n, m):
        """Correlation over rows where both sides are present."""
        w = self.frame(-(n - 1), 0)
        both = x.isNotNull() & y.isNotNull()
        xx, yy = F.when(both, x), F.when(both, y)
        cov = F.covar_pop(xx, yy).over(w)
        sd = F.stddev_pop(xx).over(w) * F.stddev_pop(yy).over(w)
        return F.when(F.count(xx).over(w) >= m, div(cov, sd))

    def rank_in_window(self, x, n, m):
        """Average-tie percentile rank of the current value among the last n rows."""
        w = self.frame(-(n - 1), 0)
        vals = F.collect_list(x).over(w)
        twice = F.aggregate(
            vals, F.lit(0),
            lambda acc, v: acc + F.when(v < x, 2).when(v == x, 1).otherwise(0),
        )
        return F.when(x.isNotNull() & (F.count(x).over(w) >= m), (twice + 1) / F.lit(2.0) / F.size(vals))

    def share_le(self, x, n, m):
        """Share of the last n non-null values that are <= the current one."""
        w = self.frame(-(n - 1), 0)
        vals = F.collect_list(x).over(w)
        return F.when(x.isNotNull() & (F.count(x).over(w) >= m),
                      F.size(F.filter(vals, lambda v: v <= x)) / F.size(vals))

    def new_high(self, x, n):
        """0/1: x at or above the maximum of the previous n-1 rows."""
        return flag(x >= self.max(x, n - 1, shift=1))


def ols_r2(o: dict[str, Column]) -> Column:
    return F.when(o["syy"] > 0, F.lit(1.0) - (o["syy"] - o["slope"] * o["sxy"]) / o["syy"])


def ols_tstat(o: dict[str, Column], n: int) -> Column:
    sxx = n * (n * n - 1) / 12.0
    ss = F.greatest(o["syy"] - o["slope"] * o["sxy"], F.lit(0.0))
    return div(o["slope"], F.sqrt(ss / (n - 2) / sxx))


def ols_last_residual_z(o: dict[str, Column], y: Column, n: int) -> Column:
    ss = F.greatest(o["syy"] - o["slope"] * o["sxy"], F.lit(0.0))
    fitted = o["ybar"] + o["slope"] * ((n - 1) / 2.0)
    return div(y - fitted, F.sqrt(ss / (n - 2)))
