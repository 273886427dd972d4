"""Null-safe scalar column builders."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def div(x: Column, y: Column) -> Column:
    """x / y, NULL where y is 0 or either side is NULL."""
    return F.try_divide(x, y)


def flag(cond: Column) -> Column:
    """Condition as 0.0 / 1.0; an unknown condition counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def clip(x: Column, lo: float | Column | None = None, hi: float | Column | None = None) -> Column:
    """Clamp x; NULL stays NULL (``greatest`` / ``least`` alone would skip it)."""
    y = x
    if hi is not None:
        y = F.least(y, hi if isinstance(hi, Column) else F.lit(float(hi)))
    if lo is not None:
        y = F.greatest(y, lo if isinstance(lo, Column) else F.lit(float(lo)))
    return F.when(x.isNotNull(), y)


def weighted(terms: Sequence[tuple[float, Column]]) -> Column:
    """Sum of weight * column; any NULL input makes the result NULL."""
    out = None
    for w, c in terms:
        term = F.lit(float(w)) * c
        out = term if out is None else out + term
    return out


def logit01(x: Column, eps: float = 0.001) -> Column:
    p = clip(x, eps, 1.0 - eps)
    return F.ln(p / (F.lit(1.0) - p))


def logit_sym(x: Column, bound: float = 0.999) -> Column:
    p = (clip(x, -bound, bound) + 1.0) / 2.0
    return F.ln(p / (F.lit(1.0) - p))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def lookup(key: Column, mapping: Mapping, default=None) -> Column:
    """Dictionary lookup with a default, as a literal map (no join, no UDF)."""
    entries = [F.lit(v) for kv in mapping.items() for v in kv]
    hit = F.element_at(F.create_map(*entries), key)
    return hit if default is None else F.coalesce(hit, F.lit(default) if not isinstance(default, Column) else default)


def first_match(rules: Sequence[tuple[str, Column]], otherwise=None) -> Column:
    """Label of the first rule that holds."""
    out = None
    for name, cond in rules:
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def all_matches(rules: Sequence[tuple[str, Column]]) -> Column:
    """Every label whose rule holds, in priority order (first element = ``first_match``)."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())


# W. J. Cody's rational approximation of erf / erfc (1969), published coefficients.
_ERF_P = (3.20937758913846947e03, 3.77485237685302021e02, 1.13864154151050156e02,
          3.16112374387056560e00, 1.85777706184603153e-1)
_ERF_Q = (2.84423683343917062e03, 1.28261652607737228e03, 2.44024637934444173e02, 2.36012909523441209e01)
_ERFC_P = (1.23033935479799725e03, 2.05107837782607147e03, 1.71204761263407058e03, 8.81952221241769090e02,
           2.98635138197400131e02, 6.61191906371416295e01, 8.88314979438837594e00, 5.64188496988670089e-1,
           2.15311535474403846e-8)
_ERFC_Q = (1.23033935480374942e03, 3.43936767414372164e03, 4.36261909014324716e03, 3.29079923573345963e03,
           1.62138957456669019e03, 5.37181101862009858e02, 1.17693950891312499e02, 1.57449261107098347e01)
_TAIL_P = (6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1, 3.60344899949804439e-1,
           3.05326634961232344e-1, 1.63153871373020978e-2)
_TAIL_Q = (2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1, 1.87295284992346047e00,
           2.56852019228982242e00)
_INV_SQRT_PI = 0.56418958354775628695


def _poly_text(var: str, low_to_high: Sequence[float]) -> str:
    text = repr(float(low_to_high[-1])) + "D"
    for c in reversed(low_to_high[:-1]):
        text = f"({text} * {var} + {float(c)!r}D)"
    return text


def normal_cdf_sql(z: str, double_suffix: str = "D") -> str:
    """Phi(z) as SQL text; the same text serves Spark and a DuckDB check."""
    y = f"(abs({z}) / sqrt(2D))"
    y2 = f"({y} * {y})"
    small = f"({y} * {_poly_text(y2, _ERF_P)} / {_poly_text(y2, (*_ERF_Q, 1.0))})"
    mid = f"(exp(-{y2}) * {_poly_text(y, _ERFC_P)} / {_poly_text(y, (*_ERFC_Q, 1.0))})"
    inv = f"(1D / {y2})"
    far_r = f"({inv} * {_poly_text(inv, _TAIL_P)} / {_poly_text(inv, (*_TAIL_Q, 1.0))})"
    far = f"(exp(-{y2}) / {y} * ({_INV_SQRT_PI!r}D - {far_r}))"
    half_tail = (
        f"(CASE WHEN {y} <= 0.46875D THEN 0.5D - 0.5D * {small} "
        f"WHEN {y} <= 4D THEN 0.5D * {mid} ELSE 0.5D * {far} END)"
    )
    text = f"(CASE WHEN {z} IS NOT NULL THEN 0.5D + sign({z}) * (0.5D - {half_tail}) END)"
    return text if double_suffix == "D" else re_suffix(text)


def re_suffix(text: str) -> str:
    """Drop Spark's double suffix: 1.5D -> 1.5e0, which other engines read as DOUBLE."""
    import re

    return re.sub(r"(?<![\w.])(\d+(?:\.\d+)?(?:e[+-]?\d+)?)D\b",
                  lambda m: m.group(1) if "e" in m.group(1) else m.group(1) + "e0", text)


def normal_cdf_array(z: np.ndarray) -> np.ndarray:
    """``normal_cdf`` of an array; NaN stays NaN."""
    def poly(x: np.ndarray, low_to_high: Sequence[float]) -> np.ndarray:
        return np.polyval(low_to_high[::-1], x)

    y = np.abs(z) / math.sqrt(2.0)
    y2 = y * y
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        small = y * poly(y2, _ERF_P) / poly(y2, (*_ERF_Q, 1.0))
        mid = np.exp(-y2) * poly(y, _ERFC_P) / poly(y, (*_ERFC_Q, 1.0))
        inv = 1.0 / y2
        far = np.exp(-y2) / y * (_INV_SQRT_PI - inv * poly(inv, _TAIL_P) / poly(inv, (*_TAIL_Q, 1.0)))
        half_tail = np.where(y <= 0.46875, 0.5 - 0.5 * small, np.where(y <= 4.0, 0.5 * mid, 0.5 * far))
        return 0.5 + np.sign(z) * (0.5 - half_tail)


def normal_cdf(z: str) -> Column:
    """Standard normal CDF of a named column."""
    return F.expr(normal_cdf_sql(f"`{z}`"))
