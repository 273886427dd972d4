"""Per-date, per-family standardisation of the feature panel."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwave import config
from panelwave.functions.expr import clip, div, logit01, logit_sym, signed_log
from panelwave.operators import xsection as xs

MIN_POPULATION = 5
LIMIT = 10.0


def family(name: str) -> str:
    for label, names in (
        ("categorical", config.CATEGORICAL), ("binary", config.BINARY), ("percentile", config.PERCENTILE),
        ("bounded", config.BOUNDED), ("logit", config.LOGIT), ("correlation", config.CORRELATION),
        ("log", config.SIGNED_LOG),
    ):
        if name in names:
            return label
    return "robust"


def _transformed(name: str, fam: str) -> Column:
    x = F.col(name)
    return {"logit": logit01, "correlation": logit_sym, "log": signed_log}.get(fam, lambda c: c)(x)


def matrix_z(x: np.ndarray, kinds: Sequence[str], share: Sequence[bool]) -> np.ndarray:
    """The z-scores of one date: columns by their family, NULL (NaN) where fewer than MIN_POPULATION have a value."""
    out = x.copy()
    kind = np.array(kinds)

    def put(label: str, fn) -> None:
        at = np.flatnonzero(kind == label)
        if len(at):
            out[:, at] = fn(x[:, at])

    def logit(p: np.ndarray) -> np.ndarray:
        return np.log(p / (1.0 - p))

    def standard(t: np.ndarray, middle: float | None) -> np.ndarray:
        _, mean, sd = xs.matrix_moments(t)
        return np.where(sd < 1e-10, 0.0, (t - (mean if middle is None else middle)) / sd)

    put("robust", xs.matrix_robust_z)
    put("logit", lambda t: xs.matrix_robust_z(logit(np.clip(t, 0.001, 0.999))))
    put("correlation", lambda t: xs.matrix_robust_z(logit((np.clip(t, -0.999, 0.999) + 1.0) / 2.0)))
    put("bounded", lambda t: standard(t, 50.0))
    put("log", lambda t: standard(np.sign(t) * np.log1p(np.abs(t)), None))
    put("percentile", lambda t: (t - 50.0) / 28.87)
    part = np.flatnonzero(share)
    out[:, part] = (0.5 - x[:, part]) / 0.2887
    few = (~np.isnan(x)).sum(axis=0) < MIN_POPULATION
    out[:, few] = np.nan
    return np.clip(out, -LIMIT, LIMIT)


def standardize(features: DataFrame, names: Sequence[str] | None = None, bound: xs.Bound = xs.Bound(),
                by: str = "date", dealt: bool = False) -> DataFrame:
    """Append ``z_<feature>`` for every numeric feature. ``dealt``: rows are partitioned by their date already.

    Where a date's names are proven to fit a task, they are one matrix there. Otherwise two wide aggregates per date serve
    all features: one for medians, moments and counts, one for the MADs. Both are exact.
    """
    names = [n for n in (names or config.FEATURES) if family(n) != "categorical"]
    fam = {n: family(n) for n in names}
    if xs._fits(bound, len(names)):
        kinds = [fam[n] for n in names]
        share = [n == "within_basket_rank_pct" for n in names]
        return xs.matrix_columns(features, [by], names, [f"z_{n}" for n in names], lambda x: matrix_z(x, kinds, share), dealt)
    robust = [n for n in names if fam[n] in ("robust", "logit", "correlation")]
    standard = [n for n in names if fam[n] in ("bounded", "log")]
    df = features.withColumns({f"_x_{n}": _transformed(n, fam[n]) for n in robust + standard})

    moments = [F.count(n).alias(f"_n_{n}") for n in names]
    moments += [F.stddev_pop(f"_x_{n}").alias(f"_s_{n}") for n in robust + standard]
    moments += [F.avg(f"_x_{n}").alias(f"_m_{n}") for n in standard if fam[n] == "log"]
    stats = df.groupBy(by).agg(*moments)
    med = xs.group_quantiles(df, [by], {f"_med_{n}": (f"_x_{n}", 0.5) for n in robust}, bound)
    df = xs.attach(df, stats.join(med, [by], "left"), [by], bound)
    dev = df.select(by, *[F.abs(F.col(f"_x_{n}") - F.col(f"_med_{n}")).alias(f"_d_{n}") for n in robust])
    mad = xs.group_quantiles(dev, [by], {f"_mad_{n}": (f"_d_{n}", 0.5) for n in robust}, bound)
    df = xs.attach(df, mad, [by], bound)

    def z(n: str) -> Column:
        x, f = F.col(n), fam[n]
        if f == "binary":
            return x
        if f == "percentile":
            return (F.lit(0.5) - x) / 0.2887 if n == "within_basket_rank_pct" else (x - 50.0) / 28.87
        t, s = F.col(f"_x_{n}"), F.col(f"_s_{n}")
        if f in ("bounded", "log"):
            mid = F.lit(50.0) if f == "bounded" else F.col(f"_m_{n}")
            return F.when(s < 1e-10, F.lit(0.0)).otherwise(div(t - mid, s))
        tight, num = F.col(f"_mad_{n}") < 1e-8, t - F.col(f"_med_{n}")
        return F.when(tight & (s < 1e-8), F.lit(0.0)).when(tight, div(num, s)).otherwise(
            div(num, F.lit(1.4826) * F.col(f"_mad_{n}")))

    zs = [F.when(F.col(f"_n_{n}") >= MIN_POPULATION, clip(z(n), -LIMIT, LIMIT)).alias(f"z_{n}") for n in names]
    return df.select(*features.columns, *zs)
