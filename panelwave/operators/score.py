"""State-weighted composite, 0-100 score and per-date quantile grades."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwave import config
from panelwave.functions.expr import div, normal_cdf, normal_cdf_array, weighted
from panelwave.operators import xsection as xs


def state_weights(raw: Mapping[str, Sequence[float]] = config.STATE_WEIGHTS) -> dict[str, tuple[float, ...]]:
    """Weight rows rescaled to sum to one."""
    return {s: tuple(w / sum(ws) for w in ws) for s, ws in raw.items()}


def _total(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def composite(df: DataFrame, weights: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """Append composite_z, weight_present and n_valid_components.

    A row's weight for a component is the probability-weighted state weight; weights are rescaled over the
    components present, and rows with too little weight or too few components give NULL.
    """
    weights = weights or state_weights()
    eff = {}
    for i, c in enumerate(config.COMPONENTS):
        eff[f"_w_{c}"] = weighted([(weights[s][i], F.coalesce(F.col(f"p_adj_{s}"), F.lit(0.0))) for s in config.STATES])
    df = df.withColumns(eff)
    here = {c: F.col(c).isNotNull() for c in config.COMPONENTS}
    df = df.withColumns({
        "weight_present": _total([F.when(here[c], F.col(f"_w_{c}")).otherwise(0.0) for c in config.COMPONENTS]),
        "n_valid_components": _total([here[c].cast("long") for c in config.COMPONENTS]),
        "_num": _total([F.when(here[c], F.col(c) * F.col(f"_w_{c}")).otherwise(0.0) for c in config.COMPONENTS]),
    })
    enough = (F.col("weight_present") >= config.MIN_WEIGHT) & (F.col("n_valid_components") >= config.MIN_COMPONENTS)
    return df.withColumn("composite_z", F.when(enough, div(F.col("_num"), F.col("weight_present")))).drop("_num", *eff)


def single_state_composite(df: DataFrame, state: str, out: str) -> DataFrame:
    """Composite under one state's weights only."""
    w = state_weights()[state]
    return df.withColumn(out, weighted([(w[i], F.col(c)) for i, c in enumerate(config.COMPONENTS)]))


def grade_from_quantiles(score: Column) -> Column:
    out = None
    for name, q in config.GRADES:
        hit = score >= F.col(f"_q{int(q * 100)}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(score.isNotNull(), out.otherwise("D"))


def grades(df: DataFrame, by: Sequence[str] = ("date",), score: str = "score", out: str = "grade",
           bound: xs.Bound = xs.Bound()) -> DataFrame:
    wanted = {f"_q{int(q * 100)}": (score, q) for _, q in config.GRADES}
    joined = xs.attach(df, xs.group_quantiles(df, by, wanted, bound), by, bound)
    return joined.withColumn(out, grade_from_quantiles(F.col(score))).drop(*wanted)


def matrix_score(x: np.ndarray) -> np.ndarray:
    """Score and place of the grade of one date's composites, as ``score`` makes them; values are measured from one of them."""
    out = np.full((len(x), 2), np.nan)
    rows = np.flatnonzero(~np.isnan(x[:, 0]))
    n = len(rows)
    if n < 2:  # no sample deviation
        return out
    d = x[rows, 0] - x[rows[0], 0]
    d = d - d.mean()
    sd = np.sqrt((d * d).sum() / (n - 1))
    raw = normal_cdf_array(d / (sd if sd else 1.0)) * 100.0

    def at(ordered: np.ndarray, q: float) -> float:
        k = (n - 1) * q
        lo, up = ordered[int(np.floor(k))], ordered[int(np.ceil(k))]
        return lo + (up - lo) * (k - np.floor(k))

    ordered = np.sort(raw)
    value = np.maximum(at(ordered, 0.01), np.minimum(at(ordered, 0.99), raw))
    ordered = np.sort(value)
    place = np.full(n, float(len(config.GRADES)))
    for i, (_, q) in reversed(list(enumerate(config.GRADES))):
        place[value >= at(ordered, q)] = i
    out[rows, 0], out[rows, 1] = value, place
    return out


def matrix_composite(parts: np.ndarray, adjusted: Sequence[np.ndarray]) -> np.ndarray:
    """composite_z of one date's components (rows x components) and adjusted state probabilities, as ``composite`` makes it."""
    weights = state_weights()
    eff = np.stack([sum(weights[s][i] * p for s, p in zip(config.STATES, adjusted, strict=True)) for i in range(parts.shape[1])], axis=1)
    here = ~np.isnan(parts)
    present = np.where(here, eff, 0.0).sum(axis=1)
    enough = (present >= config.MIN_WEIGHT) & (here.sum(axis=1) >= config.MIN_COMPONENTS)
    total = np.where(here, parts * eff, 0.0).sum(axis=1)
    return np.divide(total, present, out=np.full(len(parts), np.nan), where=enough & (present != 0))


def graded(x: DataFrame) -> DataFrame:
    """The grade's name for its place (``_place``)."""
    grade = F.lit("D")
    for i, (name, _) in reversed(list(enumerate(config.GRADES))):
        grade = F.when(F.col("_place") == i, name).otherwise(grade)
    return x.withColumn("grade", F.when(F.col("score").isNotNull(), grade)).drop("_place")


def score(df: DataFrame, bound: xs.Bound = xs.Bound()) -> DataFrame:
    """Append score_z, score_raw, score, grade and the partial-history disclosure columns."""
    df = xs.standard_z(composite(df), ["date"], {"score_z": "composite_z"}, sample=True, constant=None, bound=bound)
    df = df.withColumn("score_raw", normal_cdf("score_z") * 100.0)
    df = xs.winsorize(df, ["date"], {"score": "score_raw"}, bound=bound)
    df = grades(df, bound=bound)
    return df.withColumn("is_partial", (F.col("weight_present") < 1.0 - 1e-9) & F.col("score").isNotNull()).drop("composite_z")
