"""Six-state probabilistic regime: log-likelihoods, softmax, confidence blend."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwave import config


def gaussian(x: Column, mean: float, width: float) -> Column:
    z = (x - mean) / max(width, 1e-6)
    return z * z * -0.5


def indicator(cond: Column, p: float) -> Column:
    """Log-probability of a yes/no signal; unknown counts as a miss."""
    return F.when(cond, F.lit(math.log(p))).otherwise(F.lit(math.log(1.0 - p)))


def inputs() -> set[str]:
    """Features that the states read."""
    return {f for bells, signals in config.STATE_MODEL.values() for f in (*(b[0] for b in bells), *(s[0].split()[0] for s in signals))}


def log_likelihoods() -> dict[str, Column]:
    out = {}
    for state, (bells, signals) in config.STATE_MODEL.items():
        terms = [gaussian(F.col(f), m, s) for f, m, s in bells] + [indicator(F.expr(c), p) for c, p in signals]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        out[state] = total
    out["INDETERMINATE"] = F.lit(config.INDETERMINATE_LL)
    return out


HOLDS = {">=": np.greater_equal, ">": np.greater, "=": np.equal}


def matrix_state(raw: Callable[[str], np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Place of the primary state and the adjusted probabilities of each row, as ``state`` makes them, from arrays by name."""
    lls = []
    for bells, signals in config.STATE_MODEL.values():
        total = sum(-0.5 * ((raw(f) - m) / max(s, 1e-6)) ** 2 for f, m, s in bells)
        for text, p in signals:
            name, holds, number = text.split()
            total = total + np.where(HOLDS[holds](raw(name), float(number)), math.log(p), math.log(1.0 - p))
        lls.append(total)
    lls.append(np.full(len(lls[0]), config.INDETERMINATE_LL))
    e = np.nan_to_num(np.exp(np.stack(lls) - np.fmax.reduce(lls)))
    p = e / sum(e)
    top = p.max(axis=0)
    adjusted = []
    for s, x in zip(config.STATES, p, strict=True):
        add = float(s == "INDETERMINATE")
        adjusted.append(np.where(top >= 0.7, x, np.where(top >= 0.5, x * 0.7 + 0.3 * add, x * 0.5 + 0.5 * add)))
    return p.argmax(axis=0), adjusted


def softmax(df: DataFrame, inputs: list[str], outputs: list[str]) -> DataFrame:
    """Row softmax; a NULL input gets probability 0."""
    top = F.greatest(*[F.col(c) for c in inputs])
    df = df.withColumns({f"_e{i}": F.coalesce(F.exp(F.col(c) - top), F.lit(0.0)) for i, c in enumerate(inputs)})
    total = sum((F.col(f"_e{i}") for i in range(1, len(inputs))), F.col("_e0"))
    df = df.withColumns({o: F.col(f"_e{i}") / total for i, o in enumerate(outputs)})
    return df.drop(*[f"_e{i}" for i in range(len(inputs))])


def blend(p: str, confidence: Column, is_fallback: bool) -> Column:
    add = 1.0 if is_fallback else 0.0
    x = F.col(p)
    return (F.when(confidence >= 0.7, x)
            .when(confidence >= 0.5, x * 0.7 + 0.3 * add)
            .otherwise(x * 0.5 + 0.5 * add))


def state(df: DataFrame) -> DataFrame:
    """Append primary_state, state_confidence, p_<state> and p_adj_<state>."""
    lls = {f"_ll_{s}": c for s, c in log_likelihoods().items()}
    probs = [f"p_{s}" for s in config.STATES]
    out = softmax(df.withColumns(lls), list(lls), probs).drop(*lls)
    arr = F.array(*probs)
    out = out.withColumn("state_confidence", F.array_max(arr))
    names = F.array(*[F.lit(s) for s in config.STATES])
    out = out.withColumn(
        "primary_state", F.element_at(names, F.array_position(arr, F.col("state_confidence")).cast("int")))
    return out.withColumns({
        f"p_adj_{s}": blend(f"p_{s}", F.col("state_confidence"), s == "INDETERMINATE") for s in config.STATES
    })
