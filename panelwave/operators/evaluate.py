"""Predictive-power evaluation: forward returns, rank IC, walk-forward windows, audits, ridge weights."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwave import config
from panelwave.functions.expr import div, flag
from panelwave.functions.rolling import TimeAxis
from panelwave.operators import xsection as xs
from panelwave.operators.score import state_weights
from panelwave.operators.sizing import ship_package

col = F.col
MIN_NAMES = 20
TIE_DIGITS = 9
#: digits of a mean of ICs that rounding leaves alone
MEAN_DIGITS = 12


def forward_returns(bars: DataFrame, horizons: Sequence[int] = config.HORIZONS, long: bool = True) -> DataFrame:
    """Return over the entity's next h own rows: (entity, date, horizon, fwd) or one column per horizon."""
    w = TimeAxis("entity", "date")
    a = col("adj_close")
    cols = {h: div(w.lead(a, h), a) - 1.0 for h in horizons}
    wide = bars.select("entity", "date", *[c.alias(f"fwd_{h}") for h, c in cols.items()])
    if not long:
        return wide
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), col(f"fwd_{h}").alias("fwd")) for h in horizons])
    return wide.select("entity", "date", F.explode(pairs).alias("r")).select("entity", "date", "r.*")


def unpivot_scores(df: DataFrame, scores: Mapping[str, Sequence[str]]) -> DataFrame:
    """(entity, date, score_type, score_name, value); ``scores`` maps a type to its columns."""
    items = [F.struct(F.lit(t).alias("score_type"), F.lit(c).alias("score_name"), col(c).cast("double").alias("value"))
             for t, names in scores.items() for c in names]
    return df.select("entity", "date", F.explode(F.array(*items)).alias("s")).select("entity", "date", "s.*")


def rank_ic(scores: DataFrame, fwd: DataFrame, keys: Sequence[str] = ("score_name",), min_names: int = MIN_NAMES,
            bound: xs.Bound = xs.Bound()) -> DataFrame:
    """Per-date Spearman correlation of score and forward return over complete pairs.

    All scores and horizons go through one job: the ranks are taken inside (date, horizon, keys).
    NULL for fewer than ``min_names`` pairs or a constant side.
    """
    pairs = scores.where(col("value").isNotNull()).join(fwd.where(col("fwd").isNotNull()), ["entity", "date"])
    return _rank_ic(pairs, keys, min_names, bound)


def rank_ic_wide(df: DataFrame, scores: Mapping[str, Sequence[str]], bars: DataFrame, horizons: Sequence[int],
                 min_names: int = MIN_NAMES, bound: xs.Bound = xs.Bound()) -> DataFrame:
    """rank_ic of every (score, horizon) by (score_type, score_name): wide rows are joined once.

    Where the number of names of a date is proven, each date is one rank matrix (``rank_ic_matrix``); otherwise the rows
    are unpivoted and ranked by the plan for groups of any size. Both are exact and give the same rows.
    """
    fwd = forward_returns(bars, horizons, long=False)
    names = [c for group in scores.values() for c in group]
    # blends that agree but for the last bits of a double are ties
    wide = df.select("entity", "date", *[F.round(col(c).cast("double"), TIE_DIGITS).alias(c) for c in names]).join(fwd, ["entity", "date"])
    width = MATRIX_CELLS // bound.rows - len(horizons) if bound.rows else 0  # scores beside one another in a task
    if width > 0:
        return rank_ic_matrix(wide, scores, horizons, min_names, width)
    items = [F.struct(F.lit(t).alias("score_type"), F.lit(c).alias("score_name"), col(c).alias("value"))
             for t, group in scores.items() for c in group]
    ahead = [F.struct(F.lit(h).alias("horizon"), col(f"fwd_{h}").alias("fwd")) for h in horizons]
    pairs = wide.select("entity", "date", F.explode(F.array(*items)).alias("s"), F.array(*ahead).alias("f"))
    pairs = pairs.where(col("s.value").isNotNull()).select("entity", "date", "s.*", F.explode("f").alias("f"))
    pairs = pairs.where(col("f.fwd").isNotNull()).select("entity", "date", "score_type", "score_name", "value", "f.*")
    return _rank_ic(pairs, ("score_type", "score_name"), min_names, bound)


#: doubles of one date's block of the names x scores matrix
MATRIX_CELLS = 1 << 23


def matrix_ic(x: np.ndarray, y: np.ndarray, min_names: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, Spearman correlation) of every column of x with every column of y over complete rows.

    Columns of x with one null pattern are ranked together, the y column once for each pattern, and their correlations
    are one matrix product. NaN for too few pairs or a constant side.
    """
    have_x, have_y = ~np.isnan(x), ~np.isnan(y)
    n = have_x.T.astype(np.int64) @ have_y.astype(np.int64)
    ic = np.full(n.shape, np.nan)
    _, pattern = np.unique(have_x, axis=1, return_inverse=True)
    pattern = pattern.ravel()
    for h in range(y.shape[1]):
        for p in np.unique(pattern[n[:, h] >= min_names]):
            columns = np.flatnonzero(pattern == p)
            rows = have_x[:, columns[0]] & have_y[:, h]
            a, b = xs.average_ranks(x[rows][:, columns]), xs.average_ranks(y[rows, h : h + 1])
            k = len(a)
            a, b = (a - a.mean(axis=0)) / k, (b - b.mean(axis=0)) / k
            cov, sd = (b.T @ a)[0] / k, a.std(axis=0) * b.std(axis=0)
            known = sd > 1e-12
            ic[columns[known], h] = cov[known] / sd[known]
    return n, ic


def rank_ic_matrix(wide: DataFrame, scores: Mapping[str, Sequence[str]], horizons: Sequence[int], min_names: int = MIN_NAMES,
                   width: int = 256) -> DataFrame:
    """(date, horizon, score_type, score_name, n, ic) from rows (entity, date, scores..., fwd_<h>...): one exchange on date.

    At most ``width`` scores of a date meet in one task: wider sets are cut into blocks of columns, each with the returns.
    """
    labels = [(t, c) for t, group in scores.items() for c in group]
    ahead = [f"fwd_{h}" for h in horizons]
    blocks = [labels[i : i + width] for i in range(0, len(labels), width)]
    parts = F.array(*[F.struct(F.lit(i).alias("block"), F.array(*[col(c) for _, c in part]).alias("x")) for i, part in enumerate(blocks)])
    rows = wide.select("date", F.array(*ahead).alias("y"), F.explode(parts).alias("b")).select("date", "y", "b.*")
    out = T.StructType([
        wide.schema["date"], T.StructField("horizon", T.IntegerType()), T.StructField("score_type", T.StringType()),
        T.StructField("score_name", T.StringType()), T.StructField("n", T.LongType()), T.StructField("ic", T.DoubleType())])
    steps = np.array(horizons, np.int32)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        mine = blocks[group.column("block")[0].as_py()]

        def matrix(name: str, columns: int) -> np.ndarray:
            flat = pa.concat_arrays([c.flatten() for c in group.column(name).chunks])
            return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, columns)

        n, ic = matrix_ic(matrix("x", len(mine)), matrix("y", len(steps)), min_names)
        some, h = np.nonzero(n)
        kinds, names = (pa.array([label[k] for label in mine], pa.string()).take(pa.array(some)) for k in (0, 1))
        value = ic[some, h]
        date = pa.chunked_array([group.column("date").chunk(0)[:1]]).combine_chunks().take(pa.array(np.zeros(len(some), np.int64)))
        return pa.table([date, pa.array(steps[h]), kinds, names, pa.array(n[some, h]), pa.array(value, mask=np.isnan(value))],
                        names=out.fieldNames())

    ship_package(wide.sparkSession)
    return rows.groupBy("date", "block").applyInArrow(run, out)


def _rank_ic(pairs: DataFrame, keys: Sequence[str], min_names: int, bound: xs.Bound) -> DataFrame:
    by = ["date", "horizon", *keys]
    ranked = xs.pct_rank(pairs, by, {"_a": "value", "_b": "fwd"}, bound)
    out = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.covar_pop("_a", "_b").alias("_c"),
        (F.stddev_pop("_a") * F.stddev_pop("_b")).alias("_d"))
    ic = F.when((col("n") >= min_names) & (col("_d") > 1e-12), div(col("_c"), col("_d")))
    return out.select(*by, "n", ic.alias("ic"))


def t_stat(mean: Column, sd: Column, n: Column) -> Column:
    return F.when((n > 1) & (sd > 0), mean / (sd / F.sqrt(n)))


def positive(name: str) -> Column:
    """Above zero by more than the rounding of a mean of doubles."""
    return F.round(col(name), MEAN_DIGITS) > 0


def ic_summary(ic: DataFrame, by: Sequence[str] = ("score_name", "horizon")) -> DataFrame:
    """Mean, median, std, t, number of dates and hit rate of an IC series."""
    g = ic.where(col("ic").isNotNull()).groupBy(*by).agg(
        F.avg("ic").alias("ic_mean"), F.median("ic").alias("ic_median"), F.stddev_samp("ic").alias("ic_std"),
        F.count("*").alias("n_dates"), F.avg(flag(positive("ic"))).alias("hit_rate"))
    every = ic.select(*by).distinct()
    g = every.join(g, list(by), "left").withColumn("n_dates", F.coalesce("n_dates", F.lit(0)))
    return g.withColumn("ic_t_stat", t_stat(col("ic_mean"), col("ic_std"), col("n_dates")))


def rolling_ic(ic: DataFrame, rows: int = 60, by: Sequence[str] = ("score_name", "horizon")) -> DataFrame:
    """Rolling mean over the valid dates of each IC series (one row per date and series)."""
    w = TimeAxis(list(by), "date")
    x = ic.where(col("ic").isNotNull()).withColumn("rolling_ic", w.mean(col("ic"), rows))
    return x.where(col("rolling_ic").isNotNull()).select(*by, "date", "rolling_ic")


# ---- walk-forward -------------------------------------------------------------------------------
def walk_forward_windows(calendar: DataFrame, train: int = 252, test: int = 21, step: int = 21) -> DataFrame:
    """One row per window with its date boundaries; calendar = (date, t) with dense t."""
    n = calendar.agg((F.max("t") + 1).alias("n"))  # exactly one row
    k = n.where(col("n") >= train + test).select(
        F.explode(F.sequence(F.lit(0), F.floor((col("n") - train - test) / step).cast("int"))).alias("window_idx"))
    edges = {"train_start": 0, "train_end": train - 1, "test_start": train, "test_end": train + test - 1}
    out = k
    for name, offset in edges.items():
        days = calendar.select(col("t").alias("_t"), col("date").alias(name))
        out = out.withColumn("_t", col("window_idx") * step + offset).join(days, "_t").drop("_t")
    return out


def window_members(calendar: DataFrame, train: int = 252, test: int = 21, step: int = 21) -> DataFrame:
    """(date, window_idx, part): the few windows each date belongs to, by index arithmetic instead of a range join."""
    n = calendar.agg((F.max("t") + 1).alias("n"))  # exactly one row
    x = calendar.select("date", "t").join(F.broadcast(n))
    last = F.floor((col("n") - train - test) / step).cast("int")

    def spans(lo: int, hi: int, part: str) -> DataFrame:
        # windows k with k*step + lo <= t <= k*step + hi
        a = F.greatest(F.lit(0), F.ceil((col("t") - hi) / step).cast("int"))
        b = F.least(last, F.floor((col("t") - lo) / step).cast("int"))
        ks = F.when((col("n") >= train + test) & (a <= b), F.sequence(a, b))
        return x.select("date", F.explode(ks).alias("window_idx"), F.lit(part).alias("part"))

    return spans(0, train - 1, "train").unionByName(spans(train, train + test - 1, "test"))


def window_ic(ic: DataFrame, members: DataFrame, keys: Sequence[str] = ("score_type", "score_name", "horizon"),
              min_dates: int = 5) -> DataFrame:
    """Mean in-sample and out-of-sample IC per window; windows with too few valid dates are left out."""
    j = ic.where(col("ic").isNotNull()).join(members, "date")
    is_, oos = col("part") == "train", col("part") == "test"
    g = j.groupBy(*keys, "window_idx").agg(
        F.avg(F.when(is_, col("ic"))).alias("is_ic"), F.avg(F.when(oos, col("ic"))).alias("oos_ic"),
        F.count_if(is_).alias("n_train_dates"), F.count_if(oos).alias("n_test_dates"))
    return g.where((col("n_train_dates") >= min_dates) & (col("n_test_dates") >= min_dates))


def oos_summary(diag: DataFrame, keys: Sequence[str] = ("score_type", "score_name", "horizon")) -> DataFrame:
    m, s, n = col("oos_ic_mean"), col("oos_ic_std"), col("n_windows")
    g = diag.groupBy(*keys).agg(
        F.count("oos_ic").alias("n_windows"), F.avg("oos_ic").alias("oos_ic_mean"),
        F.stddev_samp("oos_ic").alias("oos_ic_std"), F.avg(flag(positive("oos_ic"))).alias("oos_hit_rate"),
        F.avg("is_ic").alias("is_ic_mean"))
    return g.withColumns({"oos_ic_t_stat": t_stat(m, s, n), "is_minus_oos": col("is_ic_mean") - m})


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t with a whole number of degrees of freedom.

    With angle = atan(t / sqrt(df)) the distribution is a finite series in cos(angle): even df sum
    sin * (1 + 1/2 cos^2 + 1*3/(2*4) cos^4 + ...), odd ones 2/pi * (angle + sin * (cos + 2/3 cos^3 + ...)).
    """
    df = df.cast("int")
    angle = F.atan(F.abs(t) / F.sqrt(df))
    sin, cos = F.sin(angle), F.cos(angle)
    odd = F.pmod(df, F.lit(2)) == 1
    first = F.when(odd, 1).otherwise(0)

    def grown(acc: Column, k: Column) -> Column:
        term = acc["term"] * cos * cos * k / (k + 1)
        return F.struct((acc["total"] + term).alias("total"), term.alias("term"))

    # factors k / (k + 1) with k = 1, 3, 5 ... (even df) or 2, 4, 6 ... (odd df), up to k + 1 = df - 2
    steps = F.when(df > first + 3, F.sequence(first + 1, F.greatest(df - 3, first + 1), F.lit(2))).otherwise(
        F.array().cast("array<int>"))
    start = F.when(odd, cos).otherwise(F.lit(1.0))
    series = F.aggregate(steps, F.struct(start.alias("total"), start.alias("term")), grown, lambda acc: acc["total"])
    inside = F.when(odd, (angle + F.when(df > 1, sin * series).otherwise(0.0)) * (2.0 / math.pi)).otherwise(sin * series)
    return F.when(t.isNotNull() & (df >= 1), F.greatest(F.lit(1.0) - inside, F.lit(0.0)))


def oos_significance(diag: DataFrame, keys: Sequence[str] = ("score_type", "score_name", "horizon")) -> DataFrame:
    """Out-of-sample summary with standard error and a two-sided Student-t p-value per row."""
    s = oos_summary(diag, keys)
    return s.withColumns({"oos_ic_se": col("oos_ic_std") / F.sqrt("n_windows"),
                          "oos_p_value": t_two_sided(col("oos_ic_t_stat"), col("n_windows") - 1)})


def ic_gate(summary: DataFrame, baseline: DataFrame, by: Sequence[str] = ("horizon",)) -> DataFrame:
    """Regression gate: pinned rows (by, expected, tolerance) with the mean IC found and whether it is inside the tolerance.

    A pinned series that the summary lacks, or whose mean is null, does not pass.
    """
    j = baseline.join(summary.select(*by, "ic_mean"), list(by), "left")
    return j.withColumn("passed", F.coalesce(F.abs(col("ic_mean") - col("expected")) <= col("tolerance"), F.lit(False)))


# ---- feature audit ------------------------------------------------------------------------------
def horizon_tables(summary: DataFrame, n: int = 20, min_windows: int = 10, overfit_is: float = 0.015,
                   overfit_gap: float = 0.010) -> DataFrame:
    """Rank of each score inside (type, horizon) from both ends, and the overfit flag.

    Means that agree but for the last bits of a double (scores of one order on every date) are ties, ranked by name.
    """
    x = summary.where(col("n_windows") >= min_windows)
    by, mean = Window.partitionBy("score_type", "horizon"), F.round("oos_ic_mean", MEAN_DIGITS)
    top = F.row_number().over(by.orderBy(mean.desc(), "score_name"))
    bottom = F.row_number().over(by.orderBy(mean.asc(), "score_name"))
    return x.withColumns({
        "in_top": top <= n, "in_bottom": bottom <= n,
        "overfit": (col("is_ic_mean") >= overfit_is) & (col("is_minus_oos") >= overfit_gap),
    })


def feature_classes(tables: DataFrame, score_type: str = "feature", universal: int = 3, noise: float = 0.005) -> DataFrame:
    """Per feature over all horizons: how often it ranks on top and whether it is noise or sign-flipped."""
    x = tables.where(col("score_type") == score_type)
    g = x.groupBy("score_name").agg(
        F.count_if("in_top").alias("n_top"), F.count_if("in_bottom").alias("n_bottom"), F.count("oos_ic_mean").alias("n_horizons"),
        F.max(F.abs("oos_ic_mean")).alias("max_abs_oos_ic"), F.avg("oos_ic_mean").alias("mean_oos_ic"),
        F.count_if(col("oos_ic_mean") > 0).alias("n_positive_horizons"),
        F.coalesce(F.bool_and(col("oos_ic_mean") < 0), F.lit(False)).alias("_neg"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("horizon", "oos_ic_mean")))).alias("per_horizon"))
    return g.select(
        "*", (col("n_top") >= universal).alias("universally_good"), col("n_top").between(1, 2).alias("horizon_specific"),
        (col("max_abs_oos_ic") < noise).alias("noise_candidate"),
        (col("_neg") & (col("n_horizons") >= 4)).alias("sign_flip_candidate")).drop("_neg")


def component_summary(summary: DataFrame) -> DataFrame:
    t = col("oos_ic_t_stat")
    return summary.where(col("score_type") == "component").groupBy("score_name").agg(
        F.avg("oos_ic_mean").alias("mean_oos_ic"), F.count_if(col("oos_ic_mean") > 0).alias("n_positive_horizons"),
        F.count_if(t > 2.0).alias("n_significant_positive"), F.count_if(t < -2.0).alias("n_significant_negative"))


# weight of a feature inside a component, magnitude only (fixed values, products of nested blends)
INTRA_WEIGHTS = {
    "s_rs": {"rs_rating_spy": .55, "sharpe_momentum_rank_126d": .30, "within_basket_z_21d": .15},
    "s_rs_leadership": {
        "rs_rating_spy": .30, "sharpe_rank_252d": .15 * .30, "gain_to_pain_ratio_252d": .15 * .30,
        "information_ratio_252d": .15 * .30 + .10, "sortino_rank_126d": .15 * .10, "rs_rating_slope_60d": .10 * .5,
        "rs_rating_slope_120d": .10 * .5, "rs_line_spy_new_high_252d": .20 * .20, "rs_line_spy_slope_60d": .20 * .15,
        "rs_line_spy_r_squared_60d": .20 * .50, "rs_line_qqq_new_high_252d": .20 * .15, "mtf_rs_coherence": .15 * .55,
        "within_basket_z_63d": .15 * .45},
    "s_residual_momentum": {"residual_momentum_126d": 1.0},
    "s_rsl": {"rs_line_spy_new_high_252d": .40, "rs_line_spy_new_high_60d": .25, "rs_line_spy_slope_20d": .20,
              "rs_line_spy_r_squared_60d": .15},
    "s_trend_slope": {"adx_14": .20, "trend_r_squared_60d": .15, "trend_rsquared_252d": .10, "hurst_exponent_252d": .15,
                      "return_autocorrelation_60d_lag1": .15, "trend_slope_60d": .10, "supertrend_direction": .10,
                      "supertrend_days_since_flip": .10, "plus_di": .05, "minus_di": .05},
    "s_structure": {"sma_stack_score": .20, "ema_stack_score": .20, "hh_count_60d": .10, "hl_count_60d": .25,
                    "supertrend_direction": .10, "new_252d_high": .10, "pct_up_days_21": .05},
    "s_mtf": {"weekly_stack_alignment": .80 * .30, "weekly_higher_highs": .80 * .20, "weekly_rs_rising": .80 * .20,
              "weekly_macd_posture": .80 * .15, "weekly_trend_slope_sign": .80 * .15,
              "monthly_close_above_sma_10": .20 * .5, "monthly_higher_highs_3m": .20 * .5},
    "s_extension": {"vol_normalized_extension": .55, "pct_ma_50": .30, "price_z_score_vs_trend": .15},
    "s_momentum": {"momentum_21d_pct": .40, "rs_line_spy_slope_21d": .20, "macd_posture": .20, "rsi_14": .10,
                   "bullish_divergence_20d": .10, "bearish_divergence_20d": .10},
    "s_volume": {"low_rel_vol_10d": .5, "volume_buzz_50": .5},
}


def effective_weights() -> dict[str, float]:
    """Feature weight in the composite: intra-component weight times the mean state weight."""
    weights = state_weights()
    mean = {c: sum(w[i] for w in weights.values()) / len(weights) for i, c in enumerate(config.COMPONENTS)}
    out: dict[str, float] = {}
    for c, parts in INTRA_WEIGHTS.items():
        for f, w in parts.items():
            out[f] = out.get(f, 0.0) + w * mean[c]
    return out


def horizon_audit(summary: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Features by 20 / 60-row IC against their effective weight: category A, B or C."""
    weights = effective_weights() if weights is None else weights
    w = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    g = summary.where(col("score_type") == "feature").groupBy("score_name").agg(
        F.max(F.when(col("horizon") == 20, col("oos_ic_mean"))).alias("oos_ic_20d"),
        F.max(F.when(col("horizon") == 60, col("oos_ic_mean"))).alias("oos_ic_60d"))
    g = g.withColumn("effective_weight", F.coalesce(F.element_at(w, col("score_name")), F.lit(0.0)))
    a, b, e = col("oos_ic_20d"), col("oos_ic_60d"), col("effective_weight")
    a0, b0 = F.abs(F.coalesce(a, F.lit(0.0))), F.abs(F.coalesce(b, F.lit(0.0)))
    under = F.coalesce(a > 0.025, F.lit(False)) | F.coalesce(b > 0.025, F.lit(False))
    cat = F.when(under & (e < 0.020), "A").when((e > 0.020) & (a0 < 0.005) & (b0 < 0.005), "C").otherwise("B")
    return g.withColumns({"best_abs_20_60": F.greatest(a0, b0), "category": cat})


# ---- ridge weighting ----------------------------------------------------------------------------
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)


def ridge_training_rows(scored: DataFrame, fwd: DataFrame, horizon: int, cols: Sequence[str]) -> DataFrame:
    """Complete component rows with the per-date z of the forward return as target (undefined z = 0)."""
    f = fwd.where(col("horizon") == horizon).select("entity", "date", "fwd")
    j = scored.select("entity", "date", *cols).join(f, ["entity", "date"], "left")
    z = xs.standard_z(j, ["date"], {"_y": "fwd"}, sample=True)
    return z.withColumn("y", F.coalesce("_y", F.lit(0.0))).dropna(subset=list(cols)).drop("_y", "fwd")


def solved(gram: Column, p: int) -> Column:
    """Gauss-Jordan elimination of p rows [G | right sides] of a positive definite G: the right sides become the solutions.

    Diagonal pivots are safe for such a matrix; array functions only, so the solve is part of the plan.
    """
    def step(m: Column, k: Column) -> Column:
        pivot = F.element_at(m, k)
        scaled = F.transform(pivot, lambda v: v / F.element_at(pivot, k))
        return F.transform(m, lambda row, i: F.when(i + 1 == k, scaled).otherwise(
            F.zip_with(row, scaled, lambda v, s: v - F.element_at(row, k) * s)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(p)), gram, step)


def ridge_weights(rows: DataFrame, members: DataFrame, cols: Sequence[str], alphas: Sequence[float] = ALPHAS,
                  min_rows: int = 1000) -> DataFrame:
    """Ridge fit per training window with leave-one-out alpha choice; weights rescaled to sum to one.

    One plan, nothing is collected: window moments give the Gram matrix, each alpha's inverse and coefficients are solved
    there, and a second pass over the rows takes the leave-one-out errors from the hat diagonal. The joined side has one
    row for each window. A coefficient sum near zero gives equal weights; of equal errors the smaller alpha wins.
    """
    cols, p = list(cols), len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    train = rows.join(members.where(col("part") == "train").select("date", "window_idx"), "date")
    sums = [F.count("*").alias("n"), F.avg("y").alias("ybar")]
    sums += [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)] + [F.sum(col(c) * col("y")).alias(f"b{i}") for i, c in enumerate(cols)]
    sums += [F.sum(col(cols[i]) * col(cols[j])).alias(f"g{i}_{j}") for i, j in pairs]

    def centred(i: int, j: int) -> Column:
        return col(f"g{min(i, j)}_{max(i, j)}") - col("n") * col(f"m{i}") * col(f"m{j}")

    def augmented(alpha: float) -> Column:
        return F.array(*[F.array(
            *[centred(i, j) + alpha if i == j else centred(i, j) for j in range(p)], *[F.lit(float(i == j)) for j in range(p)],
            col(f"b{i}") - col("n") * col(f"m{i}") * col("ybar")) for i in range(p)])

    window = train.groupBy("window_idx").agg(*sums).where(col("n") >= min_rows)
    window = window.select("window_idx", "n", "ybar", *[f"m{i}" for i in range(p)],
                           *[solved(augmented(a), p).alias(f"s{k}") for k, a in enumerate(alphas)])
    x = train.join(F.broadcast(window), "window_idx")
    x = x.select("window_idx", "n", (col("y") - col("ybar")).alias("_y"), *[(col(c) - col(f"m{i}")).alias(f"c{i}") for i, c in enumerate(cols)],
                 *[f"s{k}" for k in range(len(alphas))])

    def total(terms: Sequence[Column]) -> Column:
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    errs = []
    for k in range(len(alphas)):
        at = lambda i, j, k=k: col(f"s{k}")[i][j]
        hat = total([at(i, p + j) * col(f"c{i}") * col(f"c{j}") * (1.0 if i == j else 2.0) for i, j in pairs]) + 1.0 / col("n")
        fit = total([at(i, 2 * p) * col(f"c{i}") for i in range(p)])
        errs.append(F.avg(F.pow((col("_y") - fit) / (1.0 - hat), F.lit(2.0))).alias(f"e{k}"))
    best = x.groupBy("window_idx").agg(*errs)
    choice = F.array_min(F.array(*[F.struct(col(f"e{k}").alias("e"), F.lit(k).alias("k")) for k in range(len(alphas))]))["k"]
    chosen = window.join(best.select("window_idx", choice.alias("k")), "window_idx")
    table = F.array(*[col(f"s{k}") for k in range(len(alphas))])
    chosen = chosen.select("window_idx", "n", F.array(*[F.lit(float(a)) for a in alphas])[col("k")].alias("alpha"),
                           F.transform(table[col("k")], lambda row: row[2 * p]).alias("w"))
    whole = F.aggregate("w", F.lit(0.0), lambda s, v: s + v)
    weight = lambda i: F.when(F.abs(whole) < 1e-9, F.lit(1.0 / p)).otherwise(col("w")[i] / whole)
    return chosen.select("window_idx", "alpha", col("n").alias("n_train"), *[weight(i).alias(f"w_{c}") for i, c in enumerate(cols)])


def ridge_oos(rows: DataFrame, members: DataFrame, weights: DataFrame, fwd: DataFrame, cols: Sequence[str],
              min_names: int = MIN_NAMES, bound: xs.Bound = xs.Bound()) -> DataFrame:
    """Out-of-sample mean IC of each window's weighted composite, per horizon."""
    test = rows.join(members.where(col("part") == "test").select("date", "window_idx"), "date").join(F.broadcast(weights), "window_idx")
    value = col(f"w_{cols[0]}") * col(cols[0])
    for c in cols[1:]:
        value = value + col(f"w_{c}") * col(c)
    pred = test.select("entity", "date", "window_idx", value.alias("value"))
    ic = rank_ic(pred, fwd, ("window_idx",), min_names, bound)
    return ic.where(col("ic").isNotNull()).groupBy("window_idx", "horizon").agg(F.avg("ic").alias("oos_ic"), F.count("*").alias("n_dates"))


def ridge_consensus(weights: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and std of each component's weight across windows, with the instability flag."""
    items = F.array(*[F.struct(F.lit(c).alias("component"), col(f"w_{c}").alias("w")) for c in cols])
    g = weights.select(F.explode(items).alias("r")).select("r.*").groupBy("component").agg(
        F.avg("w").alias("mean_weight"), F.stddev_samp("w").alias("std_weight"), F.count("*").alias("n_windows"))
    m = F.abs("mean_weight")
    return g.withColumn("unstable", F.coalesce((m > 1e-9) & (div(col("std_weight"), m) > 4.0), F.lit(False)))


def alpha_histogram(weights: DataFrame) -> DataFrame:
    return weights.groupBy("alpha").agg(F.count("*").alias("n_windows"))


def adopt_rule(learned: DataFrame, baseline: DataFrame, consensus: DataFrame, primary: int = 126, short: int = 1,
               gain_pct: float = 10.0) -> DataFrame:
    """Adopt learned weights only with enough gain at both horizons, stable weights and no worse t-stat.

    ``learned`` / ``baseline``: (horizon, oos_ic_mean, oos_ic_t_stat).
    """
    j = learned.alias("l").join(baseline.alias("b"), "horizon")
    gain = div(col("l.oos_ic_mean") - col("b.oos_ic_mean"), F.abs("b.oos_ic_mean")) * 100.0
    g = j.select("horizon", gain.alias("gain"), (col("l.oos_ic_t_stat") >= col("b.oos_ic_t_stat")).alias("t_ok"))
    one = g.agg(
        F.max(F.when(col("horizon") == primary, col("gain"))).alias("gain_primary"),
        F.max(F.when(col("horizon") == short, col("gain"))).alias("gain_short"),
        F.coalesce(F.bool_or((col("horizon") == primary) & col("t_ok")), F.lit(False)).alias("t_ok"))
    u = consensus.agg(F.count_if("unstable").alias("n_unstable"))
    both = one.join(F.broadcast(u))  # one row each
    ok = F.coalesce((col("gain_primary") >= gain_pct) & (col("gain_short") >= gain_pct), F.lit(False))
    return both.withColumn("adopt", ok & col("t_ok") & (col("n_unstable") == 0))
