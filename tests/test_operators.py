"""Operators against independent pandas / numpy / math re-derivations and boundary rows."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from panelwave import config
from panelwave.functions.expr import all_matches, first_match, normal_cdf
from panelwave.functions.rolling import TimeAxis
from panelwave.operators import bars as B
from panelwave.operators import cascades, evaluate, quality, reliability, views
from panelwave.operators import xsection as xs
from panelwave.operators.orderwin import Wavelet, Window, order_statistics, order_windows
from panelwave.operators.recursive import Supertrend, affine_scan, indicators, recursive_indicators, rolling_hurst, smooth, wilder
from panelwave.operators.score import composite, state_weights
from panelwave.operators.state import state

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def test_normal_cdf(spark):
    zs = [-8.0, -3.2, -1.0, -0.3, 0.0, 0.2, 0.66, 1.5, 2.8, 6.0, None]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_cdf("z").alias("p"))
    for z, p in df.collect():
        if z is None:
            assert p is None
        else:
            assert abs(p - 0.5 * math.erfc(-z / math.sqrt(2))) < 1e-14


def gap_series():
    rng = np.random.default_rng(3)
    x = rng.normal(100, 5, 90)
    for a, b in ((0, 4), (20, 21), (40, 43), (60, 80), (88, 90)):
        x[a:b] = np.nan
    return x


def whole_and_cut(fn, x):
    """fn over the whole series, after checking that pieces with a carried state, and a neighbour before, give the same."""
    begin = np.zeros(len(x), bool)
    begin[0] = True
    whole = fn(x, begin, {})
    for cut in (1, 3, 22, 41, 70, 89):
        state = {}
        np.testing.assert_allclose(np.concatenate([fn(x[:cut], begin[:cut], state), fn(x[cut:], begin[cut:], state)]), whole, rtol=1e-11)
    both = fn(np.concatenate([x[5:], x]), np.concatenate([begin[:-5], begin]), {})
    np.testing.assert_allclose(both[len(x) - 5 :], whole, rtol=1e-11)
    return whole


def test_affine_scan():
    rng = np.random.default_rng(4)
    a, b, y, want = rng.uniform(-1, 1, 77), rng.normal(size=77), 0.0, []
    for i in range(77):
        y = a[i] * y + b[i]
        want.append(y)
    np.testing.assert_allclose(affine_scan(a, b), want, rtol=1e-12)


def test_ema_matches_ewm_with_gaps():
    x = gap_series()
    want = pd.Series(x).ewm(span=5, adjust=False, min_periods=5).mean()
    np.testing.assert_allclose(whole_and_cut(lambda part, start, state: smooth(part, start, 2 / 6, 5, state, "e"), x), want, rtol=1e-11)


def test_rma_reseeds_after_gap():
    x = pd.Series(gap_series())
    sma = x.rolling(5, min_periods=5).mean()
    fed = x.where(sma.notna())
    first = sma.notna() & sma.shift(1).isna()
    fed[first] = sma[first]
    want = fed.ewm(alpha=0.2, adjust=False).mean()
    got = whole_and_cut(lambda part, start, state: wilder(part, start, 5, state, "r"), x.to_numpy())
    np.testing.assert_allclose(got, want, rtol=1e-11)


def test_supertrend_flip_and_restart():
    s = Supertrend(3.0)
    assert s.step(11, 9, 10, None) == (None, None)
    assert s.step(11, 9, 10, 1.0) == (1.0, 1.0)
    assert s.step(11, 9, 10, 1.0) == (1.0, 2.0)
    assert s.step(6, 4, 5, 1.0) == (-1.0, 1.0)  # close below the lower band 7
    assert s.step(6, 4, 5, 1.0) == (-1.0, 2.0)
    assert s.step(20, 18, 19, 1.0) == (1.0, 1.0)
    assert s.step(20, 18, 19, None) == (None, None)
    assert s.step(20, 18, 19, 1.0) == (1.0, 1.0)


def test_hurst_textbook():
    r = np.random.default_rng(1).normal(0, 0.01, 300)
    out = rolling_hurst(r, 252)
    assert np.isnan(out[:251]).all()
    w = r[10:262]
    dev = np.cumsum(w - w.mean())
    assert abs(out[261] - math.log((dev.max() - dev.min()) / w.std()) / math.log(252)) < 1e-12


def test_recursion_independent_of_batches_and_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(f"e{e}", t, float(c + 1), float(c - 1), float(c)) for e in range(5) for t, c in enumerate(100 + rng.normal(0, 1, 60).cumsum())]
    df = spark.createDataFrame(rows, "entity string, t int, high double, low double, close double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        a = recursive_indicators(df, 30).orderBy("entity", "t").toPandas()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        b = recursive_indicators(df.orderBy(F.rand(1)), 30).orderBy("entity", "t").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    pd.testing.assert_frame_equal(a, b)
    own = np.array([r[2:] for r in rows if r[0] == "e0"]).T
    begin = np.arange(60) == 0
    first = indicators(*own, begin, {})
    for name in ("ema_8", "adx_14", "rsi_14", "supertrend_direction"):
        np.testing.assert_allclose(first[name], a[a.entity == "e0"][name], rtol=1e-12)


def test_order_statistics_by_hand(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=400), 1)  # many ties
    x[rng.random(400) < 0.1] = np.nan
    first = np.where(np.arange(400) < 150, 0, 150)
    windows = {"q": Window("quantile", 25, 10, 0.8), "p": Window("quantile", 400, 1, 0.0), "r": Window("rank", 25, 5), "s": Window("share_le", 25, 5)}
    got = order_statistics(x, first, windows)
    for i in range(400):
        for name, w in windows.items():
            win = x[max(i - w.n + 1, first[i]) : i + 1]
            win = win[~np.isnan(win)]
            if len(win) < w.need or (w.kind != "quantile" and np.isnan(x[i])):
                assert np.isnan(got[name][i])
                continue
            want = {"quantile": lambda: np.quantile(win, w.q), "rank": lambda: ((win < x[i]).sum() + ((win == x[i]).sum() + 1) / 2) / len(win),
                    "share_le": lambda: (win <= x[i]).mean()}[w.kind]()
            assert abs(got[name][i] - want) < 1e-12
    rows = [("a" if i < 150 else None, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "entity string, t int, x double").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
        frame = order_windows(df, "x", windows).orderBy("t").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for name in windows:
        np.testing.assert_allclose(frame[name].to_numpy(), got[name], rtol=1e-12)
    assert order_windows(df.limit(0), "x", windows).count() == 0
    assert np.isnan(order_statistics(np.full(3, np.nan), np.zeros(3, int), windows)["p"]).all()
    assert Wavelet(np.array([2.0])).kth(np.array([0]), np.array([1]), np.array([0])) == [2.0]


def bars(spark, closes, entity="A", start=0):
    rows = [(entity, day(start + i), c, c + 1, c - 1, c, c, 1e6) for i, c in enumerate(closes) if c is not None]
    return spark.createDataFrame(rows, "entity string, date date, open double, high double, low double, close double, adj_close double, volume double")


def test_densify_grid_and_duplicates(spark):
    bench = bars(spark, [1.0] * 6, "MKT")
    own = bars(spark, [None, 10.0, None, None, 12.0, None], "A").unionByName(bars(spark, [5.0], "B", 3)).unionByName(bars(spark, [7.0], "B", 99))
    dense = B.densify(own, B.calendar(bench)).orderBy("entity", "t").collect()
    assert len(dense) == 12
    assert [r.close for r in dense] == [None, 10.0, None, None, 12.0, None, None, None, None, 5.0, None, None]
    assert all(r.date == day(r.t) for r in dense)
    with pytest.raises(Exception, match="duplicate bar"):
        B.densify(own.unionByName(bars(spark, [None, 10.0], "A")), B.calendar(bench)).collect()


def test_rolling_min_periods(spark):
    x = gap_series()
    df = spark.createDataFrame([("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "entity string, t int, x double")
    w = TimeAxis()
    got = df.select("t", w.mean(F.col("x"), 10, 4).alias("m"), w.std(F.col("x"), 10).alias("s"), w.slope(F.col("x"), 6).alias("b"),
                    w.rank_in_window(F.col("x"), 10, 3).alias("r")).orderBy("t").toPandas()
    s = pd.Series(x)
    np.testing.assert_allclose(got.m, s.rolling(10, min_periods=4).mean(), rtol=1e-12)
    np.testing.assert_allclose(got.s, s.rolling(10).std(), rtol=1e-9)
    np.testing.assert_allclose(got.r, s.rolling(10, min_periods=3).rank(pct=True), rtol=1e-12)
    slope = s.rolling(6).apply(lambda y: np.polyfit(range(6), y, 1)[0], raw=True)
    np.testing.assert_allclose(got.b, slope, rtol=1e-8)


@pytest.fixture(scope="module")
def tied(spark):
    """One hot group with heavy ties, nulls, a constant group and a tiny group."""
    rng = np.random.default_rng(9)
    rows = [("hot", f"e{i}", None if i % 17 == 0 else float(rng.integers(0, 40))) for i in range(3000)]
    rows += [("flat", f"e{i}", 2.0) for i in range(30)] + [("tiny", f"e{i}", float(i)) for i in range(3)]
    rows += [("normal", f"e{i}", float(rng.normal())) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, entity string, x double").repartition(4).cache()
    return df, df.toPandas()


@pytest.mark.parametrize("bound", [xs.Bound(), xs.Bound(5000, 10)])
def test_ranks_and_quantiles_both_plans(tied, bound):
    df, pdf = tied
    got = xs.pct_rank(df, ["g"], {"r": "x"}, bound).toPandas().sort_values(["g", "entity"]).reset_index(drop=True)
    want = pdf.assign(r=pdf.groupby("g").x.rank(pct=True)).sort_values(["g", "entity"]).reset_index(drop=True)
    np.testing.assert_allclose(got.r, want.r, rtol=1e-12)
    q = xs.group_quantiles(df, ["g"], {"a": ("x", 0.01), "b": ("x", 0.5), "c": ("x", 0.92)}, bound).toPandas().set_index("g")
    for name, p in (("a", .01), ("b", .5), ("c", .92)):
        np.testing.assert_allclose(q[name].sort_index(), pdf.groupby("g").x.quantile(p).sort_index(), rtol=1e-12)
    top = xs.top_share(df, ["g"], "x", {"s": F.lit(7)}, bound).toPandas().set_index("g").s
    for g in ("hot", "flat", "tiny"):
        x = pdf[pdf.g == g].x.dropna()
        assert abs(top[g] - x.nlargest(7).sum() / x.sum()) < 1e-12


def test_both_plans_agree_on_odd_keys_and_values(spark):
    """Null group keys are a group like others; NaN, infinities and both zeros rank alike in both plans."""
    odd = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, None, 1.5, 1.5, -2.0, 7.0]
    rows = [(g, h, f"e{g}{h}{i}", odd[i % len(odd)] if i < 30 else float(i % 11)) for g in ("a", None) for h in (1, None) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, h int, entity string, x double").repartition(3)
    by, one = ["g", "h"], xs.Bound(5000, 10)
    sized = df.withColumn("size", F.lit(90))
    for call in (
        lambda b: xs.pct_rank(df, by, {"r": "x"}, b), lambda b: xs.group_rank(sized, by, "x", "size", "r", "p", bound=b),
        lambda b: xs.winsorize(df.where(~F.isnan("x")), by, {"r": "x"}, 0.2, 0.8, b), lambda b: xs.top_share(df.where("x between -9 and 9"), by, "x", {"s": F.lit(5)}, b),
        lambda b: xs.group_quantiles(df.where("x between -9 and 9"), by, {"q": ("x", 0.3)}, b),
    ):
        got, want = (sorted(map(str, call(b).collect())) for b in (xs.Bound(), one))
        assert got == want and len(got) > 3


def test_a_sketch_that_varies_from_run_to_run_changes_no_count(spark, monkeypatch):
    """Bounds that come out differently whenever they are computed, as parts of a sketch arrive in any order."""
    other = F.udf(lambda b: sorted(x + random.uniform(-9, 9) for x in b), "array<double>").asNondeterministic()
    sketch = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda *a: other(sketch(*a)))
    spark.conf.set("spark.sql.exchange.reuse", "false")  # a cluster may compute a shared step twice
    try:
        df = spark.range(300).select(F.lit(1).alias("g"), (F.col("id") % 100).cast("double").alias("x"))
        got = sorted(tuple(r) for r in xs.ordered_counts(df, ["g"], "x").collect())
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == [(1, float(i), 3, 3 * i, 300) for i in range(100)]


def test_robust_z_fallbacks(tied):
    df, pdf = tied
    got = xs.robust_z(df, ["g"], {"z": "x"}, xs.Bound(5000, 10)).toPandas()
    assert (got[got.g == "flat"].z == 0).all()
    n = pdf[pdf.g == "normal"].set_index("entity").x
    want = (n - n.median()) / (1.4826 * (n - n.median()).abs().median())
    np.testing.assert_allclose(got[got.g == "normal"].set_index("entity").z.sort_index(), want.sort_index(), rtol=1e-12)


def test_first_match_is_head_of_all_matches(spark):
    df = spark.range(20).withColumn("x", F.col("id").cast("double"))
    rules = [("a", F.col("x") > 15), ("b", F.col("x") > 10), ("c", F.col("x") > 12)]
    for r in df.select(first_match(rules, "").alias("f"), all_matches(rules).alias("m")).collect():
        assert r.f == (r.m[0] if r.m else "")


def test_momentum_class_boundaries(spark):
    vals = [(-7.0, 0.0), (-3.0, 0.0), (-7.01, 0.0), (-6.9, 0.0), (7.0, 0.0), (12.0, 7.0), (12.0, 6.9), (None, 1.0)]
    df = spark.createDataFrame(vals, "c60 double, c30 double")
    got = [r[0] for r in df.select(cascades.momentum_class(F.col("c30"), F.col("c60"))).collect()]
    assert got == ["STABLE", "STABLE", "WEAKENING", "DECELERATING", "MODERATE_ACCELERATING", "STRONG_ACCELERATING", "MODERATE_ACCELERATING", None]


def test_display_roundtrip(spark):
    df = spark.createDataFrame([(s,) for s in config.STATES] + [(None,), ("odd",)], "s string")
    rows = df.select("s", cascades.display_state(F.col("s")).alias("d")).collect()
    assert {r.d for r in rows if r.s in config.STATES} == set(config.STATE_DISPLAY.values())
    assert [r.d for r in rows if r.s is None] == [""] and [r.d for r in rows if r.s == "odd"] == ["odd"]


def _state_row(**kw):
    base = dict(adx_14=15.0, trend_r_squared_60d=0.2, pct_ma_50=0.0, sma_stack_score=0.0, atr_x_50=0.0, rsi_14=50.0, bb_width_pct_252d=50.0,
                vcp_quality_score=0.0, bb_squeeze_flag=0.0, rs_rating_spy=50.0, days_near_52w_high_60d=0.0, distribution_days_25=2.0, supertrend_direction=1.0)
    return Row(**{**base, **kw})


def test_state_probabilities(spark):
    rows = [_state_row(adx_14=32.0, trend_r_squared_60d=.7, sma_stack_score=100.0, pct_ma_50=10.0), _state_row(adx_14=None), _state_row(atr_x_50=6.0, rsi_14=76.0, rs_rating_spy=93.0, days_near_52w_high_60d=30.0, adx_14=60.0)]
    out = state(spark.createDataFrame(rows, ", ".join(f"{k} double" for k in rows[0].asDict()))).collect()
    for r in out:
        assert abs(sum(r[f"p_{s}"] for s in config.STATES) - 1) < 1e-12
        assert abs(sum(r[f"p_adj_{s}"] for s in config.STATES) - 1) < 1e-12
    assert out[0].primary_state == "TRENDING" and out[2].primary_state == "EXHAUSTION"
    assert out[1].p_TRENDING == 0.0 and out[1].p_CONSOLIDATING == 0.0


def test_composite_weight_gate(spark):
    w = state_weights()
    assert all(abs(sum(v) - 1) < 1e-12 for v in w.values())
    p = {f"p_adj_{s}": float(s == "TRENDING") for s in config.STATES}
    full = {c: 1.0 for c in config.COMPONENTS}
    rows = [{**full, **p}, {**full, **p, "s_rs": None, "s_structure": None}, {**{c: None for c in config.COMPONENTS}, **p, "s_rs": 1.0, "s_rs_leadership": 1.0, "s_structure": 1.0}]
    schema = ", ".join(f"{c} double" for c in rows[0])
    out = composite(spark.createDataFrame([Row(**r) for r in rows], schema)).collect()
    assert abs(out[0].composite_z - 1) < 1e-12 and out[0].n_valid_components == 10
    assert out[1].composite_z is None and abs(out[1].weight_present - (1 - w["TRENDING"][0] - w["TRENDING"][5])) < 1e-12
    assert out[2].composite_z is None  # enough weight, too few components


def test_firewall_codes(spark):
    n = 260
    good = bars(spark, [10.0 + (i % 3) * 0.05 for i in range(n)], "GOOD").withColumn("open", F.col("close") * 0.95)
    short = bars(spark, [10.0] * 50, "SHORT", n - 50)
    zero = bars(spark, [10.0] * n, "ZERO").withColumn("volume", F.lit(0.0))
    stale = bars(spark, [10.0] * 252, "STALE")
    bad = bars(spark, [10.0] * n, "BAD").withColumn("low", F.lit(-1.0))
    uni = spark.createDataFrame([(e,) for e in ("GOOD", "SHORT", "ZERO", "STALE", "BAD", "GONE")], "entity string")
    data = good.unionByName(short).unionByName(zero).unionByName(stale).unionByName(bad)
    ov = spark.createDataFrame([("SHORT", "suppress", "INSUFFICIENT_HISTORY")], "entity string, kind string, value string")
    got = {r.entity: r for r in quality.firewall(data, uni, ov).collect()}
    assert got["GOOD"].status == "PASS", got["GOOD"]
    assert got["GONE"].critical == ["NO_DATA"] and "ZERO_VOLUME" in got["ZERO"].critical
    assert "STALE_DATA" in got["STALE"].critical and "INVALID_PRICES" in got["BAD"].critical
    assert "INSUFFICIENT_HISTORY" not in got["SHORT"].critical and got["SHORT"].suppressed == ["INSUFFICIENT_HISTORY"]


def test_corporate_action_types(spark):
    b = bars(spark, [100.0, 101.0, 50.0, 50.5]).withColumn("adj_close", F.when(F.col("date") < day(2), F.col("close") / 2).otherwise(F.col("close")))
    late = bars(spark, [51.0], start=13)
    ev = {(r.date, r.type) for r in reliability.corporate_actions(b.unionByName(late)).collect()}
    assert ev == {(day(2), "split"), (day(13), "halt")}


def test_rank_ic_perfect_and_gate(spark):
    rows = [(f"e{i}", day(d), float(i), float(i) if d == 0 else -float(i)) for d in (0, 1) for i in range(25)]
    rows += [(f"e{i}", day(2), float(i), float(i)) for i in range(19)] + [(f"e{i}", day(3), 1.0, float(i)) for i in range(25)]
    df = spark.createDataFrame(rows, "entity string, date date, value double, fwd double")
    s = df.select("entity", "date", F.lit("s").alias("score_name"), "value")
    f = df.select("entity", "date", F.lit(1).alias("horizon"), "fwd")
    for bound in (xs.Bound(), xs.Bound(100, 10)):
        got = {r.date: r.ic for r in evaluate.rank_ic(s, f, bound=bound).collect()}
        assert abs(got[day(0)] - 1) < 1e-12 and abs(got[day(1)] + 1) < 1e-12 and got[day(2)] is None and got[day(3)] is None


@pytest.mark.parametrize("n,want", [(272, 0), (273, 1), (294, 2)])
def test_walk_forward_window_count(spark, n, want):
    cal = spark.range(n).select(F.col("id").cast("int").alias("t"), F.date_add(F.lit(D0), F.col("id").cast("int")).alias("date"))
    assert evaluate.walk_forward_windows(cal).count() == want
    m = evaluate.window_members(cal).groupBy("window_idx", "part").count().collect()
    assert {(r.part, r["count"]) for r in m} == ({("train", 252), ("test", 21)} if want else set())


def test_ridge_matches_direct_solve(spark):
    rng = np.random.default_rng(2)
    cols = ["a", "b", "c"]
    rows, pd_rows = [], []
    for t in range(30):
        for e in range(40):
            x = rng.normal(size=3)
            y = float(x @ [0.5, 0.3, 0.2] + rng.normal() * 0.5)
            rows.append((f"e{e}", day(t), *map(float, x), y))
            pd_rows.append((t, *x, y))
    df = spark.createDataFrame(rows, "entity string, date date, a double, b double, c double, y double")
    cal = spark.range(30).select(F.col("id").cast("int").alias("t"), F.date_add(F.lit(D0), F.col("id").cast("int")).alias("date"))
    members = evaluate.window_members(cal, 20, 5, 5)
    got = {r.window_idx: r for r in evaluate.ridge_weights(df, members, cols, min_rows=100).collect()}
    assert sorted(got) == [0, 1]
    arr = np.array(pd_rows)
    for k in got:
        d = arr[(arr[:, 0] >= 5 * k) & (arr[:, 0] < 5 * k + 20)]
        x, y = d[:, 1:4] - d[:, 1:4].mean(0), d[:, 4] - d[:, 4].mean()
        best = None
        for a in evaluate.ALPHAS:
            inv = np.linalg.inv(x.T @ x + a * np.eye(3))
            h = np.einsum("ij,jk,ik->i", x, inv, x) + 1 / len(x)
            coef = inv @ x.T @ y
            err = np.mean(((y - x @ coef) / (1 - h)) ** 2)
            if best is None or err < best[0]:
                best = (err, a, coef / coef.sum())
        assert got[k].alpha == best[1]
        np.testing.assert_allclose([got[k][f"w_{c}"] for c in cols], best[2], rtol=1e-9)


def test_student_t(spark):
    known = [(2.228, 10, 0.05), (0.0, 5, 1.0), (1.0, 1, 0.5), (-12.706, 1, 0.05), (4.303, 2, 0.05), (3.182, 3, 0.05), (2.776, 4, 0.05), (1.96, 100000, 0.05)]
    df = spark.createDataFrame(known + [(None, 3, None), (1.0, 0, None)], "t double, df int, p double")
    for r in df.withColumn("got", evaluate.t_two_sided(F.col("t"), F.col("df"))).collect():
        assert r.got is None if r.p is None else abs(r.got - r.p) < 1e-4
    # the integral of the density for every small number of degrees of freedom
    for n in range(1, 12):
        x = np.linspace(-1.3, 1.3, 200_001)
        c = math.gamma((n + 1) / 2) / math.sqrt(n * math.pi) / math.gamma(n / 2)
        inside = np.trapezoid(c * (1 + x * x / n) ** (-(n + 1) / 2), x)
        got = spark.range(1).select(evaluate.t_two_sided(F.lit(1.3), F.lit(n)).alias("p")).head().p
        assert abs(got - (1 - inside)) < 1e-8


def test_rank_matrix_by_hand(spark):
    rng = np.random.default_rng(7)
    names = [f"x{i}" for i in range(7)]
    rows = []
    for d in range(4):
        for e in range(30):
            x = [None if rng.random() < 0.2 * (i % 3) else float(np.round(rng.normal(), 1)) for i in range(7)]
            x[6] = 1.0  # constant
            rows.append((f"e{e}", day(d), *x, None if d == 3 or rng.random() < 0.1 else float(rng.normal()), float(np.round(rng.normal(), 1))))
    schema = "entity string, date date, " + ", ".join(f"{n} double" for n in names) + ", fwd_1 double, fwd_5 double"
    df = spark.createDataFrame(rows, schema)
    pdf = df.toPandas()
    for width in (256, 3):
        got = {(r.date, r.score_name, r.horizon): r for r in evaluate.rank_ic_matrix(df, {"a": names[:2], "b": names[2:]}, (1, 5), 20, width).collect()}
        for (d, part), n, h in ((g, n, h) for g in pdf.groupby("date") for n in names for h in (1, 5)):
            both = part[[n, f"fwd_{h}"]].astype(float).dropna()
            r = got.pop((d, n, h), None)
            if not len(both):
                assert r is None
                continue
            assert r.n == len(both) and r.score_type == ("a" if n in names[:2] else "b")
            ic = both[n].rank().corr(both[f"fwd_{h}"].rank())
            assert r.ic is None if len(both) < 20 or np.isnan(ic) else abs(r.ic - ic) < 1e-12
        assert not got


def test_top_by_group_counts(spark):
    df = spark.createDataFrame([(f"e{i}", D0, float(i % 10), "A", "S", "x") for i in range(60)], "entity string, date date, score double, grade string, primary_state string, leadership_tier string")
    m = df.select(F.lit("b").alias("basket"), "entity")
    got = views.top_by_group(df, m, 7).orderBy("rank").collect()
    want = sorted(((-(i % 10), f"e{i}") for i in range(60)))[:7]
    assert [(r.entity) for r in got] == [e for _, e in want]


def test_nearest_date(spark):
    df = spark.createDataFrame([("a", day(i), float(i)) for i in (1, 5, 9)], "entity string, date date, score double")
    r = reliability.history_coverage(df, {"x": str(day(3)), "y": str(day(50))}).first()
    assert (r.x_date, r.x_score, r.y_date, r.y_score) == (day(5), 5.0, day(9), 9.0)


def test_crowded_and_dealt_bars_equal_plain_ones(spark):
    """First and last by the whole order, ties and nulls in its leading fields included; no sort of the trades."""
    rng = np.random.default_rng(4)
    rows = [("k" if i % 3 else None, int(rng.integers(0, 3)) if i % 11 else None, int(rng.integers(0, 2)) if i % 7 else None, i, float(rng.integers(1, 90)))
            for i in range(400)]
    t = spark.createDataFrame(rows + [("one", None, None, 1, 5.0)], "g string, a int, b int, c int, p double").repartition(5)
    args = (["g"], F.col("p"), F.lit(2.0))
    want = sorted(B.trade_bars(t, *args, F.struct("a", "b", "c")).collect(), key=str)
    assert sorted(B.crowded_bars(t, *args, ("a", "b", "c")).collect(), key=str) == want
    assert sorted(B.dealt_bars(t, *args, F.struct("a", "b", "c")).collect(), key=str) == want
    fine = B.trade_bars(t.withColumn("h", F.col("c") % 9), ["g", "h"], F.col("p"), F.lit(2.0), F.struct("a", "b", "c"))
    assert sorted(B.crowded_merge(fine, ["g"]).collect(), key=str) == want


def test_brand_bars_never_sort_the_trades(spark, monkeypatch):
    """Where no side is small, trades are dealt to their names once and hashed; the bars are those of one plain aggregate."""
    from panelwave.operators import sizing
    from panelwave.plans import panels

    folder, plans = "/root/testdata/sf0.001", []
    keys = ["entity", "date", "second"]
    li, part = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("lineitem", "part"))
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "*", F.col("p_brand").alias("entity"), panels._period(F.col("l_shipdate"), "week").alias("date"), (F.col("l_returnflag") == "R").alias("second"))
    want = sorted(B.trade_bars(rows, keys, F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), F.struct(*panels.LINE_ORDER)).collect())
    written = B.materialize
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(B, "materialize", lambda df: written(plan(df)))
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(plan(panels.line_bars(spark, folder, "brand", "week")).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want
    assert not any("SortMergeJoin [l_" in p for p in plans)
    # only the scan that finds the ends deals all trades; the other one meets the wanted ends first
    assert sum("ShuffledHashJoin [l_partkey" in p and "_wa" not in p for p in plans) == 1


def test_means_equal_above_rounding_rank_by_name(spark):
    rows = [("feature", n, 5, v, 12, 0.0, 0.0) for n, v in (("b", -0.4634557047890383), ("a", -0.4634557047890382), ("c", 0.1))]
    s = spark.createDataFrame(rows, "score_type string, score_name string, horizon int, oos_ic_mean double, n_windows long, is_ic_mean double, is_minus_oos double")
    got = {r.score_name: r.in_bottom for r in evaluate.horizon_tables(s, n=1).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_a_panel_builds_bars_only_when_asked(spark, monkeypatch):
    from panelwave.plans import panels

    def fail(*a):
        raise AssertionError("bars were built")

    monkeypatch.setattr(panels, "fine_bars", fail)
    assert panels.PanelSource(spark, "/root/testdata/sf0.001", "sm").members.count() > 0


def test_selected_features_compute_and_equal_only_what_is_asked(spark, monkeypatch):
    from panelwave.operators import features
    from panelwave.plans.panels import BENCHMARKS, PanelSource

    s = PanelSource(spark, "/root/testdata/sf0.001", "sd")
    whole = features.compute_features(s.dense(), BENCHMARKS, s.bound)
    asked, kernel = [], features.kernel_features
    monkeypatch.setattr(features, "kernel_features", lambda df, columns, *a: asked.append((df.columns, columns)) or kernel(df, columns, *a))
    for only in (("rsi_14", "sharpe_rank_252d", "within_basket_rank"), ("rs_rating_slope_60d", "within_basket_z_21d", "mtf_rs_coherence", "weekly_rsi_14")):
        got = features.selected_features(s.dense(), BENCHMARKS, only, s.bound)
        shown = lambda df: df.select("entity", "date", *[F.round(c, 9).alias(c) for c in sorted(only)])
        assert got.count() == whole.count() > 0 and shown(got).exceptAll(shown(whole)).count() == 0
        assert len(asked[-1][1]) <= len(only) + 2 and "vcp_quality_score" not in asked[-1][0]


def test_supplier_days_are_made_from_bars_alone(spark, monkeypatch):
    """No dense table of days is written or dealt; every feature equals that of the dense plan."""
    from panelwave.operators import carried, features
    from panelwave.plans import queries as q
    from panelwave.plans.panels import BENCHMARKS, PanelSource

    folder = "/root/testdata/sf0.001"
    s = PanelSource(spark, folder, "sd")
    whole = features.compute_features(s.dense(), BENCHMARKS, s.bound)
    got = carried.carried_features(s.traded, s.trading_days, config.FEATURES, s.bound, BENCHMARKS)
    kinds = dict(whole.dtypes)
    shown = lambda df: df.select("entity", "date", *[F.round(c, 9).alias(c) if kinds[c] == "double" else c for c in config.FEATURES])
    assert got.count() == whole.count() > 0 and shown(got).exceptAll(shown(whole)).count() == 0
    monkeypatch.setattr(B, "densify", lambda *a: pytest.fail("the days were laid out by Spark"))
    q.clear_stages()
    assert q.features_supplier_day(spark, folder).count() == q.z_supplier_day(spark, folder).count() == whole.count()


def test_a_contracting_base_ends_at_its_last_peak():
    """What follows the last peak belongs to no segment."""
    from panelwave.operators.carried import contracting_base

    dips = [40, 20, 5]  # segments of 30 rows, each less deep and on less volume than the one before
    close = [90 - 3 * abs(i) for i in range(-10, 0)]
    for dip in dips:
        close += [100.0, *[100.0 - dip + abs(i - 14) / 100 for i in range(29)]]
    close += [100.0, *[99.0 - i for i in range(40)]]
    volume = np.repeat([9.0, 9.0, 5.0, 1.0, 50.0], [10, 30, 30, 30, 41])
    got = contracting_base(np.array(close), volume)
    assert not got[:100].any() and np.allclose(got[100:], 70.0 + (0.08 - 0.05) / 0.08 * 30.0)


def test_scores_on_their_dates_equal_the_general_plan(spark):
    from panelwave.operators.score import graded, matrix_composite, matrix_score, score

    def fn(x):
        k = len(config.COMPONENTS)
        return matrix_score(matrix_composite(x[:, :k], list(x[:, k:].T))[:, None])

    rng = random.Random(3)
    rows = [(f"E{i}", dt.date(2000, 1, 1 + day), *[None if rng.random() < .1 else round(rng.gauss(0, 1), 1) for _ in config.COMPONENTS],
             *[1.0 / len(config.STATES)] * len(config.STATES)) for day, n in ((0, 40), (1, 1), (2, 2), (3, 0), (4, 25)) for i in range(n)]
    rows += [(f"E{i}", dt.date(2000, 2, 1), *[0.1] * len(config.COMPONENTS), *[1.0 / len(config.STATES)] * len(config.STATES)) for i in range(7)]
    rows += [("E9", dt.date(2000, 2, 2), *[None] * len(config.COMPONENTS), *[1.0 / len(config.STATES)] * len(config.STATES))]
    names = [*config.COMPONENTS, *[f"p_adj_{s}" for s in config.STATES]]
    df = spark.createDataFrame(rows, "entity string, date date, " + ", ".join(f"{c} double" for c in names))
    shown = lambda x: sorted(map(str, x.select("entity", "date", F.round("score", 9), "grade").collect()))
    got = graded(xs.matrix_columns(df, ["date"], names, ["score", "_place"], fn))
    assert shown(got) == shown(score(df, xs.Bound(50, 10)))
