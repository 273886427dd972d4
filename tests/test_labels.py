"""Every label and code at its boundary: expected names are typed here, not taken from the library."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwave.operators import cascades, quality, themes


def frame(spark, base: dict, rows: list[dict]):
    """One row per override of base; numbers are doubles."""
    full = [{k: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for k, v in (base | r).items()} for r in rows]
    kinds = {float: T.DoubleType(), bool: T.BooleanType(), str: T.StringType()}
    fields = []
    for k in base:
        seen = next((v for r in full if (v := r[k]) is not None), 0.0)
        fields.append(T.StructField(k, kinds[type(seen)]))
    return spark.createDataFrame([tuple(r[k] for k in base) for r in full], T.StructType(fields)).coalesce(1)


TIER = dict(s_rs_leadership_0_100=50, rs_rating_spy=50, rs_rating_slope_60d=0, mtf_rs_coherence=0, volume_leadership_confirmed=0,
            within_basket_rank=5, rs_line_qqq_slope_60d=0, rs_line_spy_new_high_252d=0)
ELITE = dict(s_rs_leadership_0_100=90, rs_rating_spy=95, mtf_rs_coherence=3, volume_leadership_confirmed=1, within_basket_rank=1, rs_line_qqq_slope_60d=.1)


def test_leadership_tiers(spark):
    cases = [
        (ELITE, "ELITE_LEADER"), (ELITE | dict(s_rs_leadership_0_100=89.99), "STRONG_LEADER"), (ELITE | dict(within_basket_rank=2), "STRONG_LEADER"),
        (dict(s_rs_leadership_0_100=80, rs_rating_spy=75, mtf_rs_coherence=2), "STRONG_LEADER"),
        (dict(rs_rating_spy=60, rs_rating_slope_60d=10, mtf_rs_coherence=2, rs_line_qqq_slope_60d=.1), "EMERGING_LEADER"),
        (dict(rs_rating_spy=85, rs_rating_slope_60d=10, mtf_rs_coherence=2, rs_line_qqq_slope_60d=0), "STRONG_PERFORMER"),
        (dict(rs_rating_spy=75, rs_line_spy_new_high_252d=1), "ESTABLISHED_LEADER"), (dict(rs_rating_spy=60), "STRONG_PERFORMER"),
        (dict(rs_rating_spy=39, rs_rating_slope_60d=-5.01), "DETERIORATING"), (dict(rs_rating_spy=24, rs_rating_slope_60d=-5), "WEAK_LAGGARD"),
        (dict(rs_rating_spy=25, rs_rating_slope_60d=-5), "WEAK_PERFORMER"), (dict(rs_rating_spy=45), "NEUTRAL"), (dict(rs_rating_spy=59.9), "NEUTRAL"),
        (dict(rs_rating_spy=24), "UNCLASSIFIED"), (dict(rs_rating_spy=30, rs_rating_slope_60d=None), "UNCLASSIFIED"),
        (dict(rs_rating_spy=44.9, rs_rating_slope_60d=-6), "UNCLASSIFIED"),
    ]
    from panelwave.functions.expr import first_match

    df = frame(spark, TIER, [c for c, _ in cases])
    assert [r[0] for r in df.select(first_match(cascades.leadership_rules(), "UNCLASSIFIED")).collect()] == [n for _, n in cases]


SETUP = dict(close=100, ema_21=90, sma_50=80, sma_200=70, pct_ma_50=5, pct_ma_50_p80_252d=9, _adr_rank=.9, pct_from_52w_high=-30, pct_from_20d_high=-1,
             pct_from_52w_low=50, position_in_60d_range=.9, new_252d_high=0, _prior_max=200, _prior_min=10, true_range_x_atr14=1,
             failed_breakout_flag_5d_v2=0, failed_breakdown_flag_5d_v2=0, range_20d_to_60d_ratio=.9, bb_width_pct_252d=50, range_60d_pct_of_price=50)
FLAT = dict(ema_21=110)  # no bullish stack


def test_setups(spark):
    cases = [
        (dict(new_252d_high=1), "New High"), (dict(new_252d_high=1, pct_ma_50=9.1), "Extended"),
        (dict(_prior_max=99, true_range_x_atr14=1.31), "Breakout"), (dict(_prior_max=99, true_range_x_atr14=1.3), ""),
        (dict(failed_breakout_flag_5d_v2=1), "Failed Breakout"), (dict(_adr_rank=.25, pct_from_52w_high=-5), "Tight Base"),
        (dict(_adr_rank=.25, pct_from_52w_high=-5.01), ""), (dict(_adr_rank=.26, pct_from_52w_high=-5), "At Highs"),
        (dict(range_20d_to_60d_ratio=.59, bb_width_pct_252d=20), "Coiling"), (dict(range_20d_to_60d_ratio=.6, bb_width_pct_252d=20), ""),
        (dict(pct_from_20d_high=-3), "Shallow Pullback"), (dict(pct_from_20d_high=-10), "Shallow Pullback"), (dict(pct_from_20d_high=-10.01), "Deep Pullback"),
        (dict(pct_from_20d_high=-20), "Deep Pullback"), (dict(pct_from_20d_high=-20.01), ""), (dict(pct_ma_50=9.01), "Extended"),
        (FLAT | dict(pct_from_52w_low=10, _adr_rank=.4), "Basing Low"), (FLAT | dict(pct_from_52w_low=10, _adr_rank=.41), ""),
        (FLAT | dict(close=75, _prior_min=76), "Breakdown"), (FLAT | dict(failed_breakdown_flag_5d_v2=1), "Reclaim"),
        (FLAT | dict(range_60d_pct_of_price=19.9, position_in_60d_range=.25), "Sideways"), (FLAT | dict(range_60d_pct_of_price=20, position_in_60d_range=.5), ""),
        (FLAT | dict(range_60d_pct_of_price=19.9, position_in_60d_range=.751), ""), (dict(pct_ma_50_p80_252d=None, new_252d_high=1), ""),
    ]
    from panelwave.functions.expr import all_matches, first_match

    df = frame(spark, SETUP, [c for c, _ in cases])
    got = df.select(first_match(cascades.setup_rules(), ""), all_matches(cascades.setup_rules())).collect()
    assert [r[0] for r in got] == [n for _, n in cases]
    assert {n for _, n in cases} == {"", *(n for n, _ in cascades.setup_rules())}
    assert all((r[1][0] if r[1] else "") == r[0] for r in got)


LEGACY = dict(close=100, ema_21=50, sma_50=50, atr_14=1, atr_x_50=0, pct_ma_50=0, rs_rating_spy=50, sma_stack_score=0, ema_stack_score=0, adx_14=0,
              bb_squeeze_flag=0, bb_width_pct_252d=50, vcp_quality_score=0, bearish_divergence_20d=0, bullish_divergence_20d=0, climax_volume_flag=0,
              capitulation_volume_flag=0, days_near_52w_high_60d=0, distribution_days_25=0, p_TRENDING=0, p_PULLBACK=0, is_basket_leader=False,
              up_down_vol_ratio_50=1, supertrend_direction=-1, volume_z_20_252=0, failed_breakout_flag_10d=0, leadership_tier="NEUTRAL", primary_state="INDETERMINATE")


def test_legacy_setups(spark):
    e = dict(leadership_tier="ELITE_LEADER")
    cases = [
        (dict(atr_x_50=6.5), "Extreme Extension", .95), (dict(atr_x_50=4, bearish_divergence_20d=1, rs_rating_spy=85), "Exhaustion w/ Bearish Divergence", .9),
        (dict(atr_x_50=4.5, climax_volume_flag=1), "Volume-Confirmed Exhaustion", .9), (dict(atr_x_50=4, days_near_52w_high_60d=15, rs_rating_spy=80), "Extended Exhaustion", .75),
        (dict(pct_ma_50=-8.01, capitulation_volume_flag=1), "Capitulation Selling", .85), (dict(pct_ma_50=-5.01, bullish_divergence_20d=1), "Deteriorating w/ Bullish Divergence", .8),
        (dict(pct_ma_50=-5.01, distribution_days_25=8), "Distribution Pattern", .85), (dict(pct_ma_50=-8.01), "Sustained Weakness", .7),
        (e | dict(p_TRENDING=.51), "Elite Leader Continuation", .95), (e | dict(p_PULLBACK=.51), "Elite Leader Pullback", .95),
        (dict(sma_stack_score=85, ema_stack_score=70, pct_ma_50=1, atr_x_50=2.4, rs_rating_spy=80, up_down_vol_ratio_50=1.3), "Premium Pullback", .95),
        (dict(is_basket_leader=True, p_PULLBACK=.41), "Theme Leader Pullback", .8), (dict(sma_stack_score=85, adx_14=25, rs_rating_spy=80, supertrend_direction=1), "Trend Continuation", .9),
        (dict(sma_stack_score=75, adx_14=20, rs_rating_spy=80), "Trending Leadership", .85), (dict(sma_stack_score=80, ema_21=99.31, rs_rating_spy=75), "Pullback to 21EMA", .85),
        (dict(sma_stack_score=75, sma_50=98.81, rs_rating_spy=70), "Pullback to 50MA", .8),
        (dict(bb_squeeze_flag=1, vcp_quality_score=70, rs_rating_spy=85, volume_z_20_252=.5), "Tight Consolidation Pre-Breakout", .9),
        (dict(vcp_quality_score=60, rs_rating_spy=75, sma_stack_score=75), "VCP Setup", .8), (dict(bb_squeeze_flag=1, bb_width_pct_252d=19.9, rs_rating_spy=70), "BB Squeeze with RS", .75),
        (dict(bb_width_pct_252d=14.9), "Range Consolidation", .7), (dict(failed_breakout_flag_10d=1, pct_ma_50=-.1), "Failed Breakout", .85),
        (dict(primary_state="TRENDING"), "Trending (Generic)", .65), (dict(primary_state="PULLBACK"), "Routine Pullback", .65),
        (dict(primary_state="CONSOLIDATING"), "Consolidating (Generic)", .65), (dict(primary_state="EXHAUSTION"), "Exhaustion (Generic)", .65),
        (dict(primary_state="DETERIORATING"), "Deteriorating (Generic)", .65), ({}, "Indeterminate Pattern", .55), (dict(atr_x_50=6.49), "Indeterminate Pattern", .55),
    ]
    got = cascades.legacy_setups(frame(spark, LEGACY, [c for c, _, _ in cases])).select("legacy_setup", "legacy_confidence").collect()
    assert [tuple(r) for r in got] == [(n, p) for _, n, p in cases]
    assert len({n for _, n, _ in cases}) == 27


def test_theme_and_concentration_classes(spark):
    base = dict(theme_score=50, momentum_class="STABLE", theme_rs_new_252d_high=0, pct_above_50dma=0, leadership_concentration="BROAD", pct_deteriorating=0)
    cases = [
        (dict(theme_score=90, momentum_class="MODERATE_ACCELERATING", theme_rs_new_252d_high=1, pct_above_50dma=75), "ELITE_THEME"),
        (dict(theme_score=90, momentum_class="STABLE", theme_rs_new_252d_high=1, pct_above_50dma=75), "STRONG_THEME"),
        (dict(theme_score=80, theme_rs_new_252d_high=1, pct_above_50dma=60), "STRONG_THEME"),
        (dict(theme_score=60, momentum_class="STRONG_ACCELERATING", pct_above_50dma=50), "EMERGING_THEME"), (dict(theme_score=75, leadership_concentration="CONCENTRATED"), "NARROW_LEADERSHIP"),
        (dict(theme_score=50), "STABLE"), (dict(theme_score=49.9, momentum_class="WEAKENING"), "WEAKENING"), (dict(theme_score=49.9, pct_deteriorating=30), "BROKEN_THEME"),
        (dict(theme_score=49.9), "MIXED"), (dict(theme_score=75), "MIXED"), (dict(theme_score=None), None),
    ]
    got = frame(spark, base, [c for c, _ in cases]).select(cascades.theme_class()).collect()
    assert [r[0] for r in got] == [n for _, n in cases]
    df = spark.createDataFrame([(.35,), (.351,), (.5,), (.501,), (None,)], "x double").coalesce(1)
    assert [r[0] for r in df.select(cascades.concentration_class(F.col("x"))).collect()] == ["BROAD", "MODERATE", "MODERATE", "CONCENTRATED", None]


def bars(entity: str, n: int = 300, volume=1e6, close=100.0, last: dt.date = dt.date(2020, 12, 31), change=lambda k, r: r):
    out = []
    for k in range(n):  # k = age in days
        r = dict(entity=entity, date=last - dt.timedelta(days=k), open=close * .98, high=close * 1.02, low=close * .97, close=close, adj_close=close, volume=float(volume))
        out.append(change(k, r))
    return out


def scaled(r: dict, f: float) -> dict:
    return r | {c: r[c] * f for c in ("open", "high", "low", "close", "adj_close")}


FIREWALL = {
    "NO_DATA": None, "INSUFFICIENT_HISTORY": bars("INSUFFICIENT_HISTORY", 251), "PASS": bars("PASS"),
    "STALE_DATA": bars("STALE_DATA", last=dt.date(2020, 12, 25)), "FRESH": bars("FRESH", last=dt.date(2020, 12, 26)),
    "INVALID_PRICES": bars("INVALID_PRICES", change=lambda k, r: r | dict(low=0.0) if k == 200 else r),
    "ZERO_VOLUME": bars("ZERO_VOLUME", change=lambda k, r: r | dict(volume=0.0) if k < 20 else r),
    "INSUFFICIENT_LIQUIDITY": bars("INSUFFICIENT_LIQUIDITY", volume=999), "LOW_LIQUIDITY": bars("LOW_LIQUIDITY", volume=9_999),
    "SUSPICIOUS_BAR": bars("SUSPICIOUS_BAR", change=lambda k, r: r | dict(high=300.0, low=80.0, open=99.0, volume=9e6) if k == 5 else r),
    "LARGE_GAP_RECENT": bars("LARGE_GAP_RECENT", change=lambda k, r: scaled(r, 1.31) if k <= 3 else r),
    "VOLUME_COLLAPSE": bars("VOLUME_COLLAPSE", volume=1e9, change=lambda k, r: r | dict(volume=1e7) if k < 20 else r),
    "FREQUENT_GAPS": bars("FREQUENT_GAPS", change=lambda k, r: scaled(r, 1.06) if k in (1, 3, 5) else r),
    "FREQUENT_DOJI": bars("FREQUENT_DOJI", change=lambda k, r: r | dict(open=r["close"] * .999) if k < 5 else r),
    "POSSIBLE_CORPORATE_ACTION": bars("POSSIBLE_CORPORATE_ACTION", change=lambda k, r: r | dict(adj_close=50.0) if k > 100 else r),
}


def test_firewall_codes(spark):
    rows = [r for v in FIREWALL.values() for r in v or []]
    fields = ("entity", "date", "open", "high", "low", "close", "adj_close", "volume")
    df = spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], "entity string, date date, open double, high double, low double, close double, adj_close double, volume double")
    universe = spark.createDataFrame([(k,) for k in FIREWALL], "entity string")
    got = {r.entity: r for r in quality.firewall(df, universe).collect()}
    assert got["PASS"].status == got["FRESH"].status == "PASS"
    for code in FIREWALL:
        if code not in ("PASS", "FRESH"):
            r = got[code]
            assert code in (*r.critical, *r.warnings), (code, r)
            assert r.status == ("FAIL" if code in r.critical else "WARNING")
    kept = {r.entity for r in quality.passing(quality.firewall(df, universe)).collect()}
    assert kept == {k for k, r in got.items() if r.status != "FAIL"}


def test_forced_states(spark):
    scored = spark.createDataFrame([("a", "PULLBACK"), ("b", "TRENDING")], "entity string, primary_state string")
    over = spark.createDataFrame([("a", "force_state", "EXHAUSTION"), ("b", "flag", "")], "entity string, kind string, value string")
    assert dict(quality.forced_states(scored, over).select("entity", "primary_state").collect()) == {"a": "EXHAUSTION", "b": "TRENDING"}


def test_membership_and_union(spark):
    m = spark.createDataFrame([("G", "x", True), ("H", "y", True), ("T", "x", False)], "basket string, entity string, is_primary boolean")
    m = m.withColumns({"category": F.lit("C"), "basket_type": F.when(F.col("is_primary"), "CORE").otherwise("TAG")})
    assert {r[0] for r in themes.tagged(m, "T").collect()} == {"x"} and {r[0] for r in themes.constituents(m, "H").collect()} == {"y"}
    got = {r.entity: (r.basket, r.only_new) for r in themes.combined_universe(m.where("basket = 'G'"), m.where("basket <> 'G'")).collect()}
    assert got == {"x": ("G", False), "y": ("H", True)}


@pytest.mark.parametrize("need, left", [(3, {"big"}), (2, {"big", "pair"})])
def test_active_membership(spark, need, left):
    m = spark.createDataFrame([("big", e) for e in "abcd"] + [("pair", "a"), ("pair", "b"), ("gone", "a"), ("gone", "y"), ("gone", "z")], "basket string, entity string")
    present = spark.createDataFrame([(e,) for e in "abcd"], "entity string")
    assert {r.basket for r in themes.active_membership(m, present, need).collect()} == left
