"""Corporate-action and anomaly detection, sanity and consistency checks, coverage reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwave import config
from panelwave.functions.expr import div, flag, lookup
from panelwave.functions.rolling import TimeAxis

col = F.col


# ---- corporate actions --------------------------------------------------------------------------
def corporate_actions(bars: DataFrame, ratio_jump: float = 0.10, return_gap: float = 0.05, halt_days: int = 5) -> DataFrame:
    """Event rows (entity, date, type) on the entity's own rows: split, spinoff, halt."""
    w = TimeAxis("entity", "date")
    c, a = col("close"), col("adj_close")
    ratio = F.when((a > 0) & (c > 0), c / a)
    x = bars.select(
        "entity", "date",
        F.coalesce(F.abs(div(ratio, w.lag(ratio)) - 1.0) > ratio_jump, F.lit(False)).alias("_split"),
        F.coalesce(F.abs((div(c, w.lag(c)) - 1.0) - (div(a, w.lag(a)) - 1.0)) > return_gap, F.lit(False)).alias("_spin"),
        F.coalesce(F.datediff(col("date"), w.lag(col("date"))) > halt_days, F.lit(False)).alias("_halt"),
    )
    kinds = F.filter(F.array(
        F.when(col("_split"), "split"), F.when(col("_spin") & ~col("_split"), "spinoff"), F.when(col("_halt"), "halt"),
    ), lambda k: k.isNotNull())
    return x.select("entity", "date", F.explode(kinds).alias("type"))


def action_summary(events: DataFrame, last_date: DataFrame, recent_days: int = 30) -> DataFrame:
    """Count per event type, total and in the last ``recent_days``. ``last_date`` is one row (date)."""
    ref = last_date.select(F.date_sub("date", recent_days).alias("_from"))
    return events.join(F.broadcast(ref)).groupBy("type").agg(
        F.count("*").alias("n_events"), F.count_if(col("date") >= col("_from")).alias("n_recent"))


def most_affected(events: DataFrame, n: int = 20) -> DataFrame:
    return (events.groupBy("entity").agg(F.count("*").alias("n_events"))
            .orderBy(col("n_events").desc(), "entity").limit(n))


# ---- anomalies ----------------------------------------------------------------------------------
def _latest(df: DataFrame) -> DataFrame:
    last = df.agg(F.max("date").alias("date"))  # exactly one row
    return df.join(F.broadcast(last), "date", "left_semi")


def score_anomalies(scored: DataFrame, jump: float = 25.0, z_limit: float = 2.5, rows: int = 5) -> DataFrame:
    w = TimeAxis("entity", "date")
    s = col("score")
    before = w.frame(-rows, -1)
    full = F.count(s).over(before) == rows
    x = scored.select(
        "entity", "date", "score", w.lag(s).alias("score_prev"),
        F.when(full, F.avg(s).over(before)).alias("_m"), F.when(full, F.stddev_samp(s).over(before)).alias("_s"))
    x = x.select("entity", "date", "score", "score_prev", F.abs(col("score") - col("score_prev")).alias("abs_jump"),
                 div(col("score") - col("_m"), col("_s")).alias("roll_z"))
    hit = F.coalesce(col("abs_jump") > jump, F.lit(False))
    return _latest(x).where(hit | (F.abs("roll_z") > z_limit)).select(
        "*", F.lit("score_jump").alias("type"), F.when(hit, "high").otherwise("medium").alias("severity"))


def grade_anomalies(scored: DataFrame, levels: int = 2) -> DataFrame:
    w = TimeAxis("entity", "date")
    rank = lookup(col("grade"), config.GRADE_ORDER)
    x = scored.select("entity", "date", "grade", w.lag(col("grade")).alias("grade_prev"),
                      F.abs(rank - w.lag(rank)).alias("gap"))
    return _latest(x).where(col("gap") >= levels).select(
        "*", F.lit("grade_jump").alias("type"), F.when(col("gap") >= levels + 1, "high").otherwise("medium").alias("severity"))


def state_anomalies(scored: DataFrame, pairs: Sequence[tuple[str, str]] = config.NON_ADJACENT_STATES) -> DataFrame:
    w = TimeAxis("entity", "date")
    s = col("primary_state")
    x = scored.select("entity", "date", s.alias("s0"), w.lag(s, 1).alias("s1"), w.lag(s, 2).alias("s2"))
    bad = {"|".join(sorted(p)) for p in pairs}

    def far(a: str, b: str) -> Column:
        return F.array_join(F.array_sort(F.array(a, b)), "|").isin(*sorted(bad))

    return _latest(x).where((col("s0") != col("s1")) & (col("s1") != col("s2")) & (far("s0", "s1") | far("s1", "s2"))).select(
        "entity", "date", F.array("s2", "s1", "s0").alias("states"), F.lit("state_flip").alias("type"),
        F.lit("medium").alias("severity"))


def anomalies(scored: DataFrame) -> DataFrame:
    """All anomalies of the latest date, most severe first."""
    keep = ["entity", "date", "type", "severity"]
    out = score_anomalies(scored).select(*keep).unionByName(grade_anomalies(scored).select(*keep)).unionByName(
        state_anomalies(scored).select(*keep))
    return out.orderBy(lookup(col("severity"), {"high": 0, "medium": 1, "low": 2}),
                       lookup(col("type"), {"score_jump": 0, "grade_jump": 1, "state_flip": 2}), "entity")


def anomaly_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("type").agg(F.count("*").alias("n"), F.count_if(col("severity") == "high").alias("n_high"))


def label_transitions(scored: DataFrame, label: str, last_dates: DataFrame) -> DataFrame:
    """Label changes per entity inside the given dates (5 or more in 30 = flicker)."""
    w = TimeAxis("entity", "date")
    x = scored.join(last_dates.select("date"), "date", "left_semi")
    x = x.select("entity", (col(label) != w.lag(col(label))).cast("long").alias("_c"))
    return x.groupBy("entity").agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("transitions"))


# ---- sanity checks ------------------------------------------------------------------------------
def _check(name: str, passed: Column, observed: Column, expected: str) -> Column:
    return F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"),
                    observed.cast("string").alias("observed"), F.lit(expected).alias("expected"))


def sanity_checks(scored: DataFrame, themes: DataFrame, as_of: Column, *, s_share=(2.0, 15.0), theme_coverage=0.5,
                  fresh_days: int = 5, coverage: int = 750, recent_dates: int = 30) -> DataFrame:
    """Eleven output assertions; thresholds are parameters. One aggregate over each table."""
    def total(prefix: str) -> Column:
        return sum((F.coalesce(col(f"{prefix}{s}"), F.lit(0.0)) for s in config.STATES[1:]),
                   F.coalesce(col(f"{prefix}{config.STATES[0]}"), F.lit(0.0)))

    inf = F.lit(False)
    for c in config.COMPONENTS:
        inf = inf | F.coalesce(F.abs(col(c)) == float("inf"), F.lit(False))
    recent = scored.select("date").distinct().orderBy(col("date").desc()).limit(recent_dates)
    covered = (scored.join(F.broadcast(recent), "date", "left_semi").where(col("score").isNotNull())
               .agg(F.count_distinct("entity").alias("n_covered")))
    main = scored.agg(
        F.count_if((col("score") < 0) | (col("score") > 100)).alias("oob"),
        F.count_if(F.abs(total("p_") - 1) > 1e-3).alias("bad_p"),
        F.count_if(F.abs(total("p_adj_") - 1) > 1e-3).alias("bad_adj"),
        F.count_if(inf).alias("n_inf"),
        (F.count_if(col("grade") == "S") / F.count("*") * 100.0).alias("s_pct"),
        F.count_if(col("leadership_tier").isNotNull() & ~col("leadership_tier").isin(*config.TIERS)).alias("bad_tier"),
        F.count_if((col("setup_confidence") < 0) | (col("setup_confidence") > 1)).alias("bad_conf"),
        F.count_if(col("entity").isNull() | col("date").isNull()).alias("bad_key"),
        F.max("date").alias("max_date"),
    )
    th = themes.agg((F.count("theme_score") / F.count("*")).alias("theme_ratio"))
    one = main.join(F.broadcast(th)).join(F.broadcast(covered))  # each side is exactly one row
    age = F.datediff(as_of, col("max_date"))
    checks = [
        _check("score_in_0_100", col("oob") == 0, col("oob"), "0 rows outside [0,100]"),
        _check("state_probs_sum_to_1", col("bad_p") == 0, col("bad_p"), "0 rows off by more than 1e-3"),
        _check("state_p_adj_sum_to_1", col("bad_adj") == 0, col("bad_adj"), "0 rows off by more than 1e-3"),
        _check("no_inf_components", col("n_inf") == 0, col("n_inf"), "no infinite component"),
        _check("grade_s_pct_in_range", col("s_pct").between(*s_share), F.round("s_pct", 2), f"between {s_share[0]} and {s_share[1]}"),
        _check("leadership_tier_values_valid", col("bad_tier") == 0, col("bad_tier"), "known tiers only"),
        _check("setup_confidence_in_0_1", col("bad_conf") == 0, col("bad_conf"), "0 rows outside [0,1]"),
        _check("index_alignment", col("bad_key") == 0, col("bad_key"), "every row keyed"),
        _check("theme_score_coverage", col("theme_ratio") >= theme_coverage, F.round("theme_ratio", 4), f">= {theme_coverage}"),
        _check("features_fresh", age <= fresh_days, age, f"<= {fresh_days} days"),
        _check("universe_coverage", col("n_covered") >= coverage, col("n_covered"), f">= {coverage} entities"),
    ]
    return one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def key_alignment(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("entity", "date")) -> DataFrame:
    """Row counts, keys on one side only, and agreement of the latest date."""
    l = left.select(*keys, F.lit(1).alias("_l"))
    r = right.select(*keys, F.lit(1).alias("_r"))
    return l.join(r, list(keys), "full").agg(
        F.count("_l").alias("n_left"), F.count("_r").alias("n_right"),
        F.count_if(col("_r").isNull()).alias("only_left"), F.count_if(col("_l").isNull()).alias("only_right"),
        (F.max(F.when(col("_l").isNotNull(), col("date"))) == F.max(F.when(col("_r").isNotNull(), col("date")))).alias("same_latest"),
    )


# ---- level-3 consistency findings ---------------------------------------------------------------
FEATURE_BOUNDS = {  # (low, high, hard) - fixed values
    "rs_rating_spy": (0.0, 100.0, True), "pct_ma_50": (-50.0, 100.0, False), "pct_ma_200": (-70.0, 200.0, False),
    "adx_14": (0.0, 100.0, True), "rsi_14": (0.0, 100.0, True), "atr_x_50": (-20.0, 20.0, False),
    "sharpe_rank_252d": (0.0, 100.0, True), "information_ratio_252d": (-10.0, 15.0, False),
}
STRONG = ("ELITE_LEADER", "STRONG_LEADER", "EMERGING_LEADER", "ESTABLISHED_LEADER", "STRONG_PERFORMER")
WEAK = ("WEAK_PERFORMER", "DETERIORATING", "WEAK_LAGGARD")


def _findings(df: DataFrame, rules: Sequence[tuple[str, str, Column, Column]], key: str = "entity") -> DataFrame:
    """(key, check, severity, observed) for every rule that holds on a row."""
    found = F.array(*[
        F.when(cond, F.struct(F.lit(n).alias("check"), F.lit(sev).alias("severity"), obs.cast("string").alias("observed")))
        for n, sev, cond, obs in rules])
    return df.select(col(key).alias("entity"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("entity", "f.*")


def price_freshness(bars: DataFrame, calendar: DataFrame, max_rows: int = 5) -> DataFrame:
    """Entities whose last bar is more than max_rows trading days behind the calendar."""
    last = calendar.agg(F.max("t").alias("_last"))  # exactly one row
    t = bars.join(calendar.select("date", "t"), "date").groupBy("entity").agg(F.max("t").alias("_t"))
    x = t.join(F.broadcast(last)).withColumn("rows_behind", col("_last") - col("_t"))
    return x.where(col("rows_behind") > max_rows).select("entity", "rows_behind")


def feature_bounds(latest: DataFrame, bounds: Mapping = FEATURE_BOUNDS) -> DataFrame:
    return _findings(latest, [
        (f"C_{f}_bounds", "ERROR" if hard else "WARN", (col(f) < lo) | (col(f) > hi), F.round(f, 3))
        for f, (lo, hi, hard) in bounds.items()])


#: (check, column, low, high, severity): rules are data, one for each range
RANGE_RULES = (
    *[(f"C_{f}_bounds", f, lo, hi, "ERROR" if hard else "WARN") for f, (lo, hi, hard) in FEATURE_BOUNDS.items()],
    *[(f"D_{c}_extreme", c, -5.0, 5.0, "WARN") for c in config.COMPONENTS],
    ("E_score_bounds", "score", 0.0, 100.0, "ERROR"),
    *[(f"F_p_{s}_bounds", f"p_{s}", -1e-6, 1 + 1e-6, "ERROR") for s in config.STATES],
    ("H_setup_confidence_bounds", "setup_confidence", 0.0, 1.0, "ERROR"),
    ("I_theme_score_bounds", "theme_score", 0.0, 100.0, "ERROR"), ("I_theme_breadth_bounds", "pct_above_50dma", 0.0, 100.0, "ERROR"),
)
RULE_SCHEMA = "check string, column string, low double, high double, severity string"


def range_findings(df: DataFrame, rules: DataFrame, key: str = "entity") -> DataFrame:
    """(entity, check, severity, observed, low, high) for every value outside the range of a rule on its column.

    rules is a table (RULE_SCHEMA), so a new check is a new row. Columns that df lacks are passed over; nulls break no rule.
    """
    named = {r.column for r in rules.select("column").distinct().collect()}  # at most one for each column of df is used
    columns = [c for c in df.columns if c in named]
    wide = df.select(col(key).alias("entity"), *[col(c).cast("double").alias(c) for c in columns])
    tall = wide.unpivot("entity", columns, "column", "observed")
    own = F.broadcast(rules.where(col("column").isin(columns)))  # rows for the columns of one table
    return tall.join(own, "column").where((col("observed") < col("low")) | (col("observed") > col("high"))).select(
        "entity", "check", "severity", "observed", "low", "high")


def all_findings(latest: DataFrame, themes: DataFrame, members: DataFrame, rules: DataFrame) -> DataFrame:
    """Every finding on the latest date, errors first: range rules, then consistency of scores, states, tiers, setups, themes."""
    ranges = range_findings(latest, rules).unionByName(range_findings(themes, rules, "basket"))
    known = [r.check for r in rules.select("check").collect()]
    rest = [score_findings(latest), state_findings(latest), tier_findings(latest), setup_findings(latest), theme_findings(themes, members),
            orphans(latest, members)]
    others = reduce(DataFrame.unionByName, rest).where(~col("check").isin(known)).select("entity", "check", "severity")
    found = ranges.unionByName(others, allowMissingColumns=True)
    return found.orderBy(lookup(col("severity"), {"ERROR": 0, "WARN": 1}), "check", "entity")


def component_health(latest: DataFrame, null_rate: float = 0.05, z_limit: float = 5.0) -> DataFrame:
    """Per component: rows, infinite values, NULL rate and |z| beyond the limit, with a verdict."""
    aggs = []
    for c in config.COMPONENTS:
        x = col(c)
        aggs.append(F.struct(
            F.lit(c).alias("component"), F.count("*").alias("n"), F.count_if(F.abs(x) == float("inf")).alias("n_inf"),
            F.count_if(x.isNull()).alias("n_null"), F.count_if(F.abs(x) > z_limit).alias("n_extreme")).alias(c))
    wide = latest.agg(*aggs)
    tall = wide.select(F.explode(F.array(*config.COMPONENTS)).alias("s")).select("s.*")
    rate = col("n_null") / col("n")
    return tall.select("*", rate.alias("null_rate"), F.when(col("n_inf") > 0, "ERROR").when(
        (rate > null_rate) | (col("n_extreme") > 0), "WARN").otherwise("OK").alias("verdict"))


def score_findings(latest: DataFrame) -> DataFrame:
    """Score bounds, unexplained NULL scores and grade validity on one date."""
    missing = sum((col(c).isNull().cast("int") for c in config.COMPONENTS[1:]), col(config.COMPONENTS[0]).isNull().cast("int"))
    s = col("score")
    return _findings(latest, [
        ("E_score_bounds", "ERROR", s.isNotNull() & ((s < 0) | (s > 100)), F.round(s, 3)),
        ("E_score_null_from_components", "WARN", s.isNull() & (missing > 0), missing),
        ("E_score_null_with_components", "ERROR", s.isNull() & (missing == 0), F.lit("components present")),
        ("E_grade_value", "ERROR", s.isNotNull() & ~F.coalesce(col("grade").isin("S", "A", "B", "C", "D"), F.lit(False)), col("grade")),
    ])


def grade_monotonic(latest: DataFrame) -> DataFrame:
    """Median score per grade and whether it exceeds the better grade's median (should be false)."""
    med = latest.where(col("grade").isNotNull()).groupBy("grade").agg(F.median("score").alias("median_score"))
    w = Window.orderBy("_g")  # at most five rows
    return med.withColumn("_g", lookup(col("grade"), config.GRADE_ORDER)).select(
        "grade", "median_score",
        F.coalesce(col("median_score") > F.lag("median_score").over(w) + 1e-6, F.lit(False)).alias("inverted"))


def state_findings(latest: DataFrame) -> DataFrame:
    probs = [col(f"p_{s}") for s in config.STATES]
    total = sum(probs[1:], probs[0])
    names = F.array(*[F.lit(s) for s in config.STATES])
    arr = F.array(*probs)
    top = F.element_at(names, F.array_position(arr, F.array_max(arr)).cast("int"))
    rules = [("F_state_probs_sum", "ERROR", F.abs(total - 1.0) > 0.001, F.round(total, 4))]
    rules += [(f"F_p_{s}_bounds", "ERROR", (p < -1e-6) | (p > 1 + 1e-6), F.round(p, 4)) for s, p in zip(config.STATES, probs, strict=True)]
    rules += [("F_state_assignment", "WARN", col("primary_state") != top, F.concat_ws(" vs ", "primary_state", top))]
    return _findings(latest, rules)


def tier_findings(latest: DataFrame) -> DataFrame:
    r, t = col("rs_rating_spy"), F.coalesce("leadership_tier", F.lit("NULL"))
    return _findings(latest, [
        ("G_tier_value", "ERROR", ~t.isin(*config.TIERS), t),
        ("G_high_rs_weak_tier", "WARN", (r > 80) & ~t.isin(*STRONG), t),
        ("G_low_rs_strong_tier", "WARN", (r < 20) & ~t.isin(*WEAK), t),
    ])


def setup_findings(latest: DataFrame) -> DataFrame:
    c = col("setup_confidence")
    return _findings(latest, [
        ("H_setup_confidence_bounds", "ERROR", (c < 0) | (c > 1), c),
        ("H_setup_missing", "WARN", col("setup").isNull(), col("setup")),
    ])


def theme_findings(latest_themes: DataFrame, members: DataFrame) -> DataFrame:
    declared = members.groupBy("basket").agg(F.count("*").alias("_declared"))
    x = latest_themes.join(declared, "basket", "left")
    b = col("pct_above_50dma")
    return _findings(x, [
        ("I_theme_size", "ERROR", col("n_constituents") > col("_declared") + 1, col("n_constituents")),
        ("I_theme_score_bounds", "ERROR", (col("theme_score") < 0) | (col("theme_score") > 100), F.round("theme_score", 3)),
        ("I_theme_breadth_bounds", "ERROR", (b < 0) | (b > 100), F.round(b, 3)),
    ], key="basket")


def orphans(latest: DataFrame, members: DataFrame) -> DataFrame:
    return latest.select("entity").distinct().join(members, "entity", "left_anti").select(
        "entity", F.lit("J_no_basket").alias("check"), F.lit("WARN").alias("severity"), F.lit(None).cast("string").alias("observed"))


def verdict(findings: DataFrame, discrepancies: int = 0, sampled: int = 0, review_over: int = 10) -> DataFrame:
    """PASS / REVIEW / FAIL from finding counts and the external discrepancy rate."""
    n = findings.agg(F.count_if(col("severity") == "ERROR").alias("failures"), F.count_if(col("severity") == "WARN").alias("borderlines"))
    return n.select("*", F.when((col("failures") > 0) | F.lit(discrepancies > int(0.30 * max(sampled, 1))), "FAIL").when(
        (col("borderlines") > review_over) | F.lit(discrepancies > 0), "REVIEW").otherwise("PASS").alias("verdict"))


def reconcile(a: DataFrame, b: DataFrame, sample: int | None = None, seed: int = 42, close_tol: float = 0.005,
              ma_tol: float = 0.01, ret_tol: float = 0.02, ma_rows: int = 50, ret_rows: int = 252) -> DataFrame:
    """Latest close, moving average and long return of two bar sources, compared within tolerances.

    ``sample`` keeps a seeded, deterministic set of entities (a sampling check, as a feature).
    """
    def latest(bars: DataFrame, tag: str) -> DataFrame:
        w = TimeAxis("entity", "date")
        newest = Window.partitionBy("entity").orderBy(col("date").desc())
        x = bars.select("entity", "date", "close", w.mean(col("close"), ma_rows).alias("ma"),
                        w.change(col("close"), ret_rows).alias("ret"), F.row_number().over(newest).alias("_r"))
        return x.where(col("_r") == 1).select("entity", *[col(c).alias(f"{c}_{tag}") for c in ("close", "ma", "ret")])

    left = latest(a, "a")
    if sample is not None:
        picked = a.select("entity").distinct().orderBy(F.xxhash64("entity", F.lit(seed)), "entity").limit(sample)
        left = left.join(picked, "entity", "left_semi")
    j = left.join(latest(b, "b"), "entity")
    gap = lambda c: F.abs(div(col(f"{c}_a") - col(f"{c}_b"), col(f"{c}_b")))
    return j.select(
        "*", gap("close").alias("close_gap"), gap("ma").alias("ma_gap"), F.abs(col("ret_a") - col("ret_b")).alias("ret_gap"),
        (F.coalesce(gap("close") > close_tol, F.lit(False)) | F.coalesce(gap("ma") > ma_tol, F.lit(False))
         | F.coalesce(F.abs(col("ret_a") - col("ret_b")) > ret_tol, F.lit(False))).alias("discrepant"))


def reconcile_keys(a: DataFrame, b: DataFrame, shares: DataFrame, tolerance: float = 0.005, seed: int = 42) -> DataFrame:
    """(entity, date, grp, close_a, close_b, gap, side, discrepant) of a stratified, reproducible sample of keys.

    A key is in the sample where the hash of seed and key lies below the share of its group (shares: grp, share), so both
    sources, and every later run, pick the same keys. All sampled keys of either side are returned: side tells whether a
    key is in both or only_a, only_b; a one-sided key is discrepant.
    """
    def picked(x: DataFrame, tag: str) -> DataFrame:
        mark = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "entity", col("date").cast("string"))), 1, 8), 16, 10)
        return x.join(F.broadcast(shares), "grp").where(mark.cast("double") < col("share") * 4294967296.0).select(  # one row a group
            "entity", "date", "grp", col("close").alias(f"close_{tag}"))

    j = picked(a, "a").join(picked(b, "b"), ["entity", "date", "grp"], "full")
    gap = F.abs(div(col("close_a") - col("close_b"), col("close_b")))
    side = F.when(col("close_b").isNull(), "only_a").when(col("close_a").isNull(), "only_b").otherwise("both")
    return j.select("entity", "date", "grp", "close_a", "close_b", gap.alias("gap"), side.alias("side"),
                    ((side != "both") | F.coalesce(gap > tolerance, F.lit(False))).alias("discrepant"))


# ---- history and coverage -----------------------------------------------------------------------
def nearest_date_value(series: DataFrame, target: Column, value: str) -> list[Column]:
    """First date on or after target, else the last one; returns (date, value) aggregates."""
    d, at = col("date"), col("date") >= target
    first = F.min(F.when(at, F.struct(d.alias("d"), col(value).alias("v"))))
    last = F.max(F.struct(d.alias("d"), col(value).alias("v")))
    pick = F.coalesce(first, last)
    return [pick["d"], pick["v"]]


def history_coverage(scored: DataFrame, markers: Mapping[str, str], warmup_rows: int = 0) -> DataFrame:
    """Per entity: rows, valid rows, warm-up violations, out-of-range rows, score range, values at marker dates."""
    w = Window.partitionBy("entity").orderBy("date")
    x = scored.select("entity", "date", "score", F.row_number().over(w).alias("_n"))
    base = x.groupBy("entity").agg(
        F.count("*").alias("total_rows"), F.count("score").alias("valid_rows"),
        F.count_if((col("_n") <= warmup_rows) & col("score").isNotNull()).alias("warmup_violations"),
        F.count_if((col("score") < 0) | (col("score") > 100)).alias("out_of_bounds"),
        F.min(F.when(col("score").isNotNull(), col("date"))).alias("earliest_valid"),
        F.max(F.when(col("score").isNotNull(), col("date"))).alias("latest_valid"),
        F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.avg("score").alias("score_mean"))
    marks = []
    for name, day in markers.items():
        d, v = nearest_date_value(x, F.lit(day).cast("date"), "score")
        marks += [d.alias(f"{name}_date"), v.alias(f"{name}_score")]
    if not marks:
        return base
    return base.join(x.where(col("score").isNotNull()).groupBy("entity").agg(*marks), "entity", "left")


def coverage(declared: DataFrame, present: DataFrame, explained: DataFrame, report: DataFrame) -> DataFrame:
    """Declared / present / rejected / silently missing counts and the quality pass rate."""
    silent = declared.select("entity").distinct().join(present.select("entity").distinct(), "entity", "left_anti").join(
        explained.select("entity").distinct(), "entity", "left_anti").agg(F.count("*").alias("silent_missing"))
    d = declared.agg(F.count_distinct("entity").alias("declared"))
    p = present.agg(F.count_distinct("entity").alias("present"))
    q = report.agg((F.count_if(col("status").isin("PASS", "WARNING")) / F.count("*") * 100.0).alias("quality_pass_pct"))
    one = d.join(F.broadcast(p)).join(F.broadcast(silent)).join(F.broadcast(q))  # one row each
    return one.withColumn("coverage_pct", col("present") / col("declared") * 100.0)


def parity(actual: DataFrame, expected: DataFrame, tolerance: Mapping[str, float], exact: Sequence[str],
           keys: Sequence[str] = ("entity", "date")) -> DataFrame:
    """Pinned-value check: one row per (key, field) with actual, expected and pass."""
    e = expected.select(*keys, *[col(c).alias(f"_e_{c}") for c in (*tolerance, *exact)])
    j = e.join(actual.select(*keys, *tolerance, *exact), list(keys), "left")
    rows = []
    for c in tolerance:
        ok = F.abs(col(c) - col(f"_e_{c}")) <= tolerance[c]
        rows.append(F.struct(F.lit(c).alias("field"), col(c).cast("string").alias("actual"),
                             col(f"_e_{c}").cast("string").alias("expected"), F.coalesce(ok, F.lit(False)).alias("passed")))
    for c in exact:
        rows.append(F.struct(F.lit(c).alias("field"), col(c).cast("string").alias("actual"),
                             col(f"_e_{c}").cast("string").alias("expected"), col(c).eqNullSafe(col(f"_e_{c}")).alias("passed")))
    return j.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def run_validation(scored: DataFrame, members: DataFrame, themes: DataFrame, states: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Checks of one run's latest date: name, observed, passed.

    Scores inside 0..100 with a spread between their 1 % and 99 % quantiles, state probabilities that add up, members and
    groups present, and a share of S and A grades under one half.
    """
    x = scored.join(F.broadcast(scored.agg(F.max("date").alias("date"))), "date", "left_semi")
    total = sum((col(f"p_{s}") for s in states[1:]), col(f"p_{states[0]}"))
    one = x.agg(
        F.min("score").alias("lo"), F.max("score").alias("hi"), F.percentile("score", [0.01, 0.99]).alias("q"),
        F.max(F.abs(total - 1.0)).alias("off"), F.count("score").alias("n"),
        F.avg(F.when(col("score").isNotNull(), flag(col("grade").startswith("S") | col("grade").startswith("A")))).alias("top"))
    have = F.broadcast(themes.agg(F.count_distinct("basket").alias("groups")))  # one row each
    want = F.broadcast(members.agg(F.count_distinct("entity").alias("declared")))
    one = one.join(have).join(want)
    rows = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("observed"), F.coalesce(ok, F.lit(False)).alias("passed")) for n, v, ok in (
        ("score_min", col("lo"), col("lo") >= 0), ("score_max", col("hi"), col("hi") <= 100), ("score_p1", col("q")[0], col("q")[0] < col("q")[1]),
        ("score_p99", col("q")[1], col("q")[0] < col("q")[1]), ("probability_gap", col("off"), col("off") <= tolerance),
        ("scored", col("n"), col("n") > 0), ("declared", col("declared"), col("declared") >= col("n")), ("groups", col("groups"), col("groups") > 0),
        ("top_grades", col("top"), col("top") < 0.5))])
    return one.select(F.explode(rows).alias("r")).select("r.*")
