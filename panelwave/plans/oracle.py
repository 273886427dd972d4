"""SQL counterpart of every registered query that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

from panelwave import config
from panelwave.operators.evaluate import ALPHAS, effective_weights
from panelwave.operators.reliability import RANGE_RULES, STRONG, WEAK
from panelwave.operators.score import state_weights
from panelwave.operators.standardize import family
from panelwave.plans import oracle_features as OF
from panelwave.plans import oracle_scoring as OS
from panelwave.plans import planted
from panelwave.plans.oracle_base import (
    KEYS, NO_BENCH, cols, div, flag, lag, last_n, lead, panel, pct_rank, rnd, roll,
)
from panelwave.plans.queries import (
    EVAL_H, EVAL_SCORES, EVAL_WINDOWS, FEATURE_QUERIES, FULL_SCORES, FULL_WINDOWS, IC_TOLERANCE, LATE_EVERY, MIGRATION, OOS_NUMS, RECONCILE_SHARES, RIDGE_COLS, RIDGE_HORIZON, RUN_LIMITS, SUPPLIER_FEATURES, THEME_QUERIES, UD_LIMITS, Z_NAMES,
)


def day(c: str = "date") -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {c}"


def w(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


def _feat(select: str) -> str:
    return w(OF.features(), select)


_Z = [OF.features(), OS.standardized()]
_C = [*_Z, OS.components()]
_S = [*_C, OS.state(), OS.score(), OS.labels()]
_T = [*_S, OS.themes()]


def _scored(select: str, extra: str = "") -> str:
    return w(", ".join(_S) + (", " + extra if extra else ""), select)


def _themes(select: str, extra: str = "") -> str:
    return w(", ".join(_T) + (", " + extra if extra else ""), select)


def _dense(p: str, **exprs: str) -> str:
    """Window columns over a dense panel; benchmarks removed afterwards."""
    inner = ", ".join(f"{e} AS {k}" for k, e in exprs.items())
    return w(panel(p), f"SELECT {KEYS}, {cols(*exprs)} FROM (SELECT *, {inner} FROM panel) WHERE {NO_BENCH}")


LATEST = "date = (SELECT max(date) FROM lc)"
RET1 = f"({div('close', lag('close', 1))} - 1.0)"
RET12 = f"({div('close', lag('close', 12))} - 1.0)"
SMR = f"smr AS MATERIALIZED (SELECT *, {RET1} AS ret_1, {RET12} AS ret_12 FROM panel)"


def _sm(select: str, extra: str = "") -> str:
    return w(panel("sm") + ", " + SMR + (", " + extra if extra else ""), select)


# ---- quality ------------------------------------------------------------------------------------
def firewall(src: str, lim: dict[str, float], universe: str | None = None, overrides: bool = False) -> str:
    """CTE fw: entity, status, critical, warnings, rows."""
    o = dict(order="date")
    ratio = div("close", "adj_close")
    m = (
        f"q0 AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS age, {div('close', lag('close', **o))} - 1.0 AS ret, "
        f"{roll('avg', 'volume', 50, 20, **o)} AS va, abs(close - open) / nullif(high - low, 0) AS body, "
        f"abs({div(ratio, lag(ratio, **o))} - 1.0) AS rc, ({lead('close', **o)} - {lead('open', **o)}) / nullif({lead('open', **o)}, 0) AS nm FROM {src}), "
        f"q1 AS (SELECT *, coalesce((high - low) / nullif(low, 0) > {lim['big_range']}, false) AND coalesce(volume > va * {lim['volume_multiple']}, false) AS big, coalesce(body < 0.40, false) AS wick, "
        "coalesce(sign(close - open) <> 0 AND sign(nm) = -sign(close - open) AND abs(nm) > 0.05, false) AS turn FROM q0), "
        "q2 AS MATERIALIZED (SELECT entity, count(*) AS rows, max(date) AS last_date, bool_or(coalesce(open <= 0 OR high <= 0 OR low <= 0 OR close <= 0, false)) AS invalid, "
        "coalesce(sum(volume) FILTER (age <= 20), 0.0) AS vol20, count(*) FILTER (age <= 20) AS n20, median(close * volume) FILTER (age <= 20) AS d20, "
        f"bool_or(big AND wick) AS susp, bool_or(big AND NOT wick AND turn) AS rev, coalesce(bool_or(age <= 20 AND abs(ret) > {lim['large_gap']}), false) AS gap, "
        "avg(volume) FILTER (age <= 20) AS v20, avg(volume) FILTER (age <= 252) AS v252, count(*) FILTER (age <= 20 AND abs(ret) > 0.05) AS gaps, "
        "count(*) FILTER (age <= 20 AND body < 0.10) AS dojis, coalesce(bool_or(rc > 0.10), false) AS rj FROM q1 GROUP BY entity), "
    )
    everyone = universe or f"SELECT DISTINCT entity FROM {src}"
    crit = [("NO_DATA", "rows IS NULL"), ("INSUFFICIENT_HISTORY", f"rows < {lim['min_history']}"),
            ("STALE_DATA", f"date_diff('day', last_date, (SELECT max(date) FROM {src})) > {lim['max_stale_days']}"), ("INVALID_PRICES", "invalid"),
            ("ZERO_VOLUME", "vol20 = 0"), ("INSUFFICIENT_LIQUIDITY", f"n20 >= 5 AND d20 < {lim['min_liquidity']}"), ("SUSPICIOUS_BAR", "susp")]
    warn = [("LARGE_GAP_RECENT", "gap"), ("VOLUME_COLLAPSE", "rows >= 252 AND v252 > 0 AND v20 / v252 < 0.10"),
            ("LOW_LIQUIDITY", f"n20 >= 5 AND d20 >= {lim['min_liquidity']} AND d20 < {lim['low_liquidity']}"), ("FREQUENT_GAPS", "gaps >= 5"),
            ("FREQUENT_DOJI", "dojis >= 5"), ("POSSIBLE_CORPORATE_ACTION", "rj"), ("LARGE_REVERSAL_BAR", "rev")]
    lst = lambda cs, drop: "list_filter([" + ", ".join(f"CASE WHEN ({c}){drop.format(n)} THEN '{n}' END" for n, c in cs) + "], lambda x: x IS NOT NULL)"
    if overrides:
        drop = " AND NOT ('{}' = 'FREQUENT_GAPS' AND entity::BIGINT % 20 = 0)"
        extra = "CASE WHEN entity::BIGINT % 30 = 0 THEN list_concat({}, ['OVERRIDE_FLAG']) ELSE {} END"
        where = " WHERE entity::BIGINT % 50 <> 0"
    else:
        drop, extra, where = "", "{}", ""
    wl = lst(warn, drop)
    wl = extra.format(wl, wl) if overrides else wl
    return m + (
        f"q3 AS MATERIALIZED (SELECT e.entity, {lst(crit, drop)} AS crit, {wl} AS warn, coalesce(rows, 0) AS rows FROM (SELECT DISTINCT entity FROM ({everyone})) e LEFT JOIN q2 USING (entity){where}), "
        "fw AS MATERIALIZED (SELECT entity, CASE WHEN len(crit) > 0 THEN 'FAIL' WHEN len(warn) > 0 THEN 'WARNING' ELSE 'PASS' END AS status, crit, warn, rows FROM q3)"
    )


DEFAULT_LIMITS = {"min_history": 252, "max_stale_days": 5, "min_liquidity": 100000.0, "low_liquidity": 1000000.0, "big_range": 0.5, "volume_multiple": 5.0, "large_gap": 0.30}
UD = {k: getattr(UD_LIMITS, k) for k in DEFAULT_LIMITS}
NB = f"nb AS MATERIALIZED (SELECT * FROM bars WHERE {NO_BENCH})"
FW_TEXT = "SELECT entity, status, array_to_string(crit, '|') AS critical, array_to_string(warn, '|') AS warnings, rows FROM fw"

ADJ = ("adj AS MATERIALIZED (SELECT * EXCLUDE (adj_close), close * (CASE WHEN date < DATE '1998-01-01' THEN 0.5 WHEN date < DATE '2000-01-01' THEN 0.94 ELSE 1.0 END) AS adj_close FROM nb)")
_o = dict(order="date")
_ratio = "(CASE WHEN adj_close > 0 AND close > 0 THEN close / adj_close END)"
CA = (
    f"ca0 AS (SELECT entity, date, coalesce(abs({_ratio} / {lag(_ratio, **_o)} - 1.0) > 0.10, false) AS sp, "
    f"coalesce(abs((close / {lag('close', **_o)} - 1.0) - (adj_close / {lag('adj_close', **_o)} - 1.0)) > 0.05, false) AS so, "
    f"coalesce(date_diff('day', {lag('date', **_o)}, date) > 5, false) AS ha FROM adj), "
    "ca AS MATERIALIZED (SELECT entity, date, 'split' AS type FROM ca0 WHERE sp UNION ALL SELECT entity, date, 'spinoff' FROM ca0 WHERE so AND NOT sp UNION ALL SELECT entity, date, 'halt' FROM ca0 WHERE ha)"
)

# ---- anomalies over lc --------------------------------------------------------------------------
_b5 = "OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
AN = (
    f"an0 AS MATERIALIZED (SELECT *, {lag('score', **_o)} AS score_prev, CASE WHEN count(score) {_b5} = 5 THEN avg(score) {_b5} END AS rm, CASE WHEN count(score) {_b5} = 5 THEN stddev_samp(score) {_b5} END AS rs, "
    f"{lag('grade', **_o)} AS grade_prev, {lag('primary_state', 1, **_o)} AS s1, {lag('primary_state', 2, **_o)} AS s2 FROM lc), "
    "ans AS (SELECT *, abs(score - score_prev) AS abs_jump, (score - rm) / nullif(rs, 0) AS roll_z FROM an0), "
    f"an1 AS MATERIALIZED (SELECT entity, date, score, score_prev, abs_jump, roll_z, 'score_jump' AS type, CASE WHEN coalesce(abs_jump > 25, false) THEN 'high' ELSE 'medium' END AS severity FROM ans WHERE {LATEST} AND (abs_jump > 25 OR abs(roll_z) > 2.5)), "
    "an2 AS MATERIALIZED (SELECT entity, date, grade, grade_prev, gap, 'grade_jump' AS type, CASE WHEN gap >= 3 THEN 'high' ELSE 'medium' END AS severity FROM "
    f"(SELECT *, abs(instr('SABCD', grade) - instr('SABCD', grade_prev)) AS gap FROM an0 WHERE {LATEST} AND grade IS NOT NULL AND grade_prev IS NOT NULL) WHERE gap >= 2), "
    "an3 AS MATERIALIZED (SELECT entity, date, s2 || '|' || s1 || '|' || primary_state AS states, 'state_flip' AS type, 'medium' AS severity FROM an0 "
    f"WHERE {LATEST} AND primary_state <> s1 AND s1 <> s2 AND (array_to_string(list_sort([primary_state, s1]), '|') IN ('DETERIORATING|TRENDING', 'CONSOLIDATING|EXHAUSTION', 'EXHAUSTION|TRENDING') "
    "OR array_to_string(list_sort([s1, s2]), '|') IN ('DETERIORATING|TRENDING', 'CONSOLIDATING|EXHAUSTION', 'EXHAUSTION|TRENDING')))"
)

# ---- evaluation ---------------------------------------------------------------------------------
_chg = lambda k: f"({div('close', lag('close', k))} - 1.0)"
EV = (
    f"ev0 AS (SELECT *, {_chg(12)} AS mom_12, {_chg(6)} AS mom_6, -{_chg(1)} AS reversal, volume / nullif({roll('avg', 'volume', 6)}, 0) AS volume_ratio, {_chg(1)} AS r1 FROM panel), "
    f"ev1 AS MATERIALIZED (SELECT *, {roll('stddev_samp', 'r1', 6)} AS vol_6 FROM ev0 WHERE {NO_BENCH}), "
    "fw0 AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT entity, date, {h} AS horizon, {div(lead('adj_close', h, **_o), 'adj_close')} - 1.0 AS fwd FROM bars WHERE {NO_BENCH}" for h in EVAL_H) + "), "
    "us AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT entity, date, '{t}' AS score_type, '{c}' AS score_name, {c} AS value FROM ev1" for t, ns in EVAL_SCORES.items() for c in ns) + ")"
)


def rank_ic(us: str = "us", fw: str = "fw0", need: int = 20) -> str:
    by = "date, horizon, score_type, score_name"
    return (
        f"pr AS MATERIALIZED (SELECT u.* REPLACE (round(value, 9) AS value), f.horizon, f.fwd FROM {us} u JOIN {fw} f USING (entity, date) WHERE value IS NOT NULL AND fwd IS NOT NULL), "
        f"rk AS MATERIALIZED (SELECT *, {pct_rank('value', by)} AS ra, {pct_rank('fwd', by)} AS rb FROM pr), "
        f"ic AS MATERIALIZED (SELECT {by}, count(*) AS n, CASE WHEN count(*) >= {need} AND stddev_pop(ra) * stddev_pop(rb) > 1e-12 THEN covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) END AS ic FROM rk GROUP BY {by})"
    )


def window_ic(train: int, test: int, step: int) -> str:
    return (
        f"wn AS MATERIALIZED (SELECT k AS window_idx, k * {step} AS a FROM (SELECT unnest(range(0, 1000)) AS k) WHERE k * {step} + {train + test} <= (SELECT count(*) FROM cal)), "
        f"wm AS MATERIALIZED (SELECT c.date, window_idx, t < a + {train} AS is_train FROM wn JOIN cal c ON c.t >= a AND c.t < a + {train + test}), "
        "wi AS MATERIALIZED (SELECT * FROM (SELECT score_type, score_name, horizon, window_idx, avg(ic) FILTER (is_train) AS is_ic, avg(ic) FILTER (NOT is_train) AS oos_ic, "
        "count(*) FILTER (is_train) AS n_train_dates, count(*) FILTER (NOT is_train) AS n_test_dates FROM ic JOIN wm USING (date) WHERE ic IS NOT NULL GROUP BY 1, 2, 3, 4) WHERE n_train_dates >= 5 AND n_test_dates >= 5), "
        "os0 AS (SELECT score_type, score_name, horizon, count(oos_ic) AS n_windows, avg(oos_ic) AS oos_ic_mean, stddev_samp(oos_ic) AS oos_ic_std, "
        f"avg({flag('round(oos_ic, 12) > 0')}) AS oos_hit_rate, avg(is_ic) AS is_ic_mean FROM wi GROUP BY 1, 2, 3), "
        "os AS MATERIALIZED (SELECT *, CASE WHEN n_windows > 1 AND oos_ic_std > 0 THEN oos_ic_mean / (oos_ic_std / sqrt(n_windows)) END AS oos_ic_t_stat, is_ic_mean - oos_ic_mean AS is_minus_oos FROM os0)"
    )


_EV = panel("sm") + ", " + EV + ", " + rank_ic()
_EVW = _EV + ", " + window_ic(*EVAL_WINDOWS)


def _audit_ctes() -> str:
    us = " UNION ALL ".join(f"SELECT entity, date, 'feature' AS score_type, '{c}' AS score_name, {c}::DOUBLE AS value FROM feat" for c in Z_NAMES)
    fwd = " UNION ALL ".join(f"SELECT entity, date, {h} AS horizon, {div(lead('adj_close', h, **_o), 'adj_close')} - 1.0 AS fwd FROM bars WHERE {NO_BENCH}" for h in (20, 60))
    return f"{OF.features()}, us AS MATERIALIZED ({us}), fw0 AS MATERIALIZED ({fwd}), {rank_ic(need=15)}, {window_ic(60, 21, 21)}"


# ---- full evaluation ----------------------------------------------------------------------------
SCORE_KEYS = "score_type, score_name, horizon"


def _full(select: str, extra: str = "") -> str:
    """Composite, components and features of the three-day panel against the returns of six horizons."""
    us = " UNION ALL ".join(f"SELECT entity, date, '{t}' AS score_type, '{c}' AS score_name, {c}::DOUBLE AS value FROM sc" for t, ns in FULL_SCORES.items() for c in ns)
    fwd = " UNION ALL ".join(f"SELECT entity, date, {h} AS horizon, {div(lead('adj_close', h, **_o), 'adj_close')} - 1.0 AS fwd FROM bars WHERE {NO_BENCH}" for h in config.OOS_HORIZONS)
    ctes = [OF.features("bt"), OS.standardized(), OS.components(), OS.state(), OS.score(), f"us AS MATERIALIZED ({us})", f"fw0 AS MATERIALIZED ({fwd})",
            rank_ic(), window_ic(*FULL_WINDOWS)]
    return w(", ".join(ctes) + (", " + extra if extra else ""), select)


def t_two_sided(t: str, df: str) -> str:
    """Two-sided p-value of Student's t by gamma functions: the terms of the finite series for whole degrees of freedom."""
    ang = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({ang}) * list_sum(list_transform(range(0, ({df}) // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0)) / sqrt(pi()) * pow(cos({ang}), 2 * j)))"
    odd = (f"({ang} + coalesce(sin({ang}) * list_sum(list_transform(range(0, ({df}) // 2), "
           f"lambda j: exp(lgamma(j + 1.0) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * pow(cos({ang}), 2 * j + 1))), 0.0)) * 2 / pi()")
    return f"(CASE WHEN {t} IS NOT NULL AND {df} >= 1 THEN greatest(1.0 - (CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END), 0.0) END)"


def _audit(top: int, least: int) -> str:
    by = "PARTITION BY score_type, horizon ORDER BY oos_ic_mean"
    return (f"ha AS (SELECT *, row_number() OVER ({by} DESC, score_name) <= {top} AS top, row_number() OVER ({by}, score_name) <= {top} AS bot FROM os WHERE n_windows >= {least}), "
            "hb AS (SELECT score_name, count(*) FILTER (top) AS n_top, count(*) FILTER (bot) AS n_bottom, count(oos_ic_mean) AS n_horizons, max(abs(oos_ic_mean)) AS ma, "
            "avg(oos_ic_mean) AS mo, coalesce(bool_and(oos_ic_mean < 0), false) AS neg FROM ha WHERE score_type = 'feature' GROUP BY 1)")


_AUDIT_COLUMNS = (f"SELECT score_name, n_top, n_bottom, n_horizons, {rnd('ma')} AS max_abs_oos_ic, {rnd('mo')} AS mean_oos_ic, n_top >= 3 AS universally_good, "
                  "n_top BETWEEN 1 AND 2 AS horizon_specific, ma < 0.005 AS noise_candidate")
_SIGNIFICANCE = (f"SELECT {SCORE_KEYS}, n_windows, {cols(*OOS_NUMS, oos_ic_se='oos_ic_std / sqrt(n_windows)')}, "
                 f"{rnd(t_two_sided('oos_ic_t_stat', 'n_windows - 1'))} AS oos_p_value FROM os")
_COMPONENT_COLUMNS = (f"SELECT score_name, {rnd('avg(oos_ic_mean)')} AS mean_oos_ic, count(*) FILTER (oos_ic_mean > 0) AS n_positive_horizons, count(*) FILTER (oos_ic_t_stat > 2) AS n_significant_positive, "
                      "count(*) FILTER (oos_ic_t_stat < -2) AS n_significant_negative FROM os WHERE score_type = 'component' GROUP BY score_name")


def _ic_summary(by: str) -> str:
    return (f"SELECT {by}, n_dates, " + cols("ic_mean", "ic_median", "ic_std", "hit_rate", ic_t_stat="CASE WHEN n_dates > 1 AND ic_std > 0 THEN ic_mean / (ic_std / sqrt(n_dates)) END")
            + f" FROM (SELECT {by}, count(ic) AS n_dates, avg(ic) AS ic_mean, median(ic) AS ic_median, stddev_samp(ic) AS ic_std, avg(CASE WHEN ic IS NOT NULL THEN {flag('round(ic, 12) > 0')} END) AS hit_rate FROM ic GROUP BY {by})")


# ---- ridge --------------------------------------------------------------------------------------
def ridge(src: str, names: Sequence[str], horizon: int, min_rows: int) -> str:
    """CTEs rd (training rows), rt (them in their training windows), rw (a row for each window) from src and fw0, wm."""
    p = len(names)
    x = ", ".join(f"{c}::DOUBLE" for c in names)
    known = " AND ".join(f"{c} IS NOT NULL" for c in names)
    g = lambda i, j: f"sum(x[{i}] * x[{j}]) - count(*) * avg(x[{i}]) * avg(x[{j}])"
    gram = ", ".join("[" + ", ".join([g(i, j) for j in range(1, p + 1)] + [f"sum(x[{i}] * y) - count(*) * avg(x[{i}]) * avg(y)"]) + "]" for i in range(1, p + 1))
    means = ", ".join(f"avg(x[{i}])" for i in range(1, p + 1))
    alphas = ", ".join(f"{a}::DOUBLE" for a in ALPHAS)
    return (
        f"rf AS (SELECT s.entity, s.date, [{x}] AS x, {known} AS whole, fwd FROM {src} s LEFT JOIN (SELECT entity, date, fwd FROM fw0 WHERE horizon = {horizon}) f USING (entity, date)), "
        "rd AS MATERIALIZED (SELECT entity, date, x, y FROM (SELECT *, coalesce(CASE WHEN stddev_samp(fwd) OVER (PARTITION BY date) < 1e-10 THEN 0.0 "
        "ELSE (fwd - avg(fwd) OVER (PARTITION BY date)) / stddev_samp(fwd) OVER (PARTITION BY date) END, 0.0) AS y FROM rf) WHERE whole), "
        "rt AS MATERIALIZED (SELECT window_idx, x, y FROM rd JOIN wm USING (date) WHERE is_train), "
        f"rm AS MATERIALIZED (SELECT window_idx, count(*) AS n, avg(y) AS yb, [{means}] AS mu, [{gram}] AS g FROM rt GROUP BY window_idx HAVING count(*) >= {min_rows}), "
        # rows [G + alpha I | I | moments with y], reduced pivot by pivot
        f"gj AS (SELECT window_idx, alpha, 0 AS k, list_transform(range(1, {p + 1}), lambda i: list_concat(list_transform(range(1, {p + 1}), lambda j: g[i][j] + CASE WHEN i = j THEN alpha ELSE 0.0 END), "
        f"list_transform(range(1, {p + 1}), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), [g[i][{p + 1}]])) AS m FROM rm, (SELECT unnest([{alphas}]) AS alpha) "
        f"UNION ALL SELECT window_idx, alpha, k + 1, list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {2 * p + 2}), lambda j: CASE WHEN i = k + 1 THEN m[i][j] / m[i][i] "
        f"ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END)) FROM gj WHERE k < {p}), "
        f"so AS MATERIALIZED (SELECT window_idx, alpha, n, yb, mu, list_transform(m, lambda r: r[{p + 1}:{2 * p}]) AS inv, list_transform(m, lambda r: r[{2 * p + 1}]) AS co FROM gj JOIN rm USING (window_idx) WHERE k = {p}), "
        "re AS (SELECT window_idx, alpha, n, yb, y, co, inv, list_transform(list_zip(x, mu), lambda z: z[1] - z[2]) AS c FROM rt JOIN so USING (window_idx)), "
        "le AS (SELECT window_idx, alpha, avg(pow((y - yb - list_dot_product(co, c)) / (1.0 - 1.0 / n - list_dot_product(c, list_transform(inv, lambda r: list_dot_product(r, c)))), 2)) AS e FROM re GROUP BY 1, 2), "
        "rw AS MATERIALIZED (SELECT so.window_idx, so.alpha, n AS n_train, list_transform(co, lambda v: CASE WHEN abs(list_sum(co)) < 1e-9 "
        f"THEN 1.0 / {p} ELSE v / list_sum(co) END) AS w FROM so JOIN (SELECT window_idx, arg_min(alpha, (e, alpha)) AS alpha FROM le GROUP BY 1) b USING (window_idx, alpha)), "
        "rv AS (SELECT entity, date, window_idx, list_dot_product(w, x) AS value FROM rd JOIN wm USING (date) JOIN rw USING (window_idx) WHERE NOT is_train), "
        "rp AS (SELECT v.date, window_idx, horizon, value, fwd FROM rv v JOIN fw0 USING (entity, date) WHERE fwd IS NOT NULL), "
        f"rr AS (SELECT *, {pct_rank('value', 'date, horizon, window_idx')} AS ra, {pct_rank('fwd', 'date, horizon, window_idx')} AS rb FROM rp), "
        "ri AS (SELECT date, horizon, window_idx, CASE WHEN count(*) >= 20 AND stddev_pop(ra) * stddev_pop(rb) > 1e-12 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END AS ic FROM rr GROUP BY 1, 2, 3), "
        "ro AS MATERIALIZED (SELECT window_idx, horizon, avg(ic) AS oos_ic, count(*) AS n_dates FROM ri WHERE ic IS NOT NULL GROUP BY 1, 2), "
        f"rl AS (SELECT unnest([{', '.join(repr(c) for c in names)}]) AS component, unnest(w) AS v FROM rw), "
        "rc AS MATERIALIZED (SELECT component, avg(v) AS mean_weight, stddev_samp(v) AS std_weight, count(*) AS n_windows, "
        "coalesce(abs(avg(v)) > 1e-9 AND stddev_samp(v) / abs(avg(v)) > 4.0, false) AS unstable FROM rl GROUP BY 1)"
    )


def _ridge_queries(names: Sequence[str]) -> dict[str, str]:
    return {
        "weights": "SELECT window_idx::INT AS window_idx, alpha, n_train, " + cols(**{f"w_{c}": f"w[{i + 1}]" for i, c in enumerate(names)}) + " FROM rw",
        "oos": f"SELECT window_idx::INT AS window_idx, horizon, {cols('oos_ic')}, n_dates FROM ro",
        "consensus": f"SELECT component, {cols('mean_weight', 'std_weight')}, n_windows, unstable FROM rc",
        "alphas": "SELECT alpha, count(*) AS n_windows FROM rw GROUP BY alpha",
    }


def _adopt() -> str:
    t = "CASE WHEN n > 1 AND sd > 0 THEN m / (sd / sqrt(n)) END"
    return (f"ad AS (SELECT horizon, (m - oos_ic_mean) / nullif(abs(oos_ic_mean), 0) * 100.0 AS gain, {t} >= oos_ic_t_stat AS t_ok FROM "
            "(SELECT horizon, avg(oos_ic) AS m, stddev_samp(oos_ic) AS sd, count(*) AS n FROM ro GROUP BY 1) JOIN (SELECT * FROM os WHERE score_type = 'composite') USING (horizon)), "
            "ao AS (SELECT max(gain) FILTER (horizon = 126) AS gp, max(gain) FILTER (horizon = 1) AS gs, coalesce(bool_or(horizon = 126 AND t_ok), false) AS t_ok FROM ad), "
            "au AS (SELECT count(*) FILTER (unstable) AS n_unstable FROM rc)")


def _lookup(mapping: dict[str, float], key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in mapping.items()) + f" ELSE {default} END"


# ---- views --------------------------------------------------------------------------------------
DAYS = "dk AS MATERIALIZED (SELECT date, count(*) OVER (ORDER BY date DESC ROWS UNBOUNDED PRECEDING) - 1 AS k FROM (SELECT DISTINCT date FROM lc))"
CHG = (
    DAYS + ", dc AS MATERIALIZED (SELECT entity, max(score) FILTER (k = 0) AS s0, max(score) FILTER (k = 1) AS s1, max(grade) FILTER (k = 0) AS g0, max(grade) FILTER (k = 1) AS g1, "
    "max(leadership_tier) FILTER (k = 0) AS t0 FROM lc JOIN dk USING (date) WHERE k <= 1 GROUP BY entity)"
)


def _contrib() -> str:
    sw = state_weights()
    parts = []
    for i, c in enumerate(config.COMPONENTS):
        wt = "CASE primary_state " + " ".join(f"WHEN '{s}' THEN {float(sw[s][i])!r}" for s in config.STATES) + " END"
        parts.append(f"SELECT entity, date, '{c}' AS component, {c} AS z_score, {wt} AS weight FROM lc WHERE {LATEST}")
    return f"SELECT {KEYS}, component, {cols('z_score', 'weight', contribution='coalesce(z_score, 0.0) * weight')} FROM ({' UNION ALL '.join(parts)}) WHERE weight <> 0"


def _l3() -> str:
    f = []
    from panelwave.operators.reliability import FEATURE_BOUNDS

    for c, (lo, hi, hard) in FEATURE_BOUNDS.items():
        f.append(f"SELECT 'C_{c}_bounds' AS \"check\", '{'ERROR' if hard else 'WARN'}' AS severity FROM lt WHERE {c} < {lo} OR {c} > {hi}")
    miss = " + ".join(f"({c} IS NULL)::INT" for c in config.COMPONENTS)
    tot = " + ".join(f"p_{s}" for s in config.STATES)
    q = lambda ts: ", ".join(f"'{t}'" for t in ts)
    rules = [
        ("E_score_bounds", "ERROR", "score < 0 OR score > 100"), ("E_score_null_from_components", "WARN", f"score IS NULL AND {miss} > 0"),
        ("E_score_null_with_components", "ERROR", f"score IS NULL AND {miss} = 0"), ("E_grade_value", "ERROR", "score IS NOT NULL AND coalesce(grade, '') NOT IN ('S', 'A', 'B', 'C', 'D')"),
        ("F_state_probs_sum", "ERROR", f"abs({tot} - 1.0) > 0.001"),
        ("G_tier_value", "ERROR", f"coalesce(leadership_tier, 'NULL') NOT IN ({q(config.TIERS)})"),
        ("G_high_rs_weak_tier", "WARN", f"rs_rating_spy > 80 AND coalesce(leadership_tier, 'NULL') NOT IN ({q(STRONG)})"),
        ("G_low_rs_strong_tier", "WARN", f"rs_rating_spy < 20 AND coalesce(leadership_tier, 'NULL') NOT IN ({q(WEAK)})"),
        ("H_setup_missing", "WARN", "setup IS NULL"), ("J_no_basket", "WARN", "entity NOT IN (SELECT entity FROM mem)"),
    ]
    f += [f"SELECT '{n}', '{s}' FROM lt WHERE {c}" for n, s, c in rules]
    f.append("SELECT 'I_theme_size', 'ERROR' FROM tl JOIN (SELECT basket, count(*) AS d FROM mem GROUP BY 1) USING (basket) WHERE n_constituents > d + 1")
    f.append("SELECT 'I_theme_score_bounds', 'ERROR' FROM tl WHERE theme_score < 0 OR theme_score > 100")
    return _themes(f'SELECT "check", severity, count(*) AS n FROM ({" UNION ALL ".join(f)}) GROUP BY 1, 2',
                   f"lt AS MATERIALIZED (SELECT * FROM lc WHERE {LATEST}), tl AS MATERIALIZED (SELECT * FROM th WHERE date = (SELECT max(date) FROM th))")


# ---- planted faults -----------------------------------------------------------------------------
_NO = "regexp_extract(entity, '([0-9]+)', 1)::INT"


def _put(src: str, faults: Sequence[tuple[str, str, object]]) -> str:
    """SELECT from src with the value of each (condition, column, value) where it holds; the last one wins."""
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    made = []
    for c in dict.fromkeys(f[1] for f in faults):
        whens = " ".join(f"WHEN {cond} THEN {lit(v)}" for cond, name, v in reversed(faults) if name == c)
        made.append(f"CASE {whens} ELSE {c} END AS {c}")
    return f"SELECT * REPLACE ({', '.join(made)}) FROM {src}"


def _planted_ctes(plant: bool = True) -> str:
    """CTE fd: findings of the latest date, of tables with planted faults or of the tables as they are."""
    faults = [(f"{_NO} = {k}", c, v) for k, c, v in planted.SCORED]
    orphan = planted.ORPHAN if plant else ""
    q = lambda ts: ", ".join(f"'{t}'" for t in ts)
    miss = " + ".join(f"({c} IS NULL)::INT" for c in config.COMPONENTS)
    probs = ", ".join(f"p_{s}" for s in config.STATES)
    on_themes = {r[0] for r in RANGE_RULES if r[0].startswith("I_")}
    parts = [f"SELECT {'basket' if n in on_themes else 'entity'} AS entity, '{n}' AS \"check\", '{sev}' AS severity, {c}::DOUBLE AS observed, {lo!r}::DOUBLE AS low, {hi!r}::DOUBLE AS high "
             f"FROM {'tp' if n in on_themes else 'lp'} WHERE {c} < {lo!r} OR {c} > {hi!r}" for n, c, lo, hi, sev in RANGE_RULES]
    other = [
        ("E_score_null_from_components", "WARN", f"score IS NULL AND {miss} > 0"), ("E_score_null_with_components", "ERROR", f"score IS NULL AND {miss} = 0"),
        ("E_grade_value", "ERROR", "score IS NOT NULL AND coalesce(grade, '') NOT IN ('S', 'A', 'B', 'C', 'D')"),
        ("F_state_probs_sum", "ERROR", f"abs({probs.replace(', ', ' + ')} - 1.0) > 0.001"),
        ("F_state_assignment", "WARN", f"primary_state <> ([{q(config.STATES)}])[list_position([{probs}], greatest({probs}))]"),
        ("G_tier_value", "ERROR", f"coalesce(leadership_tier, 'NULL') NOT IN ({q(config.TIERS)})"),
        ("G_high_rs_weak_tier", "WARN", f"rs_rating_spy > 80 AND coalesce(leadership_tier, 'NULL') NOT IN ({q(STRONG)})"),
        ("G_low_rs_strong_tier", "WARN", f"rs_rating_spy < 20 AND coalesce(leadership_tier, 'NULL') NOT IN ({q(WEAK)})"),
        ("H_setup_missing", "WARN", "setup IS NULL"), ("J_no_basket", "WARN", f"entity NOT IN (SELECT entity FROM mem WHERE entity <> '{orphan}')"),
    ]
    parts += [f"SELECT entity, '{n}', '{sev}', NULL, NULL, NULL FROM lp WHERE {cond}" for n, sev, cond in other]
    parts.append("SELECT basket, 'I_theme_size', 'ERROR', NULL, NULL, NULL FROM tp JOIN (SELECT basket, count(*) AS d FROM mem "
                 f"WHERE entity <> '{orphan}' GROUP BY 1) USING (basket) WHERE n_constituents > d + 1")
    return (f"lt AS MATERIALIZED (SELECT * FROM lc WHERE {LATEST}), lp AS MATERIALIZED ({_put('lt', faults) if plant else 'FROM lt'}), "
            "tl AS MATERIALIZED (SELECT * FROM th WHERE date = (SELECT max(date) FROM th)), "
            f"tp AS MATERIALIZED ({_put('tl', [(f'basket = {k!r}', c, v) for k, c, v in planted.THEMES]) if plant else 'FROM tl'}), fd AS MATERIALIZED ({' UNION ALL '.join(parts)})")


def _planted_queries() -> dict[str, str]:
    found = _planted_ctes()
    fields = [(c, f"coalesce(abs(a.{c} - e.{c}) <= {tol}, false)") for c, tol in (("score", 0.01), ("rs_rating_spy", 0.01), ("adx_14", 0.5))]
    fields += [(c, f"a.{c} IS NOT DISTINCT FROM e.{c}") for c in ("grade", "primary_state", "leadership_tier")]
    pinned = " UNION ALL ".join(f"SELECT e.entity, strftime(e.date, '%Y-%m-%d') AS date, '{c}' AS field, {ok} AS passed FROM lt e LEFT JOIN lp a USING (entity)" for c, ok in fields)
    flips = [(f"{_NO} = {no} AND coalesce(k, 9) = {back}", c, v) for no, back, c, v in planted.HISTORY]
    history = f"{DAYS}, lh AS (SELECT lc.*, k FROM lc LEFT JOIN dk ON dk.date = lc.date AND k <= 2), lcp AS MATERIALIZED ({_put('lh', flips)}), " + AN.replace("FROM lc)", "FROM lcp)").replace(
        "max(date) FROM lcp", "max(date) FROM lc")
    every = " UNION ALL ".join(f"SELECT entity, date, type, severity FROM an{i}" for i in (1, 2, 3))
    spoiled = [(f"{_NO} = {no} AND back BETWEEN {a} AND {b}", c, v) for no, a, b, c, v in planted.BARS]
    bars = f"{panel('bx')}, {NB}, nr AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) - 1 AS back FROM nb), nbp AS MATERIALIZED ({_put('nr', spoiled)})"
    asked = f"SELECT entity FROM nb UNION ALL SELECT '{planted.ABSENT}'"
    return {
        "findings_listed": _themes(f'SELECT entity, "check", severity, {cols("observed", "low", "high")} FROM fd', found),
        "findings_verdict": _themes("SELECT failures, borderlines, CASE WHEN failures > 0 THEN 'FAIL' WHEN borderlines > 10 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM "
                                    "(SELECT count(*) FILTER (severity = 'ERROR') AS failures, count(*) FILTER (severity = 'WARN') AS borderlines FROM fd)", found),
        "anomaly_list": _scored(f"SELECT {KEYS}, type, severity, row_number() OVER (ORDER BY severity <> 'high', array_position(['score_jump', 'grade_jump', 'state_flip'], type), entity)::INT AS place FROM ({every})", history),
        "parity_check": _themes(pinned, found),
        "dq_planted": w(f"{bars}, {firewall('nbp', DEFAULT_LIMITS, asked)}", FW_TEXT),
        "ingest_reasons": w(bars, f"SELECT entity, CASE WHEN n IS NULL THEN 'empty_frame' ELSE 'all_close_nan' END AS reason FROM (SELECT DISTINCT entity FROM ({asked})) LEFT JOIN "
                                  "(SELECT entity, count(close) AS n FROM nbp GROUP BY 1) USING (entity) WHERE coalesce(n, 0) = 0"),
    }


def _run_queries() -> dict[str, str]:
    """What readers see of the published run: a brand with 30 bars is dropped by the gate, the failed run changes nothing."""
    lim = {k: getattr(RUN_LIMITS, k) for k in DEFAULT_LIMITS}
    last30 = "SELECT date FROM (SELECT DISTINCT date FROM bars) ORDER BY date DESC LIMIT 30"
    rb = (f"rb AS MATERIALIZED (SELECT * FROM bars UNION ALL SELECT * REPLACE ('{planted.ABSENT}' AS entity) FROM bars WHERE entity = 'Brand#1' AND date IN ({last30})), "
          f"rn AS MATERIALIZED (SELECT * FROM rb WHERE {NO_BENCH})")
    ok = "entity IN (SELECT entity FROM fw WHERE status <> 'FAIL')"
    every = " UNION ALL ".join(f"SELECT entity, date, type FROM an{i}" for i in (1, 2, 3))
    ctes = (f"{_planted_ctes(False)}, {AN}, {rb}, {firewall('rn', lim)}, rbars AS (SELECT date FROM rb WHERE NOT ({NO_BENCH}) OR {ok}), rquality AS (SELECT NULL::DATE AS date FROM fw), "
            f"rfeatures AS (SELECT date FROM feat WHERE {ok}), rscored AS (SELECT date FROM lc WHERE {ok}), rthemes AS (SELECT date FROM th), "
            f"rfindings AS (SELECT NULL::DATE AS date FROM fd), ranomalies AS (SELECT date FROM ({every}))")
    names = ("bars", "quality", "features", "scored", "themes", "findings", "anomalies")
    seen = " UNION ALL ".join(f"SELECT 'good' AS run_id, '{t}' AS \"table\", count(*) AS n_rows, strftime(max(date), '%Y-%m-%d') AS latest FROM r{t}" for t in names)
    kept = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) FILTER (date IS NULL OR date = (SELECT max(date) FROM r{t})) AS n_rows FROM r{t}" for t in names)
    return {
        "pipeline_run": _themes(seen, ctes),
        "run_archive": _themes(f"SELECT k.*, (SELECT strftime(max(date), '%Y-%m-%d') FROM rbars) AS snapshot_date FROM ({kept}) k WHERE n_rows > 0", ctes),
        "slim_history": _scored(f"SELECT {KEYS}, grade, primary_state, {cols('score')} FROM lc"),
    }


def _metrics() -> str:
    pct = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE printf('%+.1f', {c}) || '%' END"
    num = lambda c, d: f"CASE WHEN {c} IS NULL THEN '-' ELSE format('{{:,.{d}f}}', {c}) END"
    items = [("% from 50-day Moving Average", pct("pct_ma_50")), ("% from 200-day Moving Average", pct("pct_ma_200")), ("% from 52-week High", pct("pct_from_52w_high")),
             ("Average Directional Index (14)", num("adx_14", 1)), ("Relative Strength Index (14)", num("rsi_14", 1)), ("Realized Volatility (60-day)", num("realized_vol_60", 1)),
             ("Within-Basket Z-Score (21-day)", num("within_basket_z_21d", 2)), ("Distribution Days (25-day)", num("distribution_days_25", 0))]
    return _feat(" UNION ALL ".join(f"SELECT entity, '{n}' AS metric, {e} AS value FROM feat WHERE date = (SELECT max(date) FROM feat)" for n, e in items))


def _display() -> str:
    st = "CASE primary_state " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in config.STATE_DISPLAY.items()) + " END"
    ti = "CASE coalesce(leadership_tier, 'UNCLASSIFIED') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in config.TIER_DISPLAY.items()) + " END"
    return _scored(f"SELECT {KEYS}, {st} AS state_display, {ti} AS tier_display FROM lc")


LEGACY = [
    ("Extreme Extension", .95, "x >= 6.5"), ("Exhaustion w/ Bearish Divergence", .90, "x >= 4 AND bearish_divergence_20d = 1 AND r >= 85"),
    ("Volume-Confirmed Exhaustion", .90, "x >= 4.5 AND climax_volume_flag = 1"), ("Extended Exhaustion", .75, "x >= 4 AND days_near_52w_high_60d >= 15 AND r >= 80"),
    ("Capitulation Selling", .85, "p < -8 AND capitulation_volume_flag = 1"), ("Deteriorating w/ Bullish Divergence", .80, "p < -5 AND bullish_divergence_20d = 1"),
    ("Distribution Pattern", .85, "p < -5 AND distribution_days_25 >= 8"), ("Sustained Weakness", .70, "p < -8"),
    ("Elite Leader Continuation", .95, "p_TRENDING > .5 AND leadership_tier = 'ELITE_LEADER'"), ("Elite Leader Pullback", .95, "p_PULLBACK > .5 AND leadership_tier = 'ELITE_LEADER'"),
    ("Premium Pullback", .95, "sma_stack_score >= 85 AND ema_stack_score >= 70 AND p > 0 AND p < 10 AND x < 2.5 AND r >= 80 AND up_down_vol_ratio_50 >= 1.3"),
    ("Theme Leader Pullback", .80, "is_basket_leader AND p_PULLBACK > .4"),
    ("Trend Continuation", .90, "sma_stack_score >= 85 AND adx_14 >= 25 AND x < 4.5 AND r >= 80 AND supertrend_direction = 1"),
    ("Trending Leadership", .85, "sma_stack_score >= 75 AND r >= 80 AND adx_14 >= 20"),
    ("Pullback to 21EMA", .85, "sma_stack_score >= 80 AND abs(close - ema_21) / nullif(atr, 0) < .7 AND r >= 75"),
    ("Pullback to 50MA", .80, "sma_stack_score >= 75 AND abs(close - sma_50) / nullif(atr, 0) < 1.2 AND r >= 70"),
    ("Tight Consolidation Pre-Breakout", .90, "bb_squeeze_flag = 1 AND vcp_quality_score >= 70 AND r >= 85 AND volume_z_20_252 >= .5"),
    ("VCP Setup", .80, "vcp_quality_score >= 60 AND r >= 75 AND sma_stack_score >= 75"), ("BB Squeeze with RS", .75, "bb_squeeze_flag = 1 AND bb_width_pct_252d < 20 AND r >= 70"),
    ("Range Consolidation", .70, "bb_squeeze_flag = 1 OR bb_width_pct_252d < 15"), ("Failed Breakout", .85, "failed_breakout_flag_10d = 1 AND p < 0 AND r < 70"),
    ("Trending (Generic)", .65, "primary_state = 'TRENDING'"), ("Routine Pullback", .65, "primary_state = 'PULLBACK'"),
    ("Consolidating (Generic)", .65, "primary_state = 'CONSOLIDATING'"), ("Exhaustion (Generic)", .65, "primary_state = 'EXHAUSTION'"),
    ("Deteriorating (Generic)", .65, "primary_state = 'DETERIORATING'"),
]


def _legacy() -> str:
    case = lambda i: " ".join(f"WHEN {c} THEN " + (f"'{n}'" if i == 0 else repr(p)) for n, p, c in LEGACY)
    return _scored(f"SELECT {KEYS}, CASE {case(0)} ELSE 'Indeterminate Pattern' END AS legacy_setup, {rnd('CASE ' + case(1) + ' ELSE 0.55 END')} AS legacy_confidence "
                   "FROM (SELECT * REPLACE (rs_rating_spy AS r), atr_x_50 AS x, pct_ma_50 AS p, CASE WHEN atr_14 IS NOT NULL THEN greatest(atr_14, 1e-6) END AS atr FROM lc)")


def _z(fams: tuple[str, ...]) -> str:
    names = [f"z_{n}" for n in Z_NAMES if family(n) in fams]
    return w(", ".join(_Z), f"SELECT {KEYS}, {cols(*names)} FROM zp")


def oracle_sql() -> dict[str, str]:
    d: dict[str, str] = {}
    ohlc = ("open", "high", "low", "close", "adj_close", "volume")
    for name, p in (("bars_supplier_month", "sm"), ("bars_weekly", "bw"), ("bars_five_day", "bx"), ("bars_user_day", "ud")):
        d[name] = w(panel(p), f"SELECT {KEYS}, {cols(*ohlc)} FROM bars")
    d["densify_panel"] = w(panel("bd"), f"SELECT {KEYS}, t, grp, {cols('close', 'volume', 'b1_close', 'b2_close')} FROM panel")
    d["wide_long_roundtrip"] = w(panel("sm"), "SELECT basket AS entity, strftime(date, '%Y-%m-%d') AS date, " + cols("close", "volume")
                                 + " FROM (SELECT basket, date, avg(close) AS close, sum(volume) AS volume FROM bars JOIN mem USING (entity) WHERE NOT is_primary GROUP BY 1, 2)")
    d["roll_mean_std"] = _dense("bd", mean_50=roll("avg", "close", 50, 20), std_20=roll("stddev_samp", "close", 20, 10), mean_20=roll("avg", "close", 20))
    d["roll_minmax"] = _dense("bd", max_40=roll("max", "high", 40, 10), min_40=roll("min", "low", 40, 10), prior_max_20=roll("max", "high", 20, 5, shift=1))
    d["roll_sum_count"] = _dense("bd", vol_25=roll("sum", "volume", 25, 10))
    d["roll_quantile"] = _dense("bw", q80=roll("quantile_cont({x}, 0.8) {w}", "close", 52, 40), q05=roll("quantile_cont({x}, 0.05) {w}", "close", 52, 40))
    lst = f"list(close) FILTER (close IS NOT NULL) {last_n(52)}"
    inner = f"SELECT *, {lst} AS l FROM panel"
    d["roll_rank"] = w(panel("bw"), f"SELECT {KEYS}, " + cols(
        rank_52="CASE WHEN close IS NOT NULL AND len(l) >= 20 THEN (len(list_filter(l, lambda x: x < close)) + (len(list_filter(l, lambda x: x = close)) + 1) / 2.0) / len(l) END",
        share_le_52="CASE WHEN close IS NOT NULL AND len(l) >= 20 THEN len(list_filter(l, lambda x: x <= close)) / len(l) END") + f" FROM ({inner}) WHERE {NO_BENCH}")
    d["pct_changes"] = _dense("bd", ret_1=_chg(1), ret_21=_chg(21), lead_5=lead("close", 5))
    d["pct_rank"] = _sm(f"SELECT {KEYS}, {cols(rank_1=pct_rank('ret_1'), rank_12=pct_rank('ret_12'))} FROM smr")
    d["pct_rank_bucketed"] = _sm(f"SELECT {KEYS}, {cols(rank_1=pct_rank('ret_1'))} FROM smr")
    rz = OS._robust("smr", "srz", {"q_1": "ret_1", "q_12": "ret_12"})
    d["robust_z"] = _sm(f"SELECT {KEYS}, " + cols(**{f"z_{k}": f"CASE WHEN q_{k} IS NOT NULL THEN greatest(-10.0, least(10.0, q_{k})) END" for k in ("1", "12")}) + " FROM srz", rz)
    wd = "OVER (PARTITION BY date)"
    d["standard_z"] = _sm(f"SELECT {KEYS}, " + cols(z_1=f"CASE WHEN stddev_pop(ret_1) {wd} < 1e-10 THEN 0.0 ELSE (ret_1 - avg(ret_1) {wd}) / nullif(stddev_pop(ret_1) {wd}, 0) END") + " FROM smr")
    wz = f"CASE WHEN ret_1 IS NOT NULL THEN greatest(quantile_cont(ret_1, 0.01) {wd}, least(quantile_cont(ret_1, 0.99) {wd}, ret_1)) END"
    d["winsorize"] = d["winsorize_bucketed"] = _sm(f"SELECT {KEYS}, {cols(w_1=wz)} FROM smr")
    wg = "OVER (PARTITION BY date, grp)"
    d["group_z_nation"] = _sm(f"SELECT {KEYS}, grp, " + cols(z_12=f"CASE WHEN grp_size >= 3 THEN (ret_12 - avg(ret_12) {wg}) / nullif(stddev_samp(ret_12) {wg}, 0) END") + " FROM smr")
    rk = "rank() OVER (PARTITION BY date, grp ORDER BY ret_12 DESC NULLS LAST)::DOUBLE"
    ok = "ret_12 IS NOT NULL AND grp_size >= 2"
    d["group_rank_nation"] = _sm(f"SELECT {KEYS}, grp, " + cols(rank=f"CASE WHEN {ok} THEN {rk} END", rank_pct=f"CASE WHEN {ok} THEN {rk} / count(ret_12) {wg} END") + " FROM smr")
    d["top_share_region"] = w(panel("sm"), "SELECT basket, strftime(date, '%Y-%m-%d') AS date, " + cols(
        top3="list_sum(list_sort(l, 'DESC')[1:3]) / s", top_quarter="list_sum(list_sort(l, 'DESC')[1:greatest(1, ceil(len(l) / 4.0))::INT]) / s")
        + " FROM (SELECT basket, date, list(volume) AS l, sum(volume) AS s FROM bars JOIN mem USING (entity) WHERE NOT is_primary GROUP BY 1, 2)")
    d["momentum_screen"] = w(
        panel("sm") + f", m1 AS MATERIALIZED (SELECT *, {roll('avg', 'close', 12, 9)} AS sma_12, {_chg(6)} AS ret_6, {_chg(12)} AS ret_12 FROM panel), "
        f"m2 AS MATERIALIZED (SELECT *, (close - sma_12) / sma_12 * 100.0 AS pct_ma, ret_6 * 0.6 + ret_12 * 0.4 AS blend FROM m1), m3 AS MATERIALIZED (SELECT *, {pct_rank('blend')} * 98.0 + 1.0 AS score FROM m2), "
        f"m4 AS (SELECT *, CASE WHEN score IS NULL THEN NULL WHEN score >= quantile_cont(score, 0.92) {wd} THEN 'S' WHEN score >= quantile_cont(score, 0.80) {wd} THEN 'A' "
        f"WHEN score >= quantile_cont(score, 0.55) {wd} THEN 'B' WHEN score >= quantile_cont(score, 0.30) {wd} THEN 'C' ELSE 'D' END AS grade FROM m3)",
        f"SELECT {KEYS}, grade, grp, {cols('close', 'sma_12', 'pct_ma', 'ret_6', 'ret_12', 'score')} FROM (SELECT * FROM m4 WHERE {NO_BENCH} AND date = (SELECT max(date) FROM m4) AND score IS NOT NULL "
        "ORDER BY score DESC, entity LIMIT 10)")

    for name, (nums, text) in FEATURE_QUERIES.items():
        sel = ", ".join([KEYS, *text, *([cols(*nums)] if nums else [])])
        d[name] = _feat(f"SELECT {sel} FROM feat")
    d["z_robust"], d["z_logit"] = _z(("robust",)), _z(("logit", "correlation"))
    d["z_bounded_log"], d["z_rating_binary"] = _z(("bounded", "log")), _z(("percentile", "binary"))
    d["component_blend"] = w(", ".join(_C), f"SELECT {KEYS}, {cols(*config.COMPONENTS, 's_demand')} FROM cp")
    probs = [f"{p}{s}" for p in ("p_", "p_adj_") for s in config.STATES]
    d["state_softmax"] = _scored(f"SELECT {KEYS}, primary_state, {cols(*probs, 'state_confidence')} FROM lc")
    d["score_blend"] = _scored(f"SELECT {KEYS}, n_valid_components, is_partial, {cols('score_z', 'score_raw', 'score', 'weight_present')} FROM lc")
    d["grade_quantiles"] = _scored(f"SELECT {KEYS}, grade, {cols('score')} FROM lc")
    d["leadership_tier"] = _scored(f"SELECT {KEYS}, leadership_tier, is_basket_leader, {cols('s_rs_leadership_0_100')} FROM lc")
    d["setup_cascade"] = _scored(f"SELECT {KEYS}, setup, setup_matches, {cols('setup_confidence')} FROM lc")
    d["legacy_setup_cascade"] = _legacy()
    d["display_labels"] = _display()
    tk = "basket, strftime(date, '%Y-%m-%d') AS date"
    for name, (nums, keep) in THEME_QUERIES.items():
        d[name] = _themes(f"SELECT {', '.join([tk, *keep, cols(*nums)])} FROM th")
    d["theme_rs_line"] = _themes(f"SELECT {tk}, {cols('theme_rs_new_60d_high', 'theme_rs_new_252d_high', 'theme_rs_pct_252d', theme_rs_line_log='ln(theme_rs_line_value)')} FROM th")

    d["dq_firewall"] = w(f"{panel('bx')}, {NB}, {firewall('nb', DEFAULT_LIMITS)}", FW_TEXT)
    d["dq_firewall_overrides"] = w(f"{panel('ud')}, {NB}, {firewall('nb', UD, 'SELECT entity FROM mem', True)}", FW_TEXT)
    d["overrides_roundtrip"] = d["dq_firewall_overrides"]
    d["gate_filter"] = w(f"{panel('ud')}, {NB}, {firewall('nb', UD, 'SELECT entity FROM mem', True)}",
                         f"SELECT {KEYS}, {cols('close', 'volume')} FROM bars WHERE NOT ({NO_BENCH}) OR entity IN (SELECT entity FROM fw WHERE status IN ('PASS', 'WARNING'))")
    d["dq_reasons"] = w(f"{panel('ud')}, {NB}, {firewall('nb', UD)}", "SELECT code, count(*) AS n FROM (SELECT unnest(list_concat(crit, warn)) AS code FROM fw) GROUP BY code")
    d["dq_status"] = w(f"{panel('bd')}, {NB}, {firewall('nb', DEFAULT_LIMITS)}", "SELECT status, count(*) AS n FROM fw GROUP BY status")
    d["ingest_rejects"] = w(panel("sm"), "SELECT r_name AS entity, 'empty_frame' AS reason FROM region UNION ALL SELECT s_suppkey::VARCHAR, 'empty_frame' FROM supplier WHERE s_suppkey::VARCHAR NOT IN (SELECT entity FROM bars)")
    ca = f"{panel('bd')}, {NB}, {ADJ}, {CA}"
    d["corporate_actions"] = w(ca, f"SELECT {KEYS}, type FROM ca")
    d["corporate_action_summary"] = w(ca, "SELECT type, count(*) AS n_events, count(*) FILTER (date >= (SELECT max(date) FROM adj) - INTERVAL 30 DAY) AS n_recent FROM ca GROUP BY type")
    d["most_affected"] = w(ca, "SELECT entity, count(*) AS n_events FROM ca GROUP BY entity ORDER BY n_events DESC, entity LIMIT 10")

    d["anomalies_score"] = _scored(f"SELECT {KEYS}, type, severity, {cols('score', 'score_prev', 'abs_jump', 'roll_z')} FROM an1", AN)
    d["anomalies_grade"] = _scored(f"SELECT {KEYS}, grade, grade_prev, gap, severity FROM an2", AN)
    d["anomalies_state"] = _scored(f"SELECT {KEYS}, states, severity FROM an3", AN)
    d["anomaly_summary"] = _scored("SELECT type, count(*) AS n, count(*) FILTER (severity = 'high') AS n_high FROM (SELECT type, severity FROM an1 UNION ALL SELECT type, severity FROM an2 UNION ALL SELECT type, severity FROM an3) GROUP BY type", AN)
    d["label_transitions"] = _scored("SELECT entity, sum(CASE WHEN setup <> p THEN 1 ELSE 0 END)::BIGINT AS transitions FROM (SELECT entity, setup, lag(setup) OVER (PARTITION BY entity ORDER BY date) AS p FROM lc JOIN dk USING (date) WHERE k < 30) GROUP BY entity", DAYS)
    tiers = ", ".join(f"'{t}'" for t in config.TIERS)
    p6, a6 = " + ".join(f"p_{s}" for s in config.STATES), " + ".join(f"p_adj_{s}" for s in config.STATES)
    checks = [
        ("score_in_0_100", "(SELECT count(*) FROM lc WHERE score < 0 OR score > 100) = 0"), ("state_probs_sum_to_1", f"(SELECT count(*) FROM lc WHERE abs({p6} - 1) > 1e-3) = 0"),
        ("state_p_adj_sum_to_1", f"(SELECT count(*) FROM lc WHERE abs({a6} - 1) > 1e-3) = 0"), ("no_inf_components", "(SELECT count(*) FROM lc WHERE isinf(s_rs) OR isinf(s_mtf)) = 0"),
        ("grade_s_pct_in_range", "(SELECT count(*) FILTER (grade = 'S') * 100.0 / count(*) FROM lc) BETWEEN 2 AND 15"),
        ("leadership_tier_values_valid", f"(SELECT count(*) FROM lc WHERE leadership_tier NOT IN ({tiers})) = 0"), ("setup_confidence_in_0_1", "(SELECT count(*) FROM lc WHERE setup_confidence < 0 OR setup_confidence > 1) = 0"),
        ("index_alignment", "(SELECT count(*) FROM lc WHERE entity IS NULL OR date IS NULL) = 0"), ("theme_score_coverage", "(SELECT count(theme_score) * 1.0 / count(*) FROM th) >= 0.5"),
        ("features_fresh", "date_diff('day', (SELECT max(date) FROM lc), DATE '2001-11-01') <= 5"),
        ("universe_coverage", "(SELECT count(DISTINCT entity) FROM lc JOIN dk USING (date) WHERE k < 30 AND score IS NOT NULL) >= 20"),
    ]
    d["sanity_checks"] = _themes(" UNION ALL ".join(f"SELECT '{n}' AS name, {c} AS passed" for n, c in checks), DAYS)
    d["coverage_report"] = w(f"{panel('bx')}, {NB}, {firewall('nb', DEFAULT_LIMITS)}",
                             "SELECT (SELECT count(DISTINCT entity) FROM mem) AS declared, (SELECT count(DISTINCT entity) FROM nb) AS present, (SELECT count(DISTINCT entity) FROM mem WHERE entity NOT IN (SELECT entity FROM nb)) AS silent_missing, "
                             + cols(quality_pass_pct="(SELECT count(*) FILTER (status <> 'FAIL') * 100.0 / count(*) FROM fw)", coverage_pct="(SELECT count(DISTINCT entity) FROM nb) * 100.0 / (SELECT count(DISTINCT entity) FROM mem)"))
    d["coverage_anti"] = "SELECT c_custkey AS entity FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"
    o = dict(order="date")
    d["reconcile_sources"] = w(
        f"{panel('bx')}, {NB}, ra AS (SELECT entity, date, close, {roll('avg', 'close', 50, **o)} AS ma, {div('close', lag('close', 252, **o))} - 1.0 AS ret, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS r FROM nb), "
        "nc AS (SELECT entity, date, arg_max(px, ord) AS close FROM raw WHERE second GROUP BY 1, 2), "
        f"rb AS (SELECT entity, date, close, {roll('avg', 'close', 50, **o)} AS ma, {div('close', lag('close', 252, **o))} - 1.0 AS ret, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS r FROM nc)",
        f"SELECT a.entity, {rnd('a.close')} AS close_a, {rnd('a.ma')} AS ma_a, {rnd('abs((a.close - b.close) / b.close)')} AS close_gap, coalesce(abs((a.close - b.close) / b.close) > 0.005, false) OR coalesce(abs((a.ma - b.ma) / b.ma) > 0.01, false) "
        "OR coalesce(abs(a.ret - b.ret) > 0.02, false) AS discrepant FROM (SELECT * FROM ra WHERE r = 1) a JOIN (SELECT * FROM rb WHERE r = 1) b USING (entity)")
    split = lambda tag, cond: (f"{tag} AS (SELECT r.entity, r.date, m.basket AS grp, arg_max(px, ord) AS close FROM raw r JOIN mem m ON m.entity = r.entity AND m.is_primary WHERE {cond} GROUP BY 1, 2, 3), "  # noqa: E731
                               f"{tag}s AS (SELECT * FROM {tag} WHERE CAST('0x' || substr(md5('42|' || entity || '|' || strftime(date, '%Y-%m-%d')), 1, 8) AS BIGINT) < {_lookup(dict(RECONCILE_SHARES), 'grp', '0.0')} * 4294967296.0)")
    d["reconcile_sampled"] = w(
        f"{panel('bx')}, {split('ka', 'NOT second')}, {split('kb', 'second')}, kj AS (SELECT entity, date, grp, a.close AS close_a, b.close AS close_b, abs((a.close - b.close) / nullif(b.close, 0)) AS gap "
        "FROM kas a FULL JOIN kbs b USING (entity, date, grp))",
        f"SELECT {KEYS}, grp, {cols('close_a', 'close_b', 'gap')}, CASE WHEN close_b IS NULL THEN 'only_a' WHEN close_a IS NULL THEN 'only_b' ELSE 'both' END AS side, "
        "close_a IS NULL OR close_b IS NULL OR coalesce(gap > 0.005, false) AS discrepant FROM kj")
    d["key_alignment"] = w(f"{panel('bx')}, {NB}, dn AS (SELECT * FROM panel WHERE {NO_BENCH})",
                           "SELECT (SELECT count(*) FROM dn) AS n_left, (SELECT count(*) FROM nb) AS n_right, (SELECT count(*) FROM dn WHERE close IS NULL) AS only_left, 0::BIGINT AS only_right, (SELECT max(date) FROM dn) = (SELECT max(date) FROM nb) AS same_latest")
    days = [OF.features("sd"), OS.standardized(), OS.components(), OS.state(), OS.score()]
    d["features_supplier_day"] = w(days[0], f"SELECT {KEYS}, {cols(*SUPPLIER_FEATURES)} FROM feat")
    d["z_supplier_day"] = w(", ".join(days[:2]), f"SELECT {KEYS}, {cols(*[f'z_{c}' for c in SUPPLIER_FEATURES])} FROM zp")
    d["score_supplier_day"] = w(", ".join(days), f"SELECT {KEYS}, {cols(*config.COMPONENTS, 'score')}, grade, primary_state FROM sc")
    d["level3_findings"] = _l3()
    d.update(_planted_queries())
    d["check_status"] = f"SELECT passed, count(*) AS n FROM ({d['sanity_checks']}) GROUP BY passed"
    d["component_health"] = _scored(
        f"SELECT component, n, n_inf, n_null, n_extreme, {rnd('n_null / n')} AS null_rate, CASE WHEN n_inf > 0 THEN 'ERROR' WHEN n_null / n > 0.05 OR n_extreme > 0 THEN 'WARN' ELSE 'OK' END AS verdict FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS component, count(*) AS n, count(*) FILTER (isinf({c})) AS n_inf, count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER (abs({c}) > 5) AS n_extreme FROM lc WHERE {LATEST}" for c in config.COMPONENTS) + ")")
    d["grade_monotonic"] = _scored(
        f"SELECT grade, {rnd('m')} AS median_score, coalesce(m > lag(m) OVER (ORDER BY instr('SABCD', grade)) + 1e-6, false) AS inverted FROM (SELECT grade, median(score) AS m FROM lc WHERE {LATEST} AND grade IS NOT NULL GROUP BY grade)")
    d["price_freshness"] = w(panel("ud"), f"SELECT entity, rows_behind FROM (SELECT entity, (SELECT max(t) FROM cal) - max(t) AS rows_behind FROM bars JOIN cal USING (date) WHERE {NO_BENCH} GROUP BY entity) WHERE rows_behind > 0")
    mk = {"m1": "2000-06-01", "m2": "2001-06-01", "m3": "2030-01-01"}
    msel = []
    for m, dt in mk.items():
        msel += [f"coalesce(min(date) FILTER (score IS NOT NULL AND date >= DATE '{dt}'), max(date) FILTER (score IS NOT NULL)) AS {m}_date",
                 f"coalesce(arg_min(score, date) FILTER (score IS NOT NULL AND date >= DATE '{dt}'), arg_max(score, date) FILTER (score IS NOT NULL)) AS {m}_score"]
    hc = ("SELECT entity, count(*) AS total_rows, count(score) AS valid_rows, count(*) FILTER (t < 252 AND score IS NOT NULL) AS warmup_violations, count(*) FILTER (score < 0 OR score > 100) AS out_of_bounds, "
          "min(date) FILTER (score IS NOT NULL) AS earliest_valid, max(date) FILTER (score IS NOT NULL) AS latest_valid, min(score) AS score_min, max(score) AS score_max, avg(score) AS score_mean, " + ", ".join(msel) + " FROM lc GROUP BY entity")
    d["history_coverage"] = _scored("SELECT entity, total_rows, valid_rows, warmup_violations, out_of_bounds, " + ", ".join(day(c) for c in ("earliest_valid", "latest_valid", "m1_date", "m2_date", "m3_date"))
                                    + ", " + cols("score_min", "score_max", "score_mean", "m1_score", "m2_score", "m3_score") + f" FROM ({hc})")

    d["forward_return"] = w(_EV, f"SELECT {KEYS}, horizon, {cols('fwd')} FROM fw0")
    d["ic_per_date"] = w(_EV, f"SELECT {day()}, horizon, score_name, n, {cols('ic')} FROM ic")
    d["ic_summary"] = w(_EV, _ic_summary("score_name, horizon"))
    d["rolling_ic"] = w(_EV, f"SELECT score_name, horizon, {day()}, {cols('rolling_ic')} FROM (SELECT *, {roll('avg', 'ic', 12, part='score_name, horizon', order='date')} AS rolling_ic FROM ic WHERE ic IS NOT NULL) WHERE rolling_ic IS NOT NULL")
    tr, te, st = EVAL_WINDOWS
    at = lambda off: f"(SELECT strftime(date, '%Y-%m-%d') FROM cal WHERE t = a + {off})"
    d["walk_forward_windows"] = w(_EVW, f"SELECT window_idx::INT AS window_idx, {at(0)} AS train_start, {at(tr - 1)} AS train_end, {at(tr)} AS test_start, {at(tr + te - 1)} AS test_end FROM wn")
    d["walk_forward_ic"] = w(_EVW, f"SELECT score_type, score_name, horizon, window_idx::INT AS window_idx, n_train_dates, n_test_dates, {cols('is_ic', 'oos_ic')} FROM wi")
    d["oos_summary"] = w(_EVW, f"SELECT score_type, score_name, horizon, n_windows, {cols(*OOS_NUMS)} FROM os")
    d["feature_audit"] = w(f"{_EVW}, {_audit(2, 3)}", f"{_AUDIT_COLUMNS} FROM hb")
    d["component_summary"] = w(_EVW, _COMPONENT_COLUMNS)
    d["oos_significance"] = w(_EVW, _SIGNIFICANCE)
    rolled = roll("avg", "ic", 60, part=SCORE_KEYS, order="date")
    d["full_ic_per_date"] = _full(f"SELECT {day()}, {SCORE_KEYS}, n, {cols('ic')} FROM ic")
    d["full_ic_summary"] = _full(_ic_summary(SCORE_KEYS))
    d["full_rolling_ic"] = _full(f"SELECT {SCORE_KEYS}, {day()}, {cols('rolling_ic')} FROM (SELECT *, {rolled} AS rolling_ic FROM ic WHERE ic IS NOT NULL) WHERE rolling_ic IS NOT NULL")
    d["full_walk_forward_ic"] = _full(f"SELECT {SCORE_KEYS}, window_idx::INT AS window_idx, n_train_dates, n_test_dates, {cols('is_ic', 'oos_ic')} FROM wi")
    d["full_oos_summary"] = _full(f"SELECT {SCORE_KEYS}, n_windows, {cols(*OOS_NUMS)} FROM os")
    d["full_oos_significance"] = _full(_SIGNIFICANCE)
    d["full_feature_audit"] = _full(f"{_AUDIT_COLUMNS}, neg AND n_horizons >= 4 AS sign_flip_candidate FROM hb", _audit(20, 10))
    d["full_component_summary"] = _full(_COMPONENT_COLUMNS)
    zed = ", ".join(f"CASE WHEN stddev_pop({c[2:]}) OVER d < 1e-10 THEN 0.0 ELSE ({c[2:]} - avg({c[2:]}) OVER d) / nullif(stddev_pop({c[2:]}) OVER d, 0) END AS {c}" for c in RIDGE_COLS)
    small = f"{_EVW}, rz AS (SELECT entity, date, {zed} FROM ev1 WINDOW d AS (PARTITION BY date)), {ridge('rz', RIDGE_COLS, 3, 200)}"
    for k, sql in _ridge_queries(RIDGE_COLS).items():
        d[f"ridge_{k}"] = w(small, sql)
    large = ridge("sc", config.COMPONENTS, RIDGE_HORIZON, 1000)
    for k, sql in _ridge_queries(config.COMPONENTS).items():
        if k != "alphas":
            d[f"full_ridge_{k}"] = _full(sql, large)
    d["full_ridge_adopt"] = _full(f"SELECT {cols(gain_primary='gp', gain_short='gs')}, t_ok, n_unstable, coalesce(gp >= 10 AND gs >= 10, false) AND t_ok AND n_unstable = 0 AS adopt FROM ao, au",
                                  f"{large}, {_adopt()}")
    ew = _lookup(effective_weights(), "score_name", "0.0")
    d["horizon_audit"] = w(
        _audit_ctes() + f", hz AS (SELECT score_name, max(oos_ic_mean) FILTER (horizon = 20) AS a, max(oos_ic_mean) FILTER (horizon = 60) AS b, max({ew}) AS e FROM os GROUP BY score_name)",
        f"SELECT score_name, {cols(oos_ic_20d='a', oos_ic_60d='b', effective_weight='e')}, CASE WHEN (coalesce(a > 0.025, false) OR coalesce(b > 0.025, false)) AND e < 0.020 THEN 'A' "
        "WHEN e > 0.020 AND abs(coalesce(a, 0)) < 0.005 AND abs(coalesce(b, 0)) < 0.005 THEN 'C' ELSE 'B' END AS category FROM hz")

    bench = "bm AS MATERIALIZED (SELECT * FROM bars WHERE entity = 'MKT')"
    one = dict(part="entity", order="date")
    d["vol_regime"] = w(
        f"{panel('bx')}, {bench}, v0 AS (SELECT date, entity, ln(adj_close) - {lag('ln(adj_close)', **one)} AS r FROM bm), v1 AS MATERIALIZED (SELECT * FROM (SELECT date, {roll('stddev_samp', 'r', 20, 15, **one)} * sqrt(252.0) AS vol FROM v0) WHERE vol IS NOT NULL), "
        "v2 AS (SELECT max(date) AS latest_date, arg_max(vol, date) AS latest_vol, quantile_cont(vol, 0.33) AS tercile_lo, quantile_cont(vol, 0.67) AS tercile_hi FROM v1)",
        f"SELECT {day('latest_date')}, {cols('latest_vol', 'tercile_lo', 'tercile_hi')}, CASE WHEN latest_vol <= tercile_lo THEN 'LOW' WHEN latest_vol >= tercile_hi THEN 'HIGH' ELSE 'MID' END AS regime FROM v2")
    d["drawdown_regime"] = w(
        f"{panel('bx')}, {bench}, r0 AS (SELECT date, adj_close, {roll('max', 'adj_close', 252, 63, **one)} AS h, {roll('avg', 'adj_close', 200, 50, **one)} AS m FROM bm), r1 AS (SELECT *, (adj_close - h) / h AS dd, coalesce(adj_close > m, false) AS up FROM r0 WHERE h IS NOT NULL)",
        f"SELECT {day()}, {rnd('dd')} AS drawdown, up AS above_ma, CASE WHEN NOT dd > -0.15 THEN 'RED' WHEN up THEN 'GREEN' ELSE 'YELLOW' END AS regime_state FROM r1")
    d["regime_context"] = (f"SELECT v.regime, v.latest_vol, r.regime_state, r.drawdown, 'G3|G4' AS weak_groups FROM ({d['vol_regime']}) v, "
                           f"(SELECT * FROM ({d['drawdown_regime']}) ORDER BY date DESC LIMIT 1) r")
    d["dvol_quintile"] = w(
        f"{panel('sm')}, {NB}, q0 AS (SELECT entity, date, {roll('avg', '(close * volume)', 20, 10, order='date')} AS dvol FROM nb), q1 AS (SELECT *, row_number() OVER (ORDER BY dvol, entity) / count(*) OVER () AS r FROM q0 WHERE date = (SELECT max(date) FROM nb) AND dvol IS NOT NULL)",
        f"SELECT entity, {cols('dvol')}, (CASE WHEN r <= 0.2 THEN 1 WHEN r <= 0.4 THEN 2 WHEN r <= 0.6 THEN 3 WHEN r <= 0.8 THEN 4 ELSE 5 END)::BIGINT AS quintile FROM q1")
    sn = ", ".join(f"score - (SELECT score FROM lc p JOIN dk USING (date) WHERE p.entity = l.entity AND k = {k}) AS delta_{k}" for k in (1, 5, 21))
    d["snapshot_view"] = _scored(f"SELECT {KEYS}, grade, primary_state, leadership_tier, setup, grp, {cols('score', 'delta_1', 'delta_5', 'delta_21')} FROM (SELECT *, {sn} FROM lc l WHERE {LATEST} AND score IS NOT NULL)", DAYS)
    for name, dirn in (("gainers", "DESC"), ("losers", "ASC")):
        d[name] = _scored(f"SELECT entity, t0 AS leadership_tier, {cols(score='s0', score_change='c')} FROM (SELECT *, s0 - s1 AS c FROM dc WHERE s0 - s1 IS NOT NULL ORDER BY s0 - s1 {dirn}, entity LIMIT 5)", CHG)
    d["grade_moves"] = _scored(f"SELECT entity, CASE WHEN g0 <> g1 THEN g1 || ' -> ' || g0 ELSE '-' END AS grade_move, {cols(score_change='s0 - s1')} FROM (SELECT * FROM dc WHERE s0 - s1 IS NOT NULL AND g0 IS NOT NULL AND g1 IS NOT NULL "
                               "ORDER BY (g0 <> g1) DESC, abs(s0 - s1) DESC, entity LIMIT 8)", CHG)
    d["contributions"] = _scored(_contrib())
    qs = ", ".join(f"quantile_cont(score, {q}) AS q{int(q * 100)}" for q in (.30, .55, .80, .92))
    d["grade_threshold_history"] = _scored(f"SELECT {day()}, {cols('q30', 'q55', 'q80', 'q92')} FROM (SELECT date, {qs} FROM lc WHERE score IS NOT NULL GROUP BY date)")
    fill = lambda c: (f"coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
    d["threshold_alignment"] = _scored(f"SELECT {day()}, {cols('q30', 'q92')} FROM (SELECT date, {fill('a')} AS q30, {fill('b')} AS q92 FROM cal LEFT JOIN (SELECT date, quantile_cont(score, 0.30) AS a, quantile_cont(score, 0.92) AS b FROM lc "
                                       "WHERE score IS NOT NULL AND date IN (SELECT max(date) FROM lc WHERE score IS NOT NULL GROUP BY date_trunc('month', date)) GROUP BY date) USING (date))")
    d["peers"] = _scored(f"SELECT entity, grade, {cols('score')} FROM (SELECT * FROM lc WHERE {LATEST} AND score IS NOT NULL AND entity <> 'Brand#7' AND entity IN (SELECT entity FROM mem WHERE basket IN (SELECT basket FROM mem WHERE entity = 'Brand#7')) ORDER BY score DESC, entity LIMIT 5)")
    d["top_by_group"] = _scored(f"SELECT basket, rank, entity, {cols('score')} FROM (SELECT basket, entity, score, row_number() OVER (PARTITION BY basket ORDER BY score DESC, entity) AS rank FROM lc JOIN mem USING (entity) WHERE {LATEST} AND score IS NOT NULL) WHERE rank <= 3")
    d["label_screen"] = _scored(f"SELECT {KEYS}, grade, leadership_tier, {cols('score')} FROM (SELECT * FROM lc WHERE {LATEST} AND score IS NOT NULL AND leadership_tier IN ('STRONG_PERFORMER', 'NEUTRAL', 'UNCLASSIFIED', 'ESTABLISHED_LEADER') "
                                "AND primary_state = 'INDETERMINATE' ORDER BY score DESC, entity LIMIT 5)")
    d["themes_view"] = _themes(f"SELECT basket, theme_class, n_constituents, {cols('theme_score')}, coalesce(mm[1], '-') AS top_member, coalesce(array_to_string(mm, ', '), '-') AS members FROM (SELECT * FROM th WHERE date = (SELECT max(date) FROM th) AND theme_score IS NOT NULL AND n_constituents >= 3) "
                               f"LEFT JOIN (SELECT basket, list(entity ORDER BY score DESC, entity) AS mm FROM lc JOIN mem USING (entity) WHERE {LATEST} AND score IS NOT NULL GROUP BY basket) USING (basket)")
    d.update(_run_queries())
    placed = "SELECT basket, entity, row_number() OVER (PARTITION BY basket ORDER BY score DESC, entity) - 1 AS k FROM ({}) WHERE score IS NOT NULL"
    lists = "SELECT basket, k // {} AS part, count(*) AS n, string_agg(entity, ', ' ORDER BY k) AS members FROM ({}) GROUP BY 1, 2"
    scored_members = f"SELECT basket, entity, score FROM lc JOIN (SELECT DISTINCT basket, entity FROM mem) USING (entity) WHERE {LATEST}"
    d["theme_members"] = _scored(lists.format(2, placed.format(scored_members)))
    d["theme_top_member"] = _scored(f"SELECT basket, max(entity) FILTER (k = 0) AS top_member, count(*) AS n FROM ({placed.format(scored_members)}) GROUP BY 1")
    d["user_group_members"] = w(f"{panel('ud')}, {NB}", lists.format(4, placed.format("SELECT basket, entity, sum(volume) AS score FROM nb JOIN mem USING (entity) GROUP BY 1, 2")))
    means = "SELECT score_name, horizon, avg(ic) AS {} FROM ic {} GROUP BY 1, 2"
    early = means.format("expected", "JOIN (SELECT date FROM cal WHERE t < (SELECT count(*) FROM cal) // 2) USING (date)")
    d["ic_gate"] = w(_EV, f"SELECT score_name, horizon, {cols('expected', 'ic_mean')}, coalesce(abs(ic_mean - expected) <= {IC_TOLERANCE}, false) AS passed FROM ({early}) JOIN ({means.format('ic_mean', '')}) USING (score_name, horizon)")
    d["key_metrics"] = _metrics()
    d["entity_history"] = _scored(f"SELECT {day()}, grade, primary_state, leadership_tier, setup, {cols('score')} FROM lc WHERE entity = 'Brand#7' AND date >= DATE '2001-10-29' - INTERVAL 365 DAY")
    d["last_bars"] = w(panel("bx"), f"SELECT {day()}, {cols('close', 'volume')} FROM (SELECT * FROM bars WHERE entity = 'MKT' ORDER BY date DESC LIMIT 30)")
    d["last_dates_slice"] = _scored("SELECT entity, count(score) AS n_scored FROM lc JOIN dk USING (date) WHERE k < 30 GROUP BY entity", DAYS)
    d["kth_date_slice"] = _scored(f"SELECT {KEYS}, grade, {cols('score')} FROM lc JOIN dk USING (date) WHERE k = 5", DAYS)
    d["snapshot_roundtrip"] = _scored(f"SELECT {KEYS}, grade, primary_state, strftime(date, '%Y-%m-%d') AS snapshot_date, {cols('score')} FROM lc WHERE {LATEST}")
    d["slim_latest"] = _scored(f"SELECT {KEYS}, grade, primary_state, {cols('score')} FROM lc WHERE {LATEST}")
    d["serving_resolution"] = _scored(f"SELECT {KEYS}, grade, primary_state, {cols('score')} FROM lc")
    d["exclude_sector"] = ("SELECT entity, sector AS gics_sector FROM (SELECT 'S-' || (s_suppkey % 50)::VARCHAR AS entity, min({'company': s_name, 'sector': n_name}).sector AS sector "
                           "FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) WHERE sector <> 'NATION_3'")
    d["label_distribution"] = _scored(f"SELECT primary_state, n, {rnd('n / sum(n) OVER ()')} AS share FROM (SELECT primary_state, count(*) AS n FROM lc GROUP BY 1)")
    d["report_roundtrip"] = d["label_distribution"]
    d["top_setups"] = _scored("SELECT setup, count(*) AS n FROM lc WHERE setup <> '' GROUP BY setup ORDER BY n DESC, setup LIMIT 10")
    d["run_meta"] = _scored(f"SELECT rows, entities, dates, {day('min_date')}, {day('max_date')}, {cols('p1', 'p99')} FROM (SELECT count(*) AS rows, count(DISTINCT entity) AS entities, count(DISTINCT date) AS dates, min(date) AS min_date, max(date) AS max_date, "
                            "quantile_cont(score, 0.01) AS p1, quantile_cont(score, 0.99) AS p99 FROM lc)")
    d["value_ties"] = "SELECT count(*) AS distinct_values, max(n) AS max_ties FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1)"
    sw = state_weights()["TRENDING"]
    tcomp = " + ".join(f"{x!r} * {c}" for x, c in zip(sw, config.COMPONENTS, strict=True))
    d["run_comparison"] = _scored(f"SELECT entity, {cols(score_a='a', score_b='b', delta='b - a')} FROM (SELECT entity, score AS a, {tcomp} AS b FROM lc WHERE {LATEST} AND score IS NOT NULL ORDER BY score DESC, entity LIMIT 20) WHERE b IS NOT NULL")
    mig = "CASE leadership_tier " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MIGRATION["leadership_tier"].items()) + " ELSE leadership_tier END"
    d["label_migration"] = _scored(f"SELECT {KEYS}, {mig} AS leadership_tier, {cols(chart_score='score')} FROM lc")
    d["migration_report"] = _scored("SELECT 'leadership_tier' AS column_name, count(*) FILTER (leadership_tier IN ('STRONG_PERFORMER', 'DETERIORATING')) AS n_changed FROM lc")
    d["origin_diagnostics"] = _scored(f"SELECT origin, count(*) AS n, {rnd('avg(score)')} AS mean_score, {rnd('median(score)')} AS median_score, {rnd('avg(' + flag('grade IN (' + chr(39) + 'S' + chr(39) + ', ' + chr(39) + 'A' + chr(39) + ')') + ') * 100.0')} AS pct_s_a "
                                      "FROM (SELECT *, CASE WHEN regexp_extract(entity, '([0-9]+)', 1)::INT <= 12 THEN 'PROD' ELSE 'SANDBOX' END AS origin FROM lc WHERE score IS NOT NULL) GROUP BY origin")
    d["new_entities"] = "SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1"
    d["primary_assignment"] = w(panel("sm"), "SELECT entity, CASE WHEN entity::BIGINT % 10 = 0 THEN max(basket) FILTER (is_primary) ELSE max(basket) FILTER (NOT is_primary) END AS primary_basket FROM mem GROUP BY entity")
    d["tags_for"] = w(panel("bx"), "SELECT entity, string_agg(basket, '|' ORDER BY basket) AS tags FROM mem WHERE NOT is_primary GROUP BY entity")
    d["universe_nested"] = w(panel("sm"), "SELECT basket, entity, category FROM mem WHERE is_primary")
    kinds = "(SELECT basket, min(category) AS category, min(basket_type) AS basket_type FROM mem GROUP BY basket)"
    d["membership_queries"] = w(panel("bx"), (
        "SELECT 'entity' AS what, entity AS key, '' AS value FROM (SELECT DISTINCT entity FROM mem) UNION ALL "
        "SELECT 'tag_basket', basket, '' FROM (SELECT DISTINCT basket FROM mem WHERE basket_type = 'TAG') UNION ALL "
        "SELECT 'constituent_G1', entity, '' FROM (SELECT DISTINCT entity FROM mem WHERE basket = 'G1') UNION ALL "
        "SELECT 'tagged_T2', entity, '' FROM (SELECT DISTINCT entity FROM mem WHERE basket = 'T2' AND NOT is_primary) UNION ALL "
        "SELECT 'primary', entity, min(basket) FROM mem WHERE is_primary GROUP BY entity UNION ALL "
        f"SELECT 'category', basket, category FROM {kinds} UNION ALL SELECT 'type', basket, basket_type FROM {kinds}"))
    d["union_universe"] = w(panel("bx"), (
        "SELECT entity, coalesce(a.basket, b.basket) AS basket, a.basket IS NULL AS only_new "
        "FROM (SELECT entity, min(basket) AS basket FROM mem WHERE is_primary AND basket IN ('G0', 'G1', 'G2') GROUP BY entity) a "
        "FULL JOIN (SELECT entity, min(basket) AS basket FROM mem WHERE NOT is_primary GROUP BY entity) b USING (entity)"))
    total = " + ".join(f"p_{s}" for s in config.STATES)
    one = ("v AS (SELECT min(score) AS lo, max(score) AS hi, quantile_cont(score, 0.01) AS q1, quantile_cont(score, 0.99) AS q9, "
           f"max(abs({total} - 1.0)) AS gap, count(score) AS n, avg(CASE WHEN score IS NOT NULL THEN (grade[1:1] IN ('S', 'A'))::INT END) AS top, "
           "(SELECT count(DISTINCT basket) FROM th) AS g, (SELECT count(DISTINCT entity) FROM mem) AS m FROM lc WHERE date = (SELECT max(date) FROM lc))")
    checks5 = (("score_min", "lo", "lo >= 0"), ("score_max", "hi", "hi <= 100"), ("score_p1", "q1", "q1 < q9"), ("score_p99", "q9", "q1 < q9"),
               ("probability_gap", "gap", "gap <= 1e-6"), ("scored", "n::DOUBLE", "n > 0"), ("declared", "m::DOUBLE", "m >= n"), ("groups", "g::DOUBLE", "g > 0"), ("top_grades", "top", "top < 0.5"))
    d["run_validation"] = _themes(" UNION ALL ".join(f"SELECT '{n}' AS name, {rnd(c)} AS observed, coalesce({ok}, false) AS passed FROM v" for n, c, ok in checks5), one)
    named = lambda c, m: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + f" ELSE {c} END"
    back = lambda c, m: named(c, {v: k for k, v in m.items()})
    d["label_translation"] = _scored(
        f"SELECT state_display, tier_display, {back('state_display', config.STATE_DISPLAY)} AS state, CASE WHEN leadership_tier IS NOT NULL THEN {back('tier_display', config.TIER_DISPLAY)} END AS tier "
        f"FROM (SELECT DISTINCT primary_state, leadership_tier, coalesce({named('primary_state', config.STATE_DISPLAY)}, '') AS state_display, "
        f"coalesce({named('leadership_tier', config.TIER_DISPLAY)}, 'No RS Signal') AS tier_display FROM lc)")
    d["sector_assignment"] = w(panel("bx"), "SELECT p_brand AS entity, CASE WHEN max(m.basket) IS NOT NULL THEN max(m.basket) ELSE 'SEC_' || min(p_type) END AS basket FROM part LEFT JOIN (SELECT * FROM mem WHERE is_primary AND basket IN ('G0', 'G1')) m ON m.entity = p_brand GROUP BY p_brand")
    d["canonical_constituents"] = ("SELECT entity, r.company AS company, r.gics_sector AS gics_sector, '' AS founded FROM (SELECT 'S-' || (s_suppkey % 50)::VARCHAR AS entity, min({'company': s_name, 'gics_sector': n_name}) AS r "
                                   "FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)")
    d["combine_sources"] = w(f"{panel('ud')}, {NB}, sec AS (SELECT entity, date, arg_max(px, ord) AS own FROM raw WHERE second GROUP BY ALL)",
                             f"SELECT {KEYS}, {cols(close='coalesce(own, -close)')} FROM nb LEFT JOIN sec USING (entity, date)")
    d["stream_bars"] = w(f"{panel('ud')}, {NB}", f"SELECT {KEYS}, {cols('open', 'high', 'low', 'close', 'volume')} FROM nb")
    d["stream_bars_closed"] = w(f"{panel('ud')}, {NB}", f"SELECT {KEYS}, {cols('open', 'high', 'low', 'close', 'volume')} FROM nb "
                                "WHERE date + 1 <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)")
    d["stream_bars_rejected"] = (
        "WITH a AS (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events), b AS (SELECT min(s) AS lo, greatest(max(s) - min(s), 1) AS span FROM a), "
        "c AS (SELECT a.*, least(2, (s - lo) * 3 // span) AS third FROM a, b), "
        f"p AS (SELECT *, CASE WHEN third = 0 AND event_id % {LATE_EVERY} = 0 THEN 2 ELSE third END AS part FROM c) "
        "SELECT event_id, user_id, 'late' AS reason FROM p WHERE part = 2 AND ts < (SELECT max(ts) - INTERVAL 2 DAY FROM p WHERE part < 2)")
    d["stream_indicators"] = w(
        f"{panel('bx')}, ownb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) - 1 AS t FROM bars), {OF.recursion('ownb')}",
        f"SELECT {KEYS}, {cols('ema_21', 'atr_14', 'rsi_14', 'adx_14', 'supertrend_direction')} FROM ownb JOIN rec USING (entity, t) JOIN st USING (entity, t) WHERE {NO_BENCH}")
    return d
