"""SQL text for the comparison engine: the panels and helper snippets shared by the oracle queries."""

from __future__ import annotations

from panelwave import config
from panelwave.functions.expr import normal_cdf_sql

ORDER = "row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"


def rnd(x: str) -> str:
    """Magnitude-dependent rounding, the same rule as ``queries.rnd``.

    The small shift moves decimal ties (prices are cents over whole quantities) off the rounding edge;
    + 0.0 removes negative zero.
    """
    return (f"(CASE WHEN abs({x}) < 1e3 THEN round({x} + 1.37e-8, 6) WHEN abs({x}) < 1e6 THEN round({x} + 1.37e-5, 3) "
            f"ELSE round({x} + 1.37e-2, 0) END + 0.0)")


def cols(*names: str, **exprs: str) -> str:
    """Select list of rounded columns."""
    parts = [f"{rnd(n)} AS {n}" for n in names] + [f"{rnd(e)} AS {k}" for k, e in exprs.items()]
    return ", ".join(parts)


KEYS = "entity, strftime(date, '%Y-%m-%d') AS date"


def over(a: str, b: str = "CURRENT ROW", part: str = "entity", order: str = "t") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {a} AND {b})"


def last_n(n: int, shift: int = 0, **kw) -> str:
    return over(f"{n - 1 + shift} PRECEDING", "CURRENT ROW" if shift == 0 else f"{shift} PRECEDING", **kw)


def roll(fn: str, x: str, n: int, m: int | None = None, shift: int = 0, **kw) -> str:
    w = last_n(n, shift, **kw)
    call = fn.format(x=x, w=w) if "{" in fn else f"{fn}({x}) {w}"
    return f"(CASE WHEN count({x}) {w} >= {n if m is None else m} THEN {call} END)"


def lag(x: str, k: int = 1, part: str = "entity", order: str = "t") -> str:
    return f"(lag({x}, {k}) OVER (PARTITION BY {part} ORDER BY {order}))"


def lead(x: str, k: int = 1, part: str = "entity", order: str = "t") -> str:
    return f"(lead({x}, {k}) OVER (PARTITION BY {part} ORDER BY {order}))"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def flag(c: str) -> str:
    return f"(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def clip(x: str, lo: str, hi: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END)"


def phi(z: str) -> str:
    return normal_cdf_sql(z, "")


def slope(y: str, n: int, x: str = "t", **kw) -> str:
    w = last_n(n, **kw)
    return f"(CASE WHEN count({y}) {w} = {n} THEN regr_slope({y}, {x}::DOUBLE) {w} END)"


def r2(y: str, n: int, x: str = "t", **kw) -> str:
    w = last_n(n, **kw)
    return (f"(CASE WHEN count({y}) {w} = {n} AND regr_syy({y}, {x}::DOUBLE) {w} > 0 "
            f"THEN regr_r2({y}, {x}::DOUBLE) {w} END)")


def pct_rank(x: str, by: str = "date") -> str:
    """Average-tie percentile rank among non-null values."""
    return (f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) "
            f"+ (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END)")


ADJUSTED = ("close * (CASE WHEN entity IN ('MKT', 'MKT_R') THEN 1.0 WHEN date < DATE '1998-01-01' THEN 0.5 "
            "WHEN date < DATE '2000-01-01' THEN 0.94 ELSE 1.0 END)")


CARRIED = (
    "filled AS (SELECT e.entity, d.date, b.open, b.high, b.low, b.close, b.volume, "
    + ", ".join(f"last_value(b.{c} IGNORE NULLS) OVER (PARTITION BY e.entity ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS {n}"
                for c, n in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "carried")))
    + " FROM (SELECT DISTINCT entity FROM bars0) e "
    "CROSS JOIN (SELECT date FROM bars0 WHERE entity = 'MKT') d LEFT JOIN bars0 b ON b.entity = e.entity AND b.date = d.date), "
    "bars1 AS (SELECT entity, date, coalesce(open, o) AS open, coalesce(high, h) AS high, coalesce(low, l) AS low, "
    "coalesce(close, carried) AS close, coalesce(volume, 0.0) AS volume FROM filled WHERE carried IS NOT NULL), "
)


def _bars(raw: str, own: bool = False) -> str:
    one = ("arg_min(px, ord) AS open, max(px) AS high, min(px) AS low, arg_max(px, ord) AS close, "
           "sum(v)::DOUBLE AS volume")
    return (
        f"raw AS (SELECT *, 1 AS one FROM ({raw})), "
        f"bars0 AS (SELECT entity, date, {one} FROM raw GROUP BY ALL "
        f"UNION ALL SELECT 'MKT', date, {one} FROM raw GROUP BY date "
        f"UNION ALL SELECT 'MKT_R', date, {one} FROM raw WHERE second GROUP BY date), "
        f"{CARRIED if own else ''}bars AS MATERIALIZED (SELECT *, {ADJUSTED if own else 'close'} AS adj_close FROM {'bars1' if own else 'bars0'}), "
        "cal AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, close AS b1_close, "
        "(SELECT close FROM bars x WHERE x.entity = 'MKT_R' AND x.date = b.date) AS b2_close "
        "FROM bars b WHERE entity = 'MKT')"
    )


def _days(n: int) -> str:
    """Brand bars of so many days, counted from the epoch."""
    return (f"SELECT p_brand AS entity, l_shipdate::DATE - (date_diff('day', DATE '1970-01-01', l_shipdate::DATE) % {n})::INT AS date, l_returnflag = 'R' AS second, "
            f"round(pow(l_extendedprice / l_quantity / 1000.0, 0.1) * 100.0, 6) AS px, l_quantity AS v, {ORDER} AS ord FROM lineitem JOIN part ON l_partkey = p_partkey")


RAW = {
    "sm": ("SELECT l_suppkey::VARCHAR AS entity, date_trunc('month', l_shipdate)::DATE AS date, l_returnflag = 'R' AS second, "
           f"l_extendedprice / l_quantity AS px, l_quantity AS v, {ORDER} AS ord FROM lineitem"),
    "bw": ("SELECT p_brand AS entity, date_trunc('week', l_shipdate)::DATE AS date, l_returnflag = 'R' AS second, "
           f"l_extendedprice / l_quantity AS px, l_quantity AS v, {ORDER} AS ord FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "bx": _days(5), "bt": _days(3),
    "sd": ("SELECT l_suppkey::VARCHAR AS entity, l_shipdate::DATE AS date, l_returnflag = 'R' AS second, "
           f"round(pow(l_extendedprice / l_quantity / 1000.0, 0.1) * 100.0, 6) AS px, l_quantity AS v, {ORDER} AS ord FROM lineitem"),
    "bd": ("SELECT p_brand AS entity, l_shipdate::DATE AS date, l_returnflag = 'R' AS second, "
           f"l_extendedprice / l_quantity AS px, l_quantity AS v, {ORDER} AS ord FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "ud": ("SELECT user_id::VARCHAR AS entity, ts::DATE AS date, event_type = 'purchase' AS second, value AS px, "
           "1.0::DOUBLE AS v, row(ts, event_id) AS ord FROM events"),
}
MEMBERS = {
    "sm": ("SELECT n_name AS basket, s_suppkey::VARCHAR AS entity, r_name AS category, 'CORE' AS basket_type, true AS is_primary "
           "FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL "
           "SELECT r_name, s_suppkey::VARCHAR, 'REGION', 'TAG', false "
           "FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "ud": ("SELECT 'U' || (user_id % 10)::VARCHAR AS basket, user_id::VARCHAR AS entity, 'USERS' AS category, "
           "'CORE' AS basket_type, true AS is_primary FROM (SELECT DISTINCT user_id FROM events)"),
}
MEMBERS["sd"] = MEMBERS["sm"]
_BRAND = ("SELECT 'G' || (no % 5)::VARCHAR AS basket, p_brand AS entity, 'BRANDS' AS category, 'CORE' AS basket_type, true AS is_primary FROM b "
          "UNION ALL SELECT 'T' || (no % 3)::VARCHAR, p_brand, 'TAGS', 'TAG', false FROM b")
for _p in ("bw", "bx", "bt", "bd"):
    MEMBERS[_p] = ("WITH b AS (SELECT DISTINCT p_brand, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS no FROM part) " + _BRAND)


def panel(p: str) -> str:
    """CTEs raw, bars, cal, mem, grp, panel (dense; benchmarks included)."""
    return (
        f"{_bars(RAW[p], p in ('bx', 'bt', 'sd'))}, mem AS MATERIALIZED ({MEMBERS[p]}), "
        "grp0 AS (SELECT e.entity, coalesce(basket, 'UNKNOWN') AS grp FROM (SELECT DISTINCT entity FROM bars) e "
        "LEFT JOIN (SELECT * FROM mem WHERE is_primary) m USING (entity)), "
        "grp AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY grp) AS grp_size FROM grp0), "
        "panel AS MATERIALIZED (SELECT g.entity, g.grp, g.grp_size, c.date, c.t, b.open, b.high, b.low, b.close, b.adj_close, b.volume, "
        "c.b1_close, c.b2_close FROM cal c CROSS JOIN grp g LEFT JOIN bars b ON b.entity = g.entity AND b.date = c.date)"
    )


NO_BENCH = "entity NOT IN ('MKT', 'MKT_R')"


# ---- recursions: one step per calendar row ------------------------------------------------------
def ema_step(prev: str, w: str, x: str, alpha: float) -> tuple[str, str]:
    """Next value and next pending weight of an exponential average with gap decay."""
    d = f"({w} * {1.0 - alpha!r})"
    val = (f"CASE WHEN {x} IS NULL THEN {prev} WHEN {prev} IS NULL THEN {x} "
           f"ELSE ({d} * {prev} + {alpha!r} * {x}) / ({d} + {alpha!r}) END")
    wt = f"CASE WHEN {x} IS NOT NULL OR {prev} IS NULL THEN 1.0::DOUBLE ELSE {d} END"
    return val, wt


def ema_recursion(name: str, source: str, order: str, items: dict[str, tuple[str, float, int]]) -> str:
    """CTE computing several averages at once: items[out] = (column, alpha, min observations)."""
    first, nxt, carry = [], [], []
    for o, (x, a, _) in items.items():
        first += [f"{x} AS v_{o}", f"1.0::DOUBLE AS w_{o}", f"(CASE WHEN {x} IS NULL THEN 0 ELSE 1 END) AS n_{o}"]
        v, w = ema_step(f"r.v_{o}", f"r.w_{o}", f"s.{x}", a)
        nxt += [f"{v}", f"{w}", f"r.n_{o} + (CASE WHEN s.{x} IS NULL THEN 0 ELSE 1 END)"]
        carry += [f"(CASE WHEN n_{o} >= {items[o][2]} THEN v_{o} END) AS {o}"]
    return (
        f"{name}_r AS (SELECT entity, {order} AS k, {', '.join(first)} FROM {source} "
        f"WHERE {order} = (SELECT min({order}) FROM {source}) UNION ALL "
        f"SELECT s.entity, s.{order}, {', '.join(nxt)} FROM {name}_r r JOIN {source} s ON s.entity = r.entity AND s.{order} = r.k + 1), "
        f"{name} AS MATERIALIZED (SELECT entity, k AS {order}, {', '.join(carry)} FROM {name}_r)"
    )


def rma_seed(x: str, n: int, **kw) -> str:
    """Seeded input of a Wilder average: simple mean at the first full window, NULL before and in gaps."""
    part, order = kw.get("part", "entity"), kw.get("order", "t")
    w = last_n(n, part=part, order=order)
    w1 = last_n(n, 1, part=part, order=order)
    return (f"(CASE WHEN count({x}) {w} = {n} THEN CASE WHEN count({x}) {w1} = {n} THEN {x} "
            f"ELSE avg({x}) {w} END END)")


FEATURE_NAMES = config.FEATURES
