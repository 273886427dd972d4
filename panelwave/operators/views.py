"""Context regimes and serving views over the stored tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwave import config
from panelwave.functions.expr import div
from panelwave.functions.rolling import TimeAxis
from panelwave.operators import xsection as xs
from panelwave.operators.score import state_weights
from panelwave.operators.sizing import materialize

col = F.col


# ---- dates --------------------------------------------------------------------------------------
def ranked_dates(df: DataFrame) -> DataFrame:
    """Distinct dates, k = 0 for the latest; one row per date."""
    return df.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy(col("date").desc())) - 1)


def latest(df: DataFrame) -> DataFrame:
    """Rows of the latest date."""
    return df.join(F.broadcast(df.agg(F.max("date").alias("date"))), "date", "left_semi")  # one row


def kth_date(df: DataFrame, k: int, dates: DataFrame | None = None) -> DataFrame:
    """Rows of the k-th previous date."""
    days = (ranked_dates(df) if dates is None else dates).where(col("k") == k).select("date")
    return df.join(F.broadcast(days), "date", "left_semi")  # one row


def last_dates(df: DataFrame, n: int) -> DataFrame:
    return df.join(F.broadcast(ranked_dates(df).where(col("k") < n).select("date")), "date", "left_semi")  # n rows


def period(df: DataFrame, name: str, as_of: Column) -> DataFrame:
    """Rows inside 1W / 1M / 3M / 6M / 1Y / 3Y / 5Y before as_of; INCEPTION keeps all."""
    days = config.PERIOD_DAYS.get(name)
    return df if days is None else df.where(col("date") >= F.date_sub(as_of, days))


# ---- market context -----------------------------------------------------------------------------
def vol_regime(bench: DataFrame, rows: int = 20, need: int = 15) -> DataFrame:
    """Latest realised volatility of the benchmark against its own terciles."""
    w = TimeAxis("one", "date")
    lr = bench.withColumn("one", F.lit(1)).select("one", "date", (F.ln("adj_close") - F.lag(F.ln("adj_close")).over(w.spec)).alias("_r"))
    v = lr.select("date", (w.std(col("_r"), rows, need) * math.sqrt(252)).alias("vol")).where(col("vol").isNotNull())
    s = v.agg(F.percentile("vol", [0.33, 0.67]).alias("_q"), F.max_by("vol", "date").alias("latest_vol"), F.max("date").alias("latest_date"))
    lo, hi, x = col("_q")[0], col("_q")[1], col("latest_vol")
    return s.select("latest_date", "latest_vol", lo.alias("tercile_lo"), hi.alias("tercile_hi"),
                    F.when(x <= lo, "LOW").when(x >= hi, "HIGH").otherwise("MID").alias("regime"))


def drawdown_regime(bench: DataFrame, limit: float = -0.15, by_date: bool = False) -> DataFrame:
    """GREEN / YELLOW / RED from the drawdown off the 252-row high and the 200-row mean."""
    w = TimeAxis("one", "date")
    c = col("adj_close")
    x = bench.withColumn("one", F.lit(1)).select(
        "date", "adj_close", w.max(c, 252, 63).alias("high_252"), w.mean(c, 200, 50).alias("ma_200"))
    x = x.withColumn("drawdown", (c - col("high_252")) / col("high_252")).where(col("drawdown").isNotNull())
    above = F.coalesce(c > col("ma_200"), F.lit(False))
    x = x.select("date", "adj_close", "high_252", "drawdown", above.alias("above_ma"),
                 F.when(~(col("drawdown") > limit), "RED").when(above, "GREEN").otherwise("YELLOW").alias("regime_state"))
    return x if by_date else latest(x)


def dollar_volume_quintile(bars: DataFrame, rows: int = 20, need: int = 10, bound: xs.Bound = xs.Bound()) -> DataFrame:
    """Quintile 1..5 of mean dollar volume at the latest date; equal values keep entity order."""
    w = TimeAxis("entity", "date")
    v = bars.withColumn("_d", col("close") * col("volume")).select("entity", "date", w.mean(col("_d"), rows, need).alias("dvol"))
    snap = latest(v).where(col("dvol").isNotNull())
    if xs._fits(bound):
        r = F.row_number().over(Window.partitionBy("date").orderBy("dvol", "entity")) / F.count("*").over(Window.partitionBy("date"))
        ranked = snap.withColumn("_r", r)
    else:  # order inside a tie only matters within that value, so ties get their own small window
        oc = xs.ordered_counts(snap.select("date", "dvol"), ["date"], "dvol").select("date", "dvol", "below", "total")
        tie = F.row_number().over(Window.partitionBy("date", "dvol").orderBy("entity"))
        ranked = snap.withColumn("_t", tie).join(oc, ["date", "dvol"]).withColumn("_r", (col("below") + col("_t")) / col("total"))
    q = F.when(col("_r") <= 0.2, 1).when(col("_r") <= 0.4, 2).when(col("_r") <= 0.6, 3).when(col("_r") <= 0.8, 4).otherwise(5)
    return ranked.select("entity", "dvol", q.alias("quintile"))


def regime_context(bench: DataFrame, weak_groups: Sequence[str] = ()) -> DataFrame:
    """One row bundling both regimes and the configured weak groups."""
    v = vol_regime(bench).select(F.struct("*").alias("market_vol"))
    d = drawdown_regime(bench).select(F.struct("*").alias("design_space"))
    return v.join(F.broadcast(d)).withColumn(  # one row each
        "weak_groups", F.array(*[F.lit(g) for g in weak_groups]).cast("array<string>"))


# ---- snapshots and movers -----------------------------------------------------------------------
def snapshot(scored: DataFrame, deltas: Sequence[int] = (1, 5, 21), keep: Sequence[str] = ()) -> DataFrame:
    """Latest scored rows with the score change against earlier dates."""
    days = ranked_dates(scored).where(col("k").isin(0, *deltas))
    recent = scored.join(F.broadcast(days), "date")  # a handful of dates
    then = recent.where(col("k") > 0).groupBy("entity").agg(
        *[F.max(F.when(col("k") == k, col("score"))).alias(f"_s{k}") for k in deltas])
    now = recent.where(col("k") == 0).join(then, "entity", "left")
    return now.where(col("score").isNotNull()).select(
        "entity", "date", "score", *keep, *[(col("score") - col(f"_s{k}")).alias(f"delta_{k}") for k in deltas])


def day_change(scored: DataFrame) -> DataFrame:
    """Latest date against the previous one: score change and both grades."""
    days = ranked_dates(scored).where(col("k") <= 1)
    x = scored.join(F.broadcast(days), "date")  # two dates
    return x.groupBy("entity").agg(
        *[F.max(F.when(col("k") == k, col(c))).alias(f"{c}_{k}") for c in ("score", "grade", "leadership_tier") for k in (0, 1)]
    ).select("entity", col("score_0").alias("score"), (col("score_0") - col("score_1")).alias("score_change"),
             col("grade_1").alias("grade_prev"), col("grade_0").alias("grade"), col("leadership_tier_0").alias("leadership_tier"))


def movers(scored: DataFrame, n: int = 10, gainers: bool = True) -> DataFrame:
    c = day_change(scored).where(col("score_change").isNotNull())
    order = col("score_change").desc() if gainers else col("score_change").asc()
    return c.orderBy(order, "entity").limit(n).select("entity", "leadership_tier", "score", "score_change")


def grade_moves(scored: DataFrame, n: int = 10) -> DataFrame:
    """Grade changers first, then the largest absolute score changes, up to n rows."""
    c = day_change(scored).where(col("score_change").isNotNull() & col("grade").isNotNull() & col("grade_prev").isNotNull())
    changed = col("grade") != col("grade_prev")
    move = F.when(changed, F.concat_ws(" -> ", "grade_prev", "grade")).otherwise("-")
    return c.orderBy(changed.desc(), F.abs("score_change").desc(), "entity").limit(n).select(
        "entity", move.alias("grade_move"), "score_change")


def contributions(scored: DataFrame) -> DataFrame:
    """z * weight of the row's primary state per component, the largest absolute contribution first; zero weights hidden."""
    w = state_weights()
    items = []
    for i, c in enumerate(config.COMPONENTS):
        m = F.create_map(*[F.lit(v) for s in config.STATES for v in (s, float(w[s][i]))])
        items.append(F.struct(F.lit(c).alias("component"), col(c).alias("z_score"),
                              F.element_at(m, F.coalesce("primary_state", F.lit("INDETERMINATE"))).alias("weight")))
    x = scored.select("entity", "date", F.explode(F.array(*items)).alias("r")).select("entity", "date", "r.*")
    x = x.where(col("weight") != 0).withColumn("contribution", F.coalesce(col("z_score"), F.lit(0.0)) * col("weight"))
    return x.orderBy("entity", "date", F.abs("contribution").desc(), "component")


def grade_thresholds(scored: DataFrame, bound: xs.Bound = xs.Bound()) -> DataFrame:
    """Score quantiles behind the grades, per date."""
    return xs.group_quantiles(scored.where(col("score").isNotNull()), ["date"], {
        "q30": ("score", .30), "q55": ("score", .55), "q80": ("score", .80), "q92": ("score", .92)}, bound)


def aligned_thresholds(dates: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Thresholds on a date list: forward-filled, then back-filled (one row per date)."""
    cols = [c for c in thresholds.columns if c != "date"]
    w = Window.orderBy("date")
    x = dates.select("date").join(thresholds, "date", "left")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    down = w.rowsBetween(0, Window.unboundedFollowing)
    return x.select("date", *[F.coalesce(F.last(c, ignorenulls=True).over(up), F.first(c, ignorenulls=True).over(down)).alias(c) for c in cols])


def peers(scored: DataFrame, members: DataFrame, entity: str, n: int = 10) -> DataFrame:
    """Best scored members of an entity's groups at the latest date, itself left out."""
    groups = members.where(col("entity") == entity).select("basket")
    ids = members.join(groups, "basket", "left_semi").where(col("entity") != entity).select("entity").distinct()
    return latest(scored).join(ids, "entity", "left_semi").where(col("score").isNotNull()).orderBy(
        col("score").desc(), "entity").limit(n).select("entity", "score", "grade")


def top_by_group(scored: DataFrame, members: DataFrame, n: int = 10) -> DataFrame:
    """Top n of every group at the latest date, in two steps so a hot group is cut per partition first."""
    x = latest(scored).where(col("score").isNotNull()).join(members.select("basket", "entity").distinct(), "entity")
    salted = x.withColumn("_salt", F.pmod(F.xxhash64("entity"), F.lit(32)))
    best = [col("score").desc(), col("entity")]
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy("basket", "_salt").orderBy(*best))).where(col("_r") <= n)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("basket").orderBy(*best))).where(
        col("rank") <= n).select("basket", "rank", "entity", "score")


def screen(scored: DataFrame, n: int = 20, tiers: Sequence[str] | None = None, states: Sequence[str] | None = None) -> DataFrame:
    """Label-filtered top-n of the latest date."""
    x = latest(scored).where(col("score").isNotNull())
    if tiers:
        x = x.where(col("leadership_tier").isin(*tiers))
    if states:
        x = x.where(col("primary_state").isin(*states))
    return x.orderBy(col("score").desc(), "entity").limit(n)


def themes_view(themes: DataFrame, scored: DataFrame, members: DataFrame) -> DataFrame:
    """Latest valid groups ranked by score, with the top member and all members in score order."""
    t = latest(themes).where(col("theme_score").isNotNull() & (col("n_constituents") >= 3))
    m = latest(scored).where(col("score").isNotNull()).join(members.select("basket", "entity").distinct(), "entity")
    listed = m.groupBy("basket").agg(F.sort_array(F.collect_list(F.struct((-col("score")).alias("s"), "entity"))).alias("_m"))
    listed = listed.select("basket", col("_m")[0]["entity"].alias("top_member"),
                           F.array_join(F.transform("_m", lambda r: r["entity"]), ", ").alias("members"))
    x = t.join(listed, "basket", "left")
    return x.select("basket", "theme_score", "theme_class", "n_constituents", F.coalesce("top_member", F.lit("-")).alias("top_member"),
                    F.coalesce("members", F.lit("-")).alias("members"))


def member_lists(rows: DataFrame, group: str = "basket", member: str = "entity", value: str = "score", size: int = 1000,
                 task_rows: int = 1_000_000) -> DataFrame:
    """group, part, n, members: each group's members by falling value (ties by name), comma-joined, ``size`` to a row.

    Rows are cut into ranges of (group, value, member), so a group of any size, and any number of ties, is spread over
    tasks; a member's place is its place in its range plus the counts of the ranges before. A text never grows with its
    group. Rows without group, member or value are left out; repeated members are listed as often as they occur.
    """
    own = rows.select(col(group).alias("_g"), col(value).alias("_v"), col(member).alias("_m")).dropna()
    order = [col("_v").desc(), col("_m")]
    parts = max(1, -(-own.count() // task_rows))
    x = materialize(own.repartitionByRange(parts, col("_g"), *order).withColumn("_p", F.spark_partition_id()))
    ahead = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = x.groupBy("_g", "_p").agg(F.count("*").alias("_n")).select(
        "_g", "_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    placed = x.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_p").orderBy(*order))).join(before, ["_g", "_p"])
    placed = placed.withColumn("_at", col("_before") + col("_r") - 1)
    out = placed.groupBy("_g", F.floor(col("_at") / size).alias("part")).agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("_at", "_m"))).alias("_list"))
    return out.select(col("_g").alias(group), "part", "n", F.array_join(F.transform("_list", lambda r: r["_m"]), ", ").alias("members"))


def top_members(rows: DataFrame, group: str = "basket", member: str = "entity", value: str = "score") -> DataFrame:
    """group, top_member, n: the member of highest value (ties by name) and how many have a value; one partial aggregate."""
    return rows.where(col(value).isNotNull()).groupBy(group).agg(
        F.min_by(member, F.struct(-col(value), col(member))).alias("top_member"), F.count("*").alias("n"))


def entity_history(scored: DataFrame, entity: str, name: str, as_of: Column) -> DataFrame:
    return period(scored.where(col("entity") == entity), name, as_of).select(
        "date", "score", "grade", "primary_state", "leadership_tier", "setup")


def last_bars(bars: DataFrame, entity: str, k: int) -> DataFrame:
    return bars.where(col("entity") == entity).orderBy(col("date").desc()).limit(k)


METRICS = (  # (label, column, format) - fixed values
    ("% from 50-day Moving Average", "pct_ma_50", "pct"), ("% from 200-day Moving Average", "pct_ma_200", "pct"),
    ("% from 52-week High", "pct_from_52w_high", "pct"), ("Average Directional Index (14)", "adx_14", "n1"),
    ("Relative Strength Index (14)", "rsi_14", "n1"), ("Realized Volatility (60-day)", "realized_vol_60", "n1"),
    ("Within-Basket Z-Score (21-day)", "within_basket_z_21d", "n2"), ("Distribution Days (25-day)", "distribution_days_25", "int"),
)


def format_metric(x: Column, kind: str) -> Column:
    text = {"pct": F.concat(F.format_string("%+.1f", x), F.lit("%")), "n1": F.format_number(x, 1), "n2": F.format_number(x, 2),
            "int": F.format_number(x.cast("long"), 0)}[kind]
    return F.when(x.isNotNull(), text).otherwise("-")


def key_metrics(features: DataFrame) -> DataFrame:
    """Formatted metric rows per entity at the latest date."""
    items = [F.struct(F.lit(n).alias("metric"), format_metric(col(c), k).alias("value")) for n, c, k in METRICS]
    return latest(features).select("entity", F.explode(F.array(*items)).alias("m")).select("entity", "m.*")


def check_status_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("passed").agg(F.count("*").alias("n"))


# ---- label distributions, run metadata, run comparison ------------------------------------------
def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Share of each label among labelled rows."""
    g = df.where(col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return g.withColumn("share", col("n") / F.sum("n").over(Window.partitionBy()))  # one row per label


def top_labels(df: DataFrame, label: str, n: int = 10) -> DataFrame:
    return df.where(col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(col("n").desc(), label).limit(n)


def run_meta(df: DataFrame, value: str) -> DataFrame:
    """Row, entity and date counts, date range and p1 / p99 of a value in one aggregate."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct("entity").alias("entities"), F.count_distinct("date").alias("dates"),
                  F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.percentile(value, [0.01, 0.99]).alias("_q")
                  ).select("rows", "entities", "dates", "min_date", "max_date", col("_q")[0].alias("p1"), col("_q")[1].alias("p99"))


def value_ties(df: DataFrame, value: str) -> DataFrame:
    """Number of distinct values and the largest tie."""
    return df.where(col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).agg(
        F.count("*").alias("distinct_values"), F.max("n").alias("max_ties"))


def compare_runs(a: DataFrame, b: DataFrame, anchors: int | None = None) -> DataFrame:
    """Shared entities of two runs' latest dates with the score delta; anchors keeps run a's best n."""
    x = latest(a).where(col("score").isNotNull()).select("entity", col("score").alias("score_a"), col("grade").alias("grade_a"))
    if anchors is not None:
        x = x.orderBy(col("score_a").desc(), "entity").limit(anchors)
    y = latest(b).where(col("score").isNotNull()).select("entity", col("score").alias("score_b"), col("grade").alias("grade_b"))
    j = x.join(y, "entity")
    return j.withColumn("delta", col("score_b") - col("score_a")).orderBy(F.abs("delta").desc(), "entity")


def tag_origin(df: DataFrame, known: DataFrame, yes: str = "PROD", no: str = "SANDBOX") -> DataFrame:
    k = known.select("entity").distinct().withColumn("_k", F.lit(1))
    return df.join(k, "entity", "left").withColumn("origin", F.when(col("_k").isNotNull(), yes).otherwise(no)).drop("_k")


def origin_diagnostics(tagged: DataFrame) -> DataFrame:
    """Per origin: rows, mean and median score, share of top grades."""
    return tagged.where(col("score").isNotNull()).groupBy("origin").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.median("score").alias("median_score"),
        (F.avg(F.coalesce(col("grade").isin("S", "A"), F.lit(False)).cast("double")) * 100.0).alias("pct_s_a"))


def new_entities(reference: DataFrame, known: DataFrame, by: str | None = None) -> DataFrame:
    """Entities of a reference list that are not in the known universe; counted per ``by`` when given."""
    x = reference.join(known.select("entity").distinct(), "entity", "left_anti")
    return x.groupBy(by).agg(F.count("*").alias("n")) if by else x


def migrate(df: DataFrame, renames: Mapping[str, str], values: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Rename columns, then replace label values by map; other values stay."""
    out = df.withColumnsRenamed(dict(renames))
    return out.withColumns({
        c: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in m.items() for v in kv]), col(c)), col(c)) for c, m in values.items()})


def migration_report(df: DataFrame, values: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Rows that each value map would change."""
    items = [F.struct(F.lit(c).alias("column_name"), F.count_if(col(c).isin(*m)).alias("n_changed")) for c, m in values.items()]
    return df.agg(F.array(*items).alias("r")).select(F.explode("r").alias("r")).select("r.*")
