"""Group (theme) rollup: breadth, leadership, volume, relative strength and a theme score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwave.functions.expr import div, flag, normal_cdf, weighted
from panelwave.functions.rolling import TimeAxis
from panelwave.operators import cascades
from panelwave.operators import xsection as xs

col = F.col
BY = ("basket", "date")
MIN_MEMBERS = 3


def active_membership(members: DataFrame, entities: DataFrame, need: int = MIN_MEMBERS) -> DataFrame:
    """Groups with enough declared members, restricted to entities in the panel, and still big enough."""
    pairs = members.select("basket", "entity")

    def large(x: DataFrame) -> DataFrame:  # counts are combined before they are shuffled: a tag may hold most entities
        return x.join(x.groupBy("basket").count().where(col("count") >= need).select("basket"), "basket", "left_semi")

    declared = large(pairs).distinct()
    return large(declared.join(entities.select("entity").distinct(), "entity", "left_semi")).select("basket", "entity")


def own_row_inputs(bars: DataFrame) -> DataFrame:
    """60-row high flag and return on the entity's own rows (not calendar rows)."""
    w = TimeAxis("entity", "date")
    high = w.max(col("close"), 60)
    return bars.select(
        "entity", "date",
        F.when(high.isNotNull(), flag(col("close") >= high)).alias("new_60d_high"),
        w.change(col("adj_close"), 1).alias("close_ret"),
    )


def share(cond: Column) -> Column:
    """Percentage of rows where cond holds; unknown counts as no."""
    return F.avg(flag(cond)) * 100.0


def rollup(panel: DataFrame, by: Sequence[str] = BY, bound: xs.Bound = xs.Bound()) -> DataFrame:
    """All per-(basket, date) aggregates: one mergeable aggregate, plus exact quantiles and top shares."""
    ud, setup, tier = col("up_down_vol_ratio_50"), col("setup"), col("leadership_tier")
    agg = panel.groupBy(*by).agg(
        F.count("*").alias("n_constituents"),
        F.count("score").alias("n_constituents_with_valid_score"),
        F.avg("score").alias("avg_score"), F.stddev_samp("score").alias("std_score"),
        F.max("score").alias("max_score"), F.min("score").alias("min_score"),
        (F.avg("pct_above_sma_50") * 100.0).alias("pct_above_50dma"),
        (F.avg("pct_above_sma_200") * 100.0).alias("pct_above_200dma"),
        (F.avg("new_60d_high") * 100.0).alias("pct_at_60d_high"),
        (F.avg("new_252d_high") * 100.0).alias("pct_at_252d_high"),
        (F.avg("rs_line_spy_new_high_252d") * 100.0).alias("pct_rs_line_new_high"),
        share(col("sma_stack_score") >= 100).alias("pct_full_sma_stack"),
        share(col("ema_stack_score") >= 100).alias("pct_full_ema_stack"),
        share(col("supertrend_direction") == 1.0).alias("pct_supertrend_bull"),
        share(col("rs_rating_spy") >= 70).alias("pct_rs_rating_above_70"),
        share(col("rs_rating_spy") >= 85).alias("pct_rs_rating_above_85"),
        share(col("grade") == "S").alias("pct_grade_s"),
        share(col("grade").isin("S", "A")).alias("pct_grade_a_plus"),
        share(col("grade") == "D").alias("pct_grade_d"),
        share(col("primary_state") == "EXHAUSTION").alias("pct_exhaustion"),
        share(col("primary_state") == "DETERIORATING").alias("pct_deteriorating"),
        F.count_if(tier == "ELITE_LEADER").alias("n_elite_leaders"),
        F.count_if(tier == "STRONG_LEADER").alias("n_strong_leaders"),
        F.count_if(tier == "EMERGING_LEADER").alias("n_emerging_leaders"),
        F.count_if(setup == "Emerging Leader").alias("n_emerging_leader_setups"),
        F.count_if(setup == "Premium Pullback").alias("n_premium_pullback"),
        F.count_if(setup.isin("Elite Leader Continuation", "Elite Leader Pullback")).alias("n_elite_leader_setups"),
        F.avg(ud).alias("theme_avg_ud_ratio"),
        share(ud >= 1.5).alias("theme_pct_strong_ud"),
        share(col("ad_line_slope_20") > 0).alias("theme_pct_positive_ad"),
        F.avg("cmf_21").alias("theme_avg_cmf"), F.avg("distribution_days_25").alias("theme_avg_dist_days"),
        F.avg("rs_rating_spy").alias("avg_rs"), F.avg("close_ret").alias("basket_ret"),
    )
    qs = xs.group_quantiles(panel, by, {
        "median_score": ("score", 0.5), "q25_score": ("score", 0.25), "q75_score": ("score", 0.75),
        "theme_median_ud_ratio": ("up_down_vol_ratio_50", 0.5),
    }, bound)
    tops = xs.top_share(panel, by, "score", {
        "basket_top_3_share": F.lit(3),
        "basket_top_quartile_share": F.greatest(F.lit(1), F.ceil(col("total") / 4.0)),
    }, bound)
    out = agg.join(qs, list(by), "left").join(tops, list(by), "left")
    return out.withColumns({
        "theme_volume_confirmation": (col("theme_pct_strong_ud") >= 40.0) & (col("theme_pct_positive_ad") >= 50.0),
        "basket_score_cv": div(col("std_score"), col("avg_score")),
        "leadership_concentration": cascades.concentration_class(col("basket_top_3_share")),
    })


def relative_strength(agg: DataFrame, bench: DataFrame) -> DataFrame:
    """Compounded equal-weight group index against the benchmark's, and its trend columns.

    A missing group return compounds as 0 %. Both indexes start at the group's first row.
    """
    w = TimeAxis("basket", "date", "_row")
    b = TimeAxis("one", "date")
    bench_ret = bench.withColumn("one", F.lit(1)).select(
        "date", b.change(col("adj_close"), 1).alias("bench_ret"), F.row_number().over(b.spec).alias("_row"))
    x = agg.join(bench_ret, "date", "left")

    def index(r: str) -> Column:
        return F.exp(F.sum(F.log1p(F.coalesce(col(r), F.lit(0.0)))).over(w.running))

    x = x.withColumn("theme_rs_line_value", index("basket_ret") / index("bench_ret"))
    v = col("theme_rs_line_value")
    # R2 does not depend on scale; rebasing to the group's geometric mean keeps the squares in range
    log_mean = F.avg(F.ln(v)).over(Window.partitionBy("basket"))
    x = x.withColumn("_level", F.exp(F.ln(v) - log_mean))
    h60, h252 = w.max(v, 60), w.max(v, 252)
    return x.withColumns({
        "theme_rs_new_60d_high": F.when(h60.isNotNull(), flag(v >= h60)),
        "theme_rs_new_252d_high": F.when(h252.isNotNull(), flag(v >= h252)),
        "theme_rs_slope_20d": w.change(v, 20) * 100.0, "theme_rs_slope_60d": w.change(v, 60) * 100.0,
        "theme_rs_r_squared_60d": w.r2(col("_level"), 60),
        "theme_rs_pct_252d": w.share_le(v, 252, 60) * 100.0,
        **{f"theme_rs_change_{k}d": col("avg_rs") - w.lag(col("avg_rs"), k) for k in (30, 60, 90)},
    }).drop("_row", "_level", "bench_ret")


Z_INPUTS = (
    "avg_score pct_above_50dma pct_above_200dma pct_at_252d_high pct_rs_rating_above_85 pct_grade_a_plus "
    "theme_rs_new_252d_high theme_rs_slope_60d theme_rs_r_squared_60d theme_rs_pct_252d theme_rs_change_60d "
    "theme_rs_change_30d theme_pct_strong_ud theme_pct_positive_ad theme_avg_cmf theme_avg_dist_days "
    "pct_exhaustion pct_deteriorating"
).split()


def theme_score(agg: DataFrame, bound: xs.Bound = xs.Bound()) -> DataFrame:
    """Five sub-scores and the blended theme score from per-date z-scores across groups."""
    z = xs.standard_z(agg, ["date"], {f"_z_{c}": c for c in Z_INPUTS}, sample=True, constant=None, bound=bound)

    def zc(c: str) -> Column:
        return col(f"_z_{c}")

    z = z.withColumns({
        "theme_breadth_score": weighted([
            (.30, zc("pct_above_50dma")), (.20, zc("pct_above_200dma")), (.15, zc("pct_at_252d_high")),
            (.20, zc("pct_rs_rating_above_85")), (.15, zc("pct_grade_a_plus"))]),
        "theme_rs_composite": weighted([
            (.40, zc("theme_rs_new_252d_high")), (.30, zc("theme_rs_slope_60d")), (.15, zc("theme_rs_r_squared_60d")),
            (.15, zc("theme_rs_pct_252d"))]),
        "theme_momentum_score": weighted([(.60, zc("theme_rs_change_60d")), (.40, zc("theme_rs_change_30d"))]),
        "theme_volume_score": weighted([
            (.40, zc("theme_pct_strong_ud")), (.30, zc("theme_pct_positive_ad")), (.20, zc("theme_avg_cmf")),
            (-.10, zc("theme_avg_dist_days"))]),
        "theme_health_score": weighted([(-.50, zc("pct_exhaustion")), (-.50, zc("pct_deteriorating"))]),
    })
    z = z.withColumn("theme_score_z", weighted([
        (.25, zc("avg_score")), (.25, col("theme_breadth_score")), (.20, col("theme_rs_composite")),
        (.15, col("theme_momentum_score")), (.10, col("theme_volume_score")), (.05, col("theme_health_score"))]))
    z = z.withColumn("theme_score", normal_cdf("theme_score_z") * 100.0)
    z = z.withColumn("momentum_class", cascades.momentum_class(col("theme_rs_change_30d"), col("theme_rs_change_60d")))
    return z.withColumn("theme_class", cascades.theme_class()).drop(*[f"_z_{c}" for c in Z_INPUTS])


def aggregate_themes(scored: DataFrame, bars: DataFrame, members: DataFrame, bench: DataFrame,
                     bound: xs.Bound = xs.Bound()) -> DataFrame:
    """Group rollup of the scored panel (features, score, state, tier, setup) over overlapping groups."""
    active = active_membership(members, scored)
    panel = scored.join(own_row_inputs(bars), ["entity", "date"], "left").join(active, "entity")
    return theme_score(relative_strength(rollup(panel, BY, bound), bench), bound)


# ---- membership queries -------------------------------------------------------------------------
def primary_assignment(members: DataFrame, priority: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Primary group per entity: override first, else the group with the best (lowest) priority, name as tie-break."""
    w = Window.partitionBy("entity").orderBy(col("priority").asc_nulls_last(), "basket")
    ranked = members.join(priority, "basket", "left").withColumn("_r", F.row_number().over(w)).where(col("_r") == 1)
    best = ranked.select("entity", col("basket").alias("primary_basket"))
    if overrides is None:
        return best
    o = overrides.select("entity", col("basket").alias("_o"))
    return best.join(o, "entity", "full").select("entity", F.coalesce("_o", "primary_basket").alias("primary_basket"))


def sector_assignment(added: DataFrame, sector_map: DataFrame, existing: DataFrame) -> DataFrame:
    """Group for added entities from their sector; an entity that already has one keeps it."""
    return (added.join(sector_map, "sector", "left").join(existing.select("entity", col("basket").alias("_has")), "entity", "left")
            .select("entity", F.coalesce("_has", "basket").alias("basket")))


def nested_universe(raw: DataFrame) -> DataFrame:
    """map<category, map<basket, array<entity>>> -> long membership, deduplicated."""
    cats = raw.select(F.explode("universe").alias("category", "baskets"))
    groups = cats.select("category", F.explode("baskets").alias("basket", "entities"))
    return groups.select("basket", F.explode("entities").alias("entity"), "category").dropDuplicates(["basket", "entity"])


def tags_for(members: DataFrame) -> DataFrame:
    """Ordered tag groups of every entity."""
    return members.where(~col("is_primary")).groupBy("entity").agg(F.sort_array(F.collect_set("basket")).alias("tags"))


# ---- membership queries -------------------------------------------------------------------------
def all_entities(members: DataFrame) -> DataFrame:
    return members.select("entity").distinct()


def baskets_by_type(members: DataFrame, kind: str) -> DataFrame:
    return members.where(col("basket_type") == kind).select("basket").distinct()


def constituents(members: DataFrame, basket: str) -> DataFrame:
    return members.where(col("basket") == basket).select("entity").distinct()


def tagged(members: DataFrame, tag: str) -> DataFrame:
    """Entities that carry a tag group beside their primary one."""
    return members.where((col("basket") == tag) & ~col("is_primary")).select("entity").distinct()


def primary_basket(members: DataFrame) -> DataFrame:
    return members.where("is_primary").groupBy("entity").agg(F.min("basket").alias("basket"))


def basket_kinds(members: DataFrame) -> DataFrame:
    """Category and type of every basket."""
    return members.groupBy("basket").agg(F.min("category").alias("category"), F.min("basket_type").alias("basket_type"))


def combined_universe(known: DataFrame, other: DataFrame) -> DataFrame:
    """Union of two memberships, one row for each entity: its basket (the known universe's wins) and whether only other has it."""
    a, b = (primary.withColumnRenamed("basket", name) for primary, name in (
        (known.groupBy("entity").agg(F.min("basket").alias("basket")), "_a"), (other.groupBy("entity").agg(F.min("basket").alias("basket")), "_b")))
    return a.join(b, "entity", "full").select("entity", F.coalesce("_a", "_b").alias("basket"), col("_a").isNull().alias("only_new"))
