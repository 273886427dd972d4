"""Per-entity data-quality firewall on raw bars (own rows, not calendar rows)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwave.functions.expr import div
from panelwave.functions.rolling import TimeAxis

col = F.col


@dataclass(frozen=True)
class Limits:
    """Firewall thresholds (fixed values)."""

    min_history: int = 252
    max_stale_days: int = 5
    min_liquidity: float = 100_000.0
    low_liquidity: float = 1_000_000.0
    big_range: float = 0.50
    volume_multiple: float = 5.0
    wick_body: float = 0.40
    next_day_reversal: float = 0.05
    large_gap: float = 0.30
    volume_collapse: float = 0.10
    frequent_gap: float = 0.05
    frequent_gap_count: int = 5
    doji_body: float = 0.10
    doji_count: int = 5
    ratio_jump: float = 0.10
    tail: int = 20


CRITICAL = ("NO_DATA", "INSUFFICIENT_HISTORY", "STALE_DATA", "INVALID_PRICES", "ZERO_VOLUME", "INSUFFICIENT_LIQUIDITY",
            "SUSPICIOUS_BAR")
WARNINGS = ("LARGE_GAP_RECENT", "VOLUME_COLLAPSE", "LOW_LIQUIDITY", "FREQUENT_GAPS", "FREQUENT_DOJI",
            "POSSIBLE_CORPORATE_ACTION", "LARGE_REVERSAL_BAR")


def bar_measures(bars: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """Row-level measures: one window pass per entity."""
    w = TimeAxis("entity", "date")
    newest = Window.partitionBy("entity").orderBy(col("date").desc())
    o, h, l, c, v = (col(x) for x in ("open", "high", "low", "close", "volume"))
    ratio = div(c, col("adj_close"))
    rng = h - l
    x = bars.withColumns({
        "_age": F.row_number().over(newest),
        "_ret": div(c, w.lag(c)) - 1.0,
        "_vol_avg": w.mean(v, 50, 20),
        "_body": div(F.abs(c - o), rng),
        "_ratio_change": F.abs(div(ratio, w.lag(ratio)) - 1.0),
        "_next_move": div(w.lead(c) - w.lead(o), w.lead(o)),
    })
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    big = yes(div(rng, l) > lim.big_range) & yes(v > col("_vol_avg") * lim.volume_multiple)
    wick = yes(col("_body") < lim.wick_body)
    turn = yes((F.signum(c - o) != 0) & (F.signum("_next_move") == -F.signum(c - o))
               & (F.abs("_next_move") > lim.next_day_reversal))
    return x.withColumns({
        "_suspicious": big & wick,
        "_reversal": big & ~wick & turn,
        "_invalid": yes((o <= 0) | (h <= 0) | (l <= 0) | (c <= 0)),
        "_recent": col("_age") <= lim.tail,
    })


def _codes(pairs: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]), lambda x: x.isNotNull())


def firewall(bars: DataFrame, universe: DataFrame | None = None, overrides: DataFrame | None = None,
             lim: Limits = Limits()) -> DataFrame:
    """One row per entity: status, critical codes, warning codes, rows, suppressed codes.

    ``overrides``: (entity, kind, value) rows; kind = suppress removes a code, exclude drops the entity,
    flag adds an OVERRIDE_FLAG warning.
    """
    recent = col("_recent")
    dollar = F.when(recent, col("close") * col("volume"))
    ref = bars.agg(F.max("date").alias("_ref"))
    agg = bar_measures(bars, lim).groupBy("entity").agg(
        F.count("*").alias("rows"),
        F.max("date").alias("last_date"),
        F.bool_or("_invalid").alias("invalid"),
        F.coalesce(F.sum(F.when(recent, col("volume"))), F.lit(0.0)).alias("vol20"),
        F.count_if(recent).alias("n20"),
        F.median(dollar).alias("dollar20"),
        F.bool_or("_suspicious").alias("suspicious"),
        F.bool_or("_reversal").alias("reversal"),
        F.coalesce(F.bool_or(recent & (F.abs("_ret") > lim.large_gap)), F.lit(False)).alias("gap"),
        F.avg(F.when(recent, col("volume"))).alias("vmean20"),
        F.avg(F.when(col("_age") <= 252, col("volume"))).alias("vmean252"),
        F.count_if(recent & (F.abs("_ret") > lim.frequent_gap)).alias("gaps"),
        F.count_if(recent & (col("_body") < lim.doji_body)).alias("dojis"),
        F.coalesce(F.bool_or(col("_ratio_change") > lim.ratio_jump), F.lit(False)).alias("ratio_jump"),
    )
    everyone = bars.select("entity").distinct() if universe is None else universe.select("entity").distinct()
    x = everyone.join(agg, "entity", "left").join(F.broadcast(ref))  # ref is exactly one row
    n = col("rows")
    critical = _codes([
        ("NO_DATA", n.isNull()),
        ("INSUFFICIENT_HISTORY", n < lim.min_history),
        ("STALE_DATA", F.datediff("_ref", "last_date") > lim.max_stale_days),
        ("INVALID_PRICES", col("invalid")),
        ("ZERO_VOLUME", col("vol20") == 0),
        ("INSUFFICIENT_LIQUIDITY", (col("n20") >= 5) & (col("dollar20") < lim.min_liquidity)),
        ("SUSPICIOUS_BAR", col("suspicious")),
    ])
    warnings = _codes([
        ("LARGE_GAP_RECENT", col("gap")),
        ("VOLUME_COLLAPSE", (n >= 252) & (col("vmean252") > 0) & (div(col("vmean20"), col("vmean252")) < lim.volume_collapse)),
        ("LOW_LIQUIDITY", (col("n20") >= 5) & (col("dollar20") >= lim.min_liquidity) & (col("dollar20") < lim.low_liquidity)),
        ("FREQUENT_GAPS", col("gaps") >= lim.frequent_gap_count),
        ("FREQUENT_DOJI", col("dojis") >= lim.doji_count),
        ("POSSIBLE_CORPORATE_ACTION", col("ratio_jump")),
        ("LARGE_REVERSAL_BAR", col("reversal")),
    ])
    x = x.select("entity", critical.alias("critical"), warnings.alias("warnings"), F.coalesce("rows", F.lit(0)).alias("rows"))
    if overrides is not None:
        by_kind = overrides.groupBy("entity").agg(
            F.sort_array(F.collect_set(F.when(col("kind") == "suppress", col("value")))).alias("suppressed"),
            F.bool_or(col("kind") == "exclude").alias("_exclude"), F.bool_or(col("kind") == "flag").alias("_flag"))
        x = x.join(by_kind, "entity", "left").where(~F.coalesce(col("_exclude"), F.lit(False)))
        hide = F.coalesce("suppressed", F.array().cast("array<string>"))
        x = x.select(
            "entity", F.array_except("critical", hide).alias("critical"),
            F.concat(F.array_except("warnings", hide), F.when(col("_flag"), F.array(F.lit("OVERRIDE_FLAG"))).otherwise(
                F.array().cast("array<string>"))).alias("warnings"),
            "rows", hide.alias("suppressed"))
    else:
        x = x.withColumn("suppressed", F.array().cast("array<string>"))
    status = F.when(F.size("critical") > 0, "FAIL").when(F.size("warnings") > 0, "WARNING").otherwise("PASS")
    return x.select("entity", status.alias("status"), "critical", "warnings", "rows", "suppressed")


def status_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("n"))


def reason_histogram(report: DataFrame) -> DataFrame:
    return report.select(F.explode(F.concat("critical", "warnings")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def passing(report: DataFrame) -> DataFrame:
    """Entities allowed into the feature stage."""
    return report.where(col("status").isin("PASS", "WARNING")).select("entity")


def forced_states(scored: DataFrame, overrides: DataFrame) -> DataFrame:
    """force_state override: replaces an entity's primary state."""
    forced = overrides.where(col("kind") == "force_state").select("entity", col("value").alias("_forced"))
    return scored.join(forced, "entity", "left").withColumn(
        "primary_state", F.coalesce("_forced", "primary_state")).drop("_forced")


# ---- ingest -------------------------------------------------------------------------------------
def ingest_rejects(bars: DataFrame, requested: DataFrame, required: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """failed(entity, reason) for requested entities that did not arrive usable."""
    missing = [c for c in required if c not in bars.columns]
    if missing:
        return requested.select("entity", F.lit("missing_columns:" + ",".join(missing)).alias("reason"))
    seen = bars.groupBy("entity").agg(F.count("close").alias("_n"))
    return requested.select("entity").distinct().join(seen, "entity", "left").select(
        "entity", F.when(col("_n").isNull(), "empty_frame").when(col("_n") == 0, "all_close_nan").alias("reason")
    ).where(col("reason").isNotNull())
