"""Bars from trades or events, calendars and dense panels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwave.operators.sizing import hashed_side, materialize, small_side, spread

BAR_FIELDS = ("open", "high", "low", "close", "adj_close", "volume")


def trade_bars(trades: DataFrame, keys: Sequence[str], price: Column, size: Column, order: Column) -> DataFrame:
    """OHLCV per key. ``order`` is a total order inside a key; partial aggregation runs map-side."""
    t = trades.select(*keys, F.struct(order.alias("at"), price.alias("px")).alias("_t"), size.cast("double").alias("_v"))
    agg = t.groupBy(*keys).agg(
        F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.max("_t.px").alias("high"), F.min("_t.px").alias("low"),
        F.sum("_v").alias("volume"))
    return _open_close(agg, keys)


def _open_close(agg: DataFrame, keys: Sequence[str]) -> DataFrame:
    return agg.select(
        *keys, F.col("_first.px").alias("open"), "high", "low", F.col("_last.px").alias("close"), "volume",
        F.col("_first.at").alias("first_at"), F.col("_last.at").alias("last_at"))


def dealt_bars(trades: DataFrame, keys: Sequence[str], price: Column, size: Column, order: Column) -> DataFrame:
    """``trade_bars`` of keys with few trades each: rows are dealt by key first, as a map-side sort would combine next to nothing."""
    return trade_bars(spread(trades, *keys), keys, price, size, order)


def _met(left: DataFrame, ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the ends of their key; keys are bounded, so that their ends are broadcast where counted small."""
    right = small_side(ends).withColumnsRenamed({k: f"_end_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_end_{k}")) for k in keys])
    return left.join(right, same).drop(*[f"_end_{k}" for k in keys])


def _at_end(a: Column, b: Column, end: Column) -> Column:
    return a.isNull() | b.isNull() | ((a == end["_a"]) & (b == end["_b"]))


def crowded_bars(trades: DataFrame, keys: Sequence[str], price: Column, size: Column, order: Sequence[str],
                 named: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """``trade_bars`` of keys with many trades each, ``order`` being two columns or more: no task sorts the trades.

    ``named`` adds the keys that trades take from another table, by a join on columns of theirs. Structs do not fit hash
    aggregates, so a first scan finds, in plain columns, the two leading order fields of each key's first and last trade.
    A second scan keeps the trades that have them for some key (or a null there) before it names them; the whole order
    decides among these. So all trades are dealt to their names once at most.
    """
    a, b = order[:2]
    t = trades.withColumns({"_px": price, "_size": size.cast("double")})
    steps = named(t).groupBy(*keys, F.col(a).alias("_a")).agg(
        F.min(b).alias("_lo"), F.max(b).alias("_hi"), F.max("_px").alias("high"), F.min("_px").alias("low"), F.sum("_size").alias("volume"))
    ends = materialize(steps.groupBy(*keys).agg(
        F.min(F.struct("_a", F.col("_lo").alias("_b"))).alias("_first_at"), F.max(F.struct("_a", F.col("_hi").alias("_b"))).alias("_last_at"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume")))
    wanted = materialize(ends.select(F.explode(F.array("_first_at", "_last_at")).alias("_w")).select(
        F.col("_w._a").alias("_wa"), F.col("_w._b").alias("_wb")).distinct())
    x = t.join(hashed_side(wanted), (F.col(a) == F.col("_wa")) & (F.col(b) == F.col("_wb")), "left")
    x = x.where(F.col("_wa").isNotNull() | F.col(a).isNull() | F.col(b).isNull()).drop("_wa", "_wb")
    x = _met(named(x), ends, keys).where(
        _at_end(F.col(a), F.col(b), F.col("_first_at")) | _at_end(F.col(a), F.col(b), F.col("_last_at")))
    whole = F.struct(F.struct(*order).alias("at"), F.col("_px").alias("px"))
    agg = x.groupBy(*keys).agg(
        F.min(whole).alias("_first"), F.max(whole).alias("_last"),
        F.max("high").alias("high"), F.max("low").alias("low"), F.max("volume").alias("volume"))
    return _open_close(agg, keys)


def crowded_merge(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``merge_bars`` of keys with many bars each, whose order has two fields or more: no task sorts the bars.

    The ends are found as in ``crowded_bars``, by one scan for the first and one for the last bar.
    """
    a, b = bars.schema["first_at"].dataType.names[:2]

    def ends(at: str, low, high, *more: Column) -> DataFrame:
        steps = bars.groupBy(*keys, F.col(f"{at}.{a}").alias("_a")).agg(low(f"{at}.{b}").alias("_b"), *more)
        return steps.groupBy(*keys).agg(high(F.struct("_a", "_b")).alias(f"_{at}"), *more)

    whole = [F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume")]
    first, last = materialize(ends("first_at", F.min, F.min, *whole)), materialize(ends("last_at", F.max, F.max))

    def at_end(at: str) -> Column:
        return _at_end(F.col(f"{at}.{a}"), F.col(f"{at}.{b}"), F.col(f"_{at}"))

    x = _met(_met(bars.drop("high", "low", "volume"), first, keys), last, keys).where(at_end("first_at") | at_end("last_at"))
    agg = x.groupBy(*keys).agg(
        F.min(F.struct(F.col("first_at").alias("at"), F.col("open").alias("px"))).alias("_first"),
        F.max(F.struct(F.col("last_at").alias("at"), F.col("close").alias("px"))).alias("_last"),
        F.max("high").alias("high"), F.max("low").alias("low"), F.max("volume").alias("volume"))
    return _open_close(agg, keys)


def merge_bars(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coarser bars from finer ones (bars are mergeable, so raw trades are scanned once)."""
    agg = bars.groupBy(*keys).agg(
        F.min(F.struct(F.col("first_at").alias("at"), F.col("open").alias("px"))).alias("_first"),
        F.max(F.struct(F.col("last_at").alias("at"), F.col("close").alias("px"))).alias("_last"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))
    return _open_close(agg, keys)


def finish_bars(bars: DataFrame, keys: Sequence[str] = ("entity", "date")) -> DataFrame:
    return bars.select(*keys, "open", "high", "low", "close", F.col("close").alias("adj_close"), "volume")


def calendar(bench1: DataFrame, bench2: DataFrame | None = None) -> DataFrame:
    """Trading days of the first benchmark with a dense index: date, t, n_dates, b1_*, b2_*.

    One row per trading day, so the single-partition ordering window stays tiny.
    """
    b1 = bench1.select("date", F.col("close").alias("b1_close"), F.col("adj_close").alias("b1_adj_close"))
    second = (bench1 if bench2 is None else bench2).select("date", F.col("close").alias("b2_close"))
    days = b1.join(second, "date", "left")
    return days.select(
        "*",
        (F.row_number().over(Window.orderBy("date")) - 1).alias("t"),
        F.count("*").over(Window.partitionBy()).cast("int").alias("n_dates"),
    )


def densify(bars: DataFrame, cal: DataFrame, fields: Sequence[str] = BAR_FIELDS) -> DataFrame:
    """Every (calendar day, entity) pair, NULL where the entity did not trade.

    Each bar emits the rows up to the entity's next bar, so the dense grid needs no join of the
    entity list with the calendar: one exchange on entity, then a generated row per missing day.
    Off-calendar bars are dropped; a duplicate (entity, date) raises.
    """
    cal = small_side(cal)
    on_cal = bars.join(cal.select("date", "t", "n_dates"), "date")
    w = Window.partitionBy("entity").orderBy("t")
    extra = [c for c in bars.columns if c not in (*fields, "entity", "date")]
    spans = on_cal.select(
        "entity", "t", *extra, *fields,
        F.coalesce(F.lead("t").over(w), F.col("n_dates")).alias("_next"),
        F.when(F.lag("t").over(w).isNull(), F.lit(0)).otherwise(F.col("t")).alias("_from"),
    )
    spans = spans.withColumn(
        "_next",
        F.when(F.col("_next") > F.col("t"), F.col("_next")).otherwise(
            F.raise_error(F.concat(F.lit("duplicate bar for entity "), F.col("entity"))).cast("int")
        ),
    )
    rows = spans.select(
        "entity", F.explode(F.sequence("_from", F.col("_next") - 1)).alias("_t"), *extra, "t", *fields
    )
    here = F.col("_t") == F.col("t")
    dense = rows.select(
        "entity", F.col("_t").alias("t"), *extra, *[F.when(here, F.col(f)).alias(f) for f in fields]
    )
    return dense.join(cal.drop("n_dates"), "t")


def carry_bars(bars: DataFrame, cal: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Bars for every calendar day from an entity's first one on: where it did not trade, its last bar with volume 0."""
    d = densify(bars, cal)
    w = Window.partitionBy("entity").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prices = [c for c in BAR_FIELDS if c != "volume"]
    full = d.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in prices})
    return full.where(F.col("close").isNotNull()).select(
        "entity", "date", *prices, F.coalesce("volume", F.lit(0.0)).alias("volume"), *keep)


def wide_to_long(wide: DataFrame, index: str, entities: Sequence[str], fields: Sequence[str], sep: str = "_") -> DataFrame:
    """One column per entity and field -> one row per (entity, date); all-NULL rows are dropped."""
    structs = [
        F.struct(F.lit(e).alias("entity"),
                 *[F.col(f"`{e}{sep}{f}`").cast("double").alias(f.lower().replace(" ", "_")) for f in fields])
        for e in entities
    ]
    long = wide.select(F.to_date(index).alias("date"), F.explode(F.array(*structs)).alias("r")).select(
        "r.entity", "date", *[F.col(f"r.{f.lower().replace(' ', '_')}") for f in fields]
    )
    return long.dropna("all", subset=[f.lower().replace(" ", "_") for f in fields])


def long_to_wide(bars: DataFrame, entities: Sequence[str], fields: Sequence[str], sep: str = "_") -> DataFrame:
    """Pivot a declared, finite entity list back to one row per date."""
    aggs = [
        F.max(F.when(F.col("entity") == e, F.col(f))).alias(f"{e}{sep}{f}") for e in entities for f in fields
    ]
    return bars.groupBy("date").agg(*aggs)


def last_week_end(date: Column) -> Column:
    """Latest Friday label on or before the date (as-of key; no look-ahead)."""
    return F.date_sub(F.next_day(date, "FRI"), 7)


def resample(panel: DataFrame, label: Column) -> DataFrame:
    """Period bars: last non-null close, max high, min low, summed volume (0 for an empty period).

    ``p`` numbers the period labels without holes; labels with no calendar day at all get a NULL row.
    """
    return panel.groupBy("entity", label.alias("label")).agg(
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
    )
