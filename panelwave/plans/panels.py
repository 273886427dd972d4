"""Panels over the given tables: each builder scans its raw table once, into mergeable bars."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwave.operators import bars as B
from panelwave.operators.sizing import hashed_side, materialize, small_side, spread
from panelwave.operators.xsection import Bound

BENCHMARKS = ("MKT", "MKT_R")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EPOCH = "1970-01-01"


def _period(ts: Column, freq: str) -> Column:
    """First day of the period: day, week, month, or so many days ("5day") counted from the epoch."""
    if freq.endswith("day") and freq != "day":
        days = F.datediff(ts, F.lit(EPOCH))
        return F.date_sub(F.to_date(ts), F.pmod(days, F.lit(int(freq[:-3]))))
    return F.to_date(F.date_trunc(freq, ts))


def adjustment(date: Column) -> Column:
    """Deterministic price adjustment: a split in 1998 and a 6 % distribution in 2000."""
    return F.when(date < "1998-01-01", 0.5).when(date < "2000-01-01", 0.94).otherwise(1.0)


LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def line_bars(spark: SparkSession, sf_dir: str, by: str, freq: str, damped: bool = False) -> DataFrame:
    """Bars per (entity, date, flag) from line items; by = supplier or brand."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.withColumns({"date": _period(F.col("l_shipdate"), freq), "second": F.col("l_returnflag") == "R"})
    price = F.col("l_extendedprice") / F.col("l_quantity")
    if damped:  # a tenth of the log moves: unit prices of parts jump by a third, which no index survives
        price = F.round(F.pow(price / 1000.0, F.lit(0.1)) * 100.0, 6)
    keys, size = ["entity", "date", "second"], F.col("l_quantity")
    if by == "brand":
        part = hashed_side(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("entity")))
        return B.crowded_bars(rows, keys, price, size, LINE_ORDER, lambda x: x.join(part, F.col("l_partkey") == F.col("p_partkey")))
    return B.dealt_bars(rows.withColumn("entity", F.col("l_suppkey").cast("string")), keys, price, size, F.struct(*LINE_ORDER))


def event_bars(spark: SparkSession, sf_dir: str, freq: str = "day") -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumns({
        "entity": F.col("user_id").cast("string"), "date": _period(F.col("ts"), freq),
        "second": F.col("event_type") == "purchase",
    })
    return B.dealt_bars(ev, ["entity", "date", "second"], F.col("value"), F.lit(1.0), F.struct("ts", "event_id"))


def entity_bars(fine: DataFrame) -> DataFrame:
    """Entities plus both benchmarks as ordinary entities, from one materialised set of fine bars."""
    keys = ["entity", "date"]
    own = B.finish_bars(B.merge_bars(spread(fine, *keys), keys))
    mkt = B.finish_bars(B.crowded_merge(fine.withColumn("entity", F.lit("MKT")), keys))
    second = B.finish_bars(B.crowded_merge(fine.where("second").withColumn("entity", F.lit("MKT_R")), keys))
    return own.unionByName(mkt).unionByName(second)


def fine_bars(spark: SparkSession, sf_dir: str, panel: str) -> DataFrame:
    build = {
        "sm": lambda: line_bars(spark, sf_dir, "supplier", "month"),
        "bw": lambda: line_bars(spark, sf_dir, "brand", "week"),
        "bx": lambda: line_bars(spark, sf_dir, "brand", "5day", damped=True),
        "bt": lambda: line_bars(spark, sf_dir, "brand", "3day", damped=True),
        "sd": lambda: line_bars(spark, sf_dir, "supplier", "day", damped=True),
        "bd": lambda: line_bars(spark, sf_dir, "brand", "day"),
        "ud": lambda: event_bars(spark, sf_dir),
    }
    return build[panel]()


def membership(spark: SparkSession, sf_dir: str, panel: str) -> DataFrame:
    """basket, entity, category, basket_type, is_primary."""
    if panel in ("sm", "sd"):
        s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
        j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        j = j.select(F.col("s_suppkey").cast("string").alias("entity"), "n_name", "r_name")
        prim = j.select(F.col("n_name").alias("basket"), "entity", F.col("r_name").alias("category"),
                        F.lit("CORE").alias("basket_type"), F.lit(True).alias("is_primary"))
        tag = j.select(F.col("r_name").alias("basket"), "entity", F.lit("REGION").alias("category"),
                       F.lit("TAG").alias("basket_type"), F.lit(False).alias("is_primary"))
        return prim.unionByName(tag)
    if panel == "ud":
        u = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("entity")).distinct()
        key = F.concat(F.lit("U"), (F.col("entity").cast("long") % 10).cast("string"))
        return u.select(key.alias("basket"), "entity", F.lit("USERS").alias("category"),
                        F.lit("CORE").alias("basket_type"), F.lit(True).alias("is_primary"))
    b = table(spark, sf_dir, "part").select(F.col("p_brand").alias("entity")).distinct()
    no = F.regexp_extract("entity", r"(\d+)", 1).cast("int")
    prim = b.select(F.concat(F.lit("G"), (no % 5).cast("string")).alias("basket"), "entity",
                    F.lit("BRANDS").alias("category"), F.lit("CORE").alias("basket_type"), F.lit(True).alias("is_primary"))
    tag = b.select(F.concat(F.lit("T"), (no % 3).cast("string")).alias("basket"), "entity",
                   F.lit("TAGS").alias("category"), F.lit("TAG").alias("basket_type"), F.lit(False).alias("is_primary"))
    return prim.unionByName(tag)


def with_groups(bars: DataFrame, members: DataFrame) -> DataFrame:
    """Primary group and its static size; entities without one form UNKNOWN."""
    prim = members.where("is_primary").select("entity", F.col("basket").alias("grp"))
    present = bars.select("entity").distinct().join(prim, "entity", "left").withColumn(
        "grp", F.coalesce("grp", F.lit("UNKNOWN")))
    sized = present.join(present.groupBy("grp").agg(F.count("*").alias("grp_size")), "grp")
    return bars.join(small_side(sized), "entity")


CARRIED = ("bx", "bt", "sd")


class PanelSource:
    """One panel over the given tables: bars, calendar, membership and the dense grid, each built once, when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, panel: str):
        self.spark, self.sf_dir, self.panel = spark, sf_dir, panel
        self.members = membership(spark, sf_dir, panel)
        self._dense: DataFrame | None = None

    @cached_property
    def traded(self) -> DataFrame:
        """Bars of the days on which an entity traded."""
        fine = materialize(fine_bars(self.spark, self.sf_dir, self.panel))
        return materialize(with_groups(entity_bars(fine), self.members))

    @cached_property
    def trading_days(self) -> DataFrame:
        return materialize(B.calendar(*(self.traded.where(F.col("entity") == b) for b in BENCHMARKS)))

    @cached_property
    def bars(self) -> DataFrame:
        if self.panel not in CARRIED:
            return self.traded
        # panels that features and scores are built on: no gaps, adjusted closes of their own
        bars = B.carry_bars(self.traded, self.trading_days, ("grp", "grp_size"))
        own = ~F.col("entity").isin(*BENCHMARKS)
        return materialize(bars.withColumn("adj_close", F.when(own, F.col("close") * adjustment(F.col("date"))).otherwise(F.col("close"))))

    @cached_property
    def calendar(self) -> DataFrame:
        return materialize(B.calendar(*(self.bars.where(F.col("entity") == b) for b in BENCHMARKS)))

    @cached_property
    def bound(self) -> Bound:
        """Proven bound on rows per date: one row per declared entity plus the two benchmarks."""
        days = self.trading_days if self.panel in CARRIED else self.calendar
        return Bound(self.members.where("is_primary").count() + len(BENCHMARKS), days.count())

    def dense(self) -> DataFrame:
        """Dense grid, written once: the daily, weekly, monthly and peak branches all read it."""
        if self._dense is None:
            self._dense = materialize(B.densify(self.bars, self.calendar))
        return self._dense
