"""Faults planted into stored tables, so that every check has something to find: plain data that both sides read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwave import config

#: (brand number, column, value) on the latest scored date
SCORED = (
    (1, "rs_rating_spy", 150.0), (2, "adx_14", -3.0), (3, "score", 130.0), (4, "score", None), (5, "grade", "Q"),
    (6, "p_TRENDING", 1.7), (7, "primary_state", "EXHAUSTION"), (8, "leadership_tier", "UNHEARD"), (9, "rs_rating_spy", 95.0),
    (9, "leadership_tier", "WEAK_LAGGARD"), (10, "rs_rating_spy", 5.0), (10, "leadership_tier", "ELITE_LEADER"),
    (11, "setup_confidence", 1.5), (12, "setup", None), (13, "s_momentum", 9.0), (14, "score", None), (14, "s_momentum", None),
    *[(4, c, 0.1) for c in config.COMPONENTS],
)
#: (basket, column, value) on the latest theme date
THEMES = (("G0", "theme_score", -5.0), ("G1", "pct_above_50dma", 101.0), ("G2", "n_constituents", 99))
#: a brand that no basket declares
ORPHAN = "Brand#15"
#: (brand number, rows before the latest date, column, value): a state that flips twice, a jump of the score, one of the grade
HISTORY = (
    (16, 2, "primary_state", "TRENDING"), (16, 1, "primary_state", "DETERIORATING"), (16, 0, "primary_state", "TRENDING"),
    (17, 1, "score", 20.0), (17, 0, "score", 80.0), (18, 1, "grade", "S"), (18, 0, "grade", "D"), (19, 1, "grade", "S"), (19, 0, "grade", "B"),
)
#: (brand number, rows before the latest one from, to, column, value) on the bars
BARS = (
    (1, 0, 19, "volume", 0.0), (2, 7, 7, "low", -1.0), (3, 0, 19, "volume", 0.001), (4, 3, 3, "open", 0.0), (5, 0, 5000, "close", None),
)
ABSENT = "Brand#99"


def number(c: str = "entity") -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).cast("int")


def _put(df: DataFrame, faults) -> DataFrame:
    """Columns with the value of each (condition, column, value) where it holds."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = dict.fromkeys(c for _, c, _ in faults)
    made = {c: reduce(lambda x, f: F.when(f[0], F.lit(f[2]).cast(kinds[c])).otherwise(x), [f for f in faults if f[1] == c], F.col(c))
            for c in columns}
    return df.withColumns(made)


def scored(latest: DataFrame) -> DataFrame:
    return _put(latest, [(number() == k, c, v) for k, c, v in SCORED])


def themes(latest: DataFrame) -> DataFrame:
    return _put(latest, [(F.col("basket") == k, c, v) for k, c, v in THEMES])


def history(df: DataFrame, ranked: DataFrame) -> DataFrame:
    """ranked: (date, k) with k = 0 at the latest date."""
    x = df.join(F.broadcast(ranked.where("k <= 2")), "date", "left")  # three dates
    return _put(x, [((number() == no) & (F.col("k") == back), c, v) for no, back, c, v in HISTORY]).drop("k")


def bars(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    back = F.row_number().over(Window.partitionBy("entity").orderBy(F.col("date").desc())) - 1
    x = df.withColumn("_back", back)
    return _put(x, [((number() == no) & F.col("_back").between(a, b), c, v) for no, a, b, c, v in BARS]).drop("_back")
