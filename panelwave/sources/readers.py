"""Readers: stored tables, JSON reports, overrides, universe and constituent references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


BARS = T.StructType([
    T.StructField("entity", T.StringType()), T.StructField("date", T.DateType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close", "volume")],
])
OVERRIDES = "entity string, kind string, value string"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table with a declared schema; an absent table reads as empty. Selected columns prune the scan."""
    try:
        df = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], schema)
    return df.select(*columns) if columns else df


def read_serving(spark: SparkSession, slim: str, full: str, schema: T.StructType | str) -> DataFrame:
    """Slim copy if it exists, else the full table."""
    try:
        return spark.read.schema(schema).parquet(slim)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return read_table(spark, full, schema)


def read_report(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON report table."""
    return spark.read.schema(schema).json(path)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Override rows (entity, kind, value); kind = suppress | exclude | flag | force_state."""
    return spark.read.schema(OVERRIDES).json(path)


# fixed values: source column names seen for each canonical column
CONSTITUENT_NAMES = {
    "Symbol": "entity", "Ticker": "entity", "Security": "company", "Company": "company", "GICS Sector": "gics_sector",
    "GICS Sub-Industry": "gics_sub_industry", "GICS Sub Industry": "gics_sub_industry",
    "Headquarters Location": "headquarters", "Date added": "date_added", "Date first added": "date_added",
    "CIK": "cik", "Founded": "founded",
}
CONSTITUENT_COLUMNS = ("entity", "company", "gics_sector", "gics_sub_industry", "headquarters", "date_added", "cik", "founded")


def symbol(c: Column) -> Column:
    """Upper-case, trimmed, class separator as a dash."""
    return F.upper(F.trim(F.regexp_replace(c, r"\.", "-")))


def canonical_constituents(raw: DataFrame, names: Mapping[str, str] = CONSTITUENT_NAMES,
                           required: Sequence[str] = ("entity", "company", "gics_sector")) -> DataFrame:
    """Rename drifting source columns, check the required ones, default the rest, normalise and deduplicate."""
    df = raw.withColumnsRenamed({k: v for k, v in names.items() if k in raw.columns})
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"constituent source lacks columns: {', '.join(missing)}")
    df = df.withColumns({c: F.lit("") for c in CONSTITUENT_COLUMNS if c not in df.columns})
    df = df.withColumn("entity", symbol(F.col("entity"))).select(*CONSTITUENT_COLUMNS)
    # deterministic choice inside a duplicate symbol
    rest = [c for c in CONSTITUENT_COLUMNS if c != "entity"]
    one = df.groupBy("entity").agg(F.min(F.struct(*rest)).alias("r"))
    return one.select("entity", "r.*")


def first_available(sources: Sequence[DataFrame]) -> DataFrame:
    """First non-empty source, in order."""
    for s in sources:
        if not s.isEmpty():
            return s
    return sources[-1]


def exclude_sector(df: DataFrame, sector: str = "Real Estate") -> DataFrame:
    return df.where(~F.coalesce(F.col("gics_sector") == sector, F.lit(False)))


def combine_bars(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both sources; the first source wins where both have an (entity, date)."""
    return a.unionByName(b.join(a.select("entity", "date"), ["entity", "date"], "left_anti"))


def adjusted(bars: DataFrame) -> DataFrame:
    """Default adj_close to close when the source has none."""
    return bars if "adj_close" in bars.columns else bars.withColumn("adj_close", F.col("close"))


