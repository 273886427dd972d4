"""Writers: full tables, slim serving copies, JSON reports, dated snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwave.operators.views import latest


def write_table(df: DataFrame, path: str, codec: str = "snappy", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite").option("compression", codec)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Keep the previous output when the new pull is empty."""
    if df.isEmpty():
        return False
    write_table(df, path)
    return True


def write_slim(df: DataFrame, path: str, columns: Sequence[str] | None = None, latest_only: bool = False) -> None:
    """zstd serving copy: a column subset of the whole history, or the latest date only."""
    x = latest(df) if latest_only else df
    write_table(x.select(*columns) if columns else x, path, "zstd")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_snapshot(df: DataFrame, root: str) -> None:
    """Latest-date slice under snapshot_date=<date>; only that partition is replaced."""
    x = latest(df).withColumn("snapshot_date", F.col("date"))
    (x.write.mode("overwrite").option("compression", "snappy").option("partitionOverwriteMode", "dynamic")
     .partitionBy("snapshot_date").parquet(root))


def write_bucketed(df: DataFrame, table: str, key: str = "entity", buckets: int = 200, sort: Sequence[str] = ("entity", "date")) -> None:
    """Managed table bucketed by entity, so later joins and windows on entity need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(*sort).saveAsTable(table)
