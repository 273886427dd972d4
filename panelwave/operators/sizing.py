"""Size checks behind broadcasts, and lineage cuts on shared storage."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: most bytes of a side that is broadcast by a proven or counted size, and what a cell of it counts as
BROADCAST_BYTES = 64 << 20
CELL_BYTES = 32
WINDOW_ROWS = 5_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; a scratch folder only where it is unset and all runs in one JVM."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def materialize(df: DataFrame) -> DataFrame:
    """Write df once as a parquet table in the checkpoint folder and continue from the written copy.

    Cuts the lineage on shared storage like ``checkpoint()``, but later readers keep column pruning, filter
    pushdown and file sizes for the join choice.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast hint only when a bounded count proves the side small; otherwise leave the join to the optimizer."""
    rows = BROADCAST_BYTES // (CELL_BYTES * len(df.columns))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hashed_side(df: DataFrame) -> DataFrame:
    """Names for a far longer side: broadcast where counted small, else dealt by key and hashed, so that the longer side is never sorted."""
    rows = BROADCAST_BYTES // (CELL_BYTES * len(df.columns))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("shuffle_hash")


#: most wide rows of a partition, where their number is known: it is sorted and dealt again in memory
SPREAD_ROWS = 500_000


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Hash-partition by keys into the session's configured number of shuffle partitions, or more for that many wide rows.

    Window and recursion stages are bound by CPU, not bytes: an explicit count keeps the adaptive planner
    from merging partitions that are small on disk. Later operators on the same keys reuse the placement.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-(rows or 0) // SPREAD_ROWS)), *keys)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the stages that run Python there."""
    sc = spark.sparkContext
    if not getattr(sc, "_panelwave_shipped", False):
        root = Path(__file__).resolve().parents[2]
        base = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "panelwave"
        sc.addPyFile(shutil.make_archive(str(base), "zip", root, "panelwave"))
        sc._panelwave_shipped = True
