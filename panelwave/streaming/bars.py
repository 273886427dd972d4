"""Streaming bars from events: closed bars behind a watermark, and an upsert table that late rows still change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from panelwave.operators import bars as B


def stream_bars(events: DataFrame, entity: Column, ts: str, price: Column, size: Column, order: Column,
                freq: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Tumbling OHLCV bars; rows later than the watermark are dropped. Works on a batch frame too."""
    e = events.withColumns({"entity": entity, "_p": price, "_v": size.cast("double"), "_o": order})
    if events.isStreaming:
        e = e.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    g = e.groupBy("entity", F.window(ts, freq)).agg(
        F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"),
        F.max_by("_p", "_o").alias("close"), F.sum("_v").alias("volume"))
    return g.select("entity", F.col("window.start").cast("date").alias("date"), "open", "high", "low", "close", "volume")


def upsert_bars(events: DataFrame, folder: str, entity: Column, ts: str, price: Column, size: Column, order: Column,
                lateness: str = "2 days") -> DataStreamWriter:
    """Writer of daily bars that later rows may still change.

    Every micro-batch leaves its own mergeable bars, its rejected rows with a reason (missing_entity, missing_time,
    missing_price, or late: more than ``lateness`` before the latest row of earlier micro-batches) and its latest time, all
    in folders that bear its number. A micro-batch that is run again after a failure overwrites these, so no row counts
    twice. ``read_bars`` merges them.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        seen = _read(spark, f"{folder}/seen", "latest timestamp, batch long").where(F.col("batch") < number)
        limit = seen.agg(F.max("latest") - F.expr(f"INTERVAL {lateness}")).head()[0]
        reason = (F.when(F.col("_entity").isNull(), "missing_entity").when(F.col(ts).isNull(), "missing_time")
                  .when(F.col("_price").isNull(), "missing_price").when(F.col(ts) < F.lit(limit), "late"))
        named = batch.withColumns({"_entity": entity, "_price": price, "_size": size, "_order": order})
        marked = named.withColumn("reason", reason)
        rows = marked.where(F.col("reason").isNull()).withColumns({"entity": F.col("_entity"), "date": F.to_date(ts)})
        bars = B.trade_bars(rows, ["entity", "date"], F.col("_price"), F.col("_size"), F.col("_order"))
        bars.write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")
        marked.where(F.col("reason").isNotNull()).select(*batch.columns, "reason").write.mode("overwrite").parquet(
            f"{folder}/rejected/batch={number}")
        batch.agg(F.max(F.col(ts).cast("timestamp")).alias("latest")).write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")
        batch.unpersist()

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table under path, no rows where nothing has been written yet."""
    from panelwave.sources.readers import read_table

    return read_table(spark, path, spark.createDataFrame([], schema).schema)


def read_bars(spark: SparkSession, folder: str) -> DataFrame:
    """The upsert table: bars of all micro-batches, merged."""
    return B.finish_bars(B.merge_bars(spark.read.parquet(f"{folder}/parts"), ["entity", "date"]))


def read_rejected(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rejected")
