"""Effective cuts from a stream of ledger entries, as an addition to batch replay.

Entries arrive as files in a folder; each micro-batch is merged into the state table of last actions by image and
marker: a new state is written beside the old and its number returned by ``latest``, so a restart goes on from the last
whole one. Undo needs the full history and is left to batch replay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ENTRY = "order bigint, entry_id string, time_utc timestamp, image_id string, marker string, new_estimate double"


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(ENTRY).parquet(folder)


def last_cuts(df: DataFrame) -> DataFrame:
    """The newest entry of each image and marker; a batch or a stream in complete mode."""
    newest = F.max_by(F.struct("entry_id", "new_estimate", "order"), "order").alias("e")
    return df.groupBy("image_id", "marker").agg(newest).select("image_id", "marker", "e.entry_id", "e.new_estimate", "e.order")


def follow(stream: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``state`` up to date with what is there, then stops."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = last_cuts(batch)
        if number:
            old = spark.read.parquet(f"{state}/{number - 1}")
            known = last_cuts(known.select("order", "entry_id", "image_id", "marker", "new_estimate").unionByName(old.select("order", "entry_id", "image_id", "marker", "new_estimate")))
        known.write.mode("overwrite").parquet(f"{state}/{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Entries by image and window; windows close ``late`` after the newest entry's time."""
    return stream.withWatermark("time_utc", late).groupBy(F.window("time_utc", width), "image_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "image_id", "n")
