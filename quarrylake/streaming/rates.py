"""Sliding-window counts as a Structured Streaming job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.operators.graph import scratch

#: Seconds of the slide and of the window.
SLIDE, SIZE = 21_600, 43_200


def counted(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(event_type, start, n): counts by event time in sliding windows; later rows than ``late`` are dropped.

    Works on a static frame and on a stream alike. Partial counts are made before the shuffle.
    """
    timed = events.select("event_type", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late)
    grouped = timed.groupBy(F.window("at", f"{SIZE} seconds", f"{SLIDE} seconds").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("event_type", F.unix_seconds(F.col("w.start")).alias("start"), "n")


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream the event files through ``counted`` until they are read, and give the result."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    place = scratch(spark, "stream")
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{place}/part={epoch}")  # a batch that is tried again writes the same place

    # update mode: a window's row is written anew when it changes and leaves the state when the watermark passes it
    query = counted(source).writeStream.outputMode("update").option("checkpointLocation", f"{place}-state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], "event_type string, start long, n long")
    written = spark.read.parquet(place)
    return written.groupBy("event_type", "start").agg(F.max_by("n", "epoch").alias("n"))
