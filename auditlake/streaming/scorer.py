"""Extension: scores that arrive as a stream, kept as donor means and windowed activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files as they appear in a folder."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def windowed_activity(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum of values by window and type; rows later than the watermark are dropped by Spark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def running_donor_means(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("user_id").alias("donor_id")).agg(F.avg("value").alias("score"), F.count("*").alias("n"))


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that is there now, as a table: for tests and small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
