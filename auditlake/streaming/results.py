"""Results that arrive in pieces: appended exactly once, resumed after a loss, with donor means kept up to date.

A stream's checkpoint remembers which files it has seen; a batch is written to a folder of its own number, replacing what
a run that was lost midway left there. So a restart writes every batch once, whatever it was doing when it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: batch n goes to path/batch=n, whole."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def append_results(stream: DataFrame, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """All rows that have arrived and aren't appended yet."""
    query = stream.writeStream.foreachBatch(sink or write_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Appended rows, with the number of their batch."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def follow_donor_means(stream: DataFrame, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """Running mean of score and number of rows by donor, kept as state by donor; each batch appends the donors that it changed.

    stream: donor_id, score. State lives with the checkpoint, spread by donor over the cluster.
    """
    means = stream.groupBy("donor_id").agg(F.avg("score").alias("score"), F.count("*").alias("n"))
    query = means.writeStream.outputMode("update").foreachBatch(sink or write_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_donor_means(spark: SparkSession, path: str) -> DataFrame:
    """donor_id, score, n as the last batch that changed a donor left them."""
    last = Window.partitionBy("donor_id").orderBy(F.desc("batch"))
    return read_results(spark, path).withColumn("_r", F.row_number().over(last)).where("_r = 1").select("donor_id", "score", "n")
