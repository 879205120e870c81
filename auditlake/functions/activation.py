"""Scores to the unit interval within a group: z-score, less its median, through a sigmoid. Constant groups give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.ranges import grouped_median, joined
from auditlake.sources.scratch import stored


def sigmoid(x: Column, clip: float = 500.0) -> Column:
    """Of x within -clip and clip; least and greatest pass nulls over, so a null is kept apart."""
    return F.when(x.isNotNull(), 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-clip)), F.lit(clip)))))


def activate_from_logits(df: DataFrame, logit: Column, out: str, by: list[str]) -> DataFrame:
    """Group statistics are joined back, not windowed, and medians selected by counted ranges, so that a large group isn't one task's."""
    z = stored(df.withColumn("_l", logit))
    spread = z.groupBy(*by).agg(F.stddev_pop("_l").alias("_s"))
    stats = stored(joined(spread, grouped_median(z, "_l", by, held=True).withColumnRenamed("median", "_q"), by, "left"))  # of a known size
    return joined(z, stats, by).withColumn(out, sigmoid(F.try_divide(F.col("_l") - F.col("_q"), F.col("_s")))).drop("_l", "_s", "_q")


def activate(df: DataFrame, score: Column, out: str, by: list[str]) -> DataFrame:
    return activate_from_logits(df, F.log(score), out, by)
