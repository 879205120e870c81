"""Storage by type and by cell: folders that a filter prunes, buckets that join without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def store_by(df: DataFrame, path: str, by: str, files: int = 1) -> None:
    """One folder for each value of by; a value's rows are dealt over `files` files, so a large one isn't one task's.

    What lay in the folders of the values written is replaced, other folders stay.
    """
    dealt = df.repartition(F.col(by), F.pmod(F.xxhash64(*[c for c in df.columns if c != by]), F.lit(files)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_slice(spark: SparkSession, path: str, by: str, values: list) -> DataFrame:
    """Rows of some values; only their folders are listed and read."""
    return spark.read.parquet(path).where(F.col(by).isin(values))


def store_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int, by: str | None = None) -> DataFrame:
    """A table in the session's catalogue, its files at path, bucketed and sorted by key, and partitioned by `by` where that is given.

    Two tables of the same key and number of buckets join by key without a shuffle or a sort, slice by slice.
    """
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path)
    (writer if by is None else writer.partitionBy(by)).saveAsTable(name)
    return df.sparkSession.table(name)


def buckets_for(rows: int, each: int = 1_000_000) -> int:
    """How many buckets bring about `each` rows to one; a power of two, so that tables of different sizes still match."""
    return 1 << max(0, (max(rows, 1) // each)).bit_length()
