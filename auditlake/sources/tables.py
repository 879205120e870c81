"""Reading and writing tables: conforming, discovery, transposing, patching, incremental appends."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conform(df: DataFrame, schema: T.StructType, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """df with exactly the fields of schema: aliases renamed, missing fields as typed nulls, others cast (null if they can't be)."""
    renamed = df.withColumnsRenamed({old: new for old, new in (aliases or {}).items() if old in df.columns and new not in df.columns})
    have = set(renamed.columns)
    return renamed.select(*((F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=True)


def read_transposed(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A features-by-samples file as (sample, feature, value); only the header decides the samples."""
    wide = spark.read.csv(path, sep=sep, header=True)
    key, *samples = wide.columns
    long = wide.unpivot(key, samples, "sample", "value")
    return long.select("sample", F.col(key).alias("feature"), F.col("value").cast("double").alias("value"))


def discover(spark: SparkSession, pattern: str, fmt: str = "csv", depth: str = r"/(\d+)d/", **options) -> DataFrame:
    """Rows of all files that a glob finds, with their path, modification time and the donor count in the path."""
    rows = spark.read.format(fmt).options(**options).load(pattern).select("*", "_metadata.file_path", "_metadata.file_modification_time")
    return rows.withColumn("nd", F.regexp_extract("file_path", depth, 1).try_cast("int"))


def fresh_files(found: DataFrame, cutoff: str) -> DataFrame:
    """Each file once, with whether it was written at or after the cutoff."""
    return found.groupBy("file_path").agg(F.max(F.col("file_modification_time") >= F.lit(cutoff).cast("timestamp")).alias("fresh"))


def patch_column(df: DataFrame, changes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """df with column replaced where changes has a row of the same keys."""
    new = changes.select(*keys, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    return df.join(new, keys, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).select(df.columns)


def append_partitioned(df: DataFrame, path: str, by: list[str], compression: str = "gzip") -> None:
    df.write.mode("append").option("compression", compression).partitionBy(*by).parquet(path)


def as_json(df: DataFrame, name: str = "record") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))
