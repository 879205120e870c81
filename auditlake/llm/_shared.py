"""What several operators need: row keys, tables that cut lineage, let-bindings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.sources.scratch import release, shared_dir, stored, tidy

__all__ = ["documents", "let", "lower_ascii", "release", "shared_dir", "stored", "text_key", "tidy"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row wherever Catalyst moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_key(text: Column) -> Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(text)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
