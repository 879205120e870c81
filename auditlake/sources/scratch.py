"""Tables written once to the folder that the cluster shares: lineage ends there, and a lost executor costs nothing."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, from spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='auditlake-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/auditlake-{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def local_folder(spark: SparkSession, name: str) -> tuple[str, str] | tuple[None, None]:
    """A new folder in the shared one, as Spark names it and as a path; no folder where Spark's store isn't one of files."""
    jvm = spark.sparkContext._jvm
    try:
        where = jvm.org.apache.hadoop.fs.Path(f"{_folder(spark)}/{name}")
    except ValueError:  # none is set
        return None, None
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.makeQualified(where).toUri()
    if found.getScheme() != "file":
        return None, None
    store.mkdirs(where)
    return found.toString(), found.getPath()


def stored(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """df written once to the shared folder and read again.

    instead_of is an earlier stored table that nothing reads any more; its files go.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if instead_of is not None:
        delete(spark, instead_of._stored_at)
    return out


def reread(spark: SparkSession, model):
    """An MLlib model written to the shared folder and loaded again.

    A fitted model of two classes keeps its training summary, which holds the session; as soon as the session has tags of a thread, a
    transform's closure with such a model can't be serialised. What is loaded has no summary.
    """
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    return type(model).load(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete these stored tables, or, without any, all that this application has stored; results not yet read are lost with them."""
    for path in [t._stored_at for t in tables] or [_folder(spark)]:
        delete(spark, path)


def tidy(spark: SparkSession) -> None:
    """Let both sides of the driver collect their garbage: shuffle files that no plan refers to any more go only then.

    For the end of an iteration, whose rounds leave many, or of a stage; the driver's heap shrinks as well.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
