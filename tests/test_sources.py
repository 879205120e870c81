"""Array files, storage by type and buckets, results that are appended and resumed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.sources import scratch, storage
from auditlake.sources.arrays import ArrayFiles
from auditlake.streaming import results, scorer


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(ArrayFiles)


def load(spark, path, **options):
    return spark.read.format("npy").options(path=str(path), **options).load()


def test_array_files_are_read_by_slices(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(1000, 3))
    np.save(tmp_path / "x.npy", x)
    df = load(spark, tmp_path / "x.npy", sliceBytes=24 * 128)
    assert df.rdd.getNumPartitions() == 8
    rows = df.orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(1000)) and np.array_equal(np.array([r["value"] for r in rows]), x)
    assert {r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()} == {128, 104}


def test_array_files_of_names_numbers_and_nothing(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array(["d1", "donor 2", "é"]))
    np.save(tmp_path / "b.npy", np.array(["d4"]))
    assert sorted((r["file"].split("/")[-1], r["at"], r["value"]) for r in load(spark, tmp_path).collect()) == [("a.npy", 0, "d1"), ("a.npy", 1, "donor 2"), ("a.npy", 2, "é"), ("b.npy", 0, "d4")]
    (tmp_path / "n").mkdir()
    np.save(tmp_path / "n/i.npy", np.array([3, 1, 2], np.int32))
    assert load(spark, tmp_path / "n/i.npy").orderBy("at").select("value").dtypes == [("value", "int")]
    (tmp_path / "e").mkdir()
    np.save(tmp_path / "e/none.npy", np.zeros(0))
    assert load(spark, tmp_path / "e").count() == 0
    np.save(tmp_path / "e/objects.npy", np.array([{"a": 1}], object), allow_pickle=True)
    with pytest.raises(Exception, match="without objects"):
        load(spark, tmp_path / "e/objects.npy").collect()


@pytest.mark.parametrize("kind, values", [("long", list(range(50))), ("string", [f"donor {i}" for i in range(50)]), ("array<double>", [[i / 2, 1.0] for i in range(50)])])
def test_array_files_make_the_round_trip(spark, tmp_path, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"value {kind}").repartition(3)
    for _ in range(2):  # what was there is replaced
        df.write.format("npy").mode("overwrite").option("path", str(tmp_path / "out")).save()
    assert len(list((tmp_path / "out").glob("part-*.npy"))) == 3 and not (tmp_path / "out/_temporary").exists()
    back = load(spark, tmp_path / "out")
    assert sorted(r["value"] for r in back.collect()) == sorted(values)
    df.write.format("npy").mode("append").option("path", str(tmp_path / "out")).save()
    assert load(spark, tmp_path / "out").count() == 100


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_slice_reads_one_folder(spark, tmp_path):
    df = spark.range(300).select("id", F.concat(F.lit("type "), (F.col("id") % 3).cast("string")).alias("kind"))
    path = str(tmp_path / "cells")
    storage.store_by(df, path, "kind", files=2)
    one = storage.read_slice(spark, path, "kind", ["type 1"])
    folders = {r[0].split("/")[-2] for r in one.select(F.input_file_name()).distinct().collect()}
    assert one.count() == 100 and len(folders) == 1
    assert "PushedFilters: []" in plan(one) and "PartitionFilters: [" in plan(one) and "type 1" in plan(one)
    storage.store_by(df.where("kind = 'type 1' and id < 10"), path, "kind")  # the others stay
    assert spark.read.parquet(path).count() == 203


def test_buckets_join_without_a_shuffle(spark, tmp_path):
    cells = spark.range(500).select(F.col("id").alias("cell_id"), (F.col("id") % 5).alias("kind"))
    counts = spark.range(2000).select((F.col("id") % 500).alias("cell_id"), F.col("id").alias("cnt"))
    a = storage.store_bucketed(cells, "cells_by_cell", str(tmp_path / "a"), "cell_id", 4, by="kind")
    b = storage.store_bucketed(counts, "counts_by_cell", str(tmp_path / "b"), "cell_id", 4)
    joined = a.where("kind = 2").hint("merge").join(b, "cell_id").groupBy("cell_id").agg(F.sum("cnt").alias("s"))
    text = plan(joined)
    assert "Exchange" not in text and "SortMergeJoin" in text
    assert joined.count() == 100
    assert [storage.buckets_for(n) for n in (0, 999_999, 1_000_000, 5_000_000)] == [1, 1, 2, 8]
    spark.sql("drop table cells_by_cell")
    spark.sql("drop table counts_by_cell")


def test_stored_tables_are_released(spark):
    a, b = scratch.stored(spark.range(5)), scratch.stored(spark.range(6))
    scratch.release(spark, a)
    assert b.count() == 6
    with pytest.raises(Exception, match="[Pp]ath|exist"):
        a.count()


def batches(spark, folder):
    rows = [[(d, float(b * 10 + d)) for d in range(4) if (b + d) % 3] for b in range(5)]
    for b, part in enumerate(rows):
        spark.createDataFrame(part, "donor_id long, score double").coalesce(1).write.mode("append").parquet(folder)
    return [r for part in rows for r in part]


def one_by_one(spark, folder):
    return spark.readStream.schema("donor_id long, score double").option("maxFilesPerTrigger", 1).parquet(folder)


class Killed(Exception):
    pass


def dies(sink, at, written):
    """The sink, which is killed in batch `at`, before or after it has written."""

    def write(rows, batch):
        if batch == at and not written:
            raise Killed
        sink(rows, batch)
        if batch == at:
            raise Killed

    return write


@pytest.mark.parametrize("written", [False, True])
def test_a_killed_append_resumes_to_the_same_rows(spark, tmp_path, written):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    want = batches(spark, source)
    with pytest.raises(Exception, match="Killed"):
        results.append_results(one_by_one(spark, source), out, check, dies(results.write_batch(out), 2, written))
    results.append_results(one_by_one(spark, source), out, check)
    got = results.read_results(spark, out)
    assert sorted((r["donor_id"], r["score"]) for r in got.collect()) == sorted(want) and got.select("batch").distinct().count() == 5
    spark.createDataFrame([(9, 9.0)], "donor_id long, score double").write.mode("append").parquet(source)  # later rows, once
    results.append_results(one_by_one(spark, source), out, check)
    results.append_results(one_by_one(spark, source), out, check)
    assert results.read_results(spark, out).count() == len(want) + 1


@pytest.mark.parametrize("written", [False, True])
def test_donor_means_are_the_batch_ones_after_a_restart(spark, tmp_path, written):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    want = batches(spark, source)
    with pytest.raises(Exception, match="Killed"):
        results.follow_donor_means(one_by_one(spark, source), out, check, dies(results.write_batch(out), 3, written))
    results.follow_donor_means(one_by_one(spark, source), out, check)
    got = {r["donor_id"]: (r["score"], r["n"]) for r in results.latest_donor_means(spark, out).collect()}
    rows = scorer.running_donor_means(spark.createDataFrame(want, "user_id long, value double"))
    assert got == {r["donor_id"]: (r["score"], r["n"]) for r in rows.collect()}
