"""Fitted models score rows whatever the session went through before."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.operators import factors, metrics, nets


def test_models_of_two_classes_travel_from_a_session_with_tags(spark):
    """A thread's tags leave something in the session that can't be serialised; models must not carry the session to tasks."""
    spark.addTag("audit")
    spark.removeTag("audit")
    rows = spark.range(400).select(F.col("id").alias("vec_id"), (F.col("id") % 2).cast("int").alias("label"))
    rows = rows.withColumn("v", F.array(F.col("label") + F.rand(1), F.rand(2)))
    real, synth = rows.where("label = 0"), rows.where("label = 1")
    assert metrics.discriminator_auc(real, synth, "vec_id", trees=5).first()["auc"] > 0.9
    assert metrics.discriminative_f1(real, synth, real, "vec_id", iterations=20).first()["f1"] > 0.8
    assert metrics.train_synthetic_test_real(rows, rows, "label").first()["accuracy"] > 0.9
    named = rows.select("vec_id", F.col("label").cast("string").alias("kind"), F.col("v").alias("w"))
    labelled = factors.draw_labels(factors.fit_labels(named, "kind", trees=5), named.drop("kind"), "vec_id", "kind")
    assert {r["kind"] for r in labelled.collect()} == {"0", "1"}


def test_generated_cells_are_drawn_and_labelled_in_one_pass(spark):
    """A join of the draws with their labels would draw every cell twice, and Spark would take one side for small enough to broadcast."""
    from auditlake.plans.registry import QUERIES

    plan = QUERIES["factor_generator"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_a_step_keeps_single_precision_and_works_in_place():
    """Steps were taken in double precision, with nine arrays made for each layer."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(32, 6)), rng.integers(0, 2, 32)
    found = {}
    for kind in ("float64", "float32"):
        net = [a.astype(kind) for a in nets.new_net([6, 8, 8, 2], 1)]
        moments = ([np.zeros_like(a) for a in net], [np.zeros_like(a) for a in net])
        for step in range(1, 41):
            loss, g = nets.gradient(net, x.astype(kind), y)
            nets.adam(net, moments, g, step)
        assert {a.dtype.name for a in (*net, *moments[0], *moments[1], *g)} == {kind} and np.isfinite(loss)
        found[kind] = net
    assert max(np.abs(a - b).max() for a, b in zip(*found.values())) < 1e-4
    far = [np.array([[200.0, -200.0]], "float32"), np.zeros(2, "float32")]  # a probability that single precision has as zero
    assert np.isfinite(nets.gradient(far, np.ones((1, 1), "float32"), np.array([1]))[0])


@pytest.mark.parametrize("each", [10_000, 70])
def test_a_net_of_single_precision_is_that_of_double(spark, each):
    """With several tasks, what they send each other is read in the type it was written in."""
    rows = spark.range(200).select("id", F.array(*(F.randn(i) + F.col("id") % 2 for i in range(4))).alias("v"), (F.col("id") % 2).cast("int").alias("y")).repartition(2)
    fit = lambda kind: nets.train_net(rows, "id", 4, steps=30, hidden=(8, 8), batch=30, sync=15, each=each, kind=kind)
    single, double = fit("float32"), fit("float64")
    assert {a.dtype.name for a in single} == {"float64"}
    assert 0 < max(np.abs(a - b).max() for a, b in zip(single, double)) < 1e-4


def test_all_rows_of_a_large_table_train_the_net(spark):
    """Beyond two million rows only those of small hashed keys were trained on; here the others are a class of their own."""
    n = 2_200_000
    far = (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) >= F.lit(int((1 << 30) * 2_000_000 / n))).cast("int")
    rows = spark.range(n).select("id", far.alias("y")).withColumn("v", F.array(F.col("y") * 4.0 - 2.0))
    net = nets.train_net(rows, "id", 1, steps=60, hidden=(8, 8), batch=512, sync=60)
    low, high = nets.logits(net, np.array([[-2.0], [2.0]]))
    assert low[0] > low[1] and high[1] > high[0]


def test_a_share_is_mapped_as_it_came():
    import pyarrow as pa

    v = np.random.default_rng(1).normal(size=(7, 3))
    batches = [pa.RecordBatch.from_pydict({"v": list(v[a:b]), "y": pa.array([i % 2 for i in range(a, b)], pa.int32())}) for a, b in ((0, 4), (4, 7))]
    x, y = nets._share(batches, 3, "float32")
    assert x.dtype == "float32" and (x == v.astype("float32")).all() and y.tolist() == [0, 1, 0, 1, 0, 1, 0]
    assert nets._share([], 3, "float32")[0].shape == (0, 3)
    with pytest.raises(ValueError):
        nets._share(batches, 2, "float32")


def test_tasks_of_a_net_do_not_wait_a_second_for_each_other(spark, monkeypatch):
    """Every exchange went through Spark's barrier, which looks once a second; the numbers are those of the barrier still."""
    rows = spark.range(120).select("id", F.array(*(F.randn(i) + F.col("id") % 2 for i in range(4))).alias("v"), (F.col("id") % 2).cast("int").alias("y"))
    fit = lambda steps: nets.train_net(rows, "id", 4, steps=steps, hidden=(8, 8), batch=30, sync=2, each=40, kind="float32")
    fit(2)
    began, made = time.time(), []
    kept = nets.local_folder
    monkeypatch.setattr(nets, "local_folder", lambda *a: made.append(kept(*a)) or made[-1])
    fit(100)
    assert time.time() - began < 25
    assert not os.path.exists(made[0][1])  # what was exchanged is gone
    few = fit(8)
    monkeypatch.setattr(nets, "local_folder", lambda *a: (None, None))
    assert all((a == b).all() for a, b in zip(few, fit(8)))
    monkeypatch.setattr(nets, "local_folder", lambda *a: (None, "/proc/no/such/folder"))
    assert all((a == b).all() for a, b in zip(few, fit(8)))
