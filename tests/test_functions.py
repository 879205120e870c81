"""Exact values and properties of the functions and operators."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditlake.functions.activation import activate, activate_from_logits
from auditlake.functions.distributions import count_cdf, qnorm, zinb_cdf, zinb_cdf_dt, zinb_log_pmf
from auditlake.operators import baselines, factors, marginals, membership, metrics, prep, privacy, reports, splits
from auditlake.sources import tables
from auditlake.streaming import scorer

INF = float("inf")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def args(x, pi, theta, mu):
    return [F.lit(v) for v in (x, float(pi), float(theta), float(mu))]


@pytest.mark.parametrize("a, want", [((0, 0, 2, 3), 0.16), ((5, 0, 2, 3), 0.8413696), ((0, 0.2, 2, 3), 0.328), ((5, 0.2, 2, 3), 0.87309568), ((3, 0.2, 2, 3), 0.730432), ((4, 0, INF, 2.5), 0.8911780189), ((0, 0.1, INF, 2.5), 0.1738764988)])
def test_zinb_cdf(spark, a, want):
    assert value(spark, zinb_cdf(*args(*a))) == pytest.approx(want, abs=1e-9)


def test_transform_and_log_pmf(spark):
    assert value(spark, zinb_cdf_dt(*args(0, 0.2, 2, 3), F.lit(0.5))) == pytest.approx(0.264)
    assert value(spark, zinb_cdf_dt(*args(5, 0.2, 2, 3), F.lit(0.5))) == pytest.approx(0.84323584)
    for a, want in (((0, 0.2, 2, 3), -1.1147416706), ((5, 0.2, 2, 3), -2.8180936647), ((4, 0, INF, 2.5), -2.0128909029)):
        assert value(spark, zinb_log_pmf(*args(*a))) == pytest.approx(want, abs=1e-9)


def test_inverse_normal(spark):
    from statistics import NormalDist

    for p in (1e-6, 0.01, 0.3, 0.5, 0.9, 0.999):
        assert value(spark, qnorm(F.lit(p))) == pytest.approx(NormalDist().inv_cdf(p), abs=1e-7)


def test_activation(spark):
    df = spark.createDataFrame([(0, 0.2), (1, 0.5), (2, 0.9), (3, 0.4)], "i int, x double")
    got = [r["a"] for r in activate(df, F.col("x"), "a", []).orderBy("i").collect()]
    assert got == pytest.approx([0.18315724, 0.55163802, 0.78572564, 0.44836198], abs=1e-7)
    df = spark.createDataFrame([(0, -1.0), (1, 0.0), (2, 2.0), (3, 5.0)], "i int, x double")
    got = [r["a"] for r in activate_from_logits(df, F.col("x"), "a", []).orderBy("i").collect()]
    assert got == pytest.approx([0.29465714, 0.39259058, 0.60740942, 0.85141508], abs=1e-7)


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.4)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()["auc"] == 0.75
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").first()["auc"] is None


def vectors(spark, rows, base=0):
    return spark.createDataFrame([(base + i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, v array<double>")


def test_nearest_scores(spark):
    test, synth = vectors(spark, [[0, 0], [3, 3], [0, 1.5]]), vectors(spark, [[0, 1], [2, 2]], 100)
    assert [r["score"] for r in baselines.mc_score(test, synth, "id").orderBy("id").collect()] == [0, 0, 0.5]
    assert [r["score"] for r in baselines.gan_leaks(test, synth, "id").orderBy("id").collect()] == pytest.approx([0.36787944, 0.13533528, 0.77880078])


def test_mmd(spark):
    x, y = vectors(spark, [[0, 0], [1, 0], [0, 2]]), vectors(spark, [[0, 1], [2, 2]], 100)
    assert metrics.mmd(x, y, "id", 0.5).first()["mmd"] == pytest.approx(0.4519171481)
    assert metrics.mmd(x, y, "id", 0.5, biased=False).first()["mmd"] == pytest.approx(-0.2488235813)


def test_blocks_give_what_one_block_gives(spark):
    rng = np.random.default_rng(0)
    a, b = vectors(spark, rng.normal(size=(50, 4))), vectors(spark, rng.normal(size=(70, 4)), 100)

    def least(i, x, j, y):
        return pd.DataFrame({"id": i, "d2": baselines.squared(x, y).min(axis=1)})

    small = baselines.block_distances(a, b, "id", least, "id long, d2 double", block=16).groupBy("id").agg(F.min("d2").alias("d2"))
    whole = baselines.nearest_squared(a, b, "id")
    assert small.join(whole.withColumnRenamed("d2", "w"), "id").where("abs(d2 - w) > 1e-9").count() == 0


def test_wasserstein_and_rand(spark):
    col = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "x double")
    assert metrics.wasserstein(col([0, 1, 3]), col([5, 6, 8, 2]), "x", []).first()["emd"] == pytest.approx(3.9166666667)
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 1, 2], [0, 0, 0, 1, 1, 1])), "a int, b int")
    assert metrics.adjusted_rand(df, "a", "b").first()["ari"] == pytest.approx(0.1176470588)


def test_distances_agree(spark):
    rows = spark.createDataFrame([(1, "t", 0, 0.2, 0.5), (1, "t", 1, 0.7, 0.5)], "cell_id int, cell_type string, gene int, u_s double, c_s double")
    p = np.linalg.pinv(np.array([[1, 0.5], [0.5, 1]]))
    precision = spark.createDataFrame([("t", i, j, float(p[i, j])) for i in range(2) for j in range(2)], "cell_type string, gi int, gj int, p double")
    d = membership.quadratic_distances(rows, precision, ["cell_type"], ["cell_id"], "s").first()["d_s"]
    assert d == pytest.approx(0.5033222957)
    deltas = spark.createDataFrame([(1, "t", [-0.3, 0.2])], "cell_id int, cell_type string, delta array<double>")
    assert membership.matrix_distances(deltas, {"t": p}).first()["d"] == pytest.approx(d)


def test_sensitivity(spark):
    for clip, delta_f, sigma in ((3.0, 323.761172, 15.685598), (2.0, 143.893854, 6.971377), (1.0, 35.973464, 1.742844)):
        s = privacy.frobenius_sensitivity(F.lit(47933), F.lit(1054), 400, clip)
        assert value(spark, s) == pytest.approx(delta_f, abs=1e-5)
        assert value(spark, privacy.gaussian_sigma(s, F.lit(100.0), 1e-5)) == pytest.approx(sigma, abs=1e-5)
    with pytest.raises(Exception, match="more cells"):
        value(spark, privacy.frobenius_sensitivity(F.lit(5), F.lit(5), 1, 1.0))


def test_noise_limits(spark):
    corr = spark.createDataFrame([("t", 0, 0, 1.0), ("t", 0, 1, 0.4), ("t", 1, 1, 1.0)], "cell_type string, gi int, gj int, r double")
    none = spark.createDataFrame([("t", 1e-12)], "cell_type string, sigma double")
    got = privacy.noisy_correlations(corr, none, "cell_type", clip=False)
    assert got.join(corr.withColumnRenamed("r", "was"), ["cell_type", "gi", "gj"]).where("abs(r - was) > 1e-9").count() == 0
    m = marginals.to_correlation(marginals.project_psd(np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])))
    assert np.linalg.eigvalsh(m).min() > -1e-9 and np.allclose(np.diag(m), 1)


def test_fit_recovers_parameters():
    x = np.random.default_rng(3).negative_binomial(2.0, 2.0 / 5.0, 20_000)
    k, n = np.unique(x, return_counts=True)
    pi, theta, mu = marginals.fit_counts(k.astype(float), n.astype(float))
    assert pi < 0.02 and theta == pytest.approx(2.0, rel=0.1) and mu == pytest.approx(3.0, rel=0.05)
    k, n = np.unique(np.random.default_rng(4).poisson(2.0, 20_000), return_counts=True)
    assert marginals.fit_counts(k.astype(float), n.astype(float), "poisson")[1] == INF


def test_splits_are_disjoint(spark):
    donors = spark.range(100).select(F.col("id").alias("donor_id"))
    s = splits.split_donors(donors, 20, 30)
    assert {r["role"]: r["count"] for r in s.groupBy("role").count().collect()} == {"train": 20, "holdout": 20, "auxiliary": 30}
    assert s.where("role <> 'auxiliary'").groupBy("donor_id").count().where("count > 1").count() == 0
    few = splits.split_donors(donors.limit(10), 20, 8)  # the targets are all donors, and auxiliary falls back on them
    assert few.where("role = 'auxiliary'").count() == 8


def test_broken_values_raise(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    with pytest.raises(Exception, match="isn't finite"):
        prep.require_finite(df, F.col("x")).collect()
    bad = spark.createDataFrame([(1, 0.5, 0), (1, 0.5, 1)], "donor_id int, s double, member int")
    with pytest.raises(Exception, match="two memberships"):
        membership.donor_scores(bad, "s").collect()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("g1", 1, 2), ("g2", 3, 4)], "gene string, s1 int, s2 int")
    df.coalesce(1).write.option("header", True).option("sep", "\t").csv(f"{tmp_path}/20d/m")
    long = tables.read_transposed(spark, f"{tmp_path}/20d/m")
    assert {tuple(r) for r in long.collect()} == {("s1", "g1", 1.0), ("s2", "g1", 2.0), ("s1", "g2", 3.0), ("s2", "g2", 4.0)}
    found = tables.discover(spark, f"{tmp_path}/*d/m", "csv", header=True, sep="\t")
    assert {r["nd"] for r in found.collect()} == {20}
    assert tables.fresh_files(found, "2000-01-01").where("fresh").count() == 1
    for part in (1, 2):
        tables.append_partitioned(spark.createDataFrame([(part, 0.5)], "trial int, auc double"), f"{tmp_path}/out", ["trial"])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    events = tables.table(spark, "/root/testdata/sf0.001", "events")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = scorer.windowed_activity(scorer.read_stream(spark, f"{tmp_path}/in"))
    got = scorer.drain(stream, "activity", f"{tmp_path}/cp").agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
    want = scorer.windowed_activity(events).agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
    assert got == want


def test_mvn_generator_fits_and_draws_all_rows(spark, sf_dir):
    from auditlake.plans import registry
    from auditlake.sources.views import profile

    want = {r["cell_type"]: r["count"] for r in profile(spark, sf_dir).where("role = 0").groupBy("cell_type").count().collect()}
    assert {r["cell_type"]: r["count"] for r in registry.QUERIES["mvn_generator"](spark, sf_dir).groupBy("cell_type").count().collect()} == want
    x = np.random.default_rng(3).normal(size=(20_500, 3)) @ np.array([[2, 1, 0], [0, 1, 1], [0, 0, 0.5]]) + [1000, 0, -5]
    rows = spark.createDataFrame([("a", v.tolist()) for v in x] + [("b", [1.0, 2.0, 3.0]), (None, [0.0, 1.0, 0.0]), (None, [2.0, 1.0, 0.0])], "t string, v array<double>")
    model = {r["t"]: r for r in membership.mvn_model(rows, "t").collect()}
    assert {t: r["n"] for t, r in model.items()} == {"a": len(x), "b": 1, None: 2}
    root = np.array(model["a"]["root"])
    assert np.allclose(model["a"]["mean"], x.mean(axis=0)) and np.allclose(root @ root, np.cov(x, rowvar=False))
    out = membership.mvn_groups(rows, "t", 0.1).where("t = 'a'").collect()
    assert sorted(r["draw"] for r in out) == list(range(len(x)))
    assert np.allclose(np.cov(np.array([r["v"] for r in out]), rowvar=False), 1.01 * np.cov(x, rowvar=False), atol=0.25)


def test_count_cdf_of_large_means(spark):
    """Where exp(-mu) is zero in double precision."""
    rows = spark.createDataFrame([(800, 800.0), (700, 700.0), (900, 800.0), (3, 0.0)], "x int, mu double")
    got = [r["c"] for r in rows.select(count_cdf(F.col("x"), F.lit(float("inf")), F.col("mu")).alias("c")).collect()]
    want = [sum(math.exp(k * math.log(mu) - mu - math.lgamma(k + 1)) for k in range(x + 1)) if mu else 1.0 for x, mu in ((800, 800.0), (700, 700.0), (900, 800.0), (3, 0.0))]
    assert got == pytest.approx(want, rel=1e-9)


def test_fitted_distances_in_parts(spark):
    rng = np.random.default_rng(4)
    p = {t: np.linalg.inv(np.array([[1.0, r], [r, 1.0]])) for t, r in (("a", 0.2), ("b", -0.5))}
    corr = spark.createDataFrame([(t, i, j, 1.0 if i == j else r) for t, r in (("a", 0.2), ("b", -0.5)) for i in range(2) for j in range(i, 2)], "cell_type string, gi int, gj int, r double")
    cells = [(i, "abc"[i % 3], rng.normal(size=2).tolist()) for i in range(60)]
    deltas = spark.createDataFrame(cells, "cell_id long, cell_type string, delta array<double>")
    got = {r["cell_id"]: r["d"] for r in membership.fitted_distances(deltas, membership.precision_tables(corr, "cell_type", "inv"), "cell_id", cells=7).collect()}
    for i, t, d in cells:
        assert got[i] is None if t == "c" else got[i] == pytest.approx(math.sqrt(np.array(d) @ p[t] @ np.array(d)))


def test_ranks_over_ranges(spark):
    """Ties, repeated rows, nulls in order and group, a hot value, few rows and none."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 7, 7, 7, rng.randrange(50)])) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, g string, x int").repartition(5)
    got = {r["i"]: r["_r"] for r in splits.ranked(df, F.col("x"), ("i",), ("g",), parts=9).collect()}
    for g in ("a", "b", None):
        order = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))
    same = spark.createDataFrame([(1, 2)] * 4, "i int, x int")
    assert sorted(r["_r"] for r in splits.ranked(same, F.col("x")).collect()) == [1, 2, 3, 4]
    assert splits.ranked(same.where("i > 1"), F.col("x")).count() == 0


def test_filled_template(spark):
    template = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "cell_id long, t string")
    draws = spark.createDataFrame([(12, "a"), (11, "a"), (13, "a"), (14, None)], "cell_id long, t string")
    got = {r["cell_id"]: r["drawn"] for r in splits.fill_template(draws, template, "t", "cell_id").collect()}
    assert got == {1: 11, 2: 12, 3: None, 4: 14}


def test_labels_must_match_rows(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    labels = lambda *found: spark.createDataFrame(list(found), "k int, member int")
    assert {tuple(r) for r in baselines.align_labels(rows, labels((2, 0), (1, 1)), "k").collect()} == {(1, "x", 1), (2, "y", 0)}
    for wrong in (labels((1, 1)), labels((1, 1), (2, 0), (3, 0)), labels((1, 1), (2, 0), (2, 1))):
        with pytest.raises(Exception, match="labels and rows differ"):
            baselines.align_labels(rows, wrong, "k").collect()


def test_predictions_by_method(spark, tmp_path):
    scores = lambda *found: spark.createDataFrame(list(found), "method string, id int, score double")
    baselines.save_predictions(scores(("mc", 1, 0.5), ("gan", 1, 0.25)), f"{tmp_path}/scores")
    baselines.save_predictions(scores(("mc", 1, 0.75)), f"{tmp_path}/scores")
    assert {(r["method"], r["score"]) for r in baselines.load_predictions(spark, f"{tmp_path}/scores").collect()} == {("mc", 0.75), ("gan", 0.25)}
    assert [r["score"] for r in baselines.load_predictions(spark, f"{tmp_path}/scores", "gan").collect()] == [0.25]


def test_paired_variants_and_table_cells(spark):
    rows = [("no_dp", 1, 0.5), ("no_dp", 2, float("nan")), ("v2_no_dp", 1, 0.25), ("eps_10000", 1, 0.5), ("v2_eps_10000", 1, 0.75), ("v2_eps_10000", 2, 0.25), ("eps_5", 1, 0.1), ("other", 1, 0.1)]
    got = {r["label"]: r for r in reports.paired_variants(spark.createDataFrame(rows, "variant string, trial int, auc double"), ["auc"]).collect()}
    assert set(got) == {"∞ (no DP)", "10,000"}
    assert (got["∞ (no DP)"]["old_n"], got["∞ (no DP)"]["old_mean"], got["10,000"]["new_std"]) == (1, 0.5, 0.25)
    cells = spark.createDataFrame([(0.875, 0.25, 5), (-0.5, None, 1), (45.69, 1.0, 5), (None, None, 0)], "m double, s double, n int")
    assert [r[0] for r in cells.select(reports.table_cell(F.col("m"), F.col("s"), F.col("n"), 5)).collect()] == [".88±.25", "-.50±.00^1", "45.69±1.00", "---"]


def test_class_jaccard_counts_real_classes(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "d"), ("a", "a")], "x string, y string")
    got = metrics.class_jaccard(pairs, "x", "y").first()
    assert (got["jaccard"], got["classes"]) == (pytest.approx((2 / 3 + 1 / 2 + 0) / 3), 3)


def test_zinb_bootstrap_moments(spark):
    fitted = spark.createDataFrame([(i, g, 4.0, 0.25) for i in range(10) for g in (0, 1)], "cell_id long, gene int, mu double, pi double")
    phi = spark.createDataFrame([(0, 0.0), (1, 0.5)], "gene int, phi double")
    out = factors.zinb_bootstrap(fitted, phi, "cell_id", 4000)
    got = {r["gene"]: r for r in out.groupBy("gene").agg(F.avg("cnt").alias("m"), F.var_samp("cnt").alias("v"), F.count("*").alias("n")).collect()}
    for g, p in ((0, 0.0), (1, 0.5)):
        second = 0.75 * (4 + 16 * (1 + p))
        assert got[g]["n"] == 4000 and got[g]["m"] == pytest.approx(3, abs=0.2) and got[g]["v"] == pytest.approx(second - 9, rel=0.15)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, factors.zinb_bootstrap(fitted.repartition(3), phi, "cell_id", 4000).collect()))


def test_types_without_matrix(spark):
    quad = spark.createDataFrame([(1, True, 0.9, 2.0, 1.5, -0.5, 3.0, -4.0, 9), (2, False, None, None, None, None, 3.0, -4.0, 9)], "cell_id int, m boolean, standard_aux double, standard_alone double, b_aux double, b_alone double, llr double, log_s double, n_genes long")
    got = {r["cell_id"]: (r["standard_aux"], r["standard_alone"], r["b_aux"], r["b_alone"]) for r in membership.without_matrix(quad, F.col("m")).collect()}
    assert got == {1: (0.9, 2.0, 1.5, -0.5), 2: (0.5, 0.5, 1.0, 0.0)}


def test_forms_without_a_query(spark):
    flags = spark.createDataFrame([(g, g < 3) for g in range(20)], "gene int, highly_variable boolean")
    assert prep.hvg_or_all(flags).where("highly_variable").count() == 20 and prep.hvg_or_all(flags, 3).where("highly_variable").count() == 3
    assert [membership.choose_attack(True, a, m, b) for a, m, b in ((True, True, False), (False, True, True), (True, False, False))] == ["standard_aux", "b_alone", "pairwise"]
    rows = spark.range(50)
    assert [r["id"] for r in splits.sample_rows(rows, 3, F.desc("id")).collect()] == [49, 48, 47]
