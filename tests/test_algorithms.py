"""Iterative and order-based operators against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.functions.activation import activate
from auditlake.operators import adjust, communities, factors, metrics, ranges, splits


def vectors(spark, x, **columns):
    names = list(columns)
    rows = [(i, [float(c) for c in v], *(columns[n][i] for n in names)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>" + "".join(f", {n} {'string' if isinstance(columns[n][0], str) else 'long'}" for n in names))


# Nonnegative factors


def counts(n=60, genes=12, rank=3, seed=0):
    rng = np.random.default_rng(seed)
    return rng.poisson(rng.gamma(0.5, 2, (n, rank)) @ rng.gamma(0.5, 3, (rank, genes))).astype(float)


def test_weights_are_nonnegative_least_squares():
    x, basis = counts(20), np.random.default_rng(1).uniform(0, 1, (3, 12))
    w = factors.solve_weights(x, basis)
    slope = (w @ basis - x) @ basis.T  # at the optimum: zero where a weight is positive, not negative elsewhere
    assert (w >= 0).all() and (slope > -1e-5).all() and np.abs(slope[w > 0]).max() < 1e-5
    assert (factors.solve_weights(x, np.zeros((3, 12))) == 0).all()


@pytest.mark.parametrize("batches", [1, 3])
def test_factors_equal_numpy(spark, batches):
    x = counts()
    rows = vectors(spark, x).repartition(4)
    model = factors.fit_factors(rows, "id", 3, passes=5, batches=batches, seed=2)
    part = {r["id"]: r["b"] for r in rows.select("id", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(batches)).alias("b")).collect()}
    basis, above, below = factors.first_basis(x.mean(axis=0), 3, 2), 0.0, 0.0
    keep = 0.0 if batches == 1 else 0.7 ** (1 / batches)
    for _ in range(5):
        for b in range(batches):
            mine = x[[i for i in range(len(x)) if part[i] == b]]
            w = factors.solve_weights(mine, basis)
            above = keep * above + basis * (w.T @ mine)
            below = keep * below + w.T @ w @ basis
            basis = above / np.maximum(below, 1e-12)
    assert np.abs(model.basis - basis).max() < 1e-6 * basis.max()
    last = ((x - factors.solve_weights(x, basis) @ basis) ** 2).sum()
    assert abs(model.objective[-1] - last) < 1e-6 * last
    if batches == 1:
        assert all(b <= a * (1 + 1e-9) for a, b in zip(model.objective, model.objective[1:]))
    assert model.objective[-1] < model.objective[0]


def test_factor_model_is_saved_and_loaded(spark, tmp_path):
    model = factors.FactorModel(np.array([[1.0, 0.5], [0.25, 2.0]]), [3.0, 2.0])
    model.save(spark, str(tmp_path / "m"))
    again = factors.FactorModel.load(spark, str(tmp_path / "m"))
    assert (again.basis == model.basis).all() and again.objective == [3.0, 2.0]
    rows = vectors(spark, [[1, 2], [3, 4]])
    assert model.weights(rows, "id").orderBy("id").collect() == again.weights(rows, "id").orderBy("id").collect()
    assert (model.noised(0.0).basis == model.basis).all() and (model.noised(1.0).basis != model.basis).any()


def test_clusters_summaries_and_draws(spark):
    x = np.concatenate([np.random.default_rng(i).normal(4 * i, 0.1, (30, 2)) for i in range(3)]).clip(0)
    names = ["a"] * 30 + ["b"] * 30 + ["c"] * 30
    rows = vectors(spark, x, kind=names).withColumnRenamed("v", "w")
    for epsilon in (None, 50.0):
        found = {r["id"]: r["cluster"] for r in factors.cluster_weights(rows, "id", 3, epsilon=epsilon).collect()}
        assert len({found[i] for i in range(30)}) == 1 and len(set(found.values())) == 3
    long = rows.select("kind", F.posexplode("w").alias("gene", "x")).withColumn("cnt", F.round("x").cast("long")).withColumnRenamed("kind", "cluster")
    s = factors.cluster_summaries(long, "cluster")
    r = s.where("cluster = 'c' and gene = 0").first()
    assert (r["n"], r["mean"], r["variance"], r["zero_share"]) == (30, 8.0, 1e-6, 0.0)
    noisy = factors.cluster_summaries(long, "cluster", epsilon=0.2).collect()
    assert all(r["mean"] >= 0 and r["variance"] >= 1e-6 and 0 <= r["zero_share"] <= 1 for r in noisy) and any(r["mean"] % 1 for r in noisy)
    for method in ("poisson", "zinb"):
        drawn = factors.draw_cells(spark, s, 900, method=method).collect()
        assert len(drawn) == 900 and drawn == factors.draw_cells(spark, s, 900, method=method).repartition(3).orderBy("draw").collect()
        share = sum(r["cluster"] == "a" for r in drawn) / 900
        mean = np.mean([r["v"][0] for r in drawn if r["cluster"] == "c"])
        assert abs(share - 1 / 3) < 0.06 and abs(mean - 8) < 0.6


def test_labels_are_drawn_at_class_probabilities(spark):
    rng = np.random.default_rng(3)
    side = rng.integers(0, 2, 400)
    x = np.column_stack([side, rng.normal(0, 1, 400)])
    names = [("a" if rng.random() < (0.9 if s else 0.2) else "b") for s in side]
    train = vectors(spark, x, kind=names).withColumnRenamed("v", "w")
    drawn = vectors(spark, [[i % 2, 0.0] for i in range(2000)]).withColumnRenamed("v", "w")
    got = factors.draw_labels(factors.fit_labels(train, "kind", trees=30), drawn, "id", "kind")
    assert got.count() == 2000 and set(got.columns) == {"id", "w", "kind"}
    share = {r["s"]: r["p"] for r in got.groupBy((F.col("id") % 2).alias("s")).agg(F.avg((F.col("kind") == "a").cast("double")).alias("p")).collect()}
    assert abs(share[1] - 0.9) < 0.12 and abs(share[0] - 0.2) < 0.12


def test_frobenius_error_counts_what_one_side_lacks(spark):
    a = spark.createDataFrame([(1, 1, 3.0), (1, 2, 1.0)], "c int, g int, x double")
    b = spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0)], "c int, g int, x double")
    assert factors.frobenius_error(a, b, ["c", "g"], "x").first()[0] == 3.0


# Order by ranges


def test_place_is_a_bisection(spark):
    cuts = [1.0, 2.0, 2.0, 5.0, 9.0, 9.5, 10.0]
    xs = [None, -1.0, 1.0, 1.5, 2.0, 2.5, 9.7, 10.0, 11.0]
    got = spark.createDataFrame([(cuts, x) for x in xs], "c array<double>, x double").select("x", ranges.place(F.col("c"), F.col("x"), 8).alias("p")).collect()
    assert [r["p"] for r in got] == [0 if x is None else sum(c < x for c in cuts) for x in xs]


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums_equal_a_plain_loop(spark, descending):
    rng = np.random.default_rng(4)
    rows = [(g, int(x), float(rng.integers(0, 9))) for g in ("a", "b", None) for x in rng.permutation(300)[: 50 if g == "b" else 300]]
    df = spark.createDataFrame(rows, "g string, x int, n double").repartition(3)
    for by in (["g"], []):
        want = {}
        for g, x, _ in rows:
            same = [(y, n) for h, y, n in rows if not by or h == g]
            want[g, x] = (sum(n for y, n in same if (y >= x if descending else y <= x)), sum(n for _, n in same))
        if not by:
            flat = df.groupBy("x").agg(F.sum("n").alias("n"))
            got = {r["x"]: (r["upto_n"], r["all_n"]) for r in ranges.prefix_sums(flat, F.col("x"), ["n"], [], descending, parts=256).collect()}
            assert got == {x: v for (_, x), v in want.items()}
        else:
            got = {(r["g"], r["x"]): (r["upto_n"], r["all_n"]) for r in ranges.prefix_sums(df, F.col("x"), ["n"], by, descending, parts=256).collect()}
            assert got == want


def test_curves_have_no_window_over_everything(spark):
    rows = spark.createDataFrame([(i % 3 == 0, float(i % 17)) for i in range(100)], "y boolean, s double").withColumn("y", F.col("y").cast("int"))
    for df in (metrics.curve(rows, "y", "s"), metrics.threshold_metrics(rows, "y", "s"), metrics.roc_auc(rows, "y", "s")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if "Window [" in line]
        assert windows and all("_p#" in line or "_b#" in line for line in windows), windows


@pytest.mark.parametrize("enough", [3, 1_000_000])
def test_grouped_median_is_exact(spark, enough):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=501), "b": rng.integers(0, 4, 400).astype(float), "c": np.array([7.0]), "d": np.full(300, 2.5), "e": rng.normal(size=2)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("f", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r["g"]: r["median"] for r in ranges.grouped_median(df, "x", ["g"], parts=16, enough=enough).collect()}
    assert got == {g: np.median(xs) for g, xs in groups.items()}
    whole = ranges.grouped_median(df, "x", [], parts=16, enough=enough).first()["median"]
    assert whole == np.median(np.concatenate(list(groups.values())))
    assert ranges.grouped_median(df.where("g = 'f'"), "x", ["g"]).count() == 0


def test_activation_keeps_groups_without_scores(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", None), ("c", 3.0)], "g string, x double")
    got = {(r["g"], r["x"]): r["y"] for r in activate(df, F.col("x"), "y", ["g"]).collect()}
    assert len(got) == 5 and got["b", None] is None and got["c", 3.0] is None and got["a", 2.0] == 0.5


def test_ranks_take_ranges_from_the_number_of_rows(spark):
    assert ranges.n_ranges(10) == 8 and ranges.n_ranges(10**9) == 4096 and ranges.n_ranges(10**12) == ranges.MOST_RANGES
    df = spark.range(1000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(37)))
    got = splits.ranked(df, F.col("x"), ("id",), parts=64).orderBy("_r").collect()
    assert [(r["x"], r["id"]) for r in got] == sorted((r["x"], r["id"]) for r in got) and [r["_r"] for r in got] == list(range(1, 1001))


# Communities


def planted(groups=4, each=15, inside=0.6, across=0.03, seed=5):
    rng = np.random.default_rng(seed)
    n = groups * each
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // each == b // each else across)], n


def plain_modularity(pairs, c):
    m = len(pairs)
    degree = np.bincount(np.array(pairs).ravel(), minlength=len(c))
    return sum(c[a] == c[b] for a, b in pairs) / m - sum((degree[c == k].sum() / (2 * m)) ** 2 for k in set(c.tolist()))


def test_communities_are_found_and_modularity_rises(spark):
    pairs, n = planted()
    edges = communities.undirected(spark.createDataFrame(pairs + [(b, a) for a, b in pairs[:20]] + [(3, 3)], "id long, other long"))
    assert edges.count() == 2 * len(pairs)
    found, history = communities.modularity_clusters(edges)
    c = np.array([r["c"] for r in found.orderBy("id").collect()])
    assert all(b >= a - 1e-12 for a, b in zip(history, history[1:])) and len(history) > 2
    assert len(c) == n and all(len(set(c[15 * g : 15 * g + 15].tolist())) == 1 for g in range(4)) and len(set(c.tolist())) == 4
    assert abs(history[-1] - plain_modularity(pairs, c)) < 1e-9
    assert c.tolist() == [15 * (i // 15) for i in range(n)]  # named by their smallest vertex


def test_modularity_of_a_given_partition(spark):
    pairs, n = planted(seed=9)
    c = np.arange(n) % 7
    places = spark.createDataFrame([(i, int(x)) for i, x in enumerate(c)], "id long, c long")
    edges = communities.undirected(spark.createDataFrame(pairs, "id long, other long"))
    assert abs(communities.modularity(edges, places).first()[0] - plain_modularity(pairs, c)) < 1e-12


def test_communities_of_little(spark):
    none = spark.createDataFrame([], "id long, other long")
    found, history = communities.modularity_clusters(communities.undirected(none))
    assert found.count() == 0 and history == []
    found, _ = communities.modularity_clusters(communities.undirected(spark.createDataFrame([(1, 2), (5, 6)], "id long, other long")))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (5, 5), (6, 5)]


# Mixing


def plain_lisi(d, labels, perplexity):
    beta, low, high = 1.0, 0.0, np.inf
    for _ in range(200):
        p = np.exp(-beta * (d - d.min()))
        p /= p.sum()
        entropy = -(p[p > 0] * np.log(p[p > 0])).sum()
        if entropy > np.log(perplexity):
            low, beta = beta, beta * 2 if np.isinf(high) else (beta + high) / 2
        else:
            high, beta = beta, (beta + low) / 2
    return 1 / sum(p[labels == k].sum() ** 2 for k in set(labels))


def test_local_mixing_equals_a_plain_loop(spark):
    rng = np.random.default_rng(7)
    batch = rng.integers(0, 3, 40)
    rows, want = [], {}
    for i in range(40):
        others = rng.permutation([j for j in range(40) if j != i])[: 20 if i else 12]
        d2 = rng.random(len(others)) * 4
        rows += [(i, int(j), float(x)) for j, x in zip(others, d2)]
        want[i] = plain_lisi(np.sqrt(d2), batch[others], 6.0)
    near = spark.createDataFrame(rows, "id long, other long, d2 double").repartition(5)
    batches = spark.createDataFrame([(i, int(b)) for i, b in enumerate(batch)], "vec_id long, batch long")
    lisi = metrics.local_mixing(near, batches, "vec_id", 6.0)
    got = {r["id"]: r["lisi"] for r in lisi.collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-3
    assert abs(metrics.scaled_mixing(lisi, batches).first()["lisi"] - (np.median(list(got.values())) - 1) / 2) < 1e-12


# Batch adjustment


def plain_adjusted(x, batch, bayes):
    out = np.empty_like(x)
    n = np.array([(batch == b).sum() for b in (0, 1)])
    means = np.array([x[batch == b].mean(axis=0) for b in (0, 1)])
    grand = (n[:, None] * means).sum(axis=0) / n.sum()
    pooled = sum(((x[batch == b] - means[b]) ** 2).sum(axis=0) for b in (0, 1)) / n.sum()
    z = (x - grand) / np.sqrt(pooled)
    for b in (0, 1):
        mine = z[batch == b]
        g, d = mine.mean(axis=0), mine.var(axis=0, ddof=1)
        if bayes:
            g_bar, t2, m, s2 = g.mean(), g.var(ddof=1), d.mean(), d.var(ddof=1)
            a, c = (2 * s2 + m * m) / s2, (m * s2 + m**3) / s2
            new_g, new_d = g.copy(), d.copy()
            for _ in range(200):
                new_g = (t2 * n[b] * g + new_d * g_bar) / (t2 * n[b] + new_d)
                new_d = (0.5 * ((mine - new_g) ** 2).sum(axis=0) + c) / (n[b] / 2 + a - 1)
            g, d = new_g, new_d
        out[batch == b] = (mine - g) / np.sqrt(d) * np.sqrt(pooled) + grand
    return out


@pytest.mark.parametrize("bayes", [False, True])
def test_batches_are_adjusted_as_in_numpy(spark, bayes):
    rng = np.random.default_rng(8)
    batch = rng.integers(0, 2, 80)
    x = rng.normal(0, 1, (80, 10)) * (1 + batch[:, None]) + batch[:, None] * rng.normal(1, 1, 10)
    got = adjust.adjust_batches(vectors(spark, x, part=[int(b) for b in batch]).repartition(3), "part", empirical_bayes=bayes).orderBy("id").collect()
    assert np.abs(np.array([r["v"] for r in got]) - plain_adjusted(x, batch, bayes)).max() < (1e-3 if bayes else 1e-9)


def test_batches_without_spread_stay(spark):
    rows = vectors(spark, [[5.0, 1.0], [5.0, 2.0], [5.0, 4.0], [5.0, 9.0], [5.0, 3.0]], part=[0, 0, 0, 0, 1])
    got = [r["v"] for r in adjust.adjust_batches(rows, "part").orderBy("id").collect()]
    assert [v[0] for v in got] == [5.0] * 5 and all(np.isfinite(v).all() for v in got)


# Pairs of classes


def test_pairwise_rank_sums_equal_each_pair_by_itself(spark):
    rng = np.random.default_rng(10)
    rows = [(g, "abc"[int(k)], int(x)) for g in (1, 2) for k, x in zip(rng.integers(0, 3, 200), rng.poisson(3, 200))]
    df = spark.createDataFrame(rows, "gene int, kind string, cnt int").repartition(4)
    got = {(r["gene"], r["a"], r["b"]): (r["z"], r["share"]) for r in metrics.pairwise_rank_sums(df, "kind", "cnt", ["gene"]).collect()}
    assert len(got) == 6
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        two = df.where(F.col("kind").isin(a, b)).withColumn("y", (F.col("kind") == a).cast("int"))
        for r in metrics.rank_sum(two, "y", "cnt", ["gene"]).collect():
            assert np.allclose(got[r["gene"], a, b], (r["z"], r["share"]), atol=1e-9)


def test_pairwise_recovery_names_pairs_without_findings(spark):
    z = lambda rows: spark.createDataFrame(rows, "a string, b string, gene int, z double")
    real = z([("x", "y", 1, 3.0), ("x", "y", 2, -3.0), ("x", "z", 1, 0.1)])
    synth = z([("x", "y", 1, 2.0), ("x", "y", 3, 2.0), ("x", "z", 1, None)])
    got = {(r["a"], r["b"], r["direction"]): r for r in metrics.pairwise_recovery(real, synth, 10).collect()}
    assert len(got) == 4
    up, down, none = got["x", "y", "up"], got["x", "y", "down"], got["x", "z", "up"]
    assert (up["real"], up["synth"], up["hit"], up["tpr"], up["precision"]) == (1, 2, 1, 1.0, 0.5) and abs(up["fpr"] - 1 / 9) < 1e-12
    assert (down["tpr"], down["fpr"], down["precision"]) == (0.0, 0.0, None) and (none["real"], none["synth"], none["tpr"], none["fpr"]) == (0, 0, None, 0.0)


# Generators as saved models


def test_every_generator_draws_the_same_after_it_is_loaded(spark, tmp_path):
    from auditlake.operators import generators

    x = counts(120, 5)
    names = [["a", "b", "long name"][i % 3] for i in range(120)]
    rows = vectors(spark, x, kind=names)
    for name in generators.REGISTRY:
        model = generators.train(name, rows, "id", "kind")
        model.save(f"{tmp_path}/{name}")
        again = generators.load(spark.newSession(), f"{tmp_path}/{name}")
        drawn = sorted(map(tuple, model.generate().select("kind", "draw", "v").collect()), key=repr)
        assert drawn == sorted(map(tuple, again.generate().select("kind", "draw", "v").collect()), key=repr), name
        assert len(drawn) == 120 and {k for k, *_ in drawn} <= set(names) and all(len(v) == 5 for *_, v in drawn)
        other = sorted(map(tuple, model.generate(seed=9).select("kind", "draw", "v").collect()), key=repr)
        assert other != drawn
        assert abs(np.mean([v for *_, v in drawn]) / x.mean() - 1) < 0.25, name
    with pytest.raises(KeyError):
        generators.train("unknown", rows, "id", "kind")


# Noise over a grid


def test_noise_over_a_grid_is_the_noise_of_each_job(spark):
    from auditlake.operators import membership, privacy

    corr = spark.createDataFrame([(t, i, j, 1.0 if i == j else 0.3) for t in "ab" for i in range(4) for j in range(i, 4)], "cell_type string, gi int, gj int, r double")
    sigma = spark.createDataFrame([(t, e, 1 / e) for t in "ab" for e in (2.0, 1e12)], "cell_type string, epsilon double, sigma double")
    noised = privacy.noisy_jobs(corr, sigma, "cell_type", [1, 2]).cache()
    assert noised.count() == 2 * 2 * 2 * 10
    flat = noised.where("epsilon > 10").join(corr.withColumnRenamed("r", "was"), ["cell_type", "gi", "gj"])
    assert flat.where("abs(r - was) > 1e-6").count() == 0  # hardly any noise
    wide = noised.where("epsilon = 2 and gi < gj").groupBy("cell_type", "gi", "gj").agg(F.count_distinct("r").alias("n"))
    assert {r["n"] for r in wide.collect()} == {2}  # seeds differ
    deltas = spark.createDataFrame([(i, "ab"[i % 2], [float(i), 1.0, 0.0, -1.0]) for i in range(20)], "cell_id long, cell_type string, delta array<double>")
    jobs = noised.withColumn("job", F.concat_ws("|", "cell_type", "epsilon", "seed"))
    p = membership.precision_tables(jobs, "job").join(jobs.select("job", "cell_type", "epsilon", "seed").distinct(), "job")
    got = membership.fitted_distances(deltas, p, "cell_id", cells=3, jobs=("epsilon", "seed"))
    assert got.count() == 20 * 4 and got.where("d is null").count() == 0
    clean = membership.fitted_distances(deltas, membership.precision_tables(corr, "cell_type"), "cell_id").withColumnRenamed("d", "was")
    assert got.where("epsilon > 10").join(clean, ["cell_id", "cell_type"]).where("abs(d - was) > 1e-4").count() == 0


def test_sweep_summary(spark):
    from auditlake.operators import reports

    runs = spark.createDataFrame([("aux", 1.0, s, a) for s, a in ((1, 0.5), (2, 0.6))] + [("aux", 9.0, 1, 0.9)], "side string, epsilon double, seed int, auc double")
    base = spark.createDataFrame([("aux", 0.75)], "side string, auc double")
    got = {r["epsilon"]: r for r in reports.sweep_summary(runs, base, "side").collect()}
    assert abs(got[1.0]["auc_mean"] - 0.55) < 1e-12 and got[1.0]["n_seeds"] == 2 and abs(got[1.0]["privacy_reduction_pct"] - 80) < 1e-9
    assert got[9.0]["privacy_reduction_pct"] == 0 and got[9.0]["auc_std"] is None


def test_nearest_rows_and_their_ties(spark):
    from auditlake.operators import baselines

    x = np.random.default_rng(1).integers(0, 3, (70, 2)).astype(float)  # many ties
    v = vectors(spark, x).repartition(3)
    got = {}
    for r in baselines.nearest_k(v, v, "id", 5).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["other"]
    for i in range(70):
        d = ((x - x[i]) ** 2).sum(axis=1)
        want = sorted((d[j], j) for j in range(70) if j != i)[:5]
        assert [got[i][k] for k in range(1, 6)] == [j for _, j in want]
    few = vectors(spark, x[:3])
    assert baselines.nearest_k(few, few, "id", 5).count() == 6


# The net


def test_gradients_are_the_slopes_of_the_loss():
    from auditlake.operators import nets

    rng = np.random.default_rng(2)
    net, x, y = nets.new_net([4, 6, 5, 2], 3), rng.normal(size=(20, 4)), rng.integers(0, 2, 20)
    _, g = nets.gradient(net, x, y)
    for layer, slope in zip(net, g):
        for at in list(np.ndindex(layer.shape))[::7]:
            was, ends = layer[at], []
            for step in (1e-6, -1e-6):
                layer[at] = was + step
                ends.append(nets.gradient(net, x, y)[0])
            layer[at] = was
            assert abs((ends[0] - ends[1]) / 2e-6 - slope[at]) < 1e-6


@pytest.mark.parametrize("each", [10_000, 60])
def test_a_net_learns_a_shift_and_a_rerun_gives_the_same_weights(spark, each):
    from auditlake.operators import nets

    rng = np.random.default_rng(4)
    side = rng.integers(0, 2, 240)
    x = rng.normal(size=(240, 5)) + 1.5 * side[:, None]
    rows = vectors(spark, x, y=[int(s) for s in side])
    fit = lambda: nets.train_net(rows.repartition(3), "id", 5, steps=120, hidden=(16, 16), batch=64, sync=20, each=each)
    net = fit()
    assert all((a == b).all() for a, b in zip(net, fit()))
    fresh = rng.normal(size=(200, 5)) + 1.5 * (np.arange(200) % 2)[:, None]
    got = np.array([r["score"] for r in nets.score_net(vectors(spark, fresh), net, "id").orderBy("id").collect()])
    assert np.abs(got - nets.logits(net, fresh)[:, 1]).max() < 1e-9
    assert np.mean(got[1::2]) > np.mean(got[::2]) + 1 and np.median(got[1::2]) > 0 > np.median(got[::2])
    if each == 10_000:  # one task: plain mini-batch Adam
        plain, m = nets.new_net([5, 16, 16, 2], 1), None
        m = ([np.zeros_like(a) for a in plain], [np.zeros_like(a) for a in plain])
        for step in range(1, 121):
            at = np.random.default_rng([1, 0, step]).integers(0, 240, 64)
            nets.adam(plain, m, nets.gradient(plain, x[at], side[at])[1], step)
        assert max(np.abs(a - b).max() for a, b in zip(net, plain)) < 1e-9


def test_scores_follow_the_attackers_knowledge(spark):
    from auditlake.operators import membership

    q = spark.createDataFrame([(c, b, 1.0, 2.0, 3.0, 4.0) for c in ("000", "010", "101", "111") for b in (False, True)], "code string, b boolean, standard_aux double, standard_alone double, b_aux double, b_alone double")
    got = {(r["code"], r["b"]): (r["attack"], r["score"]) for r in membership.dispatched(q, F.col("code"), F.col("b")).collect()}
    assert got["000", False] == ("standard_aux", 1.0) and got["111", False] == ("standard_alone", 2.0) and got["101", True] == ("b_aux", 3.0) and got["010", True] == ("b_alone", 4.0)


def test_macro_precision_counts_classes_that_training_lacks(spark):
    x = np.array([[0.0, 1.0]] * 10 + [[5.0, 1.0]] * 10)
    train = vectors(spark, x, label=[0] * 10 + [1] * 10)
    test = vectors(spark, np.concatenate([x, [[9.0, 9.0]]]), label=[0] * 10 + [1] * 10 + [2])
    r = metrics.train_synthetic_test_real(train, test, "label").first()
    assert r["n"] == 21 and abs(r["accuracy"] - 20 / 21) < 1e-9 and 0.6 < r["macro_precision"] < 0.75


# Products of genes


@pytest.mark.parametrize("block", [512, 70, 3])
def test_products_of_genes_by_blocks(spark, block):
    from auditlake.operators import marginals

    rng = np.random.default_rng(11)
    rows, dense = [], {}
    for c in range(60):
        g = "ab"[c % 2] if c % 7 else None
        for gene in rng.permutation(150)[: int(rng.integers(1, 20))]:
            x = float(rng.integers(0, 9))
            rows.append((g, c, int(gene), x))
            dense.setdefault(g, {}).setdefault(c, {})[int(gene)] = x
    df = spark.createDataFrame(rows, "kind string, cell_id long, gene int, x double").repartition(4)
    got = {(r["kind"], r["gi"], r["gj"]): tuple(r[c] for c in ("n", "x", "y", "xx", "yy", "xy")) for r in marginals.pair_products(df, ["kind"], "x", block).collect()}
    want = {}
    for g, cells in dense.items():
        for genes in cells.values():
            for i, x in genes.items():
                for j, y in genes.items():
                    if i <= j:
                        was = want.get((g, i, j), (0,) * 6)
                        want[g, i, j] = tuple(a + b for a, b in zip(was, (1, x, y, x * x, y * y, x * y)))
    assert got == want
    assert marginals.pair_products(df.limit(0), ["kind"], "x", block).count() == 0
    assert marginals.pair_products(df, [], "x", block).count() > 0
