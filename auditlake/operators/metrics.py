"""Metrics of scores against labels, and of synthetic against real data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.baselines import block_distances, squared
from auditlake.operators.ranges import grouped_median, joined, prefix_sums
from auditlake.sources.scratch import reread, stored


def roc_auc(rows: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Rank-sum AUC from counts at distinct scores; null with one class only."""
    by = by or []
    hist = rows.groupBy(*by, F.col(score).alias("x")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.count("*").alias("n"))
    ranked = prefix_sums(hist, F.col("x"), ["n"], by).withColumn("r", F.col("upto_n") - (F.col("n") - 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("r") * F.col("p")).alias("rs"), F.sum("p").alias("pos"), (F.sum("n") - F.sum("p")).alias("neg"))
    return sums.select(*by, F.try_divide(F.col("rs") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * F.col("neg")).alias("auc"), F.col("pos").cast("long").alias("n_pos"), F.col("neg").cast("long").alias("n_neg"))


def curve(rows: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """One row a distinct score, from the highest: tp, fp, tpr, fpr, precision; p and n are the row's own positives and rows.

    Scores are summed up by ranges, so no task orders all of them.
    """
    by = by or []
    hist = rows.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.count("*").alias("n"))
    c = prefix_sums(hist, F.col("threshold"), ["p", "n"], by, descending=True)
    c = c.select(*by, "threshold", "p", "n", F.col("upto_p").alias("tp"), (F.col("upto_n") - F.col("upto_p")).alias("fp"), F.col("all_p").alias("pos"), (F.col("all_n") - F.col("all_p")).alias("neg"))
    return c.withColumns({"tpr": F.try_divide("tp", "pos"), "fpr": F.try_divide("fp", "neg"), "precision": F.col("tp") / (F.col("tp") + F.col("fp"))})


def average_precision(rows: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """by, average_precision: precision at each distinct score, weighted by the share of positives that it adds."""
    c = curve(rows, label, score, by)
    return c.groupBy(*(by or [])).agg(F.sum(F.try_divide(F.col("p"), F.col("pos")) * F.col("precision")).alias("average_precision"))


def threshold_metrics(rows: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """AUC, average precision, trapezoid PR area, accuracy and F1 at the median and best threshold, TPR at FPR of at least 0.01 and 0.1.

    A row counts as positive above a threshold, not at it; among equal F1 the smallest threshold wins. What stands before a
    threshold is its sum less its own rows.
    """
    by = by or []
    c = curve(rows, label, score, by)
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - (F.col("n") - F.col("p"))
    steps = c.withColumns({"tp0": tp0, "fp0": fp0, "recall0": F.coalesce(F.try_divide(tp0, F.col("pos")), F.lit(0.0)), "precision0": F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0))})
    at = steps.withColumns({"accuracy": (F.col("tp0") + F.col("neg") - F.col("fp0")) / (F.col("pos") + F.col("neg")), "f1": F.coalesce(F.try_divide(2 * F.col("tp0"), F.col("tp0") + F.col("fp0") + F.col("pos")), F.lit(0.0))})
    curves = at.groupBy(*by).agg(
        F.sum((F.col("tpr") - F.col("recall0")) * F.col("precision")).alias("average_precision"),
        F.sum((F.col("tpr") - F.col("recall0")) * (F.col("precision") + F.col("precision0")) / 2).alias("pr_auc"),
        F.max("accuracy").alias("accuracy_best"), F.max("f1").alias("f1_best"),
        F.min_by("tpr", F.when(F.col("fpr") >= 0.01, F.struct("fpr", -F.col("threshold")))).alias("tpr_at_fpr_001"),
        F.min_by("tpr", F.when(F.col("fpr") >= 0.1, F.struct("fpr", -F.col("threshold")))).alias("tpr_at_fpr_01"),
    )
    above, y = F.col(score) > F.col("median"), F.col(label) == 1
    n = lambda c: F.count_if(c).cast("double")
    half = joined(rows, grouped_median(rows, score, by), by).groupBy(*by).agg((n(above == y) / F.count("*")).alias("accuracy_median"), F.coalesce(F.try_divide(2 * n(above & y), 2 * n(above & y) + n(above & ~y) + n(~above & y)), F.lit(0.0)).alias("f1_median"))
    return joined(joined(curves, half, by), roc_auc(rows, label, score, by).select(*by, "auc"), by)


def wasserstein(a: DataFrame, b: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Earth mover's distance of two samples of numbers in each group, from counts at distinct values."""
    both = a.select(*by, F.col(value).cast("double").alias("x"), F.lit(1).alias("u"), F.lit(0).alias("v")).unionByName(b.select(*by, F.col(value).cast("double").alias("x"), F.lit(0).alias("u"), F.lit(1).alias("v")))
    hist = both.groupBy(*by, "x").agg(F.sum("u").alias("u"), F.sum("v").alias("v"))
    up, whole = Window.partitionBy(*by).orderBy("x"), Window.partitionBy(*by)
    gap = F.abs(F.sum("u").over(up.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("u").over(whole) - F.sum("v").over(up.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("v").over(whole))
    return hist.select(*by, (gap * (F.lead("x").over(up) - F.col("x"))).alias("w")).groupBy(*by).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("emd"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """From the contingency table; a single cluster on both sides gives 1."""
    table = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    two = lambda n: n * (n - 1) / 2.0
    both = table.agg(F.sum(two(F.col("n"))).alias("ij"), two(F.sum("n")).alias("all"))
    side = lambda c: table.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(f"s_{c}"))
    m = both.crossJoin(F.broadcast(side("a"))).crossJoin(F.broadcast(side("b")))
    expected, most = F.try_divide(F.col("s_a") * F.col("s_b"), F.col("all")), (F.col("s_a") + F.col("s_b")) / 2
    return m.select(F.coalesce(F.try_divide(F.col("ij") - expected, most - expected), F.lit(1.0)).alias("ari"))


def kernel_means(a: DataFrame, b: DataFrame, key: str, gamma: float) -> DataFrame:
    """Sums of exp(-gamma d2) over all pairs of rows, and those over a row with itself."""

    def sums(i, x, j, y):
        k = np.exp(-gamma * squared(x, y))
        same = i[:, None] == j[None, :]
        return pd.DataFrame({"k": [k.sum()], "own": [k[same].sum()], "n": [k.size], "n_own": [int(same.sum())]})

    return block_distances(a, b, key, sums, "k double, own double, n long, n_own long").agg(*(F.sum(c).alias(c) for c in ("k", "own", "n", "n_own")))


def median_gamma(rows: DataFrame, key: str) -> float:
    """1 / (2 * median of the positive squared distances); rows should be a bounded sample."""

    def each(i, x, j, y):
        d = squared(x, y)[i[:, None] < j[None, :]]
        return pd.DataFrame({"d": d[d > 1e-12]})

    return 1 / (2 * block_distances(rows, rows, key, each, "d double").agg(F.median("d")).first()[0])


def mmd(a: DataFrame, b: DataFrame, key: str, gamma: float, biased: bool = True) -> DataFrame:
    """Squared maximum mean discrepancy under a Gaussian kernel; unbiased leaves each row's kernel with itself out."""
    mean = (F.col("k") / F.col("n")) if biased else F.try_divide(F.col("k") - F.col("own"), F.col("n") - F.col("n_own"))
    xx, yy = (kernel_means(d, d, key, gamma).select(mean.alias(n)) for d, n in ((a, "xx"), (b, "yy")))
    xy = kernel_means(a, b, key, gamma).select((F.col("k") / F.col("n")).alias("xy"))
    return xx.crossJoin(F.broadcast(yy)).crossJoin(F.broadcast(xy)).select((F.col("xx") + F.col("yy") - 2 * F.col("xy")).alias("mmd"))


def mixing(neighbours: DataFrame, batches: DataFrame, key: str) -> DataFrame:
    """Median inverse Simpson index of the neighbours' batches, scaled to 0..1; neighbours count alike, without a perplexity."""
    named = neighbours.join(batches.select(F.col(key).alias("other"), F.col("batch")), "other")
    share = named.groupBy("id", "batch").agg(F.count("*").alias("n"))
    lisi = share.groupBy("id").agg((F.pow(F.sum("n"), 2) / F.sum(F.col("n") * F.col("n"))).alias("lisi"))
    n = batches.agg(F.count_distinct("batch").alias("k"))
    return lisi.agg(F.median("lisi").alias("m")).crossJoin(F.broadcast(n)).select(F.try_divide(F.col("m") - 1, F.col("k") - 1).alias("lisi"))


def mask_overlap(new: DataFrame, old: DataFrame, by: str = "gene", flag: str = "highly_variable") -> DataFrame:
    """n_old, n_new, n_overlap, only_old, only_new, jaccard of two masks' chosen genes."""
    chosen = lambda m, name: m.where(flag).select(by, F.lit(1).alias(name)).distinct()
    both = chosen(new, "n").join(chosen(old, "o"), by, "full")
    hit = F.count_if(F.col("n").isNotNull() & F.col("o").isNotNull())
    out = both.agg(F.count("o").alias("n_old"), F.count("n").alias("n_new"), hit.alias("n_overlap"), F.count("*").alias("_all"))
    return out.select("n_old", "n_new", "n_overlap", (F.col("n_old") - F.col("n_overlap")).alias("only_old"), (F.col("n_new") - F.col("n_overlap")).alias("only_new"), F.coalesce(F.try_divide("n_overlap", "_all"), F.lit(0.0)).alias("jaccard"))


def rank_sum(rows: DataFrame, label: str, value: str, by: list[str]) -> DataFrame:
    """Wilcoxon's rank sum with ties and normal approximation, class 1 against 0: u, z, share and direction."""
    hist = rows.groupBy(*by, value).agg(F.sum(F.col(label).cast("double")).alias("p"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = hist.withColumn("r", before + (F.col("n") + 1) / 2).groupBy(*by).agg(F.sum(F.col("r") * F.col("p")).alias("rs"), F.sum("p").alias("n1"), F.sum("n").cast("double").alias("n"), F.sum(F.pow(F.col("n"), 3) - F.col("n")).alias("ties"))
    n1, n0, n = F.col("n1"), F.col("n") - F.col("n1"), F.col("n")
    u = F.col("rs") - n1 * (n1 + 1) / 2
    var = n1 * n0 / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    return sums.select(*by, u.alias("u"), F.try_divide(u - n1 * n0 / 2, F.sqrt(F.when(var > 0, var))).alias("z"), F.try_divide(u, n1 * n0).alias("share"))


def direction(z: Column, critical: float = 1.959963984540054) -> Column:
    return F.when(z > critical, "up").when(z < -critical, "down")


def recovery(real: DataFrame, synth: DataFrame, by: list[str], universe: int) -> DataFrame:
    """True and false positive rates of synthetic findings (by, gene) against real ones; universe genes in all."""
    r, s = real.select(*by, "gene", F.lit(1).alias("r")), synth.select(*by, "gene", F.lit(1).alias("s"))
    both = r.join(s, [*by, "gene"], "full").groupBy(*by).agg(F.count("r").alias("real"), F.count("s").alias("synth"), F.count_if(F.col("r").isNotNull() & F.col("s").isNotNull()).alias("hit"))
    return both.withColumns({"tpr": F.try_divide("hit", "real"), "fpr": F.try_divide(F.col("synth") - F.col("hit"), universe - F.col("real")), "precision": F.try_divide("hit", "synth")})


def edge_key(a: Column, b: Column) -> Column:
    """The same for both directions."""
    return F.concat_ws("_", F.greatest(a, b), F.least(a, b))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def discriminator_auc(real: DataFrame, synth: DataFrame, key: str, trees: int = 40, depth: int = 5, seed: int = 1) -> DataFrame:
    """Held-out AUC of a random forest telling real from synthetic vectors: 0.5 where it can't."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    both = real.select(key, "v", F.lit(0.0).alias("label")).unionByName(synth.select(key, "v", F.lit(1.0).alias("label")))
    both = both.select(array_to_vector("v").alias("features"), "label", (F.pmod(F.xxhash64(key, "label"), F.lit(4)) == 0).alias("test"))
    model = reread(both.sparkSession, RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(both.where("not test")))
    scored = model.transform(both.where("test")).select(F.col("label").cast("int").alias("y"), F.round(vector_to_array("probability")[1], 9).alias("p"))
    return roc_auc(scored, "y", "p")


def train_synthetic_test_real(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """accuracy, macro_precision, n on test of a logistic regression fitted on train.

    macro_precision is the mean over the test's classes of the average precision of their probabilities; a class that train lacks has probability 0.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    shape = lambda df: df.select(array_to_vector("v").alias("features"), F.col(label).cast("double").alias("label"))
    model = reread(train.sparkSession, LogisticRegression(maxIter=30, family="multinomial").fit(shape(train)))
    scored = stored(model.transform(shape(test)).select("label", "prediction", vector_to_array("probability").alias("p")))
    classes = scored.select(F.col("label").cast("int").alias("class")).distinct()  # the test's classes
    each = scored.join(F.broadcast(classes)).select("class", (F.col("label") == F.col("class")).cast("int").alias("y"), F.coalesce(F.get("p", F.col("class")), F.lit(0.0)).alias("score"))
    macro = average_precision(each, "y", "score", ["class"]).agg(F.avg("average_precision").alias("macro_precision"))
    return scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n")).crossJoin(F.broadcast(macro)).select("accuracy", "macro_precision", "n")


def class_jaccard(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Mean over a's classes of rows that both sides give the class, of those that either does; from the contingency table."""
    table = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    n, none = F.col("n"), F.lit(0).cast("long")
    both = F.when(F.col("a") == F.col("b"), n).otherwise(none)
    sides = F.explode(F.array(F.struct(F.col("a").alias("k"), n.alias("na"), none.alias("nb"), both.alias("both")), F.struct(F.col("b").alias("k"), none.alias("na"), n.alias("nb"), none.alias("both"))))
    each = table.select(sides.alias("s")).select("s.*").groupBy("k").agg(*(F.sum(c).alias(c) for c in ("na", "nb", "both"))).where("na > 0 and k is not null")
    return each.agg(F.avg(F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"), F.count("*").alias("classes"))


def top_coefficients(coefficients: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The n largest (by, feature, coef) of each class, to nine decimals; among equals the later feature goes first."""
    w = Window.partitionBy(by).orderBy(F.desc(F.round("coef", 9)), F.desc("feature"))  # features of a model, not rows
    return coefficients.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def feature_overlap(synth: DataFrame, real: DataFrame) -> DataFrame:
    """How many features of any synthetic class's list are in a real class's, and their share of the former."""
    s, r = synth.select("feature").distinct(), real.select("feature").distinct().withColumn("_r", F.lit(1))
    return s.join(r, "feature", "left").agg(F.count("_r").alias("overlap"), F.coalesce(F.try_divide(F.count("_r"), F.count("*")), F.lit(0.0)).alias("share"))


def mean_contrasts(rows: DataFrame, label: str) -> DataFrame:
    """(label, feature, coef): a class's mean of each component less the mean of all; coefficients in closed form."""
    long = rows.select(label, F.posexplode("v").alias("feature", "x"))
    sums = long.groupBy(label, "feature").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    w = Window.partitionBy("feature")  # classes of a feature
    return sums.select(label, "feature", (F.col("s") / F.col("n") - F.sum("s").over(w) / F.sum("n").over(w)).alias("coef"))


def logistic_coefficients(rows: DataFrame, label: str, iterations: int = 100) -> DataFrame:
    """(label, feature, coef) of a one-against-the-rest logistic regression; the driver holds classes times features."""
    from pyspark.ml.classification import LogisticRegression, OneVsRest
    from pyspark.ml.functions import array_to_vector

    model = OneVsRest(classifier=LogisticRegression(maxIter=iterations)).fit(rows.select(array_to_vector("v").alias("features"), F.col(label).cast("double").alias("label")))
    found = [(k, i, float(x)) for k, m in enumerate(model.models) for i, x in enumerate(m.coefficients.toArray())]
    return rows.sparkSession.createDataFrame(found, f"{label} int, feature int, coef double")


def discriminative_f1(real: DataFrame, synth: DataFrame, unseen: DataFrame, key: str, iterations: int = 1000) -> DataFrame:
    """F1 of 'real' by a logistic regression that tells real from synthetic: 70 % train, the rest and unseen real rows test, scaled by the former."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    part = lambda rows, y: rows.select(array_to_vector("v").alias("x"), F.lit(y).alias("label"), (F.pmod(F.xxhash64(key, F.lit(y)), F.lit(10)) < 7).alias("train"))
    both = part(real, 1.0).unionByName(part(synth, 0.0))
    steps = [StandardScaler(inputCol="x", outputCol="features", withMean=True), LogisticRegression(maxIter=iterations)]
    test = both.where("not train").unionByName(part(unseen, 1.0))
    hit = reread(real.sparkSession, Pipeline(stages=steps).fit(both.where("train"))).transform(test)
    n = lambda c: F.count_if(c).cast("double")
    y, p = F.col("label") == 1, F.col("prediction") == 1
    return hit.agg(F.coalesce(F.try_divide(2 * n(y & p), 2 * n(y & p) + n(y & ~p) + n(~y & p)), F.lit(0.0)).alias("f1"), F.count("*").alias("n"))


def neighbour_weights(distances: np.ndarray, perplexity: float, tolerance: float = 1e-5, tries: int = 50) -> np.ndarray:
    """Each row's weights exp(-beta d), brought to sum one, with its own beta found by bisection so that their entropy is log(perplexity).

    Rows are sorted or not; infinite distances weigh nothing.
    """
    goal, n = np.log(perplexity), len(distances)
    d = distances - np.min(distances, axis=1, keepdims=True, initial=np.inf)
    beta, low, high = np.ones(n), np.zeros(n), np.full(n, np.inf)
    for _ in range(tries):
        p = np.exp(-d * beta[:, None])
        total = p.sum(axis=1)
        entropy = np.log(total) + beta * np.where(np.isfinite(d), d, 0).__mul__(p).sum(axis=1) / total
        off = entropy - goal
        if (np.abs(off) < tolerance).all():
            break
        wide = off > 0  # too even: sharpen
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        step = np.where(np.isinf(high), beta * 2, (low + high) / 2)
        beta = np.where(np.abs(off) < tolerance, beta, step)
    p = np.exp(-d * beta[:, None])
    return p / p.sum(axis=1, keepdims=True)


def local_mixing(neighbours: DataFrame, batches: DataFrame, key: str, perplexity: float) -> DataFrame:
    """(id, lisi): inverse Simpson index of the batches around each row, its neighbours weighted to the perplexity.

    neighbours: (id, other, d2), a bounded number a row; a row's are gathered, never a batch's.
    """
    named = neighbours.join(batches.select(F.col(key).alias("other"), F.col("batch").cast("string").alias("batch")), "other")
    lists = named.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.sqrt("d2").alias("d"), "other", "batch"))).alias("l"))
    wide = lists.select("id", F.transform("l", lambda x: x["d"]).alias("d"), F.transform("l", lambda x: x["batch"]).alias("b"))

    def index(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            most = max(map(len, pdf["d"]))
            d = np.full((len(pdf), most), np.inf)
            codes, names = pd.factorize(np.concatenate(pdf["b"].to_numpy()))
            at = np.full((len(pdf), most), -1)
            sizes = pdf["d"].map(len).to_numpy()
            filled = np.arange(most)[None, :] < sizes[:, None]
            d[filled], at[filled] = np.concatenate(pdf["d"].to_numpy()), codes
            w = neighbour_weights(d, perplexity)
            simpson = sum((w * (at == c)).sum(axis=1) ** 2 for c in range(len(names)))
            yield pd.DataFrame({"id": pdf["id"], "lisi": 1 / simpson})

    return wide.mapInPandas(index, "id long, lisi double")


def scaled_mixing(lisi: DataFrame, batches: DataFrame) -> DataFrame:
    """The median index, 0 for one batch around everything and 1 for even batches."""
    n = batches.agg(F.count_distinct("batch").alias("k"))
    return grouped_median(lisi, "lisi", []).crossJoin(F.broadcast(n)).select(F.try_divide(F.col("median") - 1, F.col("k") - 1).alias("lisi"))


def pairwise_rank_sums(rows: DataFrame, group: str, value: str, by: list[str]) -> DataFrame:
    """by, a, b, z, share: Wilcoxon's rank sum of every two groups a < b in one pass, positive where a's values are larger.

    Values become counts by (by, value, group); each group's counts are cumulated once, and the histograms of two groups give U and
    ties of their pair. The groups' names, classes of the data, are gathered; rows after that follow distinct values.
    """
    hist = rows.groupBy(*by, value, group).agg(F.count("*").alias("n"))
    names = hist.agg(F.array_sort(F.collect_set(group)).alias("names"))
    held = hist.groupBy(*by, value).agg(F.map_from_entries(F.collect_list(F.struct(group, "n"))).alias("m"))
    every = held.crossJoin(F.broadcast(names)).select(*by, value, F.explode("names").alias("g"), "m")  # one row of classes
    counted = every.select(*by, value, "g", F.coalesce(F.try_element_at("m", F.col("g")), F.lit(0).cast("long")).alias("n"))
    before = Window.partitionBy(*by, "g").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    cumulated = counted.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    met = cumulated.groupBy(*by, value).agg(F.array_sort(F.collect_list(F.struct("g", "n", "below"))).alias("c"))
    pairs = F.flatten(F.transform("c", lambda x: F.transform(F.filter("c", lambda y: y["g"] > x["g"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    each = met.select(*by, F.explode(pairs).alias("p")).select(*by, F.col("p.x.g").alias("a"), F.col("p.y.g").alias("b"), F.col("p.x.n").cast("double").alias("n"), F.col("p.y.n").cast("double").alias("m"), F.col("p.y.below").alias("below"))
    tied = F.pow(F.col("n") + F.col("m"), 3) - (F.col("n") + F.col("m"))
    sums = each.groupBy(*by, "a", "b").agg(F.sum(F.col("n") * (F.col("below") + F.col("m") / 2)).alias("u"), F.sum("n").alias("n1"), F.sum("m").alias("n0"), F.sum(tied).alias("ties"))
    n1, n0, n = F.col("n1"), F.col("n0"), F.col("n1") + F.col("n0")
    var = n1 * n0 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    return sums.select(*by, "a", "b", F.try_divide(F.col("u") - n1 * n0 / 2, F.sqrt(F.when(var > 0, var))).alias("z"), F.try_divide(F.col("u"), n1 * n0).alias("share"))


#: One-sided p < 0.05 under the normal approximation.
ONE_SIDED = 1.6448536269514722


def pairwise_recovery(real: DataFrame, synth: DataFrame, universe: int, critical: float = ONE_SIDED) -> DataFrame:
    """a, b, direction with real, synth, hit, tpr, fpr, precision for every pair of classes: synthetic findings held against real ones.

    real, synth: (a, b, gene, z); every pair that either side has gets both directions, with zeros where nothing was found.
    """
    findings = lambda z: z.withColumn("direction", direction(F.col("z"), critical)).where("direction is not null")
    found = recovery(findings(real), findings(synth), ["a", "b", "direction"], universe)
    every = real.select("a", "b").unionByName(synth.select("a", "b")).distinct().select("a", "b", F.explode(F.array(F.lit("up"), F.lit("down"))).alias("direction"))
    return every.join(found, ["a", "b", "direction"], "left").fillna(0, ["real", "synth", "hit"]).withColumn("fpr", F.coalesce("fpr", F.lit(0.0)))
