"""Nonnegative factorisation, clusters in its space, noisy summaries, and the generator that draws from them.

A model is small: a basis of rank x genes, summaries of clusters x genes. It travels to the rows; the rows' weights are
solved where the rows are, and what comes back from a task are sums of the basis' size.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.privacy import laplace
from auditlake.operators.splits import bootstrap
from auditlake.sources.scratch import reread, stored

#: Numbers in a model that may pass through the driver and to every task.
MOST_NUMBERS = 50_000_000
_TINY = 1e-12


def solve_weights(x: np.ndarray, basis: np.ndarray, tolerance: float = 1e-9, sweeps: int = 500) -> np.ndarray:
    """Rows' nonnegative least-squares weights for a basis, by coordinate descent over all rows of a batch at once."""
    gram, target = basis @ basis.T, x @ basis.T
    w = np.zeros((len(x), len(basis)))
    for _ in range(sweeps):
        most = 0.0
        for k in range(len(basis)):
            if gram[k, k] <= _TINY:
                continue
            new = np.maximum(w[:, k] + (target[:, k] - w @ gram[:, k]) / gram[k, k], 0)
            most = max(most, float(np.abs(new - w[:, k]).max(initial=0)))
            w[:, k] = new
        if most <= tolerance * max(1.0, float(w.max(initial=0))):
            break
    return w


def first_basis(mean: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Positive random rows around the mean of the data."""
    return (np.maximum(mean, 0) + 1e-3)[None, :] * np.random.default_rng(seed).uniform(0.5, 1.5, (rank, len(mean)))


def updated(basis: np.ndarray, wx: np.ndarray, ww: np.ndarray, above: np.ndarray, below: np.ndarray, keep: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multiplicative step of a batch, blended into running sums of numerators and denominators of which `keep` is kept."""
    above = keep * above + basis * wx
    below = keep * below + ww @ basis
    return above / np.maximum(below, _TINY), above, below


@dataclass
class FactorModel:
    """A basis of rank x genes, and the objective before each pass and at the end."""

    basis: np.ndarray
    objective: list[float] = field(default_factory=list)

    def weights(self, rows: DataFrame, key: str, vector: str = "v", keep: tuple[str, ...] = ()) -> DataFrame:
        """key, w (array<double>) of every row, with the columns to keep."""
        basis = rows.sparkSession.sparkContext.broadcast(self.basis)
        kinds = dict(rows.dtypes)

        def solve(batches):
            for pdf in batches:
                if len(pdf):
                    w = solve_weights(np.stack(pdf[vector].to_numpy()).astype(float), basis.value)
                    yield pdf.drop(columns=[vector]).assign(w=list(w))

        schema = ", ".join([f"{c} {kinds[c]}" for c in (key, *keep)] + ["w array<double>"])
        return rows.select(key, *keep, vector).mapInPandas(solve, schema)

    def noised(self, scale: float, seed: int = 1) -> FactorModel:
        """Gaussian noise on every entry, kept nonnegative so that it stays a basis."""
        noise = np.random.default_rng([seed, 1]).normal(0, scale, self.basis.shape)
        return FactorModel(np.maximum(self.basis + noise, 0), self.objective)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, [float(x) for x in r]) for k, r in enumerate(self.basis)]
        spark.createDataFrame(rows, "component int, basis array<double>").withColumn("objective", F.lit(json.dumps(self.objective))).write.mode("overwrite").parquet(path)

    @classmethod
    def of(cls, rows: DataFrame) -> FactorModel:
        """From a table of component and basis."""
        return cls(np.array([r["basis"] for r in rows.orderBy("component").collect()]))  # rank rows

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FactorModel:
        rows = spark.read.parquet(path)
        return cls(cls.of(rows).basis, json.loads(rows.first()["objective"]))


def fit_factors(rows: DataFrame, key: str, rank: int, passes: int = 10, batches: int = 1, forget: float = 0.7, seed: int = 1, vector: str = "v") -> FactorModel:
    """Nonnegative factors of the rows' vectors by multiplicative updates of the basis.

    Each step solves the weights of a batch exactly where its rows are and sums w'x and w'w over tasks, numbers of the
    basis' size; the basis is then multiplied by their ratio. One batch of all rows never raises the objective;
    several batches, dealt by a hash of the key, are stepped through in turn, older ones kept at forget ** (1 / batches).
    """
    spark = rows.sparkSession
    rows = stored(rows.select(key, vector))
    first = rows.select(F.posexplode(vector).alias("j", "x")).groupBy("j").agg(F.avg("x").alias("m")).orderBy("j").collect()  # one row a gene
    mean = np.array([r["m"] for r in first])
    if rank * len(mean) > MOST_NUMBERS:
        raise ValueError(f"a basis of {rank} x {len(mean)} numbers is too large to travel to every task")
    model, above, below = FactorModel(first_basis(mean, rank, seed)), np.zeros((rank, len(mean))), np.zeros((rank, len(mean)))
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(batches)))

    def sums(part: DataFrame, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        held = spark.sparkContext.broadcast(basis)

        def each(frames):
            wx, ww, loss = np.zeros(basis.shape), np.zeros((rank, rank)), 0.0
            for pdf in frames:
                if len(pdf):
                    x = np.stack(pdf[vector].to_numpy()).astype(float)
                    w = solve_weights(x, held.value)
                    wx, ww, loss = wx + w.T @ x, ww + w.T @ w, loss + float(((x - w @ held.value) ** 2).sum())
            yield pd.DataFrame({"k": range(rank), "wx": list(wx), "ww": list(ww), "loss": [loss, *[0.0] * (rank - 1)]})

        tasks = part.select(vector).mapInPandas(each, "k int, wx array<double>, ww array<double>, loss double")
        cells = tasks.select("k", "loss", F.posexplode(F.concat("wx", "ww")).alias("j", "s"))
        got = cells.groupBy("k", "j").agg(F.sum("s").alias("s"), F.sum(F.when(F.col("j") == 0, F.col("loss"))).alias("loss")).collect()  # rank x (genes + rank) numbers
        table = np.zeros((rank, len(mean) + rank))
        for r in got:
            table[r["k"], r["j"]] = r["s"]
        return table[:, : len(mean)], table[:, len(mean) :], sum(r["loss"] or 0.0 for r in got)

    keep = 0.0 if batches == 1 else forget ** (1 / batches)
    for _ in range(passes):
        loss = 0.0
        for b in range(batches):
            wx, ww, part = sums(dealt.where(F.col("_b") == b) if batches > 1 else dealt, model.basis)
            loss += part
            model.basis, above, below = updated(model.basis, wx, ww, above, below, keep)
        model.objective.append(loss)
    model.objective.append(sums(dealt, model.basis)[2])
    return model


def cluster_weights(weights: DataFrame, key: str, k: int, seed: int = 1, epsilon: float | None = None, steps: int = 10, vector: str = "w") -> DataFrame:
    """(key, cluster): k-means of the weights; with epsilon the centres get Laplace noise before Lloyd's last steps.

    The noise's scale is each component's extent over k and epsilon. Centres are k x rank numbers; each step sums rows by their
    nearest centre in the tasks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = weights.sparkSession
    model = KMeans(k=k, seed=seed, featuresCol="f").fit(weights.select(array_to_vector(vector).alias("f")))
    centres = np.array(model.clusterCenters())
    if epsilon is not None:
        extent = weights.select(F.posexplode(vector).alias("j", "x")).groupBy("j").agg((F.max("x") - F.min("x")).alias("e")).orderBy("j").collect()  # rank rows
        scale = np.array([r["e"] for r in extent]) / k / epsilon
        centres = centres + np.random.default_rng([seed, 2]).laplace(0, 1, centres.shape) * scale
    kind = dict(weights.dtypes)[key]

    def assigned(held):
        def nearest(batches):
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf[vector].to_numpy())
                    d = (held.value**2).sum(1)[None, :] - 2 * x @ held.value.T
                    yield pd.DataFrame({key: pdf[key], "cluster": d.argmin(axis=1).astype(np.int32), vector: list(x)})

        return weights.select(key, vector).mapInPandas(nearest, f"{key} {kind}, cluster int, {vector} array<double>")

    for _ in range(steps if epsilon is not None else 0):
        found = assigned(spark.sparkContext.broadcast(centres))
        sums = found.select("cluster", F.posexplode(vector).alias("j", "x")).groupBy("cluster", "j").agg(F.avg("x").alias("m")).collect()  # k x rank rows
        moved = centres.copy()
        for r in sums:
            moved[r["cluster"], r["j"]] = r["m"]
        if np.abs(moved - centres).max() < 1e-9:
            break
        centres = moved
    return assigned(spark.sparkContext.broadcast(centres)).select(key, "cluster")


def cluster_summaries(rows: DataFrame, by: str, gene: str = "gene", value: str = "cnt", epsilon: float | None = None, seed: int = 1) -> DataFrame:
    """by, gene, n, mean, variance, zero_share of counts in each cluster (rows: one for each cell and gene, zeros included).

    With epsilon each gets Laplace noise of scale 1 / n / epsilon, drawn from a hash of cluster, gene and seed; then means are
    not negative, variances at least 1e-6, and shares within 0 and 1.
    """
    stats = rows.groupBy(by, gene).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.avg((F.col(value) == 0).cast("double")).alias("zero_share"))

    def noise(which: int) -> Column:
        if epsilon is None:
            return F.lit(0.0)
        u = (F.pmod(F.xxhash64(by, gene, F.lit(seed), F.lit(which)), F.lit(1 << 40)) + 0.5) / float(1 << 40) - 0.5
        return laplace(u, 1 / (F.col("n") * epsilon))

    return stats.select(
        by, gene, "n",
        F.greatest(F.col("mean") + noise(1), F.lit(0.0)).alias("mean"),
        F.greatest(F.col("variance") + noise(2), F.lit(1e-6)).alias("variance"),
        F.least(F.greatest(F.col("zero_share") + noise(3), F.lit(0.0)), F.lit(1.0)).alias("zero_share"),
    )


def draw_cells(spark: SparkSession, summaries: DataFrame, n: int, seed: int = 1, method: str = "poisson", by: str = "cluster") -> DataFrame:
    """(draw, cluster, v): n cells, each of a cluster at the clusters' shares, its counts drawn gene by gene.

    method 'poisson' draws at the mean; 'zinb' draws the rate from a gamma of the cluster's mean and variance and then makes zeros at
    the cluster's share of them. A draw depends on its number and the seed only.
    """
    table = summaries.groupBy(by).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("gene", "mean", "variance", "zero_share"))).alias("g"))
    if (size := summaries.count()) > MOST_NUMBERS:
        raise ValueError(f"{size} summaries are too many to travel to every task")
    rows = table.orderBy(by).collect()  # clusters x genes
    share = np.cumsum([r["n"] for r in rows]) / sum(r["n"] for r in rows)
    names = [r[by] for r in rows]
    mean, variance, zero = (np.array([[g[c] for g in r["g"]] for r in rows]) for c in ("mean", "variance", "zero_share"))
    held = spark.sparkContext.broadcast((share, mean, variance, zero))
    kind = dict(summaries.dtypes)[by]

    def draw(batches):
        share, mean, variance, zero = held.value
        for pdf in batches:
            which, counts = [], []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                c = min(int(np.searchsorted(share, rng.random(), "right")), len(share) - 1)
                mu = mean[c]
                if method == "zinb":
                    theta = np.minimum(mu**2 / np.maximum(variance[c] - mu, 1e-6), 1e6)
                    rate = np.minimum(rng.gamma(np.maximum(theta, 1e-6), np.divide(mu, theta, out=np.zeros_like(mu), where=theta > 0)), 1e4)
                    x = np.where(rng.random(len(mu)) < zero[c], 0, rng.poisson(rate))
                else:
                    x = rng.poisson(mu)
                which.append(names[c])
                counts.append(x.astype(float))
            if counts:
                yield pd.DataFrame({"draw": pdf["id"], by: which, "v": counts})

    return spark.range(n).mapInPandas(draw, f"draw long, {by} {kind}, v array<double>")


def fit_labels(train: DataFrame, label: str, trees: int = 100, seed: int = 1, vector: str = "w"):
    """A pipeline model, names to numbers and a random forest, that gives class probabilities of weights."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    names = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc")
    forest = RandomForestClassifier(featuresCol="_f", labelCol="_y", probabilityCol="_p", predictionCol="_d", rawPredictionCol="_r", numTrees=trees, seed=seed)
    return reread(train.sparkSession, Pipeline(stages=[names, forest]).fit(train.select(label, array_to_vector(F.col(vector)).alias("_f"))))


def draw_labels(model, drawn: DataFrame, key: str, label: str, seed: int = 1, vector: str = "w") -> DataFrame:
    """drawn plus label, drawn at the class probabilities that a model of `fit_labels` gives each row."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    names, forest = model.stages
    u = (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(7)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    scored = forest.transform(drawn.select("*", array_to_vector(F.col(vector)).alias("_f"))).withColumn("_u", u).withColumn("_p", vector_to_array("_p"))
    upto = lambda i: F.aggregate(F.slice("_p", F.lit(1), i + 1), F.lit(0.0), lambda acc, p: acc + p)
    cut = F.get(F.filter(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: upto(i) > F.col("_u")), F.lit(0))
    named = F.element_at(F.array(*map(F.lit, names.labels)), F.coalesce(cut, F.size("_p") - 1) + 1)
    return scored.withColumn(label, named).drop("_f", "_p", "_u", "_d", "_r")


def frobenius_error(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Root of the summed squared differences of two count tables; what one side lacks counts as zero."""
    both = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys, "full")
    d = F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))
    return both.agg(F.sqrt(F.sum(d * d).cast("double")).alias("error"))


def zinb_bootstrap(fitted: DataFrame, phi: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """(draw, key, gene, cnt): n cells drawn with replacement, their counts from a zero-inflated negative binomial.

    fitted: (key, gene, mu, pi) of every cell; phi: (gene, phi), the size being 1 / max(phi, 1e-10). A draw's counts
    depend on its number, its gene and the seed only.
    """
    picked = bootstrap(fitted.select(key).distinct(), key, n, seed)
    rows = picked.join(fitted, key).join(F.broadcast(phi), "gene").select("draw", key, "gene", "mu", "pi", "phi")  # phi: a row a gene

    def draw(batches):
        for pdf in batches:
            cnt = []
            for d, g, mu, pi, dispersion in zip(*(pdf[c] for c in ("draw", "gene", "mu", "pi", "phi"))):
                rng, size = np.random.default_rng([seed, d, g]), 1 / max(dispersion, 1e-10)
                cnt.append(0 if rng.random() < pi else rng.poisson(rng.gamma(size, mu / size)))
            yield pdf[["draw", key, "gene"]].assign(cnt=cnt)

    return rows.mapInPandas(draw, f"draw long, {key} {dict(fitted.dtypes)[key]}, gene int, cnt long")
