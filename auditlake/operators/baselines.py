"""Nearest-neighbour, density and classifier scores of test vectors against synthetic and reference ones, in blocks of numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from auditlake.operators.nets import score_net, train_net
from auditlake.operators.ranges import grouped_median

#: Rows of a block at least and at most, and the blocks that a side is cut into between the two.
BLOCK, MOST_BLOCK, BLOCKS = 2048, 65_536, 24


def block_distances(left: DataFrame, right: DataFrame, key: str, reduce, schema: str, block: int | None = None) -> DataFrame:
    """reduce(left ids, left vectors, right ids, right vectors) -> frame, over all pairs of blocks of the two sides.

    Every left row meets every right row once; a task holds two blocks and meets the left one's rows a few at a time, BLOCK squared
    pairs at once, and what it returns is per row, not per pair. A side has BLOCKS blocks, so rows are copied that often, whatever their
    number; smaller tables have fewer, larger ones (1.5 million rows) more.
    """
    fit = lambda n: min(MOST_BLOCK, max(BLOCK, math.ceil(n / BLOCKS))) if block is None else block
    sized = lambda n: max(1, math.ceil(n / fit(n)))
    n_left, n_right = sized(left.count()), sized(right.count())
    dealt = lambda df, n, seed: F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)).cast("int")
    a = left.select(F.col(key).alias("id"), "v", dealt(left, n_left, 1).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    b = right.select(F.col(key).alias("jd"), F.col("v").alias("w"), dealt(right, n_right, 2).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(p, q):
        if not len(p) or not len(q):
            return out.empty_table()
        i, x, j, y = p["id"].to_numpy(), _matrix(p["v"]), q["jd"].to_numpy(), _matrix(q["w"])
        few = max(1, BLOCK * BLOCK // len(j))
        met = pd.concat([reduce(i[at : at + few], x[at : at + few], j, y) for at in range(0, len(i), few)], ignore_index=True)
        return pa.Table.from_pandas(met, schema=out, preserve_index=False)

    return a.groupBy("x", "y").cogroup(b.groupBy("x", "y")).applyInArrow(run, schema)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as a matrix, without a Python object a row."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    if lists.null_count or (sizes != sizes[0]).any():
        raise ValueError("vectors must be there and of one length")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def nearest_squared(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(id, d2): squared distance to the nearest right row with another id."""

    def least(i, a, j, b):
        d = squared(a, b)
        d[i[:, None] == j[None, :]] = np.inf
        return pd.DataFrame({"id": i, "d2": d.min(axis=1)})

    return block_distances(left, right, key, least, "id long, d2 double").groupBy("id").agg(F.min("d2").alias("d2"))


def mc_score(test: DataFrame, synth: DataFrame, key: str) -> DataFrame:
    """Share of synthetic rows nearer than the median nearest distance."""
    eps = grouped_median(nearest_squared(test, synth, key), "d2", []).first()["median"]
    n = synth.count()

    def within(i, a, j, b):
        return pd.DataFrame({"id": i, "n": (squared(a, b) < eps).sum(axis=1)})

    return block_distances(test, synth, key, within, "id long, n long").groupBy("id").agg((F.sum("n") / n).alias("score"))


def gan_leaks(test: DataFrame, synth: DataFrame, key: str) -> DataFrame:
    return nearest_squared(test, synth, key).select("id", F.exp(-F.col("d2")).alias("score"))


def gan_leaks_calibrated(test: DataFrame, synth: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    g, r = (nearest_squared(test, x, key) for x in (synth, reference))
    both = g.withColumnRenamed("d2", "g").join(r.withColumnRenamed("d2", "r"), "id")
    return both.select("id", (1 / (1 + F.exp(F.col("g") - F.col("r")))).alias("score"))


def nearest_pairs(i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, squared distance) of each row's k nearest with another id, ties of distances to 12 places by id.

    The k-th distance to some of the rows bounds what can be among the nearest; only pairs within it are measured and ordered.
    """
    less = np.hstack([-2 * a, np.ones((len(a), 1))]) @ np.hstack([b, (b * b).sum(1)[:, None]]).T  # squared distances, less the left rows' own
    bound = np.full(len(a), np.inf)
    few = max(k + 1, math.isqrt(10 * k * len(j)))  # ordering some and measuring what their bound lets through cost about the same
    if len(j) > k:
        some = np.where(i[:, None] == j[None, :few], np.inf, less[:, :few])
        bound = np.partition(some, k - 1, axis=1)[:, k - 1]
    slack = 1e-11 * (1 + (a * a).sum(1) + (b * b).sum(1).max())  # of rounding to 12 places and of the products
    row, at = np.nonzero(less <= np.where(np.isnan(bound), np.inf, bound + slack)[:, None])
    other = i[row] != j[at]
    row, at = row[other], at[other]
    d = np.empty(len(row))
    for lo in range(0, len(row), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        d[part] = ((a[row[part]] - b[at[part]]) ** 2).sum(axis=1)
    known = np.isfinite(d)
    row, at, d = row[known], at[known], d[known]
    order = np.lexsort((j[at], np.round(d, 12), row))
    row, at, d = row[order], at[order], d[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(a)))[row] < k
    return row[keep], at[keep], d[keep]


def nearest_k(left: DataFrame, right: DataFrame, key: str, k: int) -> DataFrame:
    """(id, other, d2, rank) of the k nearest, ties to the smaller id; a pair of blocks returns a list of k for each left row."""

    def best(i, a, j, b):
        row, at, d = nearest_pairs(i, a, j, b, k)
        cuts = np.searchsorted(row, np.arange(1, len(i)))
        return pd.DataFrame({"id": i, "other": np.split(j[at], cuts), "d2": np.split(d, cuts)})

    found = block_distances(left, right, key, best, "id long, other array<long>, d2 array<double>")
    each = F.transform(F.arrays_zip("d2", "other"), lambda x: F.struct(F.round(x["d2"], 12).alias("r"), x["other"].alias("other"), x["d2"].alias("d2")))
    lists = found.select("id", each.alias("n")).groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("n"))), 1, k).alias("n"))
    ranked = lists.select("id", F.posexplode("n").alias("rank", "n"))
    return ranked.select("id", "n.other", "n.d2", (F.col("rank") + 1).alias("rank"))


def _densities(test: DataFrame, sample: DataFrame, key: str, name: str) -> DataFrame:
    """Gaussian kernel density with full covariance and Scott's bandwidth, from sums over the sample."""
    moments = sample.select(F.posexplode("v").alias("i", "x"), "v").select("i", "x", F.posexplode("v").alias("j", "y"))
    rows = moments.groupBy("i", "j").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("xy")).collect()  # dimensions squared
    d, n = max(r["i"] for r in rows) + 1, rows[0]["n"]
    cov = np.zeros((d, d))
    for r in rows:
        cov[r["i"], r["j"]] = (r["xy"] - r["x"] * r["y"] / n) / (n - 1)
    cov = cov * n ** (-2 / (d + 4)) + 1e-12 * np.eye(d)
    white = np.linalg.cholesky(np.linalg.inv(cov))
    log_norm = 0.5 * (d * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1]) + np.log(n)

    def sums(i, a, j, b):
        e = -0.5 * squared(a @ white, b @ white)
        top = e.max(axis=1)
        return pd.DataFrame({"id": i, "top": top, "s": np.exp(e - top[:, None]).sum(axis=1)})

    found = block_distances(test, sample, key, sums, "id long, top double, s double")
    most = found.groupBy("id").agg(F.max("top").alias("m"))
    return found.join(most, "id").groupBy("id").agg((F.max("m") + F.log(F.sum(F.col("s") * F.exp(F.col("top") - F.col("m")))) - float(log_norm)).alias(name))


def kde_ratio(test: DataFrame, synth: DataFrame, reference: DataFrame, key: str, components: int | None = None) -> DataFrame:
    """(id, score): density under the synthetic rows over that under the reference ones; with components, each side in its own principal components."""
    if components is not None:
        test, synth, reference = (pca_scores(x, key, components) for x in (test, synth, reference))
    g, r = _densities(test, synth, key, "g"), _densities(test, reference, key, "r")
    return g.join(r, "id").select("id", (F.exp("g") / (F.exp("r") + 1e-10)).alias("score"))


def logan(test: DataFrame, synth: DataFrame, reference: DataFrame, key: str, steps: int | None = None, seed: int = 1) -> DataFrame:
    """(id, score): the raw synthetic-class output of a net of two layers of 256 that was told synthetic (1) from reference (0) rows.

    Steps follow the test rows, 300 passes over as many in batches of 256, unless stated. The net trains in single precision, as the original's.
    """
    side = lambda df, y: df.select(F.col(key).alias("_k"), "v", F.lit(y).alias("y"))
    d = len(synth.select("v").first()["v"])
    steps = int(300 * test.count() / 256) if steps is None else steps
    return score_net(test, train_net(side(synth, 1).unionByName(side(reference, 0)), "_k", d, steps, seed=seed, kind="float32"), key)


def pca_scores(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k principal components of centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = rows.select(key, array_to_vector("v").alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=False).fit(v).transform(v)
    return PCA(k=k, inputCol="features", outputCol="p").fit(centred).transform(centred).select(key, vector_to_array("p").alias("v"))


def align_labels(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """rows with the labels of their key; a key that isn't once on each side raises.

    Both sides go through one grouping: a join would let the optimizer drop a side's keys before they are counted.
    """
    rest = [[c for c in df.columns if c != key] for df in (rows, labels)]
    row, label = (F.struct(F.lit(True), *names).alias(name) for names, name in zip(rest, ("_row", "_label")))
    both = rows.select(key, row).unionByName(labels.select(key, label), allowMissingColumns=True)
    found = both.groupBy(key).agg(F.count("_row").alias("_m"), F.count("_label").alias("_n"), *(F.first(c, ignorenulls=True).alias(c) for c in ("_row", "_label")))
    wrong = (F.col("_m") != 1) | (F.col("_n") != 1)
    sound = found.where(F.when(wrong, F.raise_error("labels and rows differ").cast("boolean")).otherwise(True))
    return sound.select(key, *(F.col("_row")[c].alias(c) for c in rest[0]), *(F.col("_label")[c].alias(c) for c in rest[1]))


def save_predictions(scores: DataFrame, path: str) -> None:
    """Scores of one or more methods, a folder each; only the folders of these methods are replaced."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method").parquet(path)


def load_predictions(spark, path: str, method: str | None = None) -> DataFrame:
    """Saved scores; one method reads its own folder only."""
    found = spark.read.parquet(path)
    return found if method is None else found.where(F.col("method") == method)
