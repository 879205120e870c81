"""Batch adjustment of vectors: location and scale by gene and batch, shrunk by empirical Bayes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shrunk(n: np.ndarray, gamma: np.ndarray, delta: np.ndarray, tolerance: float = 1e-4, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """One batch's locations and scales, drawn to their distribution over genes.

    gamma and delta are the batch's means and sample variances of standardised values, n its rows. Sums of squares around
    any location follow from these, so the iteration never goes back to the rows.
    """
    g_bar, t2 = gamma.mean(), gamma.var(ddof=1) if len(gamma) > 1 else 0.0
    m, s2 = delta.mean(), delta.var(ddof=1) if len(delta) > 1 else 0.0
    if t2 <= 0 or s2 <= 0:
        return gamma, delta
    a, b = (2 * s2 + m * m) / s2, (m * s2 + m**3) / s2
    g, d = gamma.copy(), delta.copy()
    for _ in range(steps):
        g_new = (t2 * n * gamma + d * g_bar) / (t2 * n + d)
        squares = (n - 1) * delta + n * (gamma - g_new) ** 2
        d_new = (0.5 * squares + b) / (n / 2 + a - 1)
        moved = max(np.abs(g_new - g).max() / max(np.abs(g).max(), 1e-12), np.abs(d_new - d).max() / max(np.abs(d).max(), 1e-12))
        g, d = g_new, d_new
        if moved < tolerance:
            break
    return g, d


def batch_effects(rows: DataFrame, batch: str, vector: str = "v", empirical_bayes: bool = True) -> DataFrame:
    """batch, gene, slope, shift: what takes a value to the common location and scale, as slope * value + shift.

    Means and variances by gene and batch are one aggregation over the rows; what follows is genes x batches numbers. Genes without
    spread inside batches stay as they are, and so do batches of one row in scale.
    """
    long = rows.select(F.col(batch).alias("batch"), F.posexplode(vector).alias("gene", "x"))
    each = long.groupBy("gene", "batch").agg(F.count("*").cast("double").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    whole = each.groupBy("gene").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), (F.sum(F.col("n") * F.col("var")) / F.sum("n")).alias("pooled"))
    spread = F.sqrt(F.when(F.col("pooled") > 0, F.col("pooled")).otherwise(1.0))
    met = each.join(whole, "gene").withColumn("sd", spread).select(
        "batch", "gene", "n", "grand", "sd", "pooled",
        ((F.col("mean") - F.col("grand")) / F.col("sd")).alias("gamma"),
        (F.col("var") * F.try_divide(F.col("n"), F.col("n") - 1) / (F.col("sd") * F.col("sd"))).alias("delta"),
    )

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        live = ((pdf["pooled"] > 0) & pdf["delta"].notna() & (pdf["delta"] > 0)).to_numpy()
        g, d = pdf["gamma"].to_numpy(float).copy(), np.where(live, pdf["delta"].fillna(1.0), 1.0)
        g[~(pdf["pooled"] > 0).to_numpy()] = 0.0
        if empirical_bayes and live.sum() > 1:
            g[live], d[live] = shrunk(pdf["n"].to_numpy(float)[live], g[live], d[live])
        sd, grand = pdf["sd"].to_numpy(float), pdf["grand"].to_numpy(float)
        slope = 1 / np.sqrt(d)
        return pd.DataFrame({"batch": pdf["batch"], "gene": pdf["gene"], "slope": slope, "shift": grand - slope * grand - sd * g * slope})

    kind = dict(rows.dtypes)[batch]
    return met.groupBy("batch").applyInPandas(solved, f"batch {kind}, gene int, slope double, shift double")


def adjust_batches(rows: DataFrame, batch: str, vector: str = "v", empirical_bayes: bool = True) -> DataFrame:
    """rows with their vectors brought to the batches' common location and scale; a null batch is one of its own."""
    effects = batch_effects(rows, batch, vector, empirical_bayes)
    lists = effects.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("gene", "slope", "shift"))).alias("_e")).withColumnRenamed("batch", "_b")
    met = rows.join(lists, F.col(batch).eqNullSafe(F.col("_b")))  # a row a batch
    return met.withColumn(vector, F.zip_with(vector, "_e", lambda x, e: e["slope"] * x + e["shift"])).drop("_b", "_e")
