"""Noise for fitted correlations: sensitivities, scales, calibrated noise, and budget splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.marginals import project_psd, to_correlation

# Sensitivity constants of the two estimators.
CONSTANT = {"v1": 4.0, "v2": 1.0}


def donor_extent(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells of each type, and the most and mean of one donor."""
    per = cells.groupBy(*by, "donor_id").agg(F.count("*").alias("k"))
    return per.groupBy(*by).agg(F.sum("k").alias("n"), F.max("k").alias("k_max"), F.avg("k").alias("k_mean"))


def frobenius_sensitivity(n: Column, k: Column, g: Column | int, clip: float, variant: str = "v1") -> Column:
    if variant not in CONSTANT:
        raise ValueError(f"unknown variant {variant}")
    value = F.lit(CONSTANT[variant] * clip * clip) * k / (n - k) * g
    return F.when(n > k, value).otherwise(F.raise_error("sensitivity needs more cells than one donor has").cast("double"))


def gaussian_sigma(sensitivity: Column, epsilon: Column, delta: float) -> Column:
    if not 0 < delta < 1:
        raise ValueError("delta must be between 0 and 1")
    return F.when(epsilon > 0, sensitivity * float(np.sqrt(2 * np.log(1.25 / delta))) / epsilon).otherwise(F.raise_error("epsilon must be positive").cast("double"))


def l1_scale(per_entry: Column, g: Column | int, epsilon: Column) -> Column:
    return per_entry * g * g / epsilon


def sigma_grid(extent: DataFrame, g: int, epsilons: list[float], clip: float = 3.0, delta: float = 1e-5) -> DataFrame:
    """A row for each type, variant and epsilon; types where no sensitivity exists are left out."""
    grid = extent.where("n > 0 and k_max > 0 and n > k_max").withColumn("epsilon", F.explode(F.array(*map(F.lit, epsilons)))).withColumn("variant", F.explode(F.array(*map(F.lit, CONSTANT))))
    c = F.when(F.col("variant") == "v1", CONSTANT["v1"]).otherwise(CONSTANT["v2"])
    grid = grid.withColumn("delta_f", c * clip * clip * F.col("k_max") / (F.col("n") - F.col("k_max")) * g)
    return grid.withColumn("sigma", gaussian_sigma(F.col("delta_f"), F.col("epsilon"), delta))


def split_budget(epsilon: Column, shares: dict[str, float]) -> dict[str, Column]:
    total = sum(shares.values())
    return {name: epsilon * (x / total) for name, x in shares.items()}


def laplace(u: Column, scale: Column) -> Column:
    """A draw for u uniform on (-1/2, 1/2)."""
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))


def noisy_correlations(corr: DataFrame, sigma: DataFrame, by: str, clip: bool = True, seed: int = 1) -> DataFrame:
    """Symmetric Gaussian noise on each group's matrix (gi <= gj), then the nearest positive matrix brought back to correlations.

    A group's matrix is genes squared, the same for any number of cells. clip=False leaves the noise as it is.
    """
    kind = dict(corr.dtypes)[by]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["gi"], *pdf["gj"]})
        at = {g: i for i, g in enumerate(names)}
        m = np.eye(len(names))
        i, j = pdf["gi"].map(at).to_numpy(), pdf["gj"].map(at).to_numpy()
        m[i, j] = m[j, i] = pdf["r"].fillna(0.0).to_numpy()
        e = np.random.default_rng([seed, *str(key[0]).encode()]).normal(0, pdf["sigma"].iloc[0], m.shape)
        m = m + (e + e.T) / 2
        m = to_correlation(project_psd(m)) if clip else m
        return pd.DataFrame({by: key[0], "gi": pdf["gi"], "gj": pdf["gj"], "r": m[i, j]})

    return corr.join(sigma.select(by, "sigma"), by).groupBy(by).applyInPandas(run, f"{by} {kind}, gi int, gj int, r double")


def noisy_jobs(corr: DataFrame, sigma: DataFrame, by: str, seeds: list[int], clip: bool = True) -> DataFrame:
    """(by, epsilon, seed, gi, gj, r): each group's matrix under every epsilon of sigma (by, epsilon, sigma) and every seed, in one plan."""
    jobs = sigma.select(by, "epsilon", "sigma", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    jobs = jobs.withColumn("_job", F.concat_ws("|", F.col(by).cast("string"), F.col("epsilon").cast("string"), F.col("seed").cast("string")))
    noised = noisy_correlations(corr.join(jobs.select(by, "_job"), by).select("_job", "gi", "gj", "r"), jobs.select("_job", "sigma"), "_job", clip)
    return noised.join(jobs.select("_job", by, "epsilon", "seed"), "_job").drop("_job")
