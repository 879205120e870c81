"""Quality filters, normalisation and selection of informative genes, over long counts (cell_id, gene, cnt) without zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_cells(expr: DataFrame, min_counts: int | None = None, max_counts: int | None = None, min_genes: int | None = None) -> DataFrame:
    """Cells by total count (from min_counts, below max_counts) and by genes seen."""
    sums = expr.groupBy("cell_id").agg(F.sum("cnt").alias("total"), F.count_if(F.col("cnt") > 0).alias("seen"))
    keep = F.lit(True)
    keep = keep if min_counts is None else keep & (F.col("total") >= min_counts)
    keep = keep if max_counts is None else keep & (F.col("total") < max_counts)
    keep = keep if min_genes is None else keep & (F.col("seen") >= min_genes)
    return expr.join(sums.where(keep).select("cell_id"), "cell_id", "left_semi")


def filter_genes(expr: DataFrame, min_cells: int) -> DataFrame:
    seen = expr.where("cnt > 0").groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") >= min_cells)
    return expr.join(seen, "gene", "left_semi").select(expr.columns)


def mitochondrial(gene_name: Column) -> Column:
    """Whether a gene's name starts with MT-, in either case."""
    return F.upper(gene_name).startswith("MT-")


def percent_of_counts(expr: DataFrame, flagged: Column, name: str = "pct_counts_mt") -> DataFrame:
    """cell_id, total, name: percent of a cell's counts that flagged genes hold; null for a cell without counts."""
    sums = expr.groupBy("cell_id").agg(F.sum("cnt").alias("total"), F.coalesce(F.sum(F.when(flagged, F.col("cnt"))), F.lit(0)).alias("_mt"))
    return sums.select("cell_id", "total", F.try_divide(100.0 * F.col("_mt"), F.col("total")).alias(name))


def normalize_total(expr: DataFrame, target: float = 1e4) -> DataFrame:
    """norm = cnt scaled to a total of `target` a cell, lognorm = log1p of it."""
    sums = expr.groupBy("cell_id").agg(F.sum("cnt").alias("_total"))
    scaled = expr.join(sums, "cell_id").withColumn("norm", F.try_divide(F.col("cnt") * F.lit(target), F.col("_total")))
    return scaled.withColumn("lognorm", F.log1p("norm")).drop("_total")


def gene_dispersion(scaled: DataFrame, n_cells: int, bins: int = 20) -> DataFrame:
    """Mean, dispersion and its z-score within bins of the mean, zeros counted: the 'seurat' flavour.

    Bins are of equal width over the log means; a bin of one gene has no deviation, and that gene's score is 1.
    """
    stats = scaled.groupBy("gene").agg((F.sum("norm") / n_cells).alias("m"), F.sum(F.col("norm") * F.col("norm")).alias("s2"))
    var = (F.col("s2") - n_cells * F.col("m") * F.col("m")) / (n_cells - 1)
    stats = stats.where("m > 0").withColumn("disp", F.log(F.when(var > 0, var / F.col("m")))).withColumn("mean", F.log1p("m"))
    ends = stats.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = stats.crossJoin(F.broadcast(ends)).withColumn("bin", F.coalesce(F.least(F.floor(F.try_divide(F.col("mean") - F.col("lo"), width)), F.lit(bins - 1)), F.lit(0)).cast("int"))
    by = Window.partitionBy("bin")  # genes, not cells: a few thousand rows
    z = F.when(F.count("disp").over(by) == 1, 1.0).otherwise(F.try_divide(F.col("disp") - F.avg("disp").over(by), F.stddev_samp("disp").over(by)))
    return binned.select("gene", "mean", "disp", "bin", z.alias("disp_norm"))


def hvg_cutoff(dispersion: DataFrame, min_mean: float = 0.0125, max_mean: float = 3.0, min_disp: float = 0.5) -> DataFrame:
    chosen = (F.col("mean") > min_mean) & (F.col("mean") < max_mean) & (F.col("disp_norm") > min_disp)
    return dispersion.withColumn("highly_variable", F.coalesce(chosen, F.lit(False)))


def hvg_top(dispersion: DataFrame, n: int) -> DataFrame:
    """All genes at least as dispersed as the n-th, to nine decimals; ties may exceed n."""
    dispersion = dispersion.withColumn("disp_norm", F.round("disp_norm", 9))
    cut = dispersion.where("disp_norm is not null").orderBy(F.desc("disp_norm")).limit(n).agg(F.min("disp_norm").alias("cut"))
    return dispersion.crossJoin(F.broadcast(cut)).withColumn("highly_variable", F.coalesce(F.col("disp_norm") >= F.col("cut"), F.lit(False))).drop("cut")


def hvg_or_all(flagged: DataFrame, least: int = 10) -> DataFrame:
    """All genes if fewer than `least` were chosen."""
    n = flagged.agg(F.count_if("highly_variable").alias("_n"))
    return flagged.crossJoin(F.broadcast(n)).withColumn("highly_variable", F.col("highly_variable") | (F.col("_n") < least)).drop("_n")


def realign_mask(mask: DataFrame, present: DataFrame) -> DataFrame:
    """The mask over the genes that are present; those it lacks are false."""
    return present.select("gene").join(mask.select("gene", "highly_variable"), "gene", "left").withColumn("highly_variable", F.coalesce("highly_variable", F.lit(False)))


def zero_groups(dense: DataFrame, by: list[str], cutoff: float = 0.8, least: int = 2) -> DataFrame:
    """Zero share and group of each gene: primary below the cutoff, secondary while at least `least` cells aren't zero, else dropped."""
    stats = dense.groupBy(*by, "gene").agg((F.count_if(F.col("cnt") == 0) / F.count("*")).alias("zero"), F.count("*").alias("n"))
    group = F.when(F.col("zero") < cutoff, "primary").when(F.col("zero") < 1 - least / F.col("n"), "secondary").otherwise("dropped")
    return stats.withColumn("grp", group)


def invalid_counts(df: DataFrame, value: Column) -> DataFrame:
    """How many values are NaN, infinite or null."""
    return df.agg(F.count_if(F.isnan(value)).alias("nan"), F.count_if(F.abs(value) == float("inf")).alias("infinite"), F.count_if(value.isNull()).alias("missing"))


def require_finite(df: DataFrame, value: Column) -> DataFrame:
    """df; a value that isn't finite raises when it is read."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return df.where(F.when(bad, F.raise_error("a value isn't finite").cast("boolean")).otherwise(True))


def joined_batches(batches: dict[str, DataFrame]) -> DataFrame:
    """Counts of several sets in one table with a batch column, only of genes that every set has."""
    seen = [df.select("gene").distinct() for df in batches.values()]
    shared = seen[0]
    for other in seen[1:]:
        shared = shared.join(other, "gene", "left_semi")
    named = [df.select(F.lit(name).alias("batch"), "cell_id", "gene", "cnt") for name, df in batches.items()]
    rows = named[0]
    for other in named[1:]:
        rows = rows.unionByName(other)
    return rows.join(F.broadcast(shared), "gene", "left_semi").select("batch", "cell_id", "gene", "cnt")  # genes, some ten thousand


def scale_clipped(rows: DataFrame, value: str, most: float = 10.0) -> DataFrame:
    """scaled: z of a gene's values (sample deviation; a constant gene keeps 0), at most `most`."""
    stats = rows.groupBy("gene").agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = (F.col(value) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return rows.join(stats, "gene").withColumn("scaled", F.least(z, F.lit(most))).drop("_m", "_s")
