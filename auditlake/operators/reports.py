"""Summaries over trials, coverage of planned work, subgroup breakdowns and report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.strings import mean_std, strip_zero
from auditlake.operators.metrics import roc_auc


def trial_summary(results: DataFrame, by: list[str], value: str, sample: bool, planned: int | None = None) -> DataFrame:
    """Mean and deviation over trials (sample or population), count, and a star where trials are missing."""
    std = F.stddev_samp(value) if sample else F.stddev_pop(value)
    out = results.groupBy(*by).agg(F.avg(value).alias("mean"), std.alias("std"), F.count(value).alias("n"))
    star = F.lit("") if planned is None else F.when(F.col("n") < planned, "*").otherwise("")
    return out.withColumn("label", F.concat(mean_std(F.col("mean"), F.col("std")), star))


def delta_to_baseline(results: DataFrame, by: str, value: str, baseline: str) -> DataFrame:
    """Mean by variant and its distance to the baseline's."""
    means = results.groupBy(by).agg(F.avg(value).alias("mean"))
    base = means.where(F.col(by) == baseline).select(F.col("mean").alias("_b"))
    return means.crossJoin(F.broadcast(base)).withColumn("delta", F.col("mean") - F.col("_b")).drop("_b")


def with_average_row(detail: DataFrame, key: str, values: list[str]) -> DataFrame:
    average = detail.agg(*(F.avg(v).alias(v) for v in values)).select(F.lit("average").alias(key), *values)
    return detail.select(F.col(key).cast("string").alias(key), *(F.col(v).cast("double").alias(v) for v in values)).unionByName(average)


def pivot_results(results: DataFrame, rows: list[str], column: str, columns: list, value: str) -> DataFrame:
    return results.groupBy(*rows).pivot(column, columns).agg(F.first(value))


def coverage(wanted: DataFrame, done: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Wanted, done and missing units by group; done has a boolean fresh."""
    state = wanted.join(done.select(*keys, "fresh").dropDuplicates(keys), keys, "left")
    return state.groupBy(*by).agg(F.count("*").alias("wanted"), F.count_if("fresh").alias("fresh"), F.count_if(~F.col("fresh")).alias("stale"), F.count_if(F.col("fresh").isNull()).alias("missing"))


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(done, keys, "left_anti")


def first_incomplete(tracking: DataFrame, by: list[str], flag: str) -> DataFrame:
    return tracking.groupBy(*by).agg(F.min(F.when(F.col(flag) == 0, F.col("trial"))).alias("trial"))


def value_share(rows: DataFrame, key: str) -> DataFrame:
    """Counts and shares of values, nulls among them."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def bin_counts(rows: DataFrame, label: str, n: int) -> DataFrame:
    """Counts of labels 0..n-1, zeros filled in."""
    counts = rows.groupBy(F.col(label).cast("long").alias("id")).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(n).join(counts, "id", "left").select(F.col("id").cast("int").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def attach_subgroup(donors: DataFrame, subgroups: DataFrame, column: str) -> DataFrame:
    """Donors with their subgroup; donors without one go."""
    return donors.join(subgroups.dropDuplicates(["donor_id"]), "donor_id", "left").na.drop(subset=[column])


def subgroup_metrics(donors: DataFrame, by: str, least: int = 1) -> DataFrame:
    """AUC, mean score of all, members and others, and their gap; groups with fewer than `least` of a class have no AUC."""
    means = donors.groupBy(by).agg(F.avg("score").alias("mean_score"), F.avg(F.when(F.col("member") == 1, F.col("score"))).alias("member_mean"), F.avg(F.when(F.col("member") == 0, F.col("score"))).alias("other_mean"), F.count("*").alias("n"))
    auc = roc_auc(donors, "member", "score", [by])
    auc = auc.withColumn("auc", F.when((F.col("n_pos") >= least) & (F.col("n_neg") >= least), F.col("auc"))).select(by, "auc")
    return means.join(auc, by).withColumn("score_gap", F.col("member_mean") - F.col("other_mean"))


def top_n(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def privacy_reduction(auc: Column, baseline: Column) -> Column:
    """Percent of the baseline's advantage over chance that is gone, 0 to 100."""
    return F.least(F.greatest(F.try_divide(baseline - auc, baseline - 0.5) * 100, F.lit(0.0)), F.lit(100.0))


def compare_metrics(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Absolute and relative difference of a metric in two runs."""
    both = a.select(*keys, F.col(value).alias("old")).join(b.select(*keys, F.col(value).alias("new")), keys)
    return both.withColumns({"delta": F.col("new") - F.col("old"), "relative": F.try_divide(F.col("new") - F.col("old"), F.abs("old"))})


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One line of a table a row."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.col(c).cast("string") for c in columns)), F.lit(" |")).alias("line"))


def containing(rows: DataFrame, parts: dict[str, str | None]) -> DataFrame:
    """Rows whose columns hold the given substrings; None asks for nothing."""
    for column, part in parts.items():
        rows = rows if part is None else rows.where(F.col(column).contains(part))
    return rows


def paired_variants(results: DataFrame, metrics: list[str], prefix: str = "v2_") -> DataFrame:
    """Metrics of two generations of variants ('no_dp', 'eps_N', and the same with a prefix) at each epsilon both have.

    One row an epsilon and metric: mean, population deviation and count over trials on each side, without NaN.
    Both sides are sums over one grouping, so that nothing is joined.
    """
    bare = F.regexp_replace("variant", f"^{prefix}", "")
    epsilon = F.when(bare == "no_dp", float("inf")).otherwise(F.regexp_extract(bare, r"^eps_(\d+)$", 1).try_cast("double"))
    side = F.when(F.col("variant").startswith(prefix), "new").otherwise("old")
    long = results.select(side.alias("side"), epsilon.alias("epsilon"), *(F.col(m).cast("double").alias(m) for m in metrics)).where("epsilon is not null").unpivot(["side", "epsilon"], metrics, "metric", "x")
    stats, seen = [], []
    for s in ("old", "new"):
        x = F.when((F.col("side") == s) & ~F.isnan("x"), F.col("x"))
        stats += [F.avg(x).alias(f"{s}_mean"), F.stddev_pop(x).alias(f"{s}_std"), F.count(x).alias(f"{s}_n")]
        seen.append(F.count_if(F.col("side") == s).alias(f"_{s}"))
    both = long.groupBy("epsilon", "metric").agg(*stats, *seen).where("_old > 0 and _new > 0").drop("_old", "_new")
    return both.withColumn("label", F.when(F.col("epsilon") == float("inf"), "∞ (no DP)").otherwise(F.format_number("epsilon", 0)))


def table_cell(mean: Column, std: Column, n: Column, planned: int, digits: int = 2) -> Column:
    """'.87±.02', the count behind a caret where trials are missing, '---' without any."""
    text = F.concat(strip_zero(F.format_string(f"%.{digits}f", mean)), F.lit("±"), strip_zero(F.format_string(f"%.{digits}f", F.coalesce(std, F.lit(0.0)))))
    return F.when(n == 0, "---").otherwise(F.concat(text, F.when(n < planned, F.concat(F.lit("^"), n.cast("string"))).otherwise("")))


def combined_table(fidelity: DataFrame, privacy: DataFrame, by: list[str], scales: dict[str, float], codes: list[str], planned: int) -> DataFrame:
    """Fidelity metrics (columns, scaled) and AUCs by threat model (rows tm, auc) side by side as table cells, with eta = 100 / epsilon."""

    def cell(x: Column, name: str) -> Column:
        x = F.when(~F.isnan(x), x)
        return table_cell(F.avg(x), F.stddev_samp(x), F.count(x), planned).alias(name)

    left = fidelity.groupBy(*by, "epsilon").agg(*(cell(F.col(m) * scale, m) for m, scale in scales.items()))
    right = privacy.groupBy(*by, "epsilon").agg(*(cell(F.when(F.col("tm") == c, F.col("auc")), f"auc_{c}") for c in codes))
    return left.join(right, [*by, "epsilon"]).withColumn("eta", 100 / F.col("epsilon")).drop("epsilon")


def sweep_summary(runs: DataFrame, baseline: DataFrame, by: str) -> DataFrame:
    """by, epsilon with mean and deviation of auc over seeds, its difference from the baseline run, and the percent of its advantage that is gone."""
    each = runs.groupBy(by, "epsilon").agg(F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_std"), F.count("auc").alias("n_seeds"))
    met = each.join(baseline.select(by, F.col("auc").alias("baseline_auc")), by)
    return met.withColumns({"auc_vs_baseline": F.col("auc_mean") - F.col("baseline_auc"), "privacy_reduction_pct": privacy_reduction(F.col("auc_mean"), F.col("baseline_auc"))})
