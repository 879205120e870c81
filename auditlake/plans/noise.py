"""Queries over sensitivities, noise scales, noisy models and factorisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import marginals, privacy, reports
from auditlake.plans.registry import query
from auditlake.sources.tables import table
from auditlake.sources.views import CELLS_SQL, EXPR_SQL, cells, dense, expr

_EXTENT = f"WITH {CELLS_SQL}, d AS (SELECT cell_type, donor_id, count(*) AS k FROM cells GROUP BY ALL), e AS (SELECT cell_type, sum(k)::BIGINT AS n, max(k) AS k_max, avg(k) AS k_mean FROM d GROUP BY 1)"
EPSILONS = [1.0, 10.0, 100.0, 10000.0, 1e9]


@query(_EXTENT + "SELECT cell_type, n, k_max, round(k_mean, 6) AS k_mean FROM e")
def donor_extent(spark, sf_dir):
    return privacy.donor_extent(cells(spark, sf_dir), ["cell_type"]).withColumn("k_mean", F.round("k_mean", 6))


@query(_EXTENT + """SELECT cell_type, variant, epsilon::DOUBLE AS epsilon, round(c * 9 * k_max / (n - k_max) * 32, 6)::DOUBLE AS delta_f, round(c * 9 * k_max / (n - k_max) * 32 * sqrt(2 * ln(1.25 / 1e-5)) / epsilon, 6)::DOUBLE AS sigma
FROM e, (VALUES ('v1', 4.0), ('v2', 1.0)) v(variant, c), (VALUES (1.0), (10.0), (100.0), (10000.0), (1e9)) p(epsilon) WHERE n > k_max""")
def dp_sigma_grid(spark, sf_dir):
    grid = privacy.sigma_grid(privacy.donor_extent(cells(spark, sf_dir), ["cell_type"]), 32, EPSILONS)
    return grid.select("cell_type", "variant", "epsilon", F.round("delta_f", 6).alias("delta_f"), F.round("sigma", 6).alias("sigma"))


@query(_EXTENT + "SELECT cell_type, round(4 * 9 * k_max / (n - k_max) * 32 * 32 / 10.0, 6)::DOUBLE AS scale FROM e")
def l1_noise_scale(spark, sf_dir):
    e = privacy.donor_extent(cells(spark, sf_dir), ["cell_type"])
    per_entry = privacy.frobenius_sensitivity(F.col("n"), F.col("k_max"), 1, 3.0)
    return e.select("cell_type", F.round(privacy.l1_scale(per_entry, 32, F.lit(10.0)), 6).alias("scale"))


@query("SELECT p_partkey, p_size::DOUBLE AS epsilon, round(p_size * 0.5 / 2.8, 6)::DOUBLE AS basis, round(p_size * 2.1 / 2.8, 6)::DOUBLE AS centroids, round(p_size * 0.2 / 2.8, 6)::DOUBLE AS summaries FROM part")
def budget_split(spark, sf_dir):
    e = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("epsilon"))
    parts = privacy.split_budget(F.col("epsilon"), {"basis": 0.5, "centroids": 2.1, "summaries": 0.2})
    return e.select("p_partkey", "epsilon", *(F.round(c, 6).alias(n) for n, c in parts.items()))


@query("""WITH u AS (SELECT l_orderkey, l_quantity AS s, ((l_orderkey * 31 + l_linenumber * 17) % 1000 + 0.5) / 1000 - 0.5 AS u FROM lineitem)
SELECT l_orderkey, count(*) AS n, round(sum(s - s * sign(u) * ln(1 - 2 * abs(u))), 4)::DOUBLE AS noised FROM u GROUP BY 1""")
def laplace_quantiles(spark, sf_dir):
    """Quantities with Laplace noise of their own scale, at places dealt by the keys, summed by order."""
    u = ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 1000 + 0.5) / 1000 - 0.5
    s = F.col("l_quantity").cast("double")
    noised = s + privacy.laplace(u, s)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum(noised), 4).alias("noised"))


def _copula(spark, sf_dir):
    d = dense(spark, sf_dir).where("role = 0")
    return marginals.gaussian_copula(d, marginals.moment_marginals(d, ["cell_type"]), ["cell_type"])


@query()
def noisy_correlations(spark, sf_dir):
    grid = privacy.sigma_grid(privacy.donor_extent(cells(spark, sf_dir).where("role = 0"), ["cell_type"]), 32, [100.0])
    return privacy.noisy_correlations(_copula(spark, sf_dir), grid.where("variant = 'v2'"), "cell_type")


@query("""WITH a AS (SELECT o_custkey, o_orderpriority AS variant, 0.5 + 0.4 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS auc FROM orders GROUP BY ALL),
b AS (SELECT o_custkey, max(auc) AS baseline FROM a GROUP BY 1) SELECT o_custkey, variant, round(CASE WHEN baseline > 0.5 THEN least(greatest((baseline - auc) / (baseline - 0.5) * 100, 0), 100) ELSE 0 END, 6) AS reduction FROM a JOIN b USING (o_custkey)""")
def privacy_reduction(spark, sf_dir):
    """A customer's orders of one priority stand for a variant, the share filled for its advantage; the best variant is the baseline."""
    share = F.count_if(F.col("o_orderstatus") == "F") / F.count("*")
    a = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("variant")).agg((0.5 + 0.4 * share).alias("auc"))
    both = a.join(a.groupBy("o_custkey").agg(F.max("auc").alias("baseline")), "o_custkey")
    return both.select("o_custkey", "variant", F.round(reports.privacy_reduction(F.col("auc"), F.col("baseline")), 6).alias("reduction"))


@query(f"WITH {EXPR_SQL} SELECT gene, count(*) AS n_cells, sum(cnt)::BIGINT AS total FROM expr GROUP BY 1")
def gene_catalogue(spark, sf_dir):
    """Genes that any cell has, with the cells that have them and their counts in all."""
    return expr(spark, sf_dir).groupBy("gene").agg(F.count("*").alias("n_cells"), F.sum("cnt").alias("total"))
