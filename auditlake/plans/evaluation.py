"""Queries over attackers' choices, masks set side by side, and models trained on one side and tested on the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import strings
from auditlake.operators import baselines, membership, metrics, prep
from auditlake.plans.audit import _QUAD_SQL, _quad
from auditlake.plans.registry import query
from auditlake.sources.tables import table
from auditlake.sources.views import CELLS_SQL, EXPR_SQL, cells, expr, vectors


def _parts(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return [v.where(F.col("part") == i) for i in range(3)]


@query(_QUAD_SQL + """, picked AS (SELECT quad.*, CASE WHEN donor_id % 3 = 0 THEN '0' ELSE '1' END || CASE WHEN donor_id % 2 = 0 THEN '0' ELSE '1' END || '0' AS code, donor_id % 5 < 3 AS b FROM quad)
SELECT cell_id, code, CASE WHEN b THEN 'b' ELSE 'standard' END || CASE WHEN code[2] = '0' THEN '_aux' ELSE '_alone' END AS attack,
round(CASE WHEN b AND code[2] = '0' THEN b_aux WHEN b THEN b_alone WHEN code[2] = '0' THEN standard_aux ELSE standard_alone END, 6) AS score FROM picked""")
def dispatched_scores(spark, sf_dir):
    """Each donor meets an attacker of its own knowledge; the score is the one that this calls for."""
    d = F.col("donor_id")
    q = _quad(spark, sf_dir).withColumn("code", strings.threat_code(d % 3 == 0, d % 2 == 0, F.lit(True)))
    return membership.dispatched(q, F.col("code"), d % 5 < 3).select("cell_id", "code", "attack", F.round("score", 6).alias("score"))


@query(f"WITH {EXPR_SQL} SELECT cell_id, sum(cnt)::BIGINT AS total, round(100.0::DOUBLE * sum(cnt) FILTER (WHERE gene % 8 = 3) / sum(cnt), 6) AS pct_counts_mt FROM expr GROUP BY 1 HAVING sum(cnt) FILTER (WHERE gene % 8 = 3) > 0")
def mitochondrial_share(spark, sf_dir):
    """Percent of each cell's counts in genes whose name says so, of the cells that have any; every eighth gene is named so."""
    name = F.concat(F.when(F.col("gene") % 8 == 3, "mt-").otherwise("G"), F.col("gene").cast("string"))
    out = prep.percent_of_counts(expr(spark, sf_dir), prep.mitochondrial(name)).where("pct_counts_mt > 0")
    return out.withColumn("pct_counts_mt", F.round("pct_counts_mt", 6))


def _mask_sql(name: str, role: int) -> str:
    return f"""t{role} AS (SELECT cell_id, sum(cnt) AS total FROM expr GROUP BY 1), n{role} AS (SELECT count(*) AS k FROM cells WHERE role = {role}),
s{role} AS (SELECT gene, sum(cnt * 1e4 / total) / any_value(k) AS m, sum((cnt * 1e4 / total) ** 2) AS s2, any_value(k) AS k FROM expr JOIN t{role} USING (cell_id) JOIN cells USING (cell_id), n{role} WHERE role = {role} GROUP BY 1),
d{role} AS (SELECT gene, ln(1 + m) AS mean, ln((s2 - k * m * m) / (k - 1) / m) AS disp FROM s{role}),
b{role} AS (SELECT *, least(floor((mean - min(mean) OVER ()) / ((max(mean) OVER () - min(mean) OVER ()) / 20)), 19)::INT AS bin FROM d{role}),
z{role} AS (SELECT gene, round(CASE WHEN count(*) OVER (PARTITION BY bin) = 1 THEN 1.0 ELSE (disp - avg(disp) OVER (PARTITION BY bin)) / stddev_samp(disp) OVER (PARTITION BY bin) END, 9) AS z FROM b{role}),
{name} AS (SELECT gene FROM z{role} WHERE z >= (SELECT min(z) FROM (SELECT z FROM z{role} WHERE z IS NOT NULL ORDER BY z DESC LIMIT 10)))"""


@query(f"""WITH {CELLS_SQL}, {EXPR_SQL}, {_mask_sql("old", 0)}, {_mask_sql("new", 1)},
c AS (SELECT count(old.gene) AS n_old, count(new.gene) AS n_new, count(*) FILTER (WHERE old.gene IS NOT NULL AND new.gene IS NOT NULL) AS n_overlap, count(*) AS n FROM old FULL JOIN new ON old.gene = new.gene)
SELECT n_old, n_new, n_overlap, n_old - n_overlap AS only_old, n_new - n_overlap AS only_new, round(n_overlap / n, 9) AS jaccard FROM c""")
def mask_overlap(spark, sf_dir):
    """Informative genes of training and holdout cells: what both chose, and what one alone did."""
    c = cells(spark, sf_dir)

    def mask(role):
        part = c.where(F.col("role") == role).select("cell_id")
        return prep.hvg_top(prep.gene_dispersion(prep.normalize_total(expr(spark, sf_dir).join(part, "cell_id", "left_semi")), part.count()), 10)

    return metrics.mask_overlap(mask(1), mask(0)).withColumn("jaccard", F.round("jaccard", 9))


@query()
def synthetic_against_real_training(spark, sf_dir):
    """Accuracy and macro average precision on unseen real vectors, of a model trained on synthetic ones and of one trained on real ones."""
    test, synth, real = _parts(spark, sf_dir)
    named = lambda df, side: metrics.train_synthetic_test_real(df, test, "label").select(F.lit(side).alias("trained_on"), "*")
    return named(synth, "synthetic").unionByName(named(real, "real"))


@query()
def mmd_principal(spark, sf_dir):
    """Squared discrepancy in fifty shared principal components; the bandwidth is a median over 1000 vectors of smallest hash."""
    v = vectors(spark, sf_dir).where("part < 2")
    shared = baselines.pca_scores(v, "vec_id", 50).join(v.select("vec_id", "part"), "vec_id")
    sample = shared.orderBy(F.xxhash64("vec_id"), "vec_id").limit(1000)
    gamma = metrics.median_gamma(sample, "vec_id")
    return metrics.mmd(shared.where("part = 0"), shared.where("part = 1"), "vec_id", gamma).select(F.lit(gamma).alias("gamma"), "mmd")


@query()
def kde_ratio_components(spark, sf_dir):
    """Density ratios after each side was brought to its own principal components."""
    return baselines.kde_ratio(*_parts(spark, sf_dir), "vec_id", components=20)


@query("""WITH o AS (SELECT o_custkey AS donor_id, o_orderpriority AS kind, avg(o_totalprice) AS score, max((o_custkey % 3 = 0)::INT) AS member FROM orders GROUP BY ALL),
g AS (SELECT o.*, w.w AS weight, round(score * w.w + 1000 * (donor_id % 7), 6) AS x FROM o, (VALUES (0.0::DOUBLE), (0.25), (1.0)) w(w)),
r AS (SELECT *, rank() OVER (PARTITION BY kind, weight ORDER BY x) + (count(*) OVER (PARTITION BY kind, weight, x) - 1) / 2 AS r FROM g)
SELECT kind, weight::DOUBLE AS weight, round((sum(r) FILTER (WHERE member = 1) - sum(member) * (sum(member) + 1) / 2) / (sum(member) * sum(1 - member)), 6) AS auc FROM r GROUP BY ALL""")
def weighted_auc_grid(spark, sf_dir):
    """AUC of a weighted score for every type and weight, ranked by ranges across all groups at once."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("donor_id"), F.col("o_orderpriority").alias("kind")).agg(F.avg("o_totalprice").alias("score"))
    g = o.withColumn("member", (F.col("donor_id") % 3 == 0).cast("int")).withColumn("weight", F.explode(F.array(F.lit(0.0), F.lit(0.25), F.lit(1.0))))
    g = g.withColumn("x", F.round(F.col("score") * F.col("weight") + 1000 * (F.col("donor_id") % 7), 6))
    return metrics.roc_auc(g, "member", "x", ["kind", "weight"]).select("kind", "weight", F.round("auc", 6).alias("auc"))
