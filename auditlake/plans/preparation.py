"""Queries over cleaning, quality filters, normalisation, splits and marginals."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions import strings
from auditlake.functions.distributions import nudged_transform, qnorm, zinb_cdf, zinb_cdf_dt, zinb_log_pmf, zinb_uniform
from auditlake.operators import marginals, prep, splits
from auditlake.plans.registry import query
from auditlake.sources.tables import conform, table
from auditlake.sources.views import CELLS_SQL, DENSE_SQL, EXPR_SQL, cells, dense, expr, profile, vectors


@query("""SELECT p_partkey, translate(p_name, ' ,/:', '____') AS name, regexp_replace(p_brand, '#', '', 'g') AS brand FROM part""")
def clean_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", strings.clean_name(F.col("p_name")).alias("name"), F.regexp_replace("p_brand", "#", "").alias("brand"))


@query("""
WITH stages AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN (20 + c_custkey % 60)::VARCHAR || '-Year-Old human stage'
  WHEN 1 THEN (c_custkey % 90)::VARCHAR || ' year old' WHEN 2 THEN (c_custkey % 70)::VARCHAR || '.5' ELSE 'unknown' END AS raw FROM customer)
SELECT c_custkey, raw AS age_raw, CASE WHEN regexp_extract(raw, '(\\d+)[-\\s]year[-\\s]old', 1, 'i') <> ''
  THEN TRY_CAST(regexp_extract(raw, '(\\d+)[-\\s]year[-\\s]old', 1, 'i') AS INT) ELSE trunc(TRY_CAST(raw AS DOUBLE))::INT END AS age_years FROM stages""")
def clean_age(spark, sf_dir):
    k = F.col("c_custkey")
    raw = (
        F.when(k % 4 == 0, F.concat((k % 60 + 20).cast("string"), F.lit("-Year-Old human stage")))
        .when(k % 4 == 1, F.concat((k % 90).cast("string"), F.lit(" year old")))
        .when(k % 4 == 2, F.concat((k % 70).cast("string"), F.lit(".5")))
        .otherwise("unknown")
    )
    return table(spark, sf_dir, "customer").select("c_custkey", raw.alias("age_raw")).withColumn("age_years", strings.age_years(F.col("age_raw")))


OBS = T.StructType([T.StructField(n, t) for n, t in (("cell_id", T.LongType()), ("individual", T.StringType()), ("cell_type", T.StringType()), ("ethnicity", T.StringType()), ("age", T.IntegerType()))])


@query("""SELECT o_orderkey AS cell_id, o_custkey::VARCHAR AS individual, o_orderpriority AS cell_type, o_orderstatus AS ethnicity, NULL::INT AS age FROM orders""")
def conform_schema(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "donor_id", "o_orderstatus": "self_reported_ethnicity", "o_orderpriority": "cell_type", "o_orderkey": "cell_id"})
    return conform(raw, OBS, {"donor_id": "individual", "self_reported_ethnicity": "ethnicity", "development_stage": "age"})


@query("SELECT DISTINCT o_orderpriority AS cell_type FROM orders")
def metadata_only_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cell_type")).distinct()


@query(f"WITH {CELLS_SQL} SELECT cell_id, donor_id, role FROM cells WHERE cell_type = '1-URGENT' AND role IN (0, 1)")
def type_slice_scan(spark, sf_dir):
    return cells(spark, sf_dir).where("cell_type = '1-URGENT' and role in (0, 1)").select("cell_id", "donor_id", "role")


@query("""SELECT n_name AS sample, r_name AS feature, (CASE WHEN n_regionkey = r_regionkey THEN 1 ELSE 0 END)::DOUBLE AS value FROM nation CROSS JOIN region""")
def transposed_matrix(spark, sf_dir):
    """A nations-by-regions indicator matrix, unpivoted as a features-by-samples file would be."""
    names = [r["r_name"] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    wide = nation.groupBy("n_name").pivot("r_name", names).agg(F.count(F.lit(1)))
    return wide.unpivot("n_name", names, "feature", "value").select(F.col("n_name").alias("sample"), "feature", F.coalesce("value", F.lit(0)).cast("double").alias("value"))


@query(f"""WITH {EXPR_SQL}, c AS (SELECT cell_id FROM expr GROUP BY 1 HAVING sum(cnt) >= 10), e AS (SELECT * FROM expr SEMI JOIN c USING (cell_id)),
g AS (SELECT gene FROM e WHERE cnt > 0 GROUP BY 1 HAVING count(*) >= 3) SELECT cell_id, gene, cnt FROM e SEMI JOIN g USING (gene)""")
def qc_cells_then_genes(spark, sf_dir):
    return prep.filter_genes(prep.filter_cells(expr(spark, sf_dir), min_counts=10), 3).select("cell_id", "gene", "cnt")


@query(f"""WITH {EXPR_SQL}, g AS (SELECT gene FROM expr WHERE cnt > 0 GROUP BY 1 HAVING count(*) >= 3), e AS (SELECT * FROM expr SEMI JOIN g USING (gene)),
c AS (SELECT cell_id FROM e GROUP BY 1 HAVING sum(cnt) > 10 AND sum(cnt) < 200) SELECT cell_id, count(*) AS n_genes, sum(cnt)::BIGINT AS total FROM e SEMI JOIN c USING (cell_id) GROUP BY 1""")
def qc_genes_then_counts(spark, sf_dir):
    kept = prep.filter_cells(prep.filter_genes(expr(spark, sf_dir), 3), min_counts=11, max_counts=200)
    return kept.groupBy("cell_id").agg(F.count("*").alias("n_genes"), F.sum("cnt").alias("total"))


@query(f"""WITH {EXPR_SQL}, g AS (SELECT gene FROM expr WHERE cnt > 0 GROUP BY 1 HAVING count(*) >= 3), e AS (SELECT * FROM expr SEMI JOIN g USING (gene)),
c AS (SELECT cell_id FROM e GROUP BY 1 HAVING count(*) >= 4) SELECT gene, count(*) AS n_cells FROM e SEMI JOIN c USING (cell_id) GROUP BY 1""")
def qc_genes_then_cells(spark, sf_dir):
    return prep.filter_cells(prep.filter_genes(expr(spark, sf_dir), 3), min_genes=4).groupBy("gene").agg(F.count("*").alias("n_cells"))


@query(f"""WITH {DENSE_SQL}, s AS (SELECT cell_type, gene, count(*) FILTER (WHERE cnt = 0) / count(*) AS zero, count(*) AS n FROM dense GROUP BY ALL)
SELECT cell_type, gene, round(zero, 9) AS zero, n, CASE WHEN zero < 0.88 THEN 'primary' WHEN zero < 1 - 2 / n THEN 'secondary' ELSE 'dropped' END AS grp FROM s""")
def zero_fraction_groups(spark, sf_dir):
    return prep.zero_groups(dense(spark, sf_dir), ["cell_type"], cutoff=0.88).withColumn("zero", F.round("zero", 9))


@query(f"""WITH {EXPR_SQL}, t AS (SELECT cell_id, sum(cnt) AS total FROM expr GROUP BY 1)
SELECT cell_id, gene, round(cnt * 1e4 / total, 6) AS norm, round(ln(1 + cnt * 1e4 / total), 6) AS lognorm FROM expr JOIN t USING (cell_id)""")
def normalize_log1p(spark, sf_dir):
    scaled = prep.normalize_total(expr(spark, sf_dir))
    return scaled.select("cell_id", "gene", F.round("norm", 6).alias("norm"), F.round("lognorm", 6).alias("lognorm"))


_DISPERSION = f"""WITH {EXPR_SQL}, t AS (SELECT cell_id, sum(cnt) AS total FROM expr GROUP BY 1), n AS (SELECT count(*) AS k FROM orders),
s AS (SELECT gene, sum(cnt * 1e4 / total) / any_value(k) AS m, sum((cnt * 1e4 / total) ** 2) AS s2, any_value(k) AS k FROM expr JOIN t USING (cell_id), n GROUP BY 1),
d AS (SELECT gene, ln(1 + m) AS mean, ln((s2 - k * m * m) / (k - 1) / m) AS disp FROM s),
b AS (SELECT *, least(floor((mean - min(mean) OVER ()) / ((max(mean) OVER () - min(mean) OVER ()) / 20)), 19)::INT AS bin FROM d),
z AS (SELECT gene, mean, disp, bin, CASE WHEN count(*) OVER (PARTITION BY bin) = 1 THEN 1.0
  ELSE (disp - avg(disp) OVER (PARTITION BY bin)) / stddev_samp(disp) OVER (PARTITION BY bin) END AS disp_norm FROM b)"""


def _dispersion(spark, sf_dir):
    n = table(spark, sf_dir, "orders").count()
    return prep.gene_dispersion(prep.normalize_total(expr(spark, sf_dir)), n)


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "disp", "disp_norm")})


@query(_DISPERSION + "SELECT gene, round(mean, 6) AS mean, round(disp, 6) AS disp, bin, round(disp_norm, 6) AS disp_norm, mean > 0.0125 AND mean < 8.0 AND disp_norm > 0.5 AS highly_variable FROM z")
def hvg_cutoff(spark, sf_dir):
    return _rounded(prep.hvg_cutoff(_dispersion(spark, sf_dir), max_mean=8.0))


@query(_DISPERSION + "SELECT gene, round(mean, 6) AS mean, round(disp, 6) AS disp, bin, round(disp_norm, 6) AS disp_norm, round(disp_norm, 9) >= (SELECT min(disp_norm) FROM (SELECT round(disp_norm, 9) AS disp_norm FROM z ORDER BY disp_norm DESC LIMIT 10)) AS highly_variable FROM z")
def hvg_top_n(spark, sf_dir):
    return _rounded(prep.hvg_top(_dispersion(spark, sf_dir), 10))


@query("""WITH m AS (SELECT (l_suppkey % 32)::INT AS gene, sum(l_quantity) > 25 * count(*) AS highly_variable FROM lineitem WHERE l_linenumber >= 6 AND l_suppkey % 5 < 3 GROUP BY 1)
SELECT g.gene, coalesce(m.highly_variable, false) AS highly_variable FROM (SELECT DISTINCT (l_suppkey % 32)::INT AS gene FROM lineitem) g LEFT JOIN m USING (gene)""")
def hvg_mask_realigned(spark, sf_dir):
    """A mask made from one part of the lines over the genes of all of them."""
    gene = (F.col("l_suppkey") % 32).cast("int").alias("gene")
    lines = table(spark, sf_dir, "lineitem")
    mask = lines.where("l_linenumber >= 6 and l_suppkey % 5 < 3").groupBy(gene).agg((F.sum("l_quantity") > 25 * F.count("*")).alias("highly_variable"))
    return prep.realign_mask(mask, lines.select(gene).distinct())


@query("SELECT 0::BIGINT AS nan, 0::BIGINT AS infinite, 0::BIGINT AS missing")
def nonfinite_validation(spark, sf_dir):
    scaled = prep.require_finite(prep.normalize_total(expr(spark, sf_dir)), F.col("norm"))
    return prep.invalid_counts(scaled, F.col("norm"))


_SPLIT = """WITH d AS (SELECT DISTINCT o_custkey AS donor_id FROM orders), r AS (SELECT donor_id, row_number() OVER (ORDER BY donor_id * 7919 % 10007, donor_id) AS r FROM d)"""


@query(_SPLIT + """, n AS (SELECT least(100, count(*) // 2) AS n FROM d), p AS (SELECT donor_id, row_number() OVER (ORDER BY CASE WHEN r > 2 * n THEN 0 ELSE 1 END, r) AS p FROM r, n)
SELECT CASE WHEN r <= n THEN 'train' ELSE 'holdout' END AS role, donor_id FROM r, n WHERE r <= 2 * n UNION ALL SELECT 'auxiliary', donor_id FROM p, n WHERE p <= greatest(150, n)""")
def donor_split(spark, sf_dir):
    return splits.split_donors(cells(spark, sf_dir), 100, 150, F.col("donor_id") * 7919 % 10007)


@query(_SPLIT + """, n AS (SELECT least(490, count(*) // 2) AS n FROM d)
SELECT CASE WHEN r <= n THEN 'train' ELSE 'holdout' END AS role, donor_id FROM r, n WHERE r <= 2 * n UNION ALL SELECT 'auxiliary', donor_id FROM r, n WHERE r > n AND r <= least(2 * n, n + 200)""")
def donor_split_large(spark, sf_dir):
    return splits.split_donors(cells(spark, sf_dir), 490, 0, F.col("donor_id") * 7919 % 10007, aux="holdout")


@query("SELECT DISTINCT 'train' AS role, o_custkey AS donor_id FROM orders")
def donor_split_all_train(spark, sf_dir):
    return splits.split_all_train(cells(spark, sf_dir))


@query(f"WITH {CELLS_SQL} SELECT cell_id, cell_type, ((row_number() OVER (PARTITION BY cell_type ORDER BY cell_id * 7919 % 1000003, cell_id) - 1) % 5)::INT AS fold FROM cells")
def stratified_folds(spark, sf_dir):
    return splits.stratified_folds(cells(spark, sf_dir).select("cell_id", "cell_type"), "cell_type", 5, F.col("cell_id") * 7919 % 1000003, ("cell_id",))


@query(f"WITH {CELLS_SQL} SELECT cell_id, donor_id, cell_type FROM cells QUALIFY row_number() OVER (PARTITION BY donor_id, cell_type ORDER BY cell_id) <= 2")
def capped_sample(spark, sf_dir):
    return splits.sample_per_group(cells(spark, sf_dir).select("cell_id", "donor_id", "cell_type"), ["donor_id", "cell_type"], 2, F.col("cell_id"))


@query(f"""WITH {DENSE_SQL}, s AS (SELECT gene, avg(cnt) AS m, stddev_pop(cnt) AS sd FROM dense WHERE role = 0 GROUP BY 1)
SELECT cell_type, gene, round(avg((cnt - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END), 6) AS mean_z FROM dense JOIN s USING (gene) GROUP BY ALL""")
def train_standardized(spark, sf_dir):
    z = splits.standardize(dense(spark, sf_dir), "cnt", ["gene"], F.col("role") == 0)
    return z.groupBy("cell_type", "gene").agg(F.round(F.avg("z"), 6).alias("mean_z"))


@query()
def bootstrap_cells(spark, sf_dir):
    return splits.bootstrap(cells(spark, sf_dir).select("cell_id", "cell_type"), "cell_id", 1000)


@query()
def categorical_draw(spark, sf_dir):
    from auditlake.operators.reports import value_share

    c = cells(spark, sf_dir)
    shares = value_share(c, "cell_type").select(F.col("cell_type").alias("category"), "share")
    return splits.draw_category(c.select("cell_id"), shares, "cell_id")


@query(f"WITH {DENSE_SQL} SELECT cell_type, role, gene, round(avg(cnt), 9) AS mu FROM dense GROUP BY ALL")
def poisson_marginals(spark, sf_dir):
    return marginals.poisson_marginals(dense(spark, sf_dir), ["cell_type", "role"]).select("cell_type", "role", "gene", F.round("mu", 9).alias("mu"))


@query(f"""WITH {DENSE_SQL}, s AS (SELECT cell_type, gene, avg(cnt) AS mu, var_samp(cnt) AS v FROM dense WHERE role = 0 GROUP BY ALL)
SELECT cell_type, gene, round(mu, 6) AS mu, CASE WHEN v > mu THEN round(mu * mu / (v - mu), 6) END AS theta FROM s""")
def moment_marginals(spark, sf_dir):
    m = marginals.moment_marginals(dense(spark, sf_dir).where("role = 0"), ["cell_type"])
    return m.select("cell_type", "gene", F.round("mu", 6).alias("mu"), F.when(F.col("theta") != float("inf"), F.round("theta", 6)).alias("theta"))


@query()
def fitted_marginals(spark, sf_dir):
    return marginals.fitted_marginals(dense(spark, sf_dir).where("role = 0"), ["cell_type"])


# Fitted by moments of the training cells: the mean, a size where the variance is above it (else Poisson), half of the zeros inflated.
_FITS = f"""{DENSE_SQL}, fits AS (SELECT cell_type, gene, avg(cnt) AS mu, CASE WHEN var_samp(cnt) > avg(cnt) + 0.01 THEN avg(cnt) * avg(cnt) / (var_samp(cnt) - avg(cnt)) END AS theta, avg((cnt = 0)::INT) / 2 AS pi
  FROM dense WHERE role = 0 GROUP BY ALL HAVING avg(cnt) > 0), g AS (SELECT DISTINCT cell_type, gene, cnt AS x, pi, theta, mu FROM dense JOIN fits USING (cell_type, gene)),
logs AS (SELECT *, list_transform(range(x + 1), lambda k: CASE WHEN theta IS NULL THEN k * ln(mu) - mu - lgamma(k + 1) ELSE lgamma(k + theta) - lgamma(theta) - lgamma(k + 1) + theta * ln(theta / (theta + mu)) + k * ln(mu / (theta + mu)) END) AS l FROM g),
pmf AS (SELECT cell_type, gene, x, pi, theta, mu, l, list_sum(list_transform(l, lambda y: exp(y))) AS f, exp(l[x + 1]) AS p FROM logs)"""


def _fitted(spark, sf_dir):
    """Every count that a gene has in a type, with the type's fitted (pi, theta, mu)."""
    d = dense(spark, sf_dir)
    mu, v = F.avg("cnt"), F.var_samp("cnt")
    fits = d.where("role = 0").groupBy("cell_type", "gene").agg(mu.alias("mu"), F.when(v > mu + 0.01, mu * mu / (v - mu)).alias("theta"), (F.avg((F.col("cnt") == 0).cast("double")) / 2).alias("pi"))
    seen = d.select("cell_type", "gene", F.col("cnt").alias("x")).distinct()
    return seen.join(fits.where("mu > 0"), ["cell_type", "gene"]), [F.col(c) for c in ("x", "pi", "theta", "mu")]


@query(f"WITH {_FITS} SELECT cell_type, gene, x, round(pi + (1 - pi) * f, 6) AS cdf FROM pmf")
def zinb_cdf_grid(spark, sf_dir):
    """The fitted distribution function at every count."""
    rows, args = _fitted(spark, sf_dir)
    return rows.select("cell_type", "gene", "x", F.round(zinb_cdf(*args), 6).alias("cdf"))


@query(f"WITH {_FITS} SELECT cell_type, gene, x, round(pi + (1 - pi) * (f - p / 2), 6) AS mid, round(CASE WHEN x = 0 THEN 0.5 * (pi + (1 - pi) * f) ELSE pi + (1 - pi) * (f - p / 2) END, 6) AS uniform FROM pmf")
def zinb_transforms(spark, sf_dir):
    rows, args = _fitted(spark, sf_dir)
    return rows.select("cell_type", "gene", "x", F.round(zinb_cdf_dt(*args, F.lit(0.5)), 6).alias("mid"), F.round(zinb_uniform(*args, F.lit(0.5)), 6).alias("uniform"))


@query(f"WITH {_FITS} SELECT cell_type, gene, x, round(CASE WHEN x = 0 THEN ln(pi + (1 - pi) * p) ELSE ln(1 - pi) + greatest(l[x + 1], ln(1e-300)) END, 6) AS log_p FROM pmf")
def zinb_log_pmf_grid(spark, sf_dir):
    rows, args = _fitted(spark, sf_dir)
    return rows.select("cell_type", "gene", "x", F.round(zinb_log_pmf(*args), 6).alias("log_p"))


@query(f"WITH {_FITS} SELECT cell_type, gene, x, round(list_sum(list_transform(range(x + 1), lambda k: exp(k * ln(mu) - mu - lgamma(k + 1)))), 6) AS cdf, round(greatest(x * ln(mu) - mu - lgamma(x + 1), ln(1e-300)), 6) AS log_p FROM g")
def poisson_limit(spark, sf_dir):
    """The fits without dispersion or inflation."""
    rows, _ = _fitted(spark, sf_dir)
    args = F.col("x"), F.lit(0.0), F.lit(float("inf")), F.col("mu")
    return rows.select("cell_type", "gene", "x", F.round(zinb_cdf(*args), 6).alias("cdf"), F.round(zinb_log_pmf(*args), 6).alias("log_p"))


@query()
def normal_scores(spark, sf_dir):
    """Normal scores of every count under its fit."""
    rows, args = _fitted(spark, sf_dir)
    return rows.withColumn("u", nudged_transform(*args, F.lit(0.5))).withColumn("z", qnorm(F.col("u")))


@query(f"""WITH {DENSE_SQL}, n AS (SELECT gi.cell_type, gi.gene AS gi, gj.gene AS gj, CASE WHEN isfinite(corr(gi.cnt, gj.cnt)) THEN corr(gi.cnt, gj.cnt) END AS r FROM dense gi JOIN dense gj ON gi.cell_id = gj.cell_id AND gi.gene <= gj.gene
  GROUP BY ALL) SELECT cell_type, gi, gj, round(r, 6) AS r FROM n""")
def gene_correlations(spark, sf_dir):
    cells = marginals.listed_counts(profile(spark, sf_dir), ["cell_type"])
    r = marginals.correlations_of(marginals.products_of(cells, ["cell_type"]), ["cell_type"])
    return r.withColumn("r", F.round("r", 6))


@query(f"""WITH {DENSE_SQL} SELECT gi.cell_type, gi.gene AS gi, gj.gene AS gj, round(sum(gi.cnt * gj.cnt) / greatest(count(*) - 1, 1), 6) AS r FROM dense gi JOIN dense gj
  ON gi.cell_id = gj.cell_id AND gi.gene <= gj.gene GROUP BY ALL""")
def gene_second_moments(spark, sf_dir):
    cells = marginals.listed_counts(profile(spark, sf_dir), ["cell_type"])
    return marginals.second_moments_of(marginals.products_of(cells, ["cell_type"]), ["cell_type"]).withColumn("r", F.round("r", 6))


_SPEARMAN = f"""WITH {DENSE_SQL}, r AS (SELECT cell_id, gene, role % 2 AS side, rank() OVER w + (count(*) OVER (PARTITION BY role % 2, gene, cnt) - 1) / 2 AS r FROM dense
  WINDOW w AS (PARTITION BY role % 2, gene ORDER BY cnt)), m AS (SELECT a.side, a.gene AS gi, b.gene AS gj, CASE WHEN isfinite(corr(a.r, b.r)) THEN corr(a.r, b.r) END AS rho FROM r a JOIN r b ON a.cell_id = b.cell_id AND a.gene < b.gene GROUP BY ALL)"""


def _spearman(spark, sf_dir):
    rows = dense(spark, sf_dir).withColumn("side", (F.col("role") % 2).cast("int"))
    ranked = marginals.average_ranks(rows, ["side", "gene"], "cnt")
    return marginals.correlations(ranked, ["side"], "rank").where("gi < gj")


@query(_SPEARMAN + "SELECT side, gi, gj, round(rho, 6) AS rho FROM m")
def gene_spearman(spark, sf_dir):
    return _spearman(spark, sf_dir).select("side", "gi", "gj", F.round("r", 6).alias("rho"))


@query(_SPEARMAN + "SELECT round(corr(a.rho, b.rho), 6) AS score FROM m a JOIN m b ON a.gi = b.gi AND a.gj = b.gj WHERE a.side = 0 AND b.side = 1")
def correlation_of_correlations(spark, sf_dir):
    m = _spearman(spark, sf_dir)
    both = m.where("side = 0").select("gi", "gj", F.col("r").alias("a")).join(m.where("side = 1").select("gi", "gj", F.col("r").alias("b")), ["gi", "gj"])
    return both.agg(F.round(F.corr("a", "b"), 6).alias("score"))


@query()
def copula_correlations(spark, sf_dir):
    d = dense(spark, sf_dir).where("role = 0")
    return marginals.gaussian_copula(d, marginals.moment_marginals(d, ["cell_type"]), ["cell_type"])


@query()
def copula_sample(spark, sf_dir):
    """Synthetic cells as many as the training ones of each type."""
    d = dense(spark, sf_dir).where("role = 0")
    m = marginals.moment_marginals(d, ["cell_type"])
    n = cells(spark, sf_dir).where("role = 0").groupBy("cell_type").agg(F.count("*").alias("n"))
    return marginals.sample_copula(m, marginals.gaussian_copula(d, m, ["cell_type"]), n, "cell_type")


@query()
def principal_components(spark, sf_dir):
    from auditlake.operators.baselines import pca_scores

    return pca_scores(vectors(spark, sf_dir), "vec_id", 5)
