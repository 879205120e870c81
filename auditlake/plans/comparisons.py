"""Queries that set results side by side: generations of a generator, fidelity beside privacy, labels, features, aligned sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import baselines, factors, marginals, membership, metrics, prep, privacy, reports, splits
from auditlake.plans.audit import _QUAD_SQL, BY, KEYS, _evidence, _models, _quad, _targets
from auditlake.plans.registry import query
from auditlake.sources.scratch import stored
from auditlake.sources.tables import table
from auditlake.sources.views import CELLS_SQL, DENSE_SQL, EXPR_SQL, VECTORS_SQL, cells, dense, expr, vectors

# Orders stand for trials again: the customer picks the variant, the status its generation; each generation lacks one epsilon.
_VARIANTS = """o AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'v2_' ELSE '' END || ['no_dp', 'eps_1', 'eps_100', 'eps_10000', 'eps_28'][(o_custkey % 5 + 1)::INT] AS variant, o_orderkey % 7 AS trial, o_totalprice FROM orders),
v AS (SELECT variant, trial, CASE WHEN trial = 3 THEN NULL ELSE avg(o_totalprice) / 1e6 END AS lisi, max(o_totalprice) / 1e6 AS ari, avg(o_totalprice) / 1e5 AS mmd FROM o WHERE variant NOT IN ('eps_28', 'v2_eps_1') GROUP BY variant, trial)"""


def _variants(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("no_dp", "eps_1", "eps_100", "eps_10000", "eps_28"))), (F.col("o_custkey") % 5 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select(F.concat(F.when(F.col("o_orderstatus") == "F", "v2_").otherwise(""), name).alias("variant"), (F.col("o_orderkey") % 7).alias("trial"), "o_totalprice")
    v = o.where("variant not in ('eps_28', 'v2_eps_1')").groupBy("variant", "trial").agg((F.avg("o_totalprice") / 1e6).alias("lisi"), (F.max("o_totalprice") / 1e6).alias("ari"), (F.avg("o_totalprice") / 1e5).alias("mmd"))
    return v.withColumn("lisi", F.when(F.col("trial") == 3, float("nan")).otherwise(F.col("lisi")))


@query(f"""WITH {_VARIANTS}, l AS (SELECT variant LIKE 'v2%' AS new, replace(variant, 'v2_', '') AS eps, metric, x FROM v UNPIVOT INCLUDE NULLS (x FOR metric IN (lisi, ari, mmd))),
g AS (SELECT eps, metric, avg(x) FILTER (WHERE NOT new) AS om, stddev_pop(x) FILTER (WHERE NOT new) AS os, count(x) FILTER (WHERE NOT new) AS o_n, avg(x) FILTER (WHERE new) AS nm, stddev_pop(x) FILTER (WHERE new) AS ns, count(x) FILTER (WHERE new) AS n_n,
  count(*) FILTER (WHERE new) AS a, count(*) FILTER (WHERE NOT new) AS b FROM l GROUP BY ALL)
SELECT CASE WHEN eps = 'no_dp' THEN '∞ (no DP)' ELSE format('{{:,}}', replace(eps, 'eps_', '')::BIGINT) END AS epsilon, metric, round(om, 6) AS old_mean, round(os, 6) AS old_std, o_n AS old_n, round(nm, 6) AS new_mean, round(ns, 6) AS new_std, n_n AS new_n FROM g WHERE a > 0 AND b > 0""")
def paired_variants(spark, sf_dir):
    out = reports.paired_variants(_variants(spark, sf_dir), ["lisi", "ari", "mmd"])
    rounded = (F.round(c, 6).alias(c) for c in ("old_mean", "old_std", "new_mean", "new_std"))
    return out.select(F.col("label").alias("epsilon"), "metric", *rounded, "old_n", "new_n")


_CELL = "CASE WHEN count({0}) = 0 THEN '---' ELSE regexp_replace(printf('%.2f', avg({0})), '^(-?)0\\.', '\\1.') || '±' || regexp_replace(printf('%.2f', coalesce(stddev_samp({0}), 0)), '^(-?)0\\.', '\\1.') || CASE WHEN count({0}) < 5 THEN '^' || count({0}) ELSE '' END END"
_TRIALS = """t AS (SELECT o_orderpriority AS method, [1, 10, 100, 1000][(o_custkey % 4 + 1)::INT] AS epsilon, o_orderkey % 5 AS trial, ['000', '010', '100', '110'][(o_orderkey // 5 % 4 + 1)::INT] AS tm, o_totalprice AS x FROM orders),
f AS (SELECT method, epsilon, trial, avg(x) / 1e5 AS lisi, avg(x) / 3e5 AS ari, avg(x) / 1e8 * 1e3 AS mmd FROM t WHERE NOT (epsilon = 100 AND trial = 3) GROUP BY ALL),
p AS (SELECT method, epsilon, trial, tm, avg(x) / 3e5 AS auc FROM t WHERE tm <> '110' OR epsilon <> 1 GROUP BY ALL)"""


@query(f"""WITH {_TRIALS}, a AS (SELECT method, epsilon, {", ".join(_CELL.format(c) + f" AS {c}" for c in ("lisi", "ari", "mmd"))} FROM f GROUP BY ALL),
w AS (SELECT method, epsilon, {", ".join(f"CASE WHEN tm = '{c}' THEN auc END AS a{c}" for c in ("000", "010", "100", "110"))} FROM p),
b AS (SELECT method, epsilon, {", ".join(_CELL.format(f"a{c}") + f" AS auc_{c}" for c in ("000", "010", "100", "110"))} FROM w GROUP BY ALL)
SELECT method, (100.0 / epsilon)::DOUBLE AS eta, lisi, ari, mmd, auc_000, auc_010, auc_100, auc_110 FROM a JOIN b USING (method, epsilon)""")
def combined_table(spark, sf_dir):
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    t = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("method"), pick((1, 10, 100, 1000), F.col("o_custkey") % 4).alias("epsilon"), (F.col("o_orderkey") % 5).alias("trial"),
        pick(("000", "010", "100", "110"), F.floor(F.col("o_orderkey") / 5) % 4).alias("tm"), F.col("o_totalprice").alias("x"),
    )
    mean = F.avg("x")
    fidelity = t.where("not (epsilon = 100 and trial = 3)").groupBy("method", "epsilon", "trial").agg((mean / 1e5).alias("lisi"), (mean / 3e5).alias("ari"), (mean / 1e8).alias("mmd"))
    attacks = t.where("tm <> '110' or epsilon <> 1").groupBy("method", "epsilon", "trial", "tm").agg((mean / 3e5).alias("auc"))
    return reports.combined_table(fidelity, attacks, ["method"], {"lisi": 1.0, "ari": 1.0, "mmd": 1e3}, ["000", "010", "100", "110"], 5)


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE contains(o_orderpriority, 'LOW') AND contains(o_orderstatus, 'O')")
def substring_selection(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return reports.containing(o, {"o_orderpriority": "LOW", "o_orderstatus": "O", "o_orderkey": None})


@query("SELECT o_orderpriority AS cell_type, round(sum(o_totalprice), 2) AS runtime FROM orders GROUP BY 1 UNION ALL SELECT 'total', round(sum(o_totalprice), 2) FROM orders")
def runtime_total(spark, sf_dir):
    """Seconds by type and in all, in one grouping."""
    o = table(spark, sf_dir, "orders").rollup("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("runtime"), F.grouping("o_orderpriority").alias("all"))
    return o.select(F.when(F.col("all") == 1, "total").otherwise(F.col("o_orderpriority")).alias("cell_type"), "runtime")


@query("WITH f AS (SELECT o_custkey AS donor_id, min(o_orderkey) AS first FROM orders GROUP BY 1) SELECT donor_id, first, row_number() OVER (ORDER BY first, donor_id) AS position FROM f")
def first_seen_donors(spark, sf_dir):
    return splits.first_seen(cells(spark, sf_dir), "donor_id", "cell_id")


@query(f"WITH {CELLS_SQL} SELECT cell_id, cell_type, (role = 0)::INT AS member FROM cells")
def aligned_labels(spark, sf_dir):
    c = cells(spark, sf_dir)
    return baselines.align_labels(c.select("cell_id", "cell_type"), c.select("cell_id", (F.col("role") == 0).cast("int").alias("member")), "cell_id")


# Two sets that lack different genes.
_BATCHES = f"""{CELLS_SQL}, {EXPR_SQL}, b AS (SELECT CASE WHEN role = 0 THEN 'synth' ELSE 'real' END AS batch, cell_id, gene, cnt FROM expr JOIN cells USING (cell_id) WHERE (role = 0 AND gene % 5 <> 0) OR (role = 1 AND gene % 7 <> 0)),
s AS (SELECT gene FROM b GROUP BY 1 HAVING count(DISTINCT batch) = 2)"""


def _by_role(spark, sf_dir):
    both = expr(spark, sf_dir).join(cells(spark, sf_dir).select("cell_id", "role"), "cell_id")
    return lambda i: both.where(F.col("role") == i).drop("role")


@query(f"WITH {_BATCHES} SELECT batch, cell_id, gene, cnt FROM b SEMI JOIN s USING (gene)")
def joined_batches(spark, sf_dir):
    of = _by_role(spark, sf_dir)
    return prep.joined_batches({"real": of(1).where("gene % 7 <> 0"), "synth": of(0).where("gene % 5 <> 0")})


_JOINT = f"""WITH {CELLS_SQL}, {EXPR_SQL}, e AS (SELECT role, cell_id, gene, cnt FROM expr JOIN cells USING (cell_id) WHERE role < 3), t AS (SELECT cell_id, sum(cnt) AS total FROM e GROUP BY 1), n AS (SELECT count(*) AS k FROM cells WHERE role < 3),
s AS (SELECT gene, sum(cnt * 1e4 / total) / any_value(k) AS m, sum((cnt * 1e4 / total) ** 2) AS s2, any_value(k) AS k FROM e JOIN t USING (cell_id), n GROUP BY 1),
d AS (SELECT gene, ln(1 + m) AS mean, ln((s2 - k * m * m) / (k - 1) / m) AS disp FROM s),
b AS (SELECT *, least(floor((mean - min(mean) OVER ()) / ((max(mean) OVER () - min(mean) OVER ()) / 20)), 19)::INT AS bin FROM d),
z AS (SELECT gene, round(CASE WHEN count(*) OVER w = 1 THEN 1.0 ELSE (disp - avg(disp) OVER w) / stddev_samp(disp) OVER w END, 9) AS z FROM b WINDOW w AS (PARTITION BY bin)),
h AS (SELECT gene FROM z WHERE z >= (SELECT min(z) FROM (SELECT z FROM z WHERE z IS NOT NULL ORDER BY z DESC LIMIT 8)))"""


@query(_JOINT + "SELECT ['test', 'synth', 'reference'][role + 1] AS batch, cell_id, gene, round(ln(1 + cnt * 1e4 / total), 6) AS lognorm FROM e JOIN t USING (cell_id) SEMI JOIN h USING (gene)")
def joint_hvg(spark, sf_dir):
    """The baselines' preparation: genes chosen on the three sets together, then every set's normalised counts of them."""
    of = _by_role(spark, sf_dir)
    sets = prep.joined_batches({"test": of(0), "synth": of(1), "reference": of(2)})
    scaled = prep.normalize_total(sets)
    chosen = prep.hvg_top(prep.gene_dispersion(scaled, cells(spark, sf_dir).where("role < 3").count()), 8).where("highly_variable").select("gene")
    return scaled.join(F.broadcast(chosen), "gene", "left_semi").select("batch", "cell_id", "gene", F.round("lognorm", 6).alias("lognorm"))


@query(f"WITH {DENSE_SQL}, s AS (SELECT gene, avg(cnt) AS m, stddev_samp(cnt) AS sd FROM dense GROUP BY 1) SELECT cell_id, gene, round(least((cnt - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 2.5), 6) AS scaled FROM dense JOIN s USING (gene) WHERE cnt > 0")
def clipped_scaling(spark, sf_dir):
    """Cells of a count of zero are met by the statistics and left out of the result, where they'd all be one value a gene."""
    return prep.scale_clipped(dense(spark, sf_dir), "cnt", 2.5).where("cnt > 0").select("cell_id", "gene", F.round("scaled", 6).alias("scaled"))


_PAIRS = f"""WITH {VECTORS_SQL}, p AS (SELECT a.label AS a, b.label AS b FROM vecs a JOIN vecs b ON a.part = 0 AND b.part = 1 AND a.vec_id // 3 = b.vec_id // 3), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL),
k AS (SELECT a AS k, count(*) AS na, count(*) FILTER (WHERE b = a) AS hit FROM p GROUP BY 1), kb AS (SELECT b AS k, count(*) AS nb FROM p GROUP BY 1),
r AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(na * (na - 1) / 2) FROM k) AS sa, (SELECT sum(nb * (nb - 1) / 2) FROM kb) AS sb, (SELECT count(*) * (count(*) - 1) / 2 FROM p) AS al)"""


@query(_PAIRS + "SELECT (SELECT round(avg(hit / (na + coalesce(nb, 0) - hit)), 6) FROM k LEFT JOIN kb USING (k)) AS jaccard, (SELECT count(*) FROM k) AS classes, round((ij - sa * sb / al) / ((sa + sb) / 2 - sa * sb / al), 6) AS ari FROM r")
def class_agreement(spark, sf_dir):
    """Labels of real and synthetic rows, paired by an explicit row number."""
    v = vectors(spark, sf_dir).select("part", F.floor(F.col("vec_id") / 3).alias("row"), "label")
    pairs = v.where("part = 0").select("row", F.col("label").alias("a")).join(v.where("part = 1").select("row", F.col("label").alias("b")), "row")
    found = metrics.class_jaccard(pairs, "a", "b").crossJoin(F.broadcast(metrics.adjusted_rand(pairs, "a", "b")))  # one row each
    return found.select(F.round("jaccard", 6).alias("jaccard"), "classes", F.round("ari", 6).alias("ari"))


_TOP = f"""WITH {VECTORS_SQL}, l AS (SELECT part, label, unnest(range(64))::INT AS feature, unnest(v) AS x FROM vecs WHERE part < 2), g AS (SELECT part, feature, avg(x) AS m FROM l GROUP BY ALL),
c AS (SELECT part, label, feature, avg(x) - any_value(m) AS coef FROM l JOIN g USING (part, feature) GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY part, label ORDER BY round(coef, 9) DESC, feature DESC)::INT AS rank FROM c QUALIFY row_number() OVER (PARTITION BY part, label ORDER BY round(coef, 9) DESC, feature DESC) <= 10)"""


def _top(spark, sf_dir, part):
    return metrics.top_coefficients(metrics.mean_contrasts(vectors(spark, sf_dir).where(F.col("part") == part), "label"), "label")


@query(_TOP + "SELECT label, rank, feature, round(coef, 6) AS coef FROM t WHERE part = 0")
def top_features(spark, sf_dir):
    return _top(spark, sf_dir, 0).select("label", "rank", "feature", F.round("coef", 6).alias("coef"))


@query(_TOP + ", s AS (SELECT DISTINCT feature FROM t WHERE part = 1), r AS (SELECT DISTINCT feature FROM t WHERE part = 0) SELECT count(r.feature) AS overlap, round(count(r.feature) / count(*), 9) AS share FROM s LEFT JOIN r USING (feature)")
def feature_overlap(spark, sf_dir):
    return metrics.feature_overlap(_top(spark, sf_dir, 1), _top(spark, sf_dir, 0)).withColumn("share", F.round("share", 9))


@query()
def logistic_feature_overlap(spark, sf_dir):
    """The same with the coefficients of fitted regressions."""
    v = vectors(spark, sf_dir)
    synth, real = (metrics.top_coefficients(metrics.logistic_coefficients(v.where(F.col("part") == i), "label"), "label") for i in (1, 0))
    return metrics.feature_overlap(synth, real)


@query()
def discriminative_f1(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return metrics.discriminative_f1(*(v.where(F.col("part") == i) for i in (0, 1, 2)), "vec_id")


@query(_QUAD_SQL + """SELECT cell_id, round(CASE WHEN f THEN 0.5 ELSE standard_aux END, 6) AS standard_aux, round(CASE WHEN f THEN 0.5 ELSE standard_alone END, 6) AS standard_alone, round(CASE WHEN f THEN llr / sqrt(n_genes) ELSE b_aux END, 6) AS b_aux, round(CASE WHEN f THEN 0 ELSE b_alone END, 6) AS b_alone
FROM (SELECT q.*, e.llr, e.n_genes, q.cell_type IN ('1-URGENT', '5-LOW') AS f FROM quad q JOIN e USING (cell_id))""")
def scores_without_matrix(spark, sf_dir):
    """Two types whose model has no correlations, as a vine's or an independent fit's."""
    out = membership.without_matrix(_quad(spark, sf_dir), ~F.col("cell_type").isin("1-URGENT", "5-LOW"))
    return out.select("cell_id", *(F.round(c, 6).alias(c) for c in ("standard_aux", "standard_alone", "b_aux", "b_alone")))


def noised_scores(spark, sf_dir, epsilons, seeds):
    """A row for each cell, epsilon and seed: distance to the noised training model, to the auxiliary one, and the score with and without it."""
    own = lambda roles: dense(spark, sf_dir).where(roles)
    copula = lambda d: marginals.gaussian_copula(d, marginals.poisson_marginals(d, BY), BY)
    grid = privacy.sigma_grid(privacy.donor_extent(cells(spark, sf_dir).where("role = 0"), BY), 32, epsilons).where("variant = 'v2'")
    noised = privacy.noisy_jobs(copula(own("role = 0")), grid, "cell_type", seeds).withColumn("job", F.concat_ws("|", "cell_type", F.col("epsilon").cast("string"), F.col("seed").cast("string")))
    names = noised.select("job", "cell_type", "epsilon", "seed").distinct()
    jobs = membership.precision_tables(noised, "job").join(names, "job").select("cell_type", "epsilon", "seed", "p")
    e = _evidence(spark, sf_dir, "sa").select(*KEYS, *BY, "delta_s", "delta_a")
    clean = membership.fitted_distances(e, membership.precision_tables(copula(own("role in (2, 3)")), "cell_type"), "cell_id", sides={"delta_a": "d_a"})
    d = membership.fitted_distances(clean, jobs, "cell_id", sides={"delta_s": "d_s"}, jobs=("epsilon", "seed"))
    return d.withColumns({"aux": membership.distance_ratio(F.col("d_s"), F.col("d_a")), "noaux": membership.closeness_only(F.col("d_s"))})


@query()
def noise_sweep_auc(spark, sf_dir):
    """Donor AUC with and without auxiliary distances by epsilon, over seeds, against the run without noise: one plan for the whole sweep."""
    scores = noised_scores(spark, sf_dir, [1.0, 100.0, 1e4, 1e9], [1, 2, 3])
    long = scores.select(*KEYS, "epsilon", "seed", F.explode(F.array(F.struct(F.lit("aux").alias("side"), "aux"), F.struct(F.lit("noaux").alias("side"), F.col("noaux").alias("aux")))).alias("s"))
    donors = membership.donor_scores(long.select(*KEYS, "epsilon", "seed", "s.side", F.col("s.aux").alias("x")), "x", ("epsilon", "seed", "side"))
    auc = stored(metrics.roc_auc(donors, "member", "score", ["epsilon", "seed", "side"]))
    return reports.sweep_summary(auc.where("epsilon < 1e9"), auc.where("epsilon = 1e9 and seed = 1"), "side")


@query(f"""WITH {CELLS_SQL}, {EXPR_SQL}, p AS (SELECT cell_id, cell_type, row_number() OVER (PARTITION BY cell_type ORDER BY cell_id) AS r FROM cells WHERE role = 1), d AS (SELECT cell_id AS drawn, cell_type, row_number() OVER (PARTITION BY cell_type ORDER BY cell_id) AS r FROM cells WHERE role = 0)
SELECT p.cell_id, cell_type, drawn, e.gene, coalesce(e.cnt, 0)::INT AS cnt FROM p LEFT JOIN d USING (cell_type, r) LEFT JOIN expr e ON e.cell_id = drawn""")
def filled_template(spark, sf_dir):
    """Drawn cells' counts at the places of a template's cells of the type, in order; no gene where nothing was drawn."""
    c = cells(spark, sf_dir)
    places = splits.fill_template(c.where("role = 0"), c.where("role = 1"), "cell_type", "cell_id")
    counts = expr(spark, sf_dir).withColumnRenamed("cell_id", "drawn")
    return places.join(counts, "drawn", "left").select("cell_id", "cell_type", "drawn", "gene", F.coalesce("cnt", F.lit(0)).alias("cnt"))


@query()
def zinb_bootstrap(spark, sf_dir):
    """Counts of 1000 resampled training cells, with means a little above their own counts."""
    fitted = dense(spark, sf_dir).where("role = 0").select("cell_id", "gene", (F.col("cnt") + 0.1).alias("mu"), F.lit(0.1).alias("pi"))
    phi = fitted.groupBy("gene").agg(F.lit(0.5).alias("phi"))
    return factors.zinb_bootstrap(fitted, phi, "cell_id", 1000)
