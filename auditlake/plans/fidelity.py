"""Queries over nearest-neighbour baselines, curves and data-quality metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import baselines, marginals, metrics
from auditlake.operators.prep import gene_dispersion, hvg_top, normalize_total
from auditlake.plans.evaluation import _mask_sql
from auditlake.plans.registry import query
from auditlake.sources.tables import table
from auditlake.sources.views import CELLS_SQL, DENSE_SQL, EXPR_SQL, VECTORS_SQL, cells, dense, expr, profile, vectors


def _parts(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return [v.where(F.col("part") == i) for i in range(3)]


_D2 = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) ** 2))"
_NEAREST = f"""WITH {VECTORS_SQL}, g AS (SELECT a.vec_id AS id, min({_D2}) AS d2 FROM vecs a JOIN vecs b ON a.part = 0 AND b.part = 1 GROUP BY 1)"""


@query(_NEAREST + f", eps AS (SELECT median(d2) AS e FROM g) SELECT a.vec_id AS id, round(count(*) FILTER (WHERE {_D2} < e) / count(*), 6) AS score FROM vecs a JOIN vecs b ON a.part = 0 AND b.part = 1, eps GROUP BY 1")
def mc_score(spark, sf_dir):
    test, synth, _ = _parts(spark, sf_dir)
    return baselines.mc_score(test, synth, "vec_id").withColumn("score", F.round("score", 6))


@query(_NEAREST + "SELECT id, round(exp(-d2), 9) AS score FROM g")
def gan_leaks(spark, sf_dir):
    test, synth, _ = _parts(spark, sf_dir)
    return baselines.gan_leaks(test, synth, "vec_id").withColumn("score", F.round("score", 9))


@query(_NEAREST + f", r AS (SELECT a.vec_id AS id, min({_D2}) AS d2 FROM vecs a JOIN vecs b ON a.part = 0 AND b.part = 2 GROUP BY 1) SELECT id, round(1 / (1 + exp(g.d2 - r.d2)), 6) AS score FROM g JOIN r USING (id)")
def gan_leaks_calibrated(spark, sf_dir):
    return baselines.gan_leaks_calibrated(*_parts(spark, sf_dir), "vec_id").withColumn("score", F.round("score", 6))


@query(f"WITH {VECTORS_SQL}, d AS (SELECT a.vec_id AS id, min(sqrt({_D2})) AS d FROM vecs a JOIN vecs b ON a.part = 1 AND b.part <> 1 GROUP BY 1) SELECT round(avg(d), 4) AS dcr, count(*) AS n FROM d")
def closest_record(spark, sf_dir):
    v = vectors(spark, sf_dir)
    d = baselines.nearest_squared(v.where("part = 1"), v.where("part <> 1"), "vec_id")
    return d.agg(F.round(F.avg(F.sqrt("d2")), 4).alias("dcr"), F.count("*").alias("n"))


@query(f"WITH {VECTORS_SQL}, p AS (SELECT a.vec_id AS id, b.vec_id AS other, {_D2} AS d2 FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id) SELECT id, other, round(d2, 6) AS d2, row_number() OVER (PARTITION BY id ORDER BY round(d2, 12), other)::INT AS rank FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(d2, 12), other) <= 10")
def nearest_k(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return baselines.nearest_k(v, v, "vec_id", 10).withColumn("d2", F.round("d2", 6))


@query(f"""WITH {VECTORS_SQL}, p AS (SELECT a.vec_id AS id, b.part AS batch, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_D2}, 12), b.vec_id) AS r FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id),
n AS (SELECT id, batch, count(*) AS n FROM p WHERE r <= 10 GROUP BY ALL), l AS (SELECT id, sum(n) ** 2 / sum(n * n) AS lisi FROM n GROUP BY 1) SELECT round((median(lisi) - 1) / 2, 6) AS lisi FROM l""")
def neighbourhood_mixing(spark, sf_dir):
    v = vectors(spark, sf_dir)
    near = baselines.nearest_k(v, v, "vec_id", 10)
    return metrics.mixing(near, v.select("vec_id", F.col("part").alias("batch")), "vec_id").withColumn("lisi", F.round("lisi", 6))


_KERNEL = f"""WITH {VECTORS_SQL}, k AS (SELECT a.part AS p, b.part AS q, a.vec_id = b.vec_id AS own, exp(-{{}} * {_D2}) AS k FROM vecs a JOIN vecs b ON a.part <= b.part WHERE a.part < 2 AND b.part < 2)"""


@query(_KERNEL.format("0.015625") + "SELECT round(avg(k) FILTER (WHERE p = 0 AND q = 0 AND NOT own) + avg(k) FILTER (WHERE p = 1 AND q = 1 AND NOT own) - 2 * avg(k) FILTER (WHERE p = 0 AND q = 1), 6) AS mmd FROM k")
def mmd_unbiased(spark, sf_dir):
    test, synth, _ = _parts(spark, sf_dir)
    return metrics.mmd(test, synth, "vec_id", 1 / 64, biased=False).withColumn("mmd", F.round("mmd", 6))


@query(f"""WITH {VECTORS_SQL}, s AS (SELECT * FROM vecs WHERE part < 2 ORDER BY vec_id LIMIT 300), m AS (SELECT 1 / (2 * median({_D2})) AS g FROM s a JOIN s b ON a.vec_id < b.vec_id WHERE {_D2} > 1e-12),
k AS (SELECT a.part AS p, b.part AS q, exp(-g * {_D2}) AS k FROM vecs a JOIN vecs b ON a.part <= b.part, m WHERE a.part < 2 AND b.part < 2)
SELECT round(any_value(g), 6) AS gamma, round(avg(k) FILTER (WHERE p = 0 AND q = 0) + avg(k) FILTER (WHERE p = 1 AND q = 1) - 2 * avg(k) FILTER (WHERE p = 0 AND q = 1), 6) AS mmd FROM k, m""")
def mmd_median_heuristic(spark, sf_dir):
    """The bandwidth is the original's: a median over a sample of a fixed size."""
    test, synth, _ = _parts(spark, sf_dir)
    gamma = metrics.median_gamma(test.unionByName(synth).orderBy("vec_id").limit(300), "vec_id")
    return metrics.mmd(test, synth, "vec_id", gamma).select(F.round(F.lit(gamma), 6).alias("gamma"), F.round("mmd", 6).alias("mmd"))


@query()
def kde_ratio(spark, sf_dir):
    return baselines.kde_ratio(*_parts(spark, sf_dir), "vec_id")


@query()
def logan_score(spark, sf_dir):
    return baselines.logan(*_parts(spark, sf_dir), "vec_id")


@query()
def forest_discriminator(spark, sf_dir):
    test, synth, _ = _parts(spark, sf_dir)
    return metrics.discriminator_auc(test, synth, "vec_id")


@query()
def synthetic_trained_accuracy(spark, sf_dir):
    test, synth, _ = _parts(spark, sf_dir)
    return metrics.train_synthetic_test_real(synth, test, "label")


_BINARY = "WITH b AS (SELECT l.quality AS y, d.n_chars AS score FROM labels l JOIN documents d USING (doc_id))"


def _binary(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), F.col("n_chars").alias("score"))


_CURVE = _BINARY + """, h AS (SELECT score AS threshold, sum(y)::DOUBLE AS p, count(*) AS n FROM b GROUP BY 1),
c AS (SELECT threshold, sum(p) OVER w AS tp, (sum(n - p) OVER w)::DOUBLE AS fp, sum(p) OVER () AS pos, (sum(n - p) OVER ())::DOUBLE AS neg FROM h WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""


@query(_CURVE + "SELECT threshold, tp, fp, round(tp / pos, 9) AS tpr, round(fp / neg, 9) AS fpr, round(tp / (tp + fp), 9) AS precision FROM c")
def roc_points(spark, sf_dir):
    c = metrics.curve(_binary(spark, sf_dir), "y", "score")
    return c.select("threshold", "tp", "fp", *(F.round(x, 9).alias(x) for x in ("tpr", "fpr", "precision")))


@query(_CURVE + """, s AS (SELECT *, coalesce(lag(tp) OVER w, 0) AS tp0, coalesce(lag(fp) OVER w, 0) AS fp0, coalesce(lag(tp / pos) OVER w, 0) AS r0, coalesce(lag(tp / (tp + fp)) OVER w, 1) AS p0 FROM c WINDOW w AS (ORDER BY threshold DESC)),
m AS (SELECT median(score) AS m FROM b), hh AS (SELECT count(*) FILTER (WHERE score > m AND y = 1) AS tp, count(*) FILTER (WHERE score > m AND y = 0) AS fp, count(*) FILTER (WHERE score <= m AND y = 1) AS fn, count(*) FILTER (WHERE score <= m AND y = 0) AS tn FROM b, m),
r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM b)
SELECT round(sum((tp / pos - r0) * tp / (tp + fp)), 6) AS average_precision, round(sum((tp / pos - r0) * (tp / (tp + fp) + p0) / 2), 6) AS pr_auc,
round(max((tp0 + neg - fp0) / (pos + neg)), 6) AS accuracy_best, round(max(2 * tp0 / (tp0 + fp0 + pos)), 6) AS f1_best,
round(arg_min(tp / pos, fp * 1e9 - threshold) FILTER (WHERE fp / neg >= 0.01), 6) AS tpr_at_fpr_001, round(arg_min(tp / pos, fp * 1e9 - threshold) FILTER (WHERE fp / neg >= 0.1), 6) AS tpr_at_fpr_01,
(SELECT round((tp + tn) / (tp + tn + fp + fn), 6) FROM hh) AS accuracy_median, (SELECT round(2 * tp / (2 * tp + fp + fn), 6) FROM hh) AS f1_median,
(SELECT round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) FROM r) AS auc FROM s""")
def threshold_metrics(spark, sf_dir):
    m = metrics.threshold_metrics(_binary(spark, sf_dir), "y", "score")
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query(f"""WITH {DENSE_SQL}, v AS (SELECT DISTINCT gene, cnt AS x FROM dense), h AS (SELECT gene, cnt AS x, count(*) FILTER (WHERE role = 0) AS u, count(*) FILTER (WHERE role = 1) AS v FROM dense WHERE role IN (0, 1) GROUP BY ALL),
g AS (SELECT gene, abs(sum(u) OVER w / sum(u) OVER p - sum(v) OVER w / sum(v) OVER p) * (lead(x) OVER (PARTITION BY gene ORDER BY x) - x) AS d FROM h
  WINDOW w AS (PARTITION BY gene ORDER BY x ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY gene)) SELECT gene, round(coalesce(sum(d), 0), 6) AS emd FROM g GROUP BY 1""")
def earth_mover(spark, sf_dir):
    d = dense(spark, sf_dir)
    return metrics.wasserstein(d.where("role = 0"), d.where("role = 1"), "cnt", ["gene"]).withColumn("emd", F.round("emd", 6))


@query("""WITH t AS (SELECT label AS a, vec_id % 7 AS b, count(*) AS n FROM embeddings GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) * (sum(n) - 1) / 2 AS al FROM t),
x AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM t GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM t GROUP BY b))
SELECT round((ij - x.v * y.v / al) / ((x.v + y.v) / 2 - x.v * y.v / al), 9) AS ari FROM s, x, y""")
def adjusted_rand(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 7).alias("b"))
    return metrics.adjusted_rand(rows, "label", "b").withColumn("ari", F.round("ari", 9))


@query(f"""WITH {DENSE_SQL}, r AS (SELECT gene, (role = 0)::INT AS y, rank() OVER (PARTITION BY gene ORDER BY cnt) + (count(*) OVER (PARTITION BY gene, cnt) - 1) / 2 AS r FROM dense WHERE role IN (0, 1)),
t AS (SELECT gene, sum(n ** 3 - n) AS ties FROM (SELECT gene, cnt, count(*) AS n FROM dense WHERE role IN (0, 1) GROUP BY ALL) GROUP BY 1),
s AS (SELECT gene, sum(r) FILTER (WHERE y = 1) AS rs, sum(y)::DOUBLE AS n1, count(*)::DOUBLE AS n FROM r GROUP BY 1),
u AS (SELECT gene, rs - n1 * (n1 + 1) / 2 AS u, n1, n - n1 AS n0, n, ties FROM s JOIN t USING (gene))
SELECT gene, round(u, 3)::DOUBLE AS u, round((u - n1 * n0 / 2) / nullif(sqrt(n1 * n0 / 12 * (n + 1 - ties / nullif(n * (n - 1), 0))), 0), 6) AS z, round(u / nullif(n1 * n0, 0), 6) AS share FROM u""")
def wilcoxon_genes(spark, sf_dir):
    rows = dense(spark, sf_dir).where("role in (0, 1)").withColumn("y", (F.col("role") == 0).cast("int"))
    out = metrics.rank_sum(rows, "y", "cnt", ["gene"])
    return out.select("gene", F.round("u", 3).alias("u"), F.round("z", 6).alias("z"), F.round("share", 6).alias("share"))


def _findings(rows, side):
    """Genes whose counts differ between two types, with the direction, within one side."""
    two = rows.where(F.col("cell_type").isin("1-URGENT", "2-HIGH") & (F.col("role") % 2 == side)).withColumn("y", (F.col("cell_type") == "1-URGENT").cast("int"))
    found = metrics.rank_sum(two, "y", "cnt", ["gene"]).withColumn("direction", metrics.direction(F.col("z"), 0.8))
    return found.where("direction is not null").select("direction", "gene")


@query(f"""WITH {DENSE_SQL}, q AS (SELECT role % 2 AS side, gene, (cell_type = '1-URGENT')::INT AS y, cnt FROM dense WHERE cell_type IN ('1-URGENT', '2-HIGH')),
r AS (SELECT *, rank() OVER (PARTITION BY side, gene ORDER BY cnt) + (count(*) OVER (PARTITION BY side, gene, cnt) - 1) / 2 AS r FROM q),
t AS (SELECT side, gene, sum(n ** 3 - n) AS ties FROM (SELECT side, gene, cnt, count(*) AS n FROM q GROUP BY ALL) GROUP BY ALL),
s AS (SELECT side, gene, sum(r) FILTER (WHERE y = 1) AS rs, sum(y)::DOUBLE AS n1, count(*)::DOUBLE AS n FROM r GROUP BY ALL),
z AS (SELECT side, gene, (rs - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) / nullif(sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / nullif(n * (n - 1), 0))), 0) AS z FROM s JOIN t USING (side, gene)),
f AS (SELECT side, gene, CASE WHEN z > 0.8 THEN 'up' ELSE 'down' END AS direction FROM z WHERE abs(z) > 0.8),
b AS (SELECT coalesce(a.direction, c.direction) AS direction, count(a.gene) AS real, count(c.gene) AS synth, count(*) FILTER (WHERE a.gene IS NOT NULL AND c.gene IS NOT NULL) AS hit
  FROM (SELECT * FROM f WHERE side = 0) a FULL JOIN (SELECT * FROM f WHERE side = 1) c ON a.gene = c.gene AND a.direction = c.direction GROUP BY 1)
SELECT direction, real, synth, hit, round(hit / nullif(real, 0), 6) AS tpr, round((synth - hit) / nullif(32 - real, 0), 6) AS fpr, round(hit / nullif(synth, 0), 6) AS precision FROM b""")
def differential_recovery(spark, sf_dir):
    rows = dense(spark, sf_dir)
    out = metrics.recovery(_findings(rows, 0), _findings(rows, 1), ["direction"], 32)
    return out.withColumns({c: F.round(c, 6) for c in ("tpr", "fpr", "precision")})


_EDGES = f"""WITH {DENSE_SQL}, c AS (SELECT a.role % 2 AS side, greatest(a.gene, b.gene)::VARCHAR || '_' || least(a.gene, b.gene)::VARCHAR AS edge, CASE WHEN isfinite(corr(a.cnt, b.cnt)) THEN corr(a.cnt, b.cnt) END AS r FROM dense a JOIN dense b ON a.cell_id = b.cell_id AND a.gene < b.gene
  GROUP BY ALL), e AS (SELECT side, edge FROM c WHERE abs(r) > 0.01)"""


@query(_EDGES + "SELECT count(*) FILTER (WHERE s = 0) AS n_real, count(*) FILTER (WHERE s = 1) AS n_synth, (SELECT count(*) FROM (SELECT edge FROM e WHERE side = 0 INTERSECT SELECT edge FROM e WHERE side = 1)) AS shared FROM (SELECT side AS s FROM e)")
def coexpression_overlap(spark, sf_dir):
    cells = marginals.listed_counts(profile(spark, sf_dir).withColumn("side", (F.col("role") % 2).cast("int")), ["side"])
    edges = marginals.correlations_of(marginals.products_of(cells, ["side"]), ["side"]).where("gi < gj and abs(r) > 0.01").select("side", metrics.edge_key(F.col("gi"), F.col("gj")).alias("edge"))
    return edges.groupBy("edge").agg(F.max((F.col("side") == 0).cast("int")).alias("r"), F.max((F.col("side") == 1).cast("int")).alias("s")).agg(F.coalesce(F.sum("r"), F.lit(0)).alias("n_real"), F.coalesce(F.sum("s"), F.lit(0)).alias("n_synth"), F.coalesce(F.sum(F.col("r") * F.col("s")), F.lit(0)).alias("shared"))


@query(f"""WITH {DENSE_SQL}, m AS (SELECT gene, avg(cnt) FILTER (WHERE role = 0) AS a, avg(cnt) FILTER (WHERE role = 1) AS b FROM dense GROUP BY 1),
r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM m) SELECT round(corr(a, b), 6) AS pcc, round(corr(ra, rb), 6) AS scc FROM r""")
def mean_correlations(spark, sf_dir):
    """Pearson and Spearman correlation of the genes' means, over all genes."""
    means = dense(spark, sf_dir).where("role in (0, 1)").groupBy("gene").agg(F.avg(F.when(F.col("role") == 0, F.col("cnt"))).alias("a"), F.avg(F.when(F.col("role") == 1, F.col("cnt"))).alias("b"))
    ranked = marginals.average_ranks(means.withColumn("g", F.lit(0)), ["g"], "a").withColumnRenamed("rank", "ra")
    ranked = marginals.average_ranks(ranked, ["g"], "b").withColumnRenamed("rank", "rb")
    return ranked.agg(F.round(F.corr("a", "b"), 6).alias("pcc"), F.round(F.corr("ra", "rb"), 6).alias("scc"))


@query("""WITH s AS (SELECT o_orderpriority AS t, list(DISTINCT o_custkey) AS s FROM orders GROUP BY 1)
SELECT a.t AS a, b.t AS b, len(list_intersect(a.s, b.s))::INT AS shared, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM s a JOIN s b ON a.t < b.t""")
def jaccard_sets(spark, sf_dir):
    """Donors that two types share; a donor's types, five at most, make its pairs, and sets are never gathered."""
    each = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("d"), F.col("o_orderpriority").alias("t")).distinct()
    sizes = each.groupBy("t").agg(F.count("*").alias("n"))
    pairs = each.join(each.withColumnRenamed("t", "b"), "d").where("t < b").groupBy(F.col("t").alias("a"), "b").agg(F.count("*").cast("int").alias("shared"))
    both = pairs.join(sizes.select(F.col("t").alias("a"), F.col("n").alias("x")), "a").join(sizes.select(F.col("t").alias("b"), F.col("n").alias("y")), "b")
    return both.select("a", "b", "shared", F.round(F.col("shared") / (F.col("x") + F.col("y") - F.col("shared")), 6).alias("jaccard"))


@query(f"""WITH {CELLS_SQL}, {EXPR_SQL}, {_mask_sql("old", 0)}, {_mask_sql("new", 1)}
SELECT (count(*) FILTER (WHERE old.gene IS NOT NULL AND new.gene IS NOT NULL))::INT AS shared, count(*) FILTER (WHERE old.gene IS NOT NULL AND new.gene IS NOT NULL) / count(*) AS jaccard FROM old FULL JOIN new ON old.gene = new.gene""")
def hvg_overlap(spark, sf_dir):
    """How far the informative genes of training and holdout cells agree."""
    c = cells(spark, sf_dir)

    def chosen(role):
        part = c.where(F.col("role") == role)
        n = part.count()
        flagged = hvg_top(gene_dispersion(normalize_total(expr(spark, sf_dir).join(part.select("cell_id"), "cell_id", "left_semi")), n), 10)
        return flagged.where("highly_variable").agg(F.collect_set("gene").alias(f"g{role}"))

    both = chosen(0).crossJoin(chosen(1))  # one row each
    return both.select(F.size(F.array_intersect("g0", "g1")).alias("shared"), metrics.jaccard(F.col("g0"), F.col("g1")).alias("jaccard"))
