"""Queries over factors and clusters, neighbour graphs, mixing, batch adjustment, medians and curves at scale."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditlake.operators import adjust, baselines, communities, factors, generators, metrics
from auditlake.operators.ranges import grouped_median, joined
from auditlake.plans.registry import query
from auditlake.sources import storage
from auditlake.sources.arrays import ArrayFiles
from auditlake.sources.scratch import shared_dir, stored
from auditlake.sources.tables import table
from auditlake.sources.views import CELLS_SQL, DENSE_SQL, EXPR_SQL, VECTORS_SQL, cells, dense, expr, profile, vectors
from auditlake.streaming import results

_D2 = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) ** 2))"


def _cells(spark, sf_dir):
    return profile(spark, sf_dir).where("role = 0").select("cell_id", "cell_type", F.col("counts").cast("array<double>").alias("v"))


@query()
def factor_objective(spark, sf_dir):
    """Squared error of the factorisation before each pass and after the last."""
    model = factors.fit_factors(_cells(spark, sf_dir), "cell_id", rank=4, passes=6)
    return spark.createDataFrame(list(enumerate(model.objective)), "pass int, objective double")


@query()
def factor_generator(spark, sf_dir):
    """Synthetic cells: noisy factors, noisy clusters in their space, noisy summaries, draws, and labels at class probabilities."""
    cells = stored(_cells(spark, sf_dir))
    model = factors.fit_factors(cells, "cell_id", rank=4, passes=4, batches=4).noised(0.01)
    weights = stored(model.weights(cells, "cell_id", keep=("cell_type",)))
    clusters = factors.cluster_weights(weights, "cell_id", 5, epsilon=2.1)
    rows = cells.select("cell_id", F.posexplode("v").alias("gene", "cnt")).join(clusters, "cell_id")
    drawn = factors.draw_cells(spark, factors.cluster_summaries(rows, "cluster", epsilon=0.2), cells.count())
    placed = model.weights(drawn.withColumn("x", F.col("v")), "draw", "x", keep=("cluster", "v"))
    labelled = factors.draw_labels(factors.fit_labels(weights, "cell_type"), placed, "draw", "cell_type")
    return labelled.select("draw", "cluster", "cell_type", F.posexplode("v").alias("gene", "cnt"))


@query()
def generators_reloaded(spark, sf_dir):
    """Means of what every registered generator draws after it was trained, saved and loaded again."""
    out, cells = None, stored(_cells(spark, sf_dir))
    for name in sorted(generators.REGISTRY):
        path = _scratch(spark, name)
        generators.train(name, cells, "cell_id", "cell_type").save(path)
        drawn = generators.load(spark, path).generate()
        means = drawn.select("cell_type", F.posexplode("v").alias("gene", "x")).groupBy("cell_type", "gene").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"))
        named = means.withColumn("generator", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


@query(f"WITH {DENSE_SQL} SELECT cell_type AS cluster, gene, count(*) AS n, round(avg(cnt), 9) AS mean, round(greatest(var_pop(cnt), 1e-6), 6) AS variance, round(avg((cnt = 0)::INT), 9) AS zero_share FROM dense WHERE role = 0 GROUP BY ALL")
def cluster_moments(spark, sf_dir):
    """The generator's summaries without noise, types being the clusters."""
    rows = dense(spark, sf_dir).where("role = 0").withColumnRenamed("cell_type", "cluster")
    out = factors.cluster_summaries(rows, "cluster")
    return out.select("cluster", "gene", "n", F.round("mean", 9).alias("mean"), F.round("variance", 6).alias("variance"), F.round("zero_share", 9).alias("zero_share"))


@query(f"WITH {DENSE_SQL}, m AS (SELECT cell_type, gene, round(avg(cnt)) AS mean FROM dense WHERE role = 0 GROUP BY ALL) SELECT round(sqrt(sum((cnt - mean) ** 2)), 4) AS error FROM dense JOIN m USING (cell_type, gene) WHERE role = 0")
def reconstruction_error(spark, sf_dir):
    """Frobenius distance of the counts from their cluster's rounded means."""
    rows = dense(spark, sf_dir).where("role = 0")
    means = factors.cluster_summaries(rows, "cell_type").select("cell_type", "gene", F.round("mean").alias("cnt"))
    rebuilt = rows.select("cell_id", "cell_type", "gene").join(means, ["cell_type", "gene"])
    return factors.frobenius_error(rows.withColumn("cnt", F.col("cnt").cast("double")), rebuilt, ["cell_id", "gene"], "cnt").withColumn("error", F.round("error", 4))


def _scored(spark, sf_dir):
    """method, y, score: three simple scores of quality, a row each."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    each = {"length": F.col("n_chars"), "shortness": -F.col("n_chars"), "hundreds": F.expr("n_chars div 100")}
    methods = F.array(*(F.struct(F.lit(m).alias("method"), c.cast("long").alias("score")) for m, c in each.items()))
    return both.select(F.col("quality").alias("y"), F.explode(methods).alias("s")).select("y", "s.*")


_SCORED = """WITH j AS (SELECT l.quality AS y, d.n_chars FROM labels l JOIN documents d USING (doc_id)),
b AS (SELECT y, 'length' AS method, n_chars AS score FROM j UNION ALL SELECT y, 'shortness', -n_chars FROM j UNION ALL SELECT y, 'hundreds', n_chars // 100 FROM j),
h AS (SELECT method, score AS threshold, sum(y)::DOUBLE AS p, count(*)::DOUBLE AS n FROM b GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n - p) OVER w AS fp, sum(p) OVER m AS pos, sum(n - p) OVER m AS neg FROM h WINDOW w AS (PARTITION BY method ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING), m AS (PARTITION BY method))"""


@query(_SCORED + " SELECT method, threshold, tp, fp, round(tp / pos, 9) AS tpr, round(fp / neg, 9) AS fpr, round(tp / (tp + fp), 9) AS precision FROM c")
def method_curves(spark, sf_dir):
    """All methods' curves in one table."""
    c = metrics.curve(_scored(spark, sf_dir), "y", "score", ["method"])
    return c.select("method", "threshold", "tp", "fp", *(F.round(x, 9).alias(x) for x in ("tpr", "fpr", "precision")))


@query(_SCORED + """, s AS (SELECT *, tp - p AS tp0, fp - (n - p) AS fp0 FROM c), q AS (SELECT *, CASE WHEN tp0 + fp0 > 0 THEN tp0 / (tp0 + fp0) ELSE 1 END AS p0 FROM s),
r AS (SELECT method, y, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2 AS r FROM b),
a AS (SELECT method, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc FROM r GROUP BY 1)
SELECT method, round(any_value(auc), 6) AS auc, round(sum((tp - tp0) / pos * tp / (tp + fp)), 6) AS average_precision, round(sum((tp - tp0) / pos * (tp / (tp + fp) + p0) / 2), 6) AS pr_auc,
round(max((tp0 + neg - fp0) / (pos + neg)), 6) AS accuracy_best, round(max(2 * tp0 / (tp0 + fp0 + pos)), 6) AS f1_best FROM q JOIN a USING (method) GROUP BY 1""")
def method_metrics(spark, sf_dir):
    """All methods' areas and best thresholds in one pass."""
    m = metrics.threshold_metrics(_scored(spark, sf_dir), "y", "score", ["method"])
    return m.select("method", *(F.round(c, 6).alias(c) for c in ("auc", "average_precision", "pr_auc", "accuracy_best", "f1_best")))


def _scratch(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {CELLS_SQL}, {EXPR_SQL} SELECT cell_id, donor_id, gene, cnt FROM cells JOIN expr USING (cell_id) WHERE cell_type = '1-URGENT' AND role IN (0, 1)")
def stored_slice(spark, sf_dir):
    """Cells and counts stored by type; one type's folders are read and joined."""
    c, e = cells(spark, sf_dir), expr(spark, sf_dir)
    kept = [_scratch(spark, n) for n in ("cells", "counts")]
    storage.store_by(c, kept[0], "cell_type", 4)
    storage.store_by(e.join(c.select("cell_id", "cell_type"), "cell_id"), kept[1], "cell_type", 4)
    one, counts = (storage.read_slice(spark, p, "cell_type", ["1-URGENT"]) for p in kept)
    return one.where("role in (0, 1)").select("cell_id", "donor_id").join(counts.select("cell_id", "gene", "cnt"), "cell_id")


@query(f"WITH {CELLS_SQL} SELECT (cell_id % 4)::INT AS part, donor_id AS donor, count(*) AS n FROM cells GROUP BY ALL")
def array_files(spark, sf_dir):
    """Donors of cells written as array files, a folder a part, and read back by slices."""
    spark.dataSource.register(ArrayFiles)
    where, out = _scratch(spark, "arrays"), None
    for part in range(4):
        donors = cells(spark, sf_dir).where(F.col("cell_id") % 4 == part).select(F.col("donor_id").cast("long").alias("value"))
        donors.write.format("npy").mode("overwrite").option("path", f"{where}/{part}").save()
        back = spark.read.format("npy").option("path", f"{where}/{part}").load().select(F.lit(part).alias("part"), F.col("value").alias("donor"))
        out = back if out is None else out.unionByName(back)
    return out.groupBy("part", "donor").agg(F.count("*").alias("n"))


@query("SELECT user_id AS donor_id, round(avg(value), 6) AS score, count(*) AS n FROM events GROUP BY 1")
def followed_donor_means(spark, sf_dir):
    """Donor means kept as a stream's state, appended batch by batch; the last ones of each donor."""
    static = table(spark, sf_dir, "events")
    place = f"{sf_dir}/event[s].parquet"  # a pattern may name one file, a path only a folder
    stream = spark.readStream.schema(static.schema).parquet(place).select(F.col("user_id").alias("donor_id"), F.col("value").alias("score"))
    out, check = _scratch(spark, "means"), _scratch(spark, "stream")
    results.follow_donor_means(stream, out, check)
    return results.latest_donor_means(spark, out).withColumn("score", F.round("score", 6))


@query("SELECT doc_id, source, median(n_chars) OVER (PARTITION BY source)::DOUBLE AS median, n_chars - median(n_chars) OVER (PARTITION BY source)::DOUBLE AS above FROM documents")
def grouped_medians(spark, sf_dir):
    """Every document's length against its source's exact median; one source has most rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    met = joined(docs, grouped_median(docs, "n_chars", ["source"]), ["source"], "left")
    return met.select("doc_id", "source", "median", (F.col("n_chars") - F.col("median")).alias("above"))


def _graph(spark, sf_dir, k=10):
    v = vectors(spark, sf_dir)
    return communities.undirected(baselines.nearest_k(v, v, "vec_id", k))


_GRAPH = f"""{VECTORS_SQL}, near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_D2}, 12), b.vec_id) <= 10),
one AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM near), edges AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one)"""


@query(f"""WITH {_GRAPH}, n AS (SELECT x.label AS ca, y.label AS cb FROM edges JOIN vecs x ON edges.a = x.vec_id JOIN vecs y ON edges.b = y.vec_id),
d AS (SELECT ca, count(*) AS k, count(*) FILTER (WHERE ca = cb) AS i FROM n GROUP BY 1) SELECT round(sum(i) / sum(k) - sum(k * k) / sum(k) ** 2, 9) AS modularity FROM d""")
def label_modularity(spark, sf_dir):
    """Modularity of the labels on the neighbour graph."""
    places = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("c"))
    return communities.modularity(_graph(spark, sf_dir), places).withColumn("modularity", F.round("modularity", 9))


@query()
def graph_clusters(spark, sf_dir):
    """Communities of the neighbour graph."""
    return communities.modularity_clusters(_graph(spark, sf_dir))[0]


@query()
def cluster_agreement(spark, sf_dir):
    """Adjusted Rand index of the labels with the neighbour graph's communities."""
    found = communities.modularity_clusters(_graph(spark, sf_dir))[0]
    return metrics.adjusted_rand(vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label").join(found, "id"), "label", "c")


@query()
def perplexity_mixing(spark, sf_dir):
    """Mixing of the parts around each vector, neighbours weighted to a perplexity."""
    v = vectors(spark, sf_dir)
    parts = v.select("vec_id", F.col("part").alias("batch"))
    near = baselines.nearest_k(v, v, "vec_id", 30)
    return metrics.scaled_mixing(metrics.local_mixing(near, parts, "vec_id", 10.0), parts)


def _two_parts(spark, sf_dir):
    return vectors(spark, sf_dir).where("part < 2").select("vec_id", "part", "v")


@query(f"""WITH {VECTORS_SQL}, x AS (SELECT vec_id, part, unnest(range(len(v)))::INT AS gene, unnest(v) AS x FROM vecs WHERE part < 2),
s AS (SELECT gene, part, count(*)::DOUBLE AS n, avg(x) AS m, var_pop(x) AS vp, var_samp(x) AS vs FROM x GROUP BY ALL), g AS (SELECT gene, sum(n * m) / sum(n) AS grand, sum(n * vp) / sum(n) AS pooled FROM s GROUP BY 1)
SELECT vec_id, gene, round(grand + sqrt(pooled) * (((x - grand) / sqrt(pooled) - (m - grand) / sqrt(pooled)) / sqrt(vs / pooled)), 6) AS x FROM x JOIN s USING (gene, part) JOIN g USING (gene)""")
def batch_location_scale(spark, sf_dir):
    """Every component brought to the parts' common location and scale, without shrinking."""
    out = adjust.adjust_batches(_two_parts(spark, sf_dir), "part", empirical_bayes=False)
    return out.select("vec_id", F.posexplode("v").alias("gene", "x")).withColumn("x", F.round("x", 6))


@query()
def adjusted_discriminator(spark, sf_dir):
    """Held-out AUC of a forest that tells the parts apart after their batch effects, shrunk by empirical Bayes, are taken out."""
    v = adjust.adjust_batches(_two_parts(spark, sf_dir), "part")
    return metrics.discriminator_auc(v.where("part = 0"), v.where("part = 1"), "vec_id", trees=200)


@query(f"""WITH {DENSE_SQL}, q AS (SELECT role % 2 AS side, gene, cell_type AS t, cnt FROM dense),
p AS (SELECT x.side, x.gene, x.t AS a, y.t AS b, x.cnt AS ca, y.cnt AS cb, x.n AS na, y.n AS nb FROM (SELECT side, gene, t, cnt, count(*)::DOUBLE AS n FROM q GROUP BY ALL) x JOIN (SELECT side, gene, t, cnt, count(*)::DOUBLE AS n FROM q GROUP BY ALL) y ON x.side = y.side AND x.gene = y.gene AND x.t < y.t),
u AS (SELECT side, gene, a, b, sum(na * nb * CASE WHEN ca > cb THEN 1 WHEN ca = cb THEN 0.5 ELSE 0 END) AS u FROM p GROUP BY ALL),
k AS (SELECT DISTINCT a, b FROM u), ties AS (SELECT side, gene, a, b, sum(n ** 3 - n) AS ties, sum(n1) AS n1, sum(n) - sum(n1) AS n0 FROM (SELECT side, gene, a, b, cnt, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE t = a))::DOUBLE AS n1 FROM q JOIN k ON q.t = k.a OR q.t = k.b GROUP BY ALL) GROUP BY ALL),
z AS (SELECT side, gene, a, b, (u - n1 * n0 / 2) / nullif(sqrt(greatest(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1))), 0)), 0) AS z FROM u JOIN ties USING (side, gene, a, b)),
f AS (SELECT side, gene, a, b, CASE WHEN z > 0 THEN 'up' ELSE 'down' END AS direction FROM z WHERE abs(z) > {metrics.ONE_SIDED}),
m AS (SELECT coalesce(r.a, s.a) AS a, coalesce(r.b, s.b) AS b, coalesce(r.direction, s.direction) AS direction, count(r.gene) AS real, count(s.gene) AS synth, count(*) FILTER (WHERE r.gene IS NOT NULL AND s.gene IS NOT NULL) AS hit
  FROM (SELECT * FROM f WHERE side = 0) r FULL JOIN (SELECT * FROM f WHERE side = 1) s ON r.gene = s.gene AND r.a = s.a AND r.b = s.b AND r.direction = s.direction GROUP BY ALL),
e AS (SELECT a, b, direction FROM k, (VALUES ('up'), ('down')) d(direction))
SELECT a, b, direction, coalesce(real, 0) AS real, coalesce(synth, 0) AS synth, coalesce(hit, 0) AS hit, round(hit / nullif(real, 0), 6) AS tpr, round(coalesce((synth - hit) / nullif(32 - real, 0), 0), 6) AS fpr, round(hit / nullif(synth, 0), 6) AS precision FROM e LEFT JOIN m USING (a, b, direction)""")
def pairwise_differential_recovery(spark, sf_dir):
    """Findings of every pair of types, one side held against the other; p < 0.05, one-sided."""
    rows = dense(spark, sf_dir).select((F.col("role") % 2).alias("side"), "gene", "cell_type", "cnt")
    z = metrics.pairwise_rank_sums(rows, "cell_type", "cnt", ["side", "gene"])
    out = metrics.pairwise_recovery(z.where("side = 0"), z.where("side = 1"), 32)
    return out.withColumns({c: F.round(c, 6) for c in ("tpr", "fpr", "precision")})
