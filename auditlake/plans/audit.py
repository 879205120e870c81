"""Queries over membership evidence: distances, likelihood ratios, donor scores and AUC."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.functions import closeness, strings
from auditlake.functions.activation import activate, activate_from_logits
from auditlake.operators import marginals, membership, metrics, reports
from auditlake.plans.registry import query
from auditlake.sources.scratch import stored
from auditlake.sources.tables import table
from auditlake.sources.views import CELLS_SQL, DENSE_SQL, GENES, cells, counted, dense, expr, profile

BY = ["cell_type"]
KEYS = ["cell_id", "donor_id", "member"]


def _models(spark, sf_dir, smooth: float = 0.01):
    """Poisson models of training and auxiliary cells by type and gene; a little smoothing keeps log probabilities finite.

    A mean is a sum of nonzero counts over a number of cells, so zeros are never made rows.
    """
    counts = expr(spark, sf_dir).join(cells(spark, sf_dir).select("cell_id", *BY, "role"), "cell_id")
    return _fitted(counts.select(*BY, "role", "gene", F.col("cnt").alias("x")), cells(spark, sf_dir).select(*BY, "role", F.lit(1).alias("n")), smooth)


def _fitted(counts, sizes, smooth: float = 0.01):
    """The models from parts of sums of counts (x, by role and gene) and of numbers of cells (n, by role)."""
    of = {"s": F.col("role") == 0, "a": F.col("role").isin(2, 3)}
    sums = counts.groupBy(*BY, "gene").agg(*(F.sum(F.when(x, F.col("x"))).alias(f"sum_{k}") for k, x in of.items()))
    both = sizes.groupBy(*BY).agg(*(F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k, x in of.items())).where("n_s > 0 and n_a > 0")
    grid = both.withColumn("gene", F.explode(F.sequence(F.lit(0), F.lit(GENES - 1))))  # genes by types
    mu = lambda k: F.coalesce(F.col(f"sum_{k}"), F.lit(0)) / F.col(f"n_{k}") + smooth
    fit = lambda k: grid.join(sums, [*BY, "gene"], "left").select(*BY, "gene", F.lit(0.0).alias("pi"), F.lit(float("inf")).alias("theta"), mu(k).alias("mu"))
    return membership.shared_genes(fit("s"), fit("a"), BY)


def _targets(spark, sf_dir):
    return dense(spark, sf_dir).where("role in (0, 1)").withColumn("member", (F.col("role") == 0).cast("int"))


_MODEL_SQL = f"""{DENSE_SQL}, m AS (SELECT cell_type, gene, avg(cnt) FILTER (WHERE role = 0) + 0.01 AS mu_s, avg(cnt) FILTER (WHERE role IN (2, 3)) + 0.01 AS mu_a FROM dense GROUP BY ALL),
t AS (SELECT d.cell_id, d.donor_id, d.cell_type, d.subgroup, (role = 0)::INT AS member, gene, cnt, mu_s, mu_a FROM dense d JOIN m USING (cell_type, gene) WHERE role IN (0, 1))"""
_LLR_SQL = f"""WITH {_MODEL_SQL}, llr AS (SELECT cell_id, donor_id, cell_type, subgroup, member, sum(cnt * ln(mu_s / mu_a) - mu_s + mu_a) AS llr FROM t GROUP BY ALL),
donor AS (SELECT donor_id, any_value(subgroup) AS subgroup, avg(llr) AS score, max(member) AS member, count(*) AS n_cells FROM llr GROUP BY 1)"""


def _llr(spark, sf_dir, keep=()):
    """The Poisson ratio is linear in the count, so only genes that a cell has are met; the zeros' part is a sum of the model's means.

    That keeps the plan at the size of the nonzero counts: the models are genes by types and travel to the data.
    """
    m = _models(spark, sf_dir)
    zero = m.groupBy(*BY).agg(F.sum(F.col("mu_a") - F.col("mu_s")).alias("zero"))
    who = cells(spark, sf_dir).where("role in (0, 1)").withColumn("member", (F.col("role") == 0).cast("int"))
    slope = m.select(*BY, "gene", F.log(F.col("mu_s") / F.col("mu_a")).alias("slope"))
    seen = who.select("cell_id", *BY).join(expr(spark, sf_dir), "cell_id").join(slope, [*BY, "gene"]).groupBy("cell_id").agg(F.sum(F.col("cnt") * F.col("slope")).alias("seen"))
    rows = who.join(seen, "cell_id", "left").join(zero, BY)
    return rows.select(*KEYS, *BY, *keep, (F.coalesce("seen", F.lit(0.0)) + F.col("zero")).alias("llr"))


@query(_LLR_SQL + """, r AS (SELECT *, rank() OVER (ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY round(score, 9)) - 1) / 2 AS r FROM donor)
SELECT round((sum(r) FILTER (WHERE member = 1) - sum(member) * (sum(member) + 1) / 2) / (sum(member) * sum(1 - member)), 6) AS auc, sum(member)::BIGINT AS n_pos, sum(1 - member)::BIGINT AS n_neg FROM r""")
def donor_membership_auc(spark, sf_dir):
    """The flagship: likelihood ratio by cell, mean by donor, AUC of training against holdout donors."""
    donors = membership.donor_scores(_llr(spark, sf_dir), "llr").withColumn("score", F.round("score", 9))
    return metrics.roc_auc(donors, "member", "score").withColumn("auc", F.round("auc", 6))


@query(_LLR_SQL + "SELECT cell_id, donor_id, cell_type, member, round(llr, 6) AS llr FROM llr")
def class_b_llr(spark, sf_dir):
    return _llr(spark, sf_dir).withColumn("llr", F.round("llr", 6))


@query(f"""WITH {_MODEL_SQL} SELECT cell_id, round(sum(cnt * ln(mu_s) - mu_s - lgamma(cnt + 1)), 6) AS log_s, count(*) AS n_genes FROM t GROUP BY 1""")
def class_b_alone(spark, sf_dir):
    e = _evidence(spark, sf_dir)
    return e.select("cell_id", F.round("log_s", 6).alias("log_s"), "n_genes")


_CDF_SQL = """cdf AS (SELECT t.*, list_sum(list_transform(range(cnt + 1), lambda k: exp(k * ln(mu_s) - mu_s - lgamma(k + 1)))) AS u_s, list_sum(list_transform(range(cnt + 1), lambda k: exp(k * ln(mu_a) - mu_a - lgamma(k + 1)))) AS u_a,
  list_sum(list_transform(range(floor(mu_s)::INT + 1), lambda k: exp(k * ln(mu_s) - mu_s - lgamma(k + 1)))) AS c_s, list_sum(list_transform(range(floor(mu_a)::INT + 1), lambda k: exp(k * ln(mu_a) - mu_a - lgamma(k + 1)))) AS c_a FROM t)"""


@query(f"WITH {_MODEL_SQL}, {_CDF_SQL} SELECT cell_id, round(0.5 * (ln(greatest(12 * sum((u_a - 0.5) ** 2), 1e-300)) - ln(greatest(12 * sum((u_s - 0.5) ** 2), 1e-300))), 6) AS diag FROM cdf GROUP BY 1")
def class_b_diagonal(spark, sf_dir):
    e = _evidence(spark, sf_dir)
    return e.select("cell_id", F.round("diag", 6).alias("diag"))


# A fixed precision matrix with the same closed form in both engines: 1.2 on the diagonal, 0.3 ** distance off it.
_PRECISION = "CASE WHEN i.gene = j.gene THEN 1.2 ELSE 0.3 ** abs(i.gene - j.gene) END"
_DISTANCES_SQL = f"""{_CDF_SQL}, dist AS (SELECT i.cell_id, any_value(i.donor_id) AS donor_id, any_value(i.cell_type) AS cell_type, any_value(i.member) AS member,
  sqrt(greatest(sum((i.u_s - i.c_s) * {_PRECISION} * (j.u_s - j.c_s)), 0)) AS d_s, sqrt(greatest(sum((i.u_a - i.c_a) * {_PRECISION} * (j.u_a - j.c_a)), 0)) AS d_a
  FROM cdf i JOIN cdf j ON i.cell_id = j.cell_id GROUP BY 1)"""


def _precision(types):
    """(cell_type, p) of every type that has cells, the matrix row by row."""
    at = F.sequence(F.lit(0), F.lit(GENES - 1))
    row = lambda i: F.transform(at, lambda j: F.when(i == j, 1.2).otherwise(F.pow(F.lit(0.3), F.abs(i - j))))
    return types.withColumn("p", F.flatten(F.transform(at, row)))


def _counted(spark, sf_dir):
    """Cells stored once with their counts in an array; how often a type's and role's cells have a count (n; zeros left out); numbers of cells."""
    held = stored(counted(spark, sf_dir, "donor_id", "cell_type", "role"))
    seen = held.select(*BY, "role", F.posexplode("counts").alias("gene", "cnt")).where("cnt <> 0")
    return held, stored(seen.groupBy(*BY, "role", "gene", "cnt").agg(F.count("*").alias("n"))), stored(held.groupBy(*BY, "role").agg(F.count("*").alias("n")))


def _targets_and_values(spark, sf_dir, primary=None):
    """Training and holdout cells, and their distinct counts through the models; primary: a function of the two counts that marks genes."""
    held, seen, sizes = _counted(spark, sf_dir)
    model = stored(_fitted(seen.select(*BY, "role", "gene", (F.col("cnt").cast("long") * F.col("n")).alias("x")), sizes))
    distinct = seen.where("role in (0, 1)").select(*BY, "gene", "cnt").distinct().unionByName(model.select(*BY, "gene", F.lit(0).alias("cnt")))
    values = membership.mapped_counts(distinct, model, BY)
    values = stored(values if primary is None else values.join(primary(seen, sizes), [*BY, "gene"]))
    return held.where("role in (0, 1)").withColumn("member", (F.col("role") == 0).cast("int")), values


def _scored(spark, sf_dir, primary=None):
    """A row a cell: its evidence and both distances, from one look at its counts."""
    targets, values = _targets_and_values(spark, sf_dir, primary)
    return membership.listed_evidence(targets, values, KEYS, "cell_type", _precision(values.select("cell_type").distinct()), primary and "is_primary")


def _evidence(spark, sf_dir, deltas=""):
    return membership.listed_evidence(*_targets_and_values(spark, sf_dir), KEYS, "cell_type", deltas=deltas)


@query(f"WITH {_MODEL_SQL}, {_DISTANCES_SQL} SELECT cell_id, round(d_s, 6) AS d_s, round(d_a, 6) AS d_a, round(CASE WHEN d_s + d_a = 0 THEN 0.5 ELSE d_a / (d_s + d_a) END, 6) AS with_aux, round(1 / (d_s + 1e-4), 6) AS alone FROM dist")
def mahalanobis_both(spark, sf_dir):
    d = _scored(spark, sf_dir)
    s, a = F.col("d_s"), F.col("d_a")
    return d.select("cell_id", F.round(s, 6).alias("d_s"), F.round(a, 6).alias("d_a"), F.round(membership.distance_ratio(s, a), 6).alias("with_aux"), F.round(membership.closeness_only(s), 6).alias("alone"))


@query()
def mahalanobis_fitted(spark, sf_dir):
    """The production form: copula correlations of the training cells, their pseudo-inverse, one Arrow pass over cells."""
    d = dense(spark, sf_dir).where("role = 0")
    fitted = marginals.poisson_marginals(d, BY)
    p = membership.precision_tables(marginals.gaussian_copula(d, fitted, BY), "cell_type")
    return membership.fitted_distances(_evidence(spark, sf_dir, "s").select(*KEYS, *BY, F.col("delta_s").alias("delta")), p, "cell_id")


_QUAD_SQL = f"""WITH {_MODEL_SQL}, {_DISTANCES_SQL}, e AS (SELECT cell_id, sum(cnt * ln(mu_s / mu_a) - mu_s + mu_a) AS llr, count(*) AS n_genes FROM cdf GROUP BY 1),
quad AS (SELECT cell_id, donor_id, cell_type, member, CASE WHEN d_s + d_a = 0 THEN 0.5 ELSE d_a / (d_s + d_a) END AS standard_aux, 1 / (d_s + 1e-4) AS standard_alone,
  ln(d_a + 1e-4) - ln(d_s + 1e-4) + llr / sqrt(n_genes) AS b_aux, -ln(d_s + 1e-4) AS b_alone FROM dist JOIN e USING (cell_id))"""


def _quad(spark, sf_dir):
    return membership.quad_logits(_scored(spark, sf_dir))


CODES = {"standard_aux": "100", "standard_alone": "110", "b_aux": "101", "b_alone": "111"}


@query(_QUAD_SQL + "SELECT cell_id, attack, CASE attack WHEN 'standard_aux' THEN '100' WHEN 'standard_alone' THEN '110' WHEN 'b_aux' THEN '101' ELSE '111' END AS tm, round(score, 6) AS score FROM quad UNPIVOT (score FOR attack IN (standard_aux, standard_alone, b_aux, b_alone))")
def quad_long(spark, sf_dir):
    long = membership.to_long(_quad(spark, sf_dir), KEYS, CODES)
    return long.select("cell_id", "attack", "tm", F.round("score", 6).alias("score"))


@query(_QUAD_SQL + """, z AS (SELECT *, (b_aux - avg(b_aux) OVER w) / stddev_pop(b_aux) OVER w AS z FROM quad WINDOW w AS (PARTITION BY cell_type)),
c AS (SELECT *, 1 / (1 + exp(-(z - median(z) OVER (PARTITION BY cell_type)))) AS a FROM z),
d AS (SELECT donor_id, avg(a) AS score, max(member) AS member, count(*) AS n_cells FROM c GROUP BY 1),
l AS (SELECT *, (ln(score) - avg(ln(score)) OVER ()) / stddev_pop(ln(score)) OVER () AS z FROM d)
SELECT donor_id, member, n_cells, round(score, 6) AS score, round(1 / (1 + exp(-(z - median(z) OVER ()))), 6) AS activated FROM l""")
def donor_aggregate(spark, sf_dir):
    """One activation of cells, their mean by donor, and the donors' activation."""
    each = membership.cell_scores(_quad(spark, sf_dir), "cell_type", double=False)
    donors = membership.activated_donors(membership.donor_scores(each, "activated"))
    return donors.select("donor_id", "member", "n_cells", F.round("score", 6).alias("score"), F.round("activated", 6).alias("activated"))


@query(_QUAD_SQL + """, z AS (SELECT *, (b_aux - avg(b_aux) OVER w) / stddev_pop(b_aux) OVER w AS z FROM quad WINDOW w AS (PARTITION BY cell_type)),
c AS (SELECT cell_id, cell_type, ln(1 / (1 + exp(-(z - median(z) OVER (PARTITION BY cell_type))))) AS l FROM z),
y AS (SELECT *, (l - avg(l) OVER w) / stddev_pop(l) OVER w AS z FROM c WINDOW w AS (PARTITION BY cell_type))
SELECT cell_id, round(1 / (1 + exp(-(z - median(z) OVER (PARTITION BY cell_type)))), 6) AS activated FROM y""")
def cell_double_activation(spark, sf_dir):
    return membership.cell_scores(_quad(spark, sf_dir), "cell_type").select("cell_id", F.round("activated", 6).alias("activated"))


@query(_LLR_SQL + """, r AS (SELECT *, rank() OVER (PARTITION BY subgroup ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY subgroup, round(score, 9)) - 1) / 2 AS r FROM donor)
SELECT subgroup, count(*) AS n, round(avg(round(score, 9)), 6) AS mean_score, round(avg(round(score, 9)) FILTER (WHERE member = 1), 6) AS member_mean, round(avg(round(score, 9)) FILTER (WHERE member = 0), 6) AS other_mean,
round((sum(r) FILTER (WHERE member = 1) - sum(member) * (sum(member) + 1) / 2) / (sum(member) * sum(1 - member)), 6) AS auc,
round(avg(round(score, 9)) FILTER (WHERE member = 1) - avg(round(score, 9)) FILTER (WHERE member = 0), 6) AS score_gap FROM r GROUP BY 1""")
def subgroup_auc(spark, sf_dir):
    donors = membership.donor_scores(_llr(spark, sf_dir), "llr").withColumn("score", F.round("score", 9))
    named = reports.attach_subgroup(donors, cells(spark, sf_dir).select("donor_id", "subgroup"), "subgroup")
    out = reports.subgroup_metrics(named, "subgroup", 2)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_score", "member_mean", "other_mean", "auc", "score_gap")})


@query(f"""WITH {_MODEL_SQL}, {_CDF_SQL}, pairs AS (SELECT i.cell_id, sum((0.8 ** (j.gene - i.gene) + 0.7 ** (j.gene - i.gene)) / 2 * (1 - abs(i.u_s - j.u_s) / greatest(i.u_s, j.u_s)) / (1 - abs(i.u_a - j.u_a) / greatest(i.u_a, j.u_a) + 1e-4)) AS p
  FROM cdf i JOIN cdf j ON i.cell_id = j.cell_id AND i.gene < j.gene GROUP BY 1), own AS (SELECT cell_id, sum(0.17 * (1 - 2 * abs(u_s - 0.5)) / (1 - 2 * abs(u_s - 0.5) + 1e-4)) AS g FROM cdf GROUP BY 1)
SELECT cell_id, round(coalesce(p, 0) + g, 6) AS score FROM own LEFT JOIN pairs USING (cell_id)""")
def pairwise_score(spark, sf_dir):
    pairs = [(t, i, j, 0.8 ** (j - i), 0.7 ** (j - i)) for t in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW") for i in range(GENES) for j in range(i + 1, GENES)]
    corr = spark.createDataFrame(pairs, "cell_type string, gi int, gj int, r_s double, r_a double")
    return membership.pairwise_score(*_targets_and_values(spark, sf_dir), corr, "cell_type", KEYS).select("cell_id", F.round("score", 6).alias("score"))


_CLOSE_SQL = """WITH v AS (SELECT l_orderkey AS k, l_linenumber AS n, l_discount + 0.01 AS a, l_tax + 0.01 AS b, l_quantity / 25 - 1 AS c FROM lineitem)"""


@query(_CLOSE_SQL + """SELECT k, n, count(*) AS times, round(sum(1 - abs(a - b) / greatest(a, b)), 6) AS closeness_1, round(sum(CASE WHEN b / (a + 1e-9) > 1 THEN (a + 1e-9) / b ELSE b / (a + 1e-9) END), 6) AS closeness_2,
round(sum(CASE WHEN c >= 0 THEN 1 - abs(a - b) / greatest(a, b) ELSE 1 - abs(a - (1 - b)) / greatest(a, 1 - b) END), 6) AS closeness_3, round(sum(1 - abs(c * a + 0.5 - c / 2 - b)), 6) AS closeness_4 FROM v GROUP BY ALL""")
def closeness_functions(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_discount") + 0.01).alias("a"), (F.col("l_tax") + 0.01).alias("b"), (F.col("l_quantity") / 25 - 1).alias("c"))
    args = F.col("a"), F.col("b"), F.col("c")
    return v.groupBy("k", "n").agg(F.count("*").alias("times"), *(F.round(F.sum(f(*args)), 6).alias(name) for name, f in closeness.REGISTRY.items()))


_ACTIVATE_SQL = "SELECT o_orderkey, round(1 / (1 + exp(-(z - median(z) OVER (PARTITION BY o_orderpriority)))), 6) AS activated FROM (SELECT *, (x - avg(x) OVER (PARTITION BY o_orderpriority)) / stddev_pop(x) OVER (PARTITION BY o_orderpriority) AS z FROM (SELECT *, {} AS x FROM orders))"


@query(_ACTIVATE_SQL.format("ln(o_totalprice)"))
def activate_scores(spark, sf_dir):
    out = activate(table(spark, sf_dir, "orders"), F.col("o_totalprice"), "activated", ["o_orderpriority"])
    return out.select("o_orderkey", F.round("activated", 6).alias("activated"))


@query(_ACTIVATE_SQL.format("o_totalprice / 1000"))
def activate_logits(spark, sf_dir):
    out = activate_from_logits(table(spark, sf_dir, "orders"), F.col("o_totalprice") / 1000, "activated", ["o_orderpriority"])
    return out.select("o_orderkey", F.round("activated", 6).alias("activated"))


_BOUND_SQL = f"WITH {CELLS_SQL}, b AS (SELECT c.*, (role = 0)::INT AS member, o_totalprice / 1e5 AS s, (o_totalprice + 1000 * (o_orderkey % 17)) / 1e5 AS a FROM cells c JOIN orders ON o_orderkey = cell_id WHERE role IN (0, 1))"


def _bounds(spark, sf_dir):
    price = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell_id"), (F.col("o_totalprice") / 1e5).alias("s"), ((F.col("o_totalprice") + 1000 * (F.col("o_orderkey") % 17)) / 1e5).alias("a"))
    return cells(spark, sf_dir).where("role in (0, 1)").withColumn("member", (F.col("role") == 0).cast("int")).join(price, "cell_id")


@query(_BOUND_SQL + """, p AS (SELECT *, 1 / (1 + exp(-s / (stddev_pop(s) OVER () + 1e-8))) AS x FROM b) SELECT donor_id, max(member) AS member, round(1 / (1 + exp(-avg(x))), 6) AS score FROM p GROUP BY 1""")
def elbo_score(spark, sf_dir):
    return membership.elbo_scores(_bounds(spark, sf_dir), "s").withColumn("score", F.round("score", 6))


@query(_BOUND_SQL + """, m AS (SELECT *, least(min(s) OVER (), min(a) OVER ()) AS m FROM b), q AS (SELECT *, greatest(least((s - m + 1e-8) / (s - m + 1e-8 + a - m + 1e-8), 1 - 1e-8), 1e-8) AS p FROM m)
SELECT donor_id, max(member) AS member, round(avg(1 / (1 + exp(-ln(p / (1 - p))))), 6) AS score FROM q GROUP BY 1""")
def elbo_score_aux(spark, sf_dir):
    return membership.elbo_scores_aux(_bounds(spark, sf_dir), "s", "a").withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT o_orderpriority AS cell_type, o_orderkey AS cell_id, CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderkey % 1000 = 7 THEN NULL ELSE o_totalprice END AS score FROM orders)
SELECT * FROM s WHERE cell_type NOT IN (SELECT cell_type FROM s WHERE score IS NULL)""")
def broken_types_dropped(spark, sf_dir):
    hole = (F.col("o_orderpriority") == "3-MEDIUM") & (F.col("o_orderkey") % 1000 == 7)
    s = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cell_type"), F.col("o_orderkey").alias("cell_id"), F.when(~hole, F.col("o_totalprice")).alias("score"))
    return membership.drop_broken_groups(s, "cell_type", "score")


@query("""WITH t AS (SELECT o_orderkey, o_orderstatus = 'F' AS w, o_orderpriority < '3' AS a, o_custkey % 2 = 0 AS h FROM orders)
SELECT o_orderkey, CASE WHEN w THEN '0' ELSE '1' END || CASE WHEN a THEN '0' ELSE '1' END || CASE WHEN h THEN '0' ELSE '1' END AS code, CASE WHEN w THEN 'WB' ELSE 'BB' END || CASE WHEN a THEN '+aux' ELSE '-aux' END AS label FROM t""")
def threat_models(spark, sf_dir):
    """Code and label of what each trial's attacker knows; an order is a trial."""
    knows = (F.col("o_orderstatus") == "F", F.col("o_orderpriority") < "3", F.col("o_custkey") % 2 == 0)
    trials = table(spark, sf_dir, "orders").select("o_orderkey", strings.threat_code(*knows).alias("code"))
    return trials.withColumn("label", strings.threat_label(F.col("code")))


# The 16 genes of a type that most training cells have are primary: distances are theirs.
_PRIMARY = """zc AS (SELECT cell_type, gene, count(*) FILTER (WHERE cnt = 0) AS zeros FROM dense WHERE role = 0 GROUP BY cell_type, gene),
pr AS (SELECT cell_type, gene, row_number() OVER (PARTITION BY cell_type ORDER BY zeros, gene) <= 16 AS is_primary FROM zc)"""


def _primary(seen, sizes):
    train = seen.where("role = 0").groupBy(*BY, "gene").agg(F.sum("n").alias("nonzero"))
    grid = sizes.where("role = 0").select(*BY, "n", F.explode(F.sequence(F.lit(0), F.lit(GENES - 1))).alias("gene"))
    zeros = grid.join(train, [*BY, "gene"], "left").withColumn("zeros", F.col("n") - F.coalesce("nonzero", F.lit(0)))
    w = Window.partitionBy(*BY).orderBy("zeros", "gene")  # genes of a type
    return zeros.select(*BY, "gene", (F.row_number().over(w) <= 16).alias("is_primary"))


_VARIANTS_SQL = ", ".join(f"('{v}', '{g}', '{k}', {'NULL' if w is None else w}::DOUBLE)" for v, g, k, w in membership.VARIANTS)


@query(f"""WITH {_MODEL_SQL}, {_CDF_SQL}, {_PRIMARY}, x AS (SELECT cdf.*, is_primary, cnt * ln(mu_s) - mu_s - lgamma(cnt + 1) AS l_s, cnt * ln(mu_a) - mu_a - lgamma(cnt + 1) AS l_a FROM cdf JOIN pr USING (cell_type, gene)),
d AS (SELECT i.cell_id, sqrt(greatest(sum((i.u_s - i.c_s) * {_PRECISION} * (j.u_s - j.c_s)), 0)) AS d_s, sqrt(greatest(sum((i.u_a - i.c_a) * {_PRECISION} * (j.u_a - j.c_a)), 0)) AS d_a FROM x i JOIN x j ON i.cell_id = j.cell_id AND i.is_primary AND j.is_primary GROUP BY 1),
e AS (SELECT cell_id, any_value(donor_id) AS donor_id, any_value(member) AS member, g.genes, sum(l_s - l_a) AS llr, sum(l_s) AS log_s, sqrt(12 * sum((u_s - 0.5) ** 2)) AS off_s, sqrt(12 * sum((u_a - 0.5) ** 2)) AS off_a, count(*) AS n
  FROM x, (VALUES ('secondary'), ('all')) g(genes) WHERE g.genes = 'all' OR NOT is_primary GROUP BY cell_id, g.genes),
v AS (SELECT * FROM (VALUES {_VARIANTS_SQL}) t(variant, genes, kind, gamma)),
l AS (SELECT variant, donor_id, member, ln(d_a + 1e-4) - ln(d_s + 1e-4) + coalesce(gamma, 1 / sqrt(n)) * CASE kind WHEN 'llr' THEN llr ELSE ln(off_a + 1e-4) - ln(off_s + 1e-4) END AS aux,
  -ln(d_s + 1e-4) + coalesce(gamma, 1 / sqrt(n)) * CASE kind WHEN 'llr' THEN log_s ELSE -ln(off_s + 1e-4) END AS noaux FROM e JOIN v USING (genes) JOIN d USING (cell_id)),
s AS (SELECT variant, side, donor_id, member, x FROM l UNPIVOT (x FOR side IN (aux, noaux))),
z AS (SELECT *, (x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) AS z FROM s WINDOW w AS (PARTITION BY variant, side)),
a AS (SELECT *, 1 / (1 + exp(-(z - median(z) OVER (PARTITION BY variant, side)))) AS a FROM z),
o AS (SELECT variant, side, donor_id, round(avg(a), 9) AS score, max(member) AS member, count(*) AS n FROM a GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY variant, side ORDER BY score) + (count(*) OVER (PARTITION BY variant, side, score) - 1) / 2 AS r FROM o)
SELECT variant, side, round((sum(r) FILTER (WHERE member = 1) - sum(member) * (sum(member) + 1) / 2) / (sum(member) * sum(1 - member)), 6) AS auc, sum(n)::BIGINT AS n_cells FROM r GROUP BY ALL""")
def ablation_variants(spark, sf_dir):
    """Donor AUC of all eighteen variants with and without auxiliary evidence, from one grouping of each cell's genes."""
    cells_of = _scored(spark, sf_dir, _primary).repartition("donor_id")  # a donor's cells lie together before they are widened
    donors = stored(membership.ablation_scores(membership.ablation_logits(cells_of, ["donor_id", "member"])).withColumn("score", F.round("score", 9)))
    sizes = donors.groupBy("variant", "side").agg(F.sum("n_cells").alias("n_cells"))
    auc = metrics.roc_auc(donors, "member", "score", ["variant", "side"]).select("variant", "side", F.round("auc", 6).alias("auc"))
    return auc.join(sizes, ["variant", "side"])


@query(f"""WITH {DENSE_SQL}, zc AS (SELECT cell_type, gene, avg(cnt) + 0.01 AS mu, count(*) FILTER (WHERE cnt = 0) AS zeros FROM dense WHERE role = 0 GROUP BY cell_type, gene),
zr AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY zeros, gene) AS r FROM zc), own AS (SELECT cell_type, gene, mu, r <= 12 AS is_primary FROM zr WHERE r <= 20),
t AS (SELECT d.cell_id, d.cell_type, gene, cnt, mu, is_primary FROM dense d JOIN own USING (cell_type, gene) WHERE role IN (0, 1)),
x AS (SELECT *, list_sum(list_transform(range(cnt + 1), lambda k: exp(k * ln(mu) - mu - lgamma(k + 1)))) - list_sum(list_transform(range(floor(mu)::INT + 1), lambda k: exp(k * ln(mu) - mu - lgamma(k + 1)))) AS d, cnt * ln(mu) - mu - lgamma(cnt + 1) AS l FROM t),
q AS (SELECT i.cell_id, sqrt(greatest(sum(i.d * {_PRECISION} * j.d), 0)) AS d_s FROM x i JOIN x j ON i.cell_id = j.cell_id AND i.is_primary AND j.is_primary GROUP BY 1),
e AS (SELECT cell_id, sum(l) FILTER (WHERE NOT is_primary) AS log_s, count(*) FILTER (WHERE NOT is_primary) AS n FROM x GROUP BY 1)
SELECT cell_id, round(1 / (d_s + 1e-4), 6) AS standard_alone, round(-ln(d_s + 1e-4) + log_s / sqrt(n), 6) AS b_alone FROM q JOIN e USING (cell_id)""")
def alone_on_own_genes(spark, sf_dir):
    """Scores without auxiliary data on the training model's own twenty genes a type, twelve of them with correlations."""
    train = dense(spark, sf_dir).where("role = 0").groupBy(*BY, "gene").agg((F.avg("cnt") + 0.01).alias("mu_s"), F.count_if(F.col("cnt") == 0).alias("zeros"))
    w = Window.partitionBy(*BY).orderBy("zeros", "gene")  # genes of a type
    own = stored(train.withColumn("r", F.row_number().over(w)).where("r <= 20").select(*BY, "gene", "mu_s", F.lit(0.0).alias("pi_s"), F.lit(float("inf")).alias("theta_s"), (F.col("r") <= 12).alias("is_primary")))
    rows = membership.mapped(_targets(spark, sf_dir), own, BY, "s")
    at = own.groupBy(*BY).agg(F.array_sort(F.collect_list("gene")).alias("g"))
    row = lambda i: F.transform("g", lambda j: F.when(i == j, 1.2).otherwise(F.pow(F.lit(0.3), F.abs(i - j))))
    p = at.select(*BY, F.flatten(F.transform("g", row)).alias("p"))
    d = membership.fitted_distances(membership.own_evidence(rows, KEYS, BY, F.col("is_primary")), p, "cell_id", sides={"delta_s": "d_s"})
    return membership.alone_scores(d).select("cell_id", F.round("standard_alone", 6).alias("standard_alone"), F.round("b_alone", 6).alias("b_alone"))


@query(f"""WITH {_MODEL_SQL}, {_DISTANCES_SQL}, ev AS (SELECT cell_id, sum(cnt * ln(mu_s / mu_a) - mu_s + mu_a) AS llr FROM cdf GROUP BY 1),
x AS (SELECT donor_id, member, gamma, ln(d_a + 1e-4) - ln(d_s + 1e-4) + gamma * llr AS x FROM dist JOIN ev USING (cell_id), (VALUES (0.0::DOUBLE), (0.1), (0.25), (0.5), (1.0), (2.0)) g(gamma)),
dn AS (SELECT gamma, donor_id, round(avg(x), 9) AS score, max(member) AS member FROM x GROUP BY gamma, donor_id),
r AS (SELECT *, rank() OVER (PARTITION BY gamma ORDER BY score) + (count(*) OVER (PARTITION BY gamma, score) - 1) / 2 AS r FROM dn)
SELECT gamma, round((sum(r) FILTER (WHERE member = 1) - sum(member) * (sum(member) + 1) / 2) / (sum(member) * sum(1 - member)), 6) AS auc, sum(member)::BIGINT AS n_pos, sum(1 - member)::BIGINT AS n_neg FROM r GROUP BY gamma""")
def ablation_grid(spark, sf_dir):
    """AUC of every weight of the evidence, from one pass over the cells' distances and ratios."""
    gammas = (0.0, 0.1, 0.25, 0.5, 1.0, 2.0)
    logit = lambda g: F.log(F.col("d_a") + 1e-4) - F.log(F.col("d_s") + 1e-4) + F.lit(g) * F.col("llr")
    each = _scored(spark, sf_dir).select("donor_id", "member", *(logit(g).alias(f"x{i}") for i, g in enumerate(gammas)))
    donors = membership.donor_means(each, [f"x{i}" for i in range(len(gammas))]).withColumn("gamma", F.array(*map(F.lit, gammas))[F.col("i")])
    return metrics.roc_auc(donors.withColumn("score", F.round("score", 9)), "member", "score", ["gamma"]).withColumn("auc", F.round("auc", 6))


@query()
def mvn_generator(spark, sf_dir):
    v = profile(spark, sf_dir).where("role = 0").select("cell_type", F.col("counts").cast("array<double>").alias("v"))
    return membership.mvn_groups(v, "cell_type", 0.1)
