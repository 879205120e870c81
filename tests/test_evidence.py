"""Evidence of cells that keep their counts in an array, and scores of many variants at once."""

import math

import pytest
from pyspark.sql import functions as F

from auditlake.functions.closeness import NUMPY
from auditlake.operators import membership, ranges
from auditlake.plans.registry import QUERIES
from auditlake.sources import views

BY, KEYS = ["cell_type"], ["cell_id", "donor_id", "member"]


@pytest.mark.parametrize("name", ["scores_without_matrix", "dispatched_scores", "pairwise_score", "quad_long", "class_b_diagonal"])
def test_cells_are_not_taken_apart(spark, name):
    """A row for each cell and gene was made, joined with its mapped count and gathered again by cell."""
    assert "posexplode" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def _small(spark):
    counts = F.array(*(F.pmod(F.xxhash64("id", F.lit(g)), F.lit(6)).cast("int") for g in range(5)))
    kind = F.when(F.col("id") < 90, F.concat(F.lit("t"), (F.col("id") % 3).cast("string")))
    cells = spark.range(100).select(F.col("id").alias("cell_id"), (F.col("id") % 7).alias("donor_id"), F.lit(1).alias("member"), kind.alias("cell_type"), counts.alias("counts"))
    grid = spark.createDataFrame([(f"t{t}", g, 0.1, 2.0, 1.0 + g + t, 0.0, float("inf"), 2.0 + t) for t in (0, 1) for g in (0, 2, 3, 4)], "cell_type string, gene int, pi_s double, theta_s double, mu_s double, pi_a double, theta_a double, mu_a double")
    rows = cells.select(*KEYS, *BY, F.posexplode("counts").alias("gene", "cnt"))
    mark = F.col("gene") < 3
    values = membership.mapped_counts(rows.select(*BY, "gene", "cnt").distinct(), grid, BY).withColumn("mark", mark)
    p = spark.createDataFrame([("t0", [1.0 + i % 5 if i % 5 == 0 else 0.1 for i in range(16)])], "cell_type string, p array<double>")
    return cells, rows, grid, mark, values, p


def test_evidence_of_arrays_is_that_of_rows(spark, monkeypatch):
    """Types without a model or a name go, a type without a matrix has no distances, genes without a model don't count."""
    cells, rows, grid, mark, values, p = _small(spark)
    old = membership.cell_evidence(membership.mapped(rows, grid, BY), KEYS, BY, mark)
    want = {r["cell_id"]: r for r in membership.fitted_distances(old, p, "cell_id", sides={"delta_s": "d_s", "delta_a": "d_a"}).collect()}
    deltas = {r["cell_id"]: r for r in old.collect()}
    monkeypatch.setattr(membership, "AT_ONCE", 15)
    got = membership.listed_evidence(cells, values, KEYS, "cell_type", p, "mark", "sa", part=7).collect()
    assert len(got) == len(want) == 60
    for r in got:
        for c in r.asDict():
            if c.startswith("delta"):
                assert r[c] == pytest.approx(deltas[r["cell_id"]][c], abs=1e-12)
            elif isinstance(r[c], float) and not math.isnan(r[c]):
                assert r[c] == pytest.approx(want[r["cell_id"]][c], abs=1e-9)
            elif r[c] is None:
                assert r["cell_type"] == "t1" and c in ("d_s", "d_a") and (want[r["cell_id"]][c] is None or math.isnan(want[r["cell_id"]][c]))
            else:
                assert r[c] == want[r["cell_id"]][c]


def test_an_unmapped_count_is_an_error(spark):
    cells, _, _, _, values, _ = _small(spark)
    with pytest.raises(Exception, match="isn't among the mapped ones"):
        membership.listed_evidence(cells, values.where("cnt <> 4"), KEYS, "cell_type").collect()


def test_means_of_several_scores_are_those_of_each(spark):
    cells = spark.createDataFrame([(1, 1, 0.5, None), (1, 1, 1.5, 2.0), (2, 0, 3.0, None)], "donor_id int, member int, a double, b double")
    got = {(r["i"], r["donor_id"]): (r["score"], r["member"], r["n_cells"]) for r in membership.donor_means(cells, ["a", "b"]).collect()}
    for i, c in enumerate("ab"):
        assert {d: x for (k, d), x in got.items() if k == i} == {r["donor_id"]: (r["score"], r["member"], r["n_cells"]) for r in membership.donor_scores(cells, c).collect()}
    with pytest.raises(Exception, match="two memberships"):
        membership.donor_means(cells.withColumn("member", F.col("a").cast("int")), ["a"]).collect()


@pytest.mark.parametrize("held", [False, True])
def test_median_beside_far_and_endless_values(spark, held):
    """Even cuts about the mean: a far value leaves them too wide, an endless one leaves none, equal values are one."""
    x = F.when(F.col("g") == 0, F.when(F.col("id") == 0, 1e12).otherwise(F.col("id"))).when(F.col("g") == 1, F.when(F.col("id") == 1, float("inf")).otherwise(-F.col("id"))).when(F.col("g") == 2, 4.0).otherwise(F.col("id"))
    rows = spark.range(2000).withColumn("g", F.when(F.col("id") < 1996, F.col("id") % 4)).withColumn("x", x.cast("double"))
    got = {r["g"]: r["median"] for r in ranges.grouped_median(rows, "x", ["g"], parts=8, enough=40, held=held).collect()}
    want = {r["g"]: r["m"] for r in rows.groupBy("g").agg(F.median("x").alias("m")).collect()}
    assert got == want and len(got) == 5


def test_counts_are_added_up_across_batches(spark):
    """A list and a map were made of each cell's lines and joined to it; now lines and cells lie together, whatever the batch they fall in."""
    cells = spark.createDataFrame([(None, "n"), (1, "a"), (2, "b"), (2, "twice"), (3, "none"), (-5, "low"), (0, "zero")], "cell_id long, kind string")
    lines = [(2, g % 3, 1.0 + g) for g in range(40)] + [(1, 0, 5.0), (1, 0, 2.0), (-5, 2, 7.0), (9, 1, 3.0), (0, 1, 4.0)]
    lines = spark.createDataFrame(lines, "cell_id long, gene int, x double")
    want = {"n": [0, 0, 0], "a": [7, 0, 0], "b": [287, 260, 273], "twice": [287, 260, 273], "none": [0, 0, 0], "low": [0, 0, 7], "zero": [0, 4, 0]}
    name, was = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 3, 10_000):
            spark.conf.set(name, size)
            for order in (cells, cells.orderBy(F.desc("kind"))):
                got = [(r["kind"], r["counts"]) for r in views.gathered(order.repartition(3), lines.repartition(4), 3).collect()]
                assert len(got) == 7 and dict(got) == want
    finally:
        spark.conf.set(name, was)


def test_counted_cells_are_profiled_ones(spark):
    small = "/root/testdata/sf0.001"
    rows = lambda df: sorted(map(tuple, df.select("cell_id", "donor_id", "cell_type", "role", "counts").collect()))
    assert rows(views.counted(spark, small, "donor_id", "cell_type", "role")) == rows(views.profile(spark, small))


def test_pairs_are_met_by_their_first_gene(spark, monkeypatch):
    """Both genes' values were copied out for every pair; a pair that isn't a number, or has no correlations, doesn't count."""

    def close(a, b, corr):
        if a.ndim != 1 or b.ndim != 2:
            raise ValueError("a value for each pair and cell")
        return NUMPY["closeness_1"](a, b, corr)

    monkeypatch.setattr(membership, "NUMPY", {"plain": close})
    cells, rows, _, _, values, _ = _small(spark)
    values = values.withColumn("u_s", F.when((F.col("gene") == 3) & (F.col("cnt") == 2), 0.0).when((F.col("gene") == 2) & (F.col("cnt") == 2), 0.0).otherwise(F.col("u_s")))
    corr = spark.createDataFrame([(f"t{t}", i, j, 0.5, -0.2) for t in (0, 1) for i, j in ((0, 2), (0, 1), (2, 3), (0, 4), (3, 4))], "cell_type string, gi int, gj int, r_s double, r_a double")
    got = {r["cell_id"]: r["score"] for r in membership.pairwise_score(cells, values, corr, "cell_type", KEYS, "plain", part=7).collect()}
    u = {(r["cell_id"], r["gene"]): (r["u_s"], r["u_a"]) for r in rows.join(values, [*BY, "gene", "cnt"]).collect()}
    assert len(got) == 60
    for cell, score in got.items():
        want = sum(0.17 * c / (c + 1e-4) for g in (0, 2, 3, 4) for c in [1 - 2 * abs(u[cell, g][0] - 0.5)])
        for i, j in ((0, 2), (2, 3), (0, 4), (3, 4)):
            s, a = ([u[cell, g][side] for g in (i, j)] for side in (0, 1))
            if max(s) > 0:
                want += 0.35 * (1 - abs(s[0] - s[1]) / max(s)) / (1 - abs(a[0] - a[1]) / max(a) + 1e-4)
        assert score == pytest.approx(want, rel=1e-9)
