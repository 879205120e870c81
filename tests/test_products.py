"""Products of genes where the cells are."""

import pytest
from pyspark.sql import functions as F

from auditlake.operators import marginals
from auditlake.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["gene_correlations", "gene_second_moments", "coexpression_overlap"])
def test_cells_are_not_taken_apart(spark, name):
    """A row for each cell and gene was made, gathered again by cell, and sorted by group."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "Sort [" not in plan


def test_sums_sent_early_add_up_to_the_same(spark, monkeypatch):
    counts = F.array(*(F.pmod(F.xxhash64("id", F.lit(g)), F.lit(9)) for g in range(7)))
    cells = marginals.listed_counts(spark.range(500).select((F.col("id") % 3).alias("kind"), counts.alias("counts")), ["kind"])
    found = lambda: sorted(map(tuple, marginals.products_of(cells, ["kind"], 3).collect()))
    whole = found()
    assert len(whole) == 3 * 28
    monkeypatch.setattr(marginals, "HELD", 1)
    assert found() == whole
