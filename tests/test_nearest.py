"""Nearest rows of large blocks: what a pair of blocks sends, copies, and how often rows are copied."""

import numpy as np

from auditlake.operators import baselines


def test_pairs_within_the_bound_are_those_of_all_distances():
    rng = np.random.default_rng(3)
    b = np.vstack([rng.normal(size=(3000, 8)), np.repeat(rng.normal(size=(1, 8)), 500, axis=0), rng.integers(0, 2, (800, 8))])
    j = rng.permutation(len(b))
    pick = rng.permutation(len(b))[:60]
    a, i = b[pick], j[pick]
    row, at, d = baselines.nearest_pairs(i, a, j, b, 7)
    for r in range(len(i)):
        all_ = ((b - a[r]) ** 2).sum(axis=1)
        want = sorted((round(x, 12), n) for x, n in zip(all_, j) if n != i[r])[:7]
        assert [j[t] for t in at[row == r]] == [n for _, n in want]
        assert np.allclose(d[row == r], [x for x, _ in want], atol=1e-12)
    alone = baselines.nearest_pairs(np.array([1]), np.ones((1, 2)), np.array([1]), np.ones((1, 2)), 3)
    assert not any(map(len, alone))


def test_rows_are_copied_as_often_in_a_larger_table(spark, monkeypatch):
    """With blocks of a fixed size, a table of ten times the rows had each row copied ten times as often."""
    monkeypatch.setattr(baselines, "BLOCK", 4)
    monkeypatch.setattr(baselines, "BLOCKS", 3)
    seen = {}
    for n in (30, 300):
        v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)], "id long, v array<double>")
        blocks = baselines.block_distances(v, v, "id", lambda i, a, j, b: __import__("pandas").DataFrame({"id": i}), "id long")
        seen[n] = blocks.groupBy("id").count().agg({"count": "max"}).first()[0]
    assert seen[30] == seen[300] == 3
