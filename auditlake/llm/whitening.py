"""Whitening of embeddings: an exact centre, MLlib's Gramian of the centred rows, one small eigenproblem.

Entries are put on a grid, x = floor(64 * c) + 1000000, and the fit list is each distinct x vector once: n
vectors with the sums S. With n and S known, n * x - S is an integer, so rows are centred without rounding before
anything is multiplied, and (n * x - S) / n is rounded once. `RowMatrix.computeGramianMatrix` adds up their
products in a tree over tasks; divided by n that is the covariance V, a matrix of dimensions x dimensions
whatever the rows. Its eigenvectors come from one `eigh` on the driver; the whitening matrix is broadcast and applied
in `mapInPandas`. The covariance of the whitened fit list comes from a second RowMatrix and gives `identity_error`.

What passes through the driver is n, S and matrices of dimensions x dimensions; more than `MAX_DIMENSIONS` raise.
Equal vectors are counted away before they are shuffled, so a vector that a third of all rows hold costs one row a task.

Defined results: rows whose vector is null or holds null or non-finite entries take no part, nor do those whose
length isn't the commonest one (of equally common lengths the longest), nor empty vectors; null and repeated ids stay, one result
a row; entries beyond 2**60 on the grid count as that; components whose eigenvalue is
nothing but rounding (a constant direction, fewer distinct vectors than dimensions) can't be brought to variance one and
are left out, so a table with one distinct vector, or none, has no rows; equal eigenvalues take the order that eigh
gives them; a component's sign makes its entry of largest size positive. A deviation that 64 bits can't hold is null.
Columns other than id and vector don't reach the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm._shared import stored

MAX_DIMENSIONS = 8192
LARGEST = float(2**60)


def on_grid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and x (array<long>) of the rows that take part, all of the commonest length."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    good = rows.where(F.coalesce(finite, F.lit(False)) & (F.size("v") > 0))
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()  # one row a length
    d = max(lengths, key=lambda r: (r["n"], r["d"]))["d"] if lengths else 0
    if d > MAX_DIMENSIONS:
        raise ValueError(f"{d} dimensions make a matrix too large for one machine ({MAX_DIMENSIONS} at most)")
    x = F.transform("v", lambda c: F.floor(F.least(F.greatest(64 * c, F.lit(-LARGEST)), F.lit(LARGEST))) + 1_000_000)
    return good.where(F.size("v") == d).select("id", x.cast("array<long>").alias("x"))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as 64-bit integers where these hold it, else as Python's."""
    largest = max(int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0) // n + 1)
    if 2 * n * largest < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(exact: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, null where 64 bits can't hold it."""
    reach = int(np.abs(exact).max(initial=0))
    if reach**2 * max(exact.shape[1], 1) < 2**63:
        return (exact * exact).sum(axis=1).tolist()
    big = exact.astype(object)
    return [int(s) if s < 2**63 else None for s in (big * big).sum(axis=1)]


def _gramian(rows: DataFrame) -> np.ndarray:
    """Of a column of arrays, through MLlib; the rows never leave the executors."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; at most `most`, none that is only rounding."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = int((values > 0).sum() and (values > values[0] * len(values) * 2.0**-50).sum())
    values, vectors = values[: min(most, keep)], vectors[:, : min(most, keep)]
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[top, np.arange(vectors.shape[1])])


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """A row for each row that takes part and each component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = on_grid(vectors, id_col, vector_col)
    fit = stored(rows.select("x").distinct())
    n = fit.count()
    if not n:
        return spark.createDataFrame([], schema)
    exact_sum = F.sum(F.col("e").cast("decimal(20,0)"))
    sums = [int(r["s"]) for r in fit.select(F.posexplode("x").alias("j", "e")).groupBy("j").agg(exact_sum.alias("s")).orderBy("j").collect()]  # one row a dimension

    def differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"v": list((centred(np.stack(batch["x"].to_numpy()), n, sums) / n).astype(float))})

    covariance = _gramian(fit.mapInPandas(differences, "v array<double>")) / n
    values, axes = components_of(covariance, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    whitening = spark.sparkContext.broadcast(axes / np.sqrt(values))
    explained = values / np.trace(covariance)

    def whitened(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exact = centred(x, n, sums)
        return exact, (exact / n).astype(float) @ whitening.value

    def projections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"v": list(whitened(np.stack(batch["x"].to_numpy()))[1])})

    spread = _gramian(fit.mapInPandas(projections, "v array<double>")) / n
    error = float(np.abs(spread - np.eye(len(values))).max())
    k = len(values)

    def results(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                exact, scores = whitened(np.stack(part["x"].to_numpy()))
                yield pd.DataFrame(
                    {
                        id_col: part["id"].repeat(k).to_numpy(),
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(part)),
                        "n": np.int64(n),
                        "deviation": pd.array(deviations(exact), "Int64").repeat(k),
                        "whitened": scores.ravel(),
                        "explained": np.tile(explained, len(part)),
                        "identity_error": error,
                    }
                )

    # null ids become floats in pandas, so ids travel as text
    out = rows.select(F.col("id").cast("string").alias("id"), "x").mapInPandas(results, schema.replace(f"`{id_col}` {kind}", f"`{id_col}` string"))
    return out.withColumn(id_col, F.col(id_col).cast(kind))
