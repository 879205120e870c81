"""The audit's domain objects over the star schema: cells with donors and types, counts by gene, roles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from auditlake.sources.tables import table

GENES = 32

# The same views for DuckDB.
CELLS_SQL = """cells AS (
  SELECT o_orderkey AS cell_id, o_custkey AS donor_id, o_orderpriority AS cell_type, c_mktsegment AS subgroup, (o_custkey % 4)::INT AS role
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
EXPR_SQL = """expr AS (
  SELECT l_orderkey AS cell_id, (l_suppkey % 32)::INT AS gene, sum(l_quantity)::INT AS cnt FROM lineitem GROUP BY ALL)"""
DENSE_SQL = f"""{CELLS_SQL}, {EXPR_SQL}, genes AS (SELECT range::INT AS gene FROM range({GENES})), dense AS (
  SELECT c.*, g.gene, coalesce(e.cnt, 0)::INT AS cnt FROM cells c CROSS JOIN genes g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").alias("donor_id"), F.col("o_orderpriority").alias("cell_type"),
        F.col("c_mktsegment").alias("subgroup"), (F.col("o_custkey") % 4).cast("int").alias("role"),
    )


def genes(spark: SparkSession) -> DataFrame:
    return spark.range(GENES).select(F.col("id").cast("int").alias("gene"))


def expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that aren't zero: (cell_id, gene, cnt)."""
    return _counts(table(spark, sf_dir, "lineitem"))


def _counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.col("l_orderkey").alias("cell_id"), (F.col("l_suppkey") % GENES).cast("int").alias("gene")).agg(F.sum("l_quantity").cast("int").alias("cnt"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a cell: cells' columns and counts, an array by gene with the zeros in it. Lines are dealt by cell once, for all steps."""
    dealt = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").repartition("l_orderkey")
    pairs = _counts(dealt).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("gene", "cnt"))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(GENES - 1)), lambda g: F.coalesce(F.try_element_at("m", g), F.lit(0)))
    return cells(spark, sf_dir).join(pairs, "cell_id", "left").withColumn("counts", counts).drop("m")


def counted(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """`profile`'s cell_id, counts and these columns, for whoever reads all cells: cells and lines are dealt and sorted by cell together,
    and counts are added up batch by batch, so no list, map or join is made for a cell."""
    gene = (F.col("l_suppkey") % GENES).cast("int").alias("gene")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell_id"), gene, F.col("l_quantity").cast("double").alias("x")).where("cell_id is not null and gene >= 0 and x is not null")
    return gathered(cells(spark, sf_dir).select("cell_id", *names), lines, GENES)


def gathered(cells: DataFrame, lines: DataFrame, genes: int) -> DataFrame:
    """cells and `counts`, an array by gene of the whole sums of x over a cell's lines (cell_id, gene, x; x of whole numbers adds up exactly)."""
    names, kinds = cells.columns, dict(cells.dtypes)
    both = cells.withColumn("_cell", F.lit(1)).unionByName(lines.withColumn("_cell", F.lit(0)), allowMissingColumns=True)
    dealt = both.repartition("cell_id").sortWithinPartitions("cell_id")  # one whole number, which Spark sorts by its digits
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "counts array<int>"])
    out = to_arrow_schema(StructType.fromDDL(schema))

    def with_counts(kept, sums):
        if (np.abs(sums) >= 1 << 31).any():
            raise ValueError("a count is beyond an int")
        counts = pa.ListArray.from_arrays(np.arange(len(sums) + 1, dtype=np.int32) * genes, pa.array(sums.astype(np.int32).reshape(-1)))
        return pa.RecordBatch.from_arrays([*(kept[c].cast(out.field(c).type) for c in names), counts.cast(out.field("counts").type)], schema=out)

    def run(batches):
        last, carried, waiting = None, None, []  # the last cell's rows may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            none = batch["cell_id"].is_null().to_numpy(zero_copy_only=False)
            key = batch["cell_id"].fill_null(0).to_numpy(zero_copy_only=False)
            rank = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (none[1:] != none[:-1]))])
            cell, end = batch["_cell"].to_numpy() == 1, rank[-1]
            at = rank[~cell] * genes + batch["gene"].fill_null(0).to_numpy()[~cell]
            sums = np.bincount(at, batch["x"].fill_null(0.0).to_numpy()[~cell], (end + 1) * genes).reshape(-1, genes)
            if last == (key[0], none[0]):
                sums[0] += carried
                carried = sums[0]
            if last != (key[-1], none[-1]):
                for kept in waiting:
                    yield with_counts(kept, np.repeat(carried[None], kept.num_rows, axis=0))
                waiting = []
            whole = cell & (rank < end)
            if whole.any():
                yield with_counts(batch.filter(pa.array(whole)), sums[rank[whole]])
            if (cell & (rank == end)).any():
                waiting.append(batch.filter(pa.array(cell & (rank == end))))
            last, carried = (key[-1], none[-1]), sums[-1].copy()
        for kept in waiting:
            yield with_counts(kept, np.repeat(carried[None], kept.num_rows, axis=0))

    return dealt.mapInArrow(run, schema)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells' columns, gene and cnt, a row for each cell and gene; made in the row, not by a cross join."""
    return profile(spark, sf_dir).select("cell_id", "donor_id", "cell_type", "subgroup", "role", F.posexplode("counts").alias("gene", "cnt"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their part: 0 test, 1 synthetic, 2 reference."""
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 3).cast("int").alias("part"), "label", F.col("embedding").cast("array<double>").alias("v"))


VECTORS_SQL = """vecs AS (
  SELECT vec_id, (vec_id % 3)::INT AS part, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"""
