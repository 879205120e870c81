"""Order at scale: ranges at approximate quantiles, exact counts of them, and work inside a range only.

Cuts come from a quantile sketch, but results don't depend on how good they are: what is counted is counted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.sources.scratch import stored

#: Rows that a range should have, and the most ranges a quantile sketch is asked for.
RANGE_ROWS, MOST_RANGES = 250_000, 1 << 14
#: Ranges are summed in blocks of so many.
BLOCK = 128


def n_ranges(rows: int, each: int = RANGE_ROWS) -> int:
    """A power of two, so that a search takes the same steps everywhere; it follows the number of rows."""
    return 1 << min(max(3, math.ceil(math.log2(max(rows, 1) / each))), int(math.log2(MOST_RANGES)))


def quantiles(value: Column, parts: int) -> Column:
    """parts - 1 cuts at approximate quantiles."""
    return F.percentile_approx(value, [i / parts for i in range(1, parts)], max(10_000, 4 * parts))


def place(cuts: Column, value: Column, parts: int) -> Column:
    """How many of the parts - 1 sorted cuts lie below value, by bisection; nulls and what no cut is below are 0."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(int(math.log2(parts))))))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) < value, step).otherwise(0))


def in_ranges(rows: DataFrame, order: Column, parts: int | None = None) -> DataFrame:
    """rows plus _p, the range of each row's order among all rows; equal orders share one. Without parts, rows are stored to be counted."""
    if parts is None:
        rows = stored(rows)
        parts = n_ranges(rows.count())
    cuts = rows.agg(quantiles(order.cast("double"), parts).alias("_cuts"))
    return rows.crossJoin(F.broadcast(cuts)).withColumn("_p", place(F.col("_cuts"), order.cast("double"), parts)).drop("_cuts")  # one row of cuts


def prefix_sums(rows: DataFrame, order: Column, values: list[str], by: list[str], descending: bool = False, parts: int | None = None) -> DataFrame:
    """rows plus, for each value, its sum up to the row (upto_) and in all (all_) within by, in the order given.

    Sums inside ranges, sums of ranges inside blocks of ranges, and sums of blocks: a task holds one range of one group, and
    the last level is an array of at most MOST_RANGES / BLOCK entries a group. Equal orders should be one row.
    """
    placed = in_ranges(rows, order, parts).withColumn("_b", (F.col("_p") / BLOCK).cast("int"))
    turn = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    inside = Window.partitionBy(*by, "_p").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    ranges = placed.groupBy(*by, "_b", "_p").agg(*(F.sum(v).alias(f"_r_{v}") for v in values))
    within = Window.partitionBy(*by, "_b").orderBy(turn(F.col("_p"))).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(*by, F.col("_b"), F.col("_p").alias("_q"), *(F.coalesce(F.sum(f"_r_{v}").over(within), F.lit(0)).alias(f"_s_{v}") for v in values))
    blocks = ranges.groupBy(*by, "_b").agg(*(F.sum(f"_r_{v}").alias(v) for v in values))
    blocks = blocks.groupBy(*by).agg(F.collect_list(F.struct("_b", *values)).alias("_blocks"))

    def earlier(v):
        kept = F.filter("_blocks", lambda x: (x["_b"] > F.col("_b")) if descending else (x["_b"] < F.col("_b")))
        return F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x[v].cast("double"))

    total = lambda v: F.aggregate("_blocks", F.lit(0.0), lambda acc, x: acc + x[v].cast("double"))
    met = joined(starts, blocks, by)
    offsets = met.select(*(F.col(c).alias(f"_k_{c}") for c in by), "_q", *((F.col(f"_s_{v}") + earlier(v)).alias(f"_o_{v}") for v in values), *(total(v).alias(f"all_{v}") for v in values))
    summed = placed.select("*", *(F.sum(v).over(inside).alias(f"_i_{v}") for v in values))
    same = F.col("_p") == F.col("_q")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = summed.join(offsets, same)
    return out.select(*rows.columns, *((F.col(f"_i_{v}") + F.col(f"_o_{v}")).alias(f"upto_{v}") for v in values), *(f"all_{v}" for v in values))


def joined(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """On by, nulls meeting nulls; without keys the right side is one row, or none."""
    if not by:
        return left.join(F.broadcast(right), F.lit(True), how)
    renamed = right.withColumnsRenamed({c: f"_j_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_j_{c}"))
    return left.join(renamed, same, how).drop(*(f"_j_{c}" for c in by))


def grouped_median(rows: DataFrame, value: str, by: list[str], parts: int = 1024, enough: int = 1_000_000, held: bool = False) -> DataFrame:
    """by, median: exact, of the values that aren't null; the mean of the middle two where their number is even.

    Each pass cuts a group's candidates into ranges, counts them exactly and keeps the one or two that hold the middle. The first pass
    cuts evenly within a deviation of the mean, where every median lies; passes that are still needed after it cut at approximate
    quantiles, as many as bring a group of all rows down to `enough` candidates. Only those are then counted by distinct value
    and ordered, so no task holds more than that or a range of equal values, which is one row.

    held: rows are cheap to read again, as stored ones are, and aren't stored first.
    """
    left = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    left = left if held else stored(left)
    # stored, so that the sizes of small tables are known and the rows they are joined to aren't shuffled
    about = stored(left.groupBy(*by).agg(F.count("*").alias("_n"), F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_s")))
    n = about.agg(F.sum("_n")).first()[0] or 0
    left = joined(left, about.select(*by, F.expr("(_n + 1) div 2").alias("_k1"), F.expr("_n div 2 + 1").alias("_k2"), "_m", "_s"), by)
    if n > enough:
        at = (F.col("_v") - (F.col("_m") - F.col("_s"))) / (F.col("_s") * (2 / parts))
        spot = F.when(at < 0, 0).when(at >= parts, parts + 1).otherwise(F.floor(at) + 1)
        even = F.when((F.col("_s") > 0) & (F.col("_s") < float("inf")), spot).otherwise(0).cast("int")
        left = stored(_narrowed(left.withColumn("_p", even).drop("_m", "_s"), by))
        n = left.count()
    for _ in range(max(0, math.ceil(math.log(max(n / enough, 1), parts)))):
        cuts = stored(left.groupBy(*by).agg(quantiles(F.col("_v"), parts).alias("_cuts")))
        left = stored(_narrowed(joined(left, cuts, by).withColumn("_p", place(F.col("_cuts"), F.col("_v"), parts)).drop("_cuts"), by))
    seen = left.groupBy(*by, "_v", "_k1", "_k2").agg(F.count("*").alias("_n"))
    ordered = prefix_sums(seen, F.col("_v"), ["_n"], by, parts=n_ranges(min(n, enough)))
    holds = lambda k: F.max(F.when((F.col("upto__n") >= F.col(k)) & (F.col("upto__n") - F.col("_n") < F.col(k)), F.col("_v")))
    return ordered.groupBy(*by).agg(holds("_k1").alias("_a"), holds("_k2").alias("_b")).select(*by, (0.5 * F.col("_a") + 0.5 * F.col("_b")).alias("median"))


def _narrowed(placed: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the ranges _p that hold each group's _k1-th and _k2-th value, with places counted among them."""
    sizes = placed.groupBy(*by, "_p").agg(F.count("*").alias("_n"), F.first("_k1").alias("_k1"), F.first("_k2").alias("_k2"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))  # at most a row a range
    wanted = sizes.withColumn("_upto", upto).where("_upto >= _k1 and _upto - _n < _k2")
    first = stored(wanted.groupBy(*by).agg(F.min(F.col("_upto") - F.col("_n")).alias("_gone"), F.min("_p").alias("_p1"), F.max("_p").alias("_p2")))
    kept = joined(placed, first, by).where("_p = _p1 or _p = _p2")
    return kept.select(*by, "_v", (F.col("_k1") - F.col("_gone")).alias("_k1"), (F.col("_k2") - F.col("_gone")).alias("_k2"))
