"""Donor splits and sampling. Random order is a hash of the key and a seed, so that it doesn't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.ranges import in_ranges


def shuffled(key: Column | str, seed: int = 0) -> Column:
    return F.xxhash64(key if isinstance(key, str) else key, F.lit(seed))


def ranked(rows: DataFrame, order: Column, ties: tuple[str, ...] = (), by: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """rows plus _r, from 1 by a numeric order (nulls first) within by, without a whole group in one task's sort.

    Rows are cut into ranges at approximate quantiles of the order, as many as the number of rows asks for (any cuts
    give the same ranks), ranked within their range, and moved up by the sizes of the ranges before it.
    """
    placed = in_ranges(rows.withColumn("_o", order), F.col("_o"), parts)
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
    starts = sizes.select(*(F.col(c).alias(f"_k_{c}") for c in by), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = placed.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_o", *ties)))
    same = F.col("_p") == F.col("_q")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return inside.join(starts, same).select(*rows.columns, (F.col("_start") + F.col("_i")).alias("_r"))


def split_donors(donors: DataFrame, wanted: int, min_aux: int, order: Column | None = None, aux: str = "rest") -> DataFrame:
    """(role, donor_id): n = min(wanted, half) train and holdout donors and max(min_aux, n) auxiliary ones.

    aux='rest' takes auxiliary donors from the others first and from the targets only where those don't
    suffice; aux='holdout' takes at most 200 of the holdout donors.
    """
    order = shuffled("donor_id") if order is None else order
    each = donors.select("donor_id").distinct()
    total = each.count()
    n = min(wanted, total // 2)
    each = ranked(each, order, ("donor_id",))
    role = F.when(F.col("_r") <= n, "train").when(F.col("_r") <= 2 * n, "holdout")
    targets = each.withColumn("role", role).where("role is not null").select("role", "donor_id")
    if aux == "holdout":
        pool = each.where((F.col("_r") > n) & (F.col("_r") <= min(2 * n, n + 200)))
    else:
        place = F.when(F.col("_r") > 2 * n, F.col("_r") - 2 * n).otherwise(F.col("_r") + total - 2 * n)
        pool = each.where(place <= max(min_aux, n))
    return targets.unionByName(pool.select(F.lit("auxiliary").alias("role"), "donor_id"))


def split_all_train(donors: DataFrame) -> DataFrame:
    return donors.select(F.lit("train").alias("role"), "donor_id").distinct()


def stratified_folds(rows: DataFrame, label: str, k: int, order: Column, ties: tuple[str, ...] = ()) -> DataFrame:
    """fold 0..k-1, dealt in turn within each label."""
    return ranked(rows, order, ties, (label,)).withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def sample_per_group(rows: DataFrame, by: list[str], cap: int, order: Column) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_r") <= cap).drop("_r")


def sample_rows(rows: DataFrame, n: int, order: Column) -> DataFrame:
    return rows.orderBy(order).limit(n)


def bootstrap(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement, by rank: (draw, and the row drawn)."""
    size = rows.count()
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(size)) + 1).alias("_r"))
    return draws.join(ranked(rows, F.col(key)), "_r").drop("_r")


def draw_category(rows: DataFrame, shares: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A category for each row, at the categories' shares (category, share); the few categories are broadcast as one list."""
    w = Window.orderBy("category")
    cuts = shares.withColumn("upto", F.sum("share").over(w)).agg(F.array_sort(F.collect_list(F.struct("upto", "category"))).alias("cuts"))
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.crossJoin(F.broadcast(cuts)).withColumn("_u", u)
    return drawn.withColumn("category", F.coalesce(F.get(F.filter("cuts", lambda c: c["upto"] > F.col("_u")), 0)["category"], F.element_at("cuts", -1)["category"])).drop("cuts", "_u")


def standardize(rows: DataFrame, value: str, by: list[str], train: Column) -> DataFrame:
    """value as z by the training rows' mean and population deviation; a deviation of zero counts as one."""
    stats = rows.where(train).groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return rows.join(stats, by, "left").withColumn("z", (F.col(value) - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")


def fill_template(draws: DataFrame, template: DataFrame, by: str, key: str) -> DataFrame:
    """(key, by, drawn): the k-th template row of a group gets the k-th drawn one, by key; null where a group's draws run out."""
    side = lambda rows, name: ranked(rows.select(key, by), F.col(key), by=(by,)).select(F.col(key).alias(name), F.col(by).alias(f"_{name}"), F.col("_r").alias(f"_r_{name}"))
    places, drawn = side(template, "place"), side(draws, "drawn")
    same = F.col("_place").eqNullSafe(F.col("_drawn")) & (F.col("_r_place") == F.col("_r_drawn"))
    return places.join(drawn, same, "left").select(F.col("place").alias(key), F.col("_place").alias(by), "drawn")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the place of their first row and their position in that order."""
    first = rows.groupBy(key).agg(F.min(order).alias("first"))
    return ranked(first, F.col("first"), (key,)).withColumnRenamed("_r", "position")
