"""Line deduplication over overlapping windows of consecutive lines.

Every run of `window` consecutive lines is hashed to 128 bits. A window that occurs anywhere before, in
the order (doc_id, position), is a repeat; the lines that repeats cover are merged and removed, in time
proportional to the text. Only
built-in functions run, and only hashes, never texts, are grouped and joined: the groups are reduced to
their first occurrence before they meet the windows again, so a window that a third of all documents
share is a skewed join side that adaptive execution splits, not a group in one task.

Defined results: a null text has no lines and stays null; an empty text stays empty; a text with fewer
lines than the window keeps all of them; rows repeated with the same id and text are one document, and
each of them gets its result; texts that share an id are ordered by a hash of the text; null ids come
last; very long texts are cut whole; an empty table gives none. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm._shared import let, text_key


def _lines(text):
    return F.split(text, "\n", -1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """docs with `text_col` less its repeated lines, plus n_lines and n_removed (long)."""
    text = F.col(text_col)
    keyed = docs.select(F.col(id_col).cast("long").alias("_id"), text_key(text).alias("_key"), text.alias("_text"))

    def digests(lines):
        at = lambda i: [F.get(lines, i + k) for k in range(window)]
        return F.transform(
            F.sequence(F.lit(0), F.size(lines) - window),
            lambda i: F.struct(
                i.alias("pos"),
                F.xxhash64(*at(i)).alias("h1"),
                F.xxhash64(F.lit(window), *reversed(at(i))).alias("h2"),
            ),
        )

    lined = keyed.where("_text is not null").select("_id", "_key", _lines(F.col("_text")).alias("_lines"))
    windows = (
        lined.where(F.size("_lines") >= window)
        .select("_id", "_key", F.explode(F.transform(F.array("_lines"), digests)[0]).alias("w"))
        .select("_id", "_key", "w.pos", "w.h1", "w.h2")
    )
    place = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_key").alias("key"), F.col("pos").alias("pos"))
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    covered = (
        windows.join(first, ["h1", "h2"])
        .where(place > F.col("first"))
        .groupBy("_id", "_key")
        .agg(F.collect_set("pos").alias("_starts"))
        .withColumnsRenamed({"_id": "__line_cid", "_key": "__line_ckey", "_starts": "__line_starts"})
    )

    rows = docs.withColumns({"__line_id": F.col(id_col).cast("long"), "__line_key": text_key(text)})
    joined = rows.join(covered, F.col("__line_id").eqNullSafe(F.col("__line_cid")) & (F.col("__line_key") == F.col("__line_ckey")), "left")

    def kept(lines, starts):
        # what stands before the first start, and between the end of each start's window and the next start
        stop = lambda i: F.coalesce(F.get(starts, i + 1), F.size(lines))
        gaps = F.transform(starts, lambda s, i: F.slice(lines, s + window + 1, F.greatest(stop(i) - s - window, F.lit(0))))
        return F.flatten(F.concat(F.array(F.slice(lines, F.lit(1), F.get(starts, F.lit(0)))), gaps))

    lines = _lines(text)
    rest = let(lines, lambda ls: let(F.array_sort("__line_starts"), lambda starts: kept(ls, starts)))
    changed = joined.withColumn("__line_kept", F.when(F.col("__line_starts").isNotNull(), rest))
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = changed.withColumns(
        {
            "n_lines": n_lines,
            "n_removed": F.when(F.col("__line_starts").isNull(), F.lit(0).cast("long")).otherwise(n_lines - F.size("__line_kept")),
            text_col: F.when(F.col("__line_starts").isNull(), text).otherwise(F.array_join("__line_kept", "\n")),
        }
    )
    return out.drop("__line_id", "__line_key", "__line_cid", "__line_ckey", "__line_starts", "__line_kept")
