"""Ranked lexical search: every query against every document by TPUT over term-partitioned postings.

Texts are read once and become postings of the asked terms: (term, document, occurrences, length), partitioned by term,
with each list dealt into `LIST_PARTS` parts so that the list of a word that all documents hold isn't one task's. All
document counts and frequencies are of the whole table. A posting's contribution to a score depends on term and
document only and is never negative, so a query's score is a sum over its terms' lists, and three phases find its best k:

1. the k highest contributions of each list are fetched; the k-th largest of their sums by document, tau, bounds the
   k-th score from below;
2. every list of a query of m terms is fetched down to the same threshold, tau / m. A document that no fetched entry
   names can't reach tau. The k-th largest sum of the others' entries is a better tau. With that, documents are bounded from above, a missing
   entry counting as the most it can be: less than the threshold, and no more than the list's head; those whose bound stays below
   tau go;
3. the others, few, are looked up in every list of the query, and ranked by their exact scores.

Fetched entries are shuffled as postings, one row a list entry, to parts of documents, where numpy adds
them up for one block of queries: rows don't grow with queries times documents, and a group's size follows
the postings' count. Sums leave a part as k numbers a query, to find tau, and then as what the bounds leave. Queries come in blocks
of `QUERY_BLOCK`. Asked terms are broadcast up to `BROADCAST_TERMS`, beyond that all terms become postings first and are
joined with the asked ones; candidates are broadcast to the lists up to `BROADCAST_LOOKUPS`, and joined beyond.

Defined results: a null or wordless text is no document and asks nothing; rows repeated with the same id and text are
one document, or one query; texts that share an id are documents, or queries, of their own; of equal scores
the smaller id comes first, then null ids, then the smaller hash of the text; terms of queries that no document holds
count as nothing; very long texts are read slice by slice; an empty table on either side gives no rows; other columns
don't reach the result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm._shared import lower_ascii, stored, text_key

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_KEPT = [c for c in range(256) if c >= 0x80 or chr(c).isalnum()]
#: Bytes of words, A-Z lower-cased; all others a space.
_BYTES = bytes(ord(chr(c).lower()) if c < 0x80 else c for c in range(256)).translate(bytes(c if c in _KEPT else 0x20 for c in range(256)))
SLICE = 1 << 22
LIST_PARTS = 64
GROUP_POSTINGS = 1 << 19
QUERY_BLOCK = 4096
BROADCAST_TERMS = 200_000
BROADCAST_LOOKUPS = 500_000
#: Least id, for null ones in numpy; a mask says which are null.
_NO_ID = -(2**63)
_DOCUMENT = [("none", bool), ("id", np.int64), ("key", np.int64)]


def occurrences(text: str) -> Counter[bytes]:
    """Terms of a whole text with their counts."""
    data, counts, at = text.encode(), Counter(), 0
    while at < len(data):
        part = data[at : at + SLICE].translate(_BYTES)
        more = at + SLICE
        while more < len(data) and part[-1] != 0x20:  # to the end of the word
            rest = data[more : more + SLICE].translate(_BYTES)
            stop = rest.find(b" ")
            part += rest if stop < 0 else rest[: stop + 1]
            more += len(rest) if stop < 0 else stop + 1
        counts.update(part.split())
        at = more
    return counts


def _postings(docs: DataFrame, terms: dict[bytes, int] | None) -> DataFrame:
    """id, key, n, tf and the term (its number, where terms are given): a row for each term of each document, and one of term null for each document."""
    kind = "string" if terms is None else "long"
    held = None if terms is None else docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "key", "n", "term", "tf"]
        known = held.value if held else None
        rows: tuple[list, ...] = ([], [], [], [], [])

        def flushed():
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string() if known is None else pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)
            for c in rows:
                c.clear()
            return out

        for batch in batches:
            ids, keys, texts = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                counts = occurrences(texts[i].as_py())
                if not counts:
                    continue
                if known is None:
                    found = [(t.decode(), c) for t, c in counts.items()]
                else:
                    found = [(known[t], c) for t, c in counts.items() if t in known]
                k = len(found) + 1
                rows[0].extend([ids[i].as_py()] * k)
                rows[1].extend([keys[i].as_py()] * k)
                rows[2].extend([counts.total()] * k)
                rows[3].extend([None, *(t for t, _ in found)])
                rows[4].extend([0, *(c for _, c in found)])
                if len(rows[0]) > 100_000:
                    yield flushed()
        if rows[0]:
            yield flushed()

    return docs.mapInArrow(count, f"id long, key long, n long, term {kind}, tf long")


def _sums(entries: pa.Table, asks: pa.Table):
    """For each query: its number, tau, documents with fetched entries, the entries' sums, and bounds from above."""
    docs, at, c, lists = _lists(entries)
    for item, terms, tau, floors, heads in _queries(asks):
        total, slack = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        most = np.minimum(floors - 1, heads)  # of an entry that wasn't fetched
        for t, floor, miss in zip(terms, floors, most):
            lo, hi = lists.get(t, (0, 0))
            hi = lo + np.searchsorted(-c[lo:hi], -floor, "right")  # contributions fall along a list
            total[at[lo:hi]] += c[lo:hi]
            slack[at[lo:hi]] += miss
        seen = np.flatnonzero(total)
        if len(seen):
            yield item, tau, docs[seen], total[seen], total[seen] + (most.sum() - slack[seen])


def largest_sums(entries: pa.Table, asks: pa.Table, k: int) -> pa.Table:
    """Phase 2, first pass over one part of the documents: each query's k largest sums of fetched entries."""
    out = [(item, np.partition(total, -k)[-k:] if len(total) > k else total) for item, _, _, total, _ in _sums(entries, asks)]
    sums = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int64)
    return pa.table([pa.array([i for i, x in out for _ in range(len(x))], pa.int64()), pa.array(sums)], ["item", "sum"])


def possible(entries: pa.Table, asks: pa.Table) -> pa.Table:
    """Phase 2, second pass: the documents whose bound reaches tau."""
    items, kept = [], []
    for item, tau, docs, _, upper in _sums(entries, asks):
        kept.append(docs[upper >= tau])
        items += [item] * len(kept[-1])
    found = np.concatenate(kept) if kept else np.empty(0, _DOCUMENT)
    return pa.table([pa.array(items, pa.int64()), pa.array(found["id"].copy(), mask=found["none"].copy()), pa.array(found["key"].copy())], ["item", "id", "key"])


def _documents(table: pa.Table) -> np.ndarray:
    """(null, id, key) of each row, as one sortable array of fields."""
    ids = table.column("id").combine_chunks()
    out = np.empty(len(table), _DOCUMENT)
    out["none"], out["id"], out["key"] = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(_NO_ID).to_numpy(), table.column("key").to_numpy()
    return out


def _lists(entries: pa.Table):
    """The part's documents; entries by term and falling contribution: place of the document, contribution; each term's range."""
    rows = _documents(entries)
    order = np.lexsort((rows["key"], rows["id"], rows["none"]))
    fresh = np.concatenate([[True], rows[order][1:] != rows[order][:-1]]) if len(rows) else np.zeros(0, bool)
    at = np.empty(len(rows), np.int64)
    at[order] = np.cumsum(fresh) - 1
    docs = rows[order][fresh]
    term, c = entries.column("term").to_numpy(), entries.column("c").to_numpy()
    order = np.lexsort((-c, term))
    term, c, at = term[order], c[order], at[order]
    starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    ends = np.concatenate([starts[1:], [len(term)]]).astype(np.int64)
    return docs, at, c, dict(zip(term[starts].tolist(), zip(starts.tolist(), ends.tolist())))


def _queries(asks: pa.Table):
    """item, its terms, tau, thresholds and heads of its lists."""
    item = asks.column("item").to_numpy()
    order = np.argsort(item, kind="stable")
    cols = [asks.column(n).to_numpy(zero_copy_only=False)[order] for n in ("item", "term", "tau", "floor", "head")]
    starts = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]])) if len(item) else []
    for lo, hi in zip(starts, [*starts[1:], len(item)]):
        yield int(cols[0][lo]), cols[1][lo:hi].astype(np.int64).tolist(), int(cols[2][lo]), cols[3][lo:hi].astype(np.int64), cols[4][lo:hi].astype(np.int64)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query_id, item (its hash), term: each term of each query once."""
    asks = queries.select(F.col(id_col).alias("query_id"), F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col)).alias("item"), F.col(text_col).alias("text"))
    words = F.filter(F.array_distinct(F.split(lower_ascii(F.col("text")), SEPARATORS)), lambda w: w != "")
    return asks.where("text is not null").select("query_id", "item", F.explode(words).alias("term")).distinct()


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
) -> DataFrame:
    """query id, rank (from 1), doc id, score: each query's k best documents of score above 0."""
    spark = docs.sparkSession
    query_kind, doc_kind = dict(queries.dtypes)[query_id], dict(docs.dtypes)[doc_id]
    schema = f"`{query_id}` {query_kind}, rank int, `{doc_id}` {doc_kind}, score long"
    asked = stored(query_terms(queries, query_id, query_text))
    numbered = stored(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("number")))
    n_terms = numbered.count()
    if not n_terms:
        return spark.createDataFrame([], schema)

    rows = docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), text_key(F.col(doc_text)).alias("key"), F.col(doc_text).alias("text"))
    if n_terms <= BROADCAST_TERMS:
        found = _postings(rows, {r["term"].encode(): r["number"] for r in numbered.collect()})
    else:
        every = _postings(rows, None)
        found = every.join(numbered, "term", "left").where("number is not null or term is null").select("id", "key", "n", F.col("number").alias("term"), "tf")
    part = F.pmod(F.xxhash64("id", "key"), F.lit(LIST_PARTS)).cast("int").alias("part")
    found = found.select("*", part).repartition("term", "part").dropDuplicates(["term", "part", "id", "key"])
    postings = stored(found.drop("part").sortWithinPartitions("term"))

    sizes = postings.where("term is null").agg(F.count("*").alias("N"), F.sum("n").alias("L"), F.max("n").alias("most")).first()
    n_docs, n_words = sizes["N"], sizes["L"]
    if not n_docs:
        return spark.createDataFrame([], schema)
    small = n_terms <= BROADCAST_TERMS
    with_terms = lambda df: F.broadcast(df) if small else df
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = stored(postings.where("term is not null").groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")).where("w > 0"))
    fits = 90 * n_docs * sizes["most"] < 2**63  # else the product needs more than 64 bits
    length = F.expr(f"(90L * n * {n_docs}L) div {n_words}L" if fits else f"(cast(n as decimal(19,0)) * cast({90 * n_docs} as decimal(19,0))) div cast({n_words} as decimal(19,0))")
    lists = (
        postings.where("term is not null").join(with_terms(weights), "term")
        .select("term", "id", "key", "w", "tf", (10 + length).alias("m"))
        .select("term", "id", "key", (F.col("w") * F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")).alias("c"))
        .where("c > 0")
    )

    # phase 1
    falling = Window.partitionBy("term").orderBy(F.col("c").desc(), F.col("id").asc_nulls_last(), "key")
    heads = stored(lists.withColumn("place", F.row_number().over(falling)).where(F.col("place") <= k))
    n_queries = asked.select("item").distinct().count()
    blocks = math.ceil(n_queries / QUERY_BLOCK)
    asks = asked.join(with_terms(numbered), "term").select("query_id", "item", F.col("number").alias("term"), F.pmod("item", F.lit(blocks)).cast("int").alias("block"))
    sums = asks.join(heads, "term").groupBy("item", "id", "key").agg(F.sum("c").alias("sum"))
    tau = _kth(sums, "sum", k)
    tops = heads.where("place = 1").select("term", F.col("c").alias("head"))
    alive = asks.join(tops, "term")
    lengths = alive.groupBy("item").agg(F.count("*").alias("m"))
    bounds = lengths.join(tau, "item", "left").select("item", "m", F.coalesce("tau", F.lit(0).cast("long")).alias("tau"))
    floor = F.greatest(F.lit(1).cast("long"), F.expr("(tau + m - 1) div m")).alias("floor")
    plan = stored(alive.join(bounds, "item").select("query_id", "item", "block", "term", "tau", floor, "head"))

    # phase 2
    parts = max(1, math.ceil(postings.count() / GROUP_POSTINGS))
    dealt = F.pmod(F.xxhash64("key", "id"), F.lit(parts)).cast("int").alias("part")
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    ask_rows = plan.select("block", every_part, "item", "term", "tau", "floor", "head")
    needed = stored(plan.groupBy("term", "block").agg(F.min("floor").alias("floor")))
    fetched = lists.join(with_terms(needed), "term").where("c >= floor").select("block", dealt, "term", "id", "key", "c")
    by = ["block", "part"]
    tops = fetched.groupBy(*by).cogroup(ask_rows.groupBy(*by)).applyInArrow(lambda e, a: largest_sums(e, a, k), "item long, sum long")
    better = _kth(tops, "sum", k).withColumnRenamed("tau", "better")
    raised = plan.join(better, "item", "left").withColumn("tau", F.greatest("tau", "better"))
    ask_again = raised.select("block", every_part, "item", "term", "tau", "floor", "head")
    candidates = stored(fetched.groupBy(*by).cogroup(ask_again.groupBy(*by)).applyInArrow(possible, "item long, id long, key long"))

    # phase 3
    wanted = candidates.select("item", F.col("id").alias("_id"), F.col("key").alias("_key")).join(plan.select("item", F.col("term").alias("_term")), "item")
    longest = plan.groupBy("item").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0
    few = candidates.count() * longest <= BROADCAST_LOOKUPS
    same = (F.col("term") == F.col("_term")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    exact = lists.join(F.broadcast(wanted) if few else wanted, same).groupBy("item", "id", "key").agg(F.sum("c").alias("score"))
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "key")
    ranked = exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = plan.select("item", "query_id").distinct()
    return ranked.join(names, "item").select(F.col("query_id").alias(query_id), "rank", F.col("id").cast(doc_kind).alias(doc_id), "score")


def _kth(sums: DataFrame, value: str, k: int) -> DataFrame:
    """item, tau: the k-th largest value of each item that has as many."""
    largest = Window.partitionBy("item").orderBy(F.col(value).desc())
    top = sums.select("item", value).withColumn("place", F.row_number().over(largest)).where(F.col("place") <= k)
    return top.where(F.col("place") == k).select("item", F.col(value).alias("tau"))
