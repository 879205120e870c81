"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation.

1. Each text's distinct shingles give a digest of the whole set and `bands * rows` minima under
   multiply-add-shift hashes. Texts with the same set are one representative from here on.
2. Representatives that agree in a band meet the smallest id of that bucket: a star, never all pairs.
   The star's pairs stay candidates if their signatures agree in at least `slack` of the minima. Where a
   bucket's other members are in several components of these pairs, they meet each other by signature,
   in blocks of `meet` and within classes of set size that a link can't leave, so no pair that shares a
   bucket goes unseen. A bucket of more than `wide` blocks is dealt again by second bands first, so its members
   meet where they share two buckets.
3. Candidates' connected components are families. Families are compared exactly on their full shingle
   sets, in blocks of about `block` documents or BLOCK_SHINGLES shingles, in numpy: every block with
   itself and with the family's first block, and then, only in families of several blocks that are still
   apart, what isn't in the largest part with everything. A comparison returns at most one link a
   document. So a group that holds a third of all documents is many small tasks, and links with
   100 * shared >= 100 * threshold * union are exact.
4. Connected components of the links, by large-star and small-star.

With 36 bands of 4 rows a pair at similarity 0.75 shares no band with probability 1e-6, and no second
one with probability 2e-5; that falls fast with the similarity. Members that meet each other cost the
square of their number in a bucket (or a pair of buckets, of a wide one) and size class, over tasks of
two blocks.

Defined results: a null, empty or wordless text has no shingles, is its own component and links with
nothing; null ids take no part and have a null component; rows that share an id are one node, linked by each of
their texts (ids are below 2**62); an empty table gives none; very long texts are shingled whole. Extra
columns stay, ones named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm._hashing import mix, windows, word_hashes
from auditlake.llm._shared import stored, text_key
from auditlake.llm.components import connected_components

BLOCK_SHINGLES = 1 << 21
#: Numbers of further texts of an id start here; ids are smaller.
OWN_NODES = 1 << 62
SIGNED = "id long, key long, n long, digest binary, signature binary"


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of `size` lower-cased words; of all words if there are fewer."""
    words = word_hashes((text or "").encode().lower())
    if 0 < len(words) < size:
        return windows(words, len(words), 100 + len(words))
    return np.unique(windows(words, size, 3))


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def minima(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(found), 2048):
        hashed = (found[None, i : i + 2048] * a[:, None] + b[:, None]) >> np.uint64(32)
        np.minimum(out, hashed.min(axis=1), out=out)
    return out.astype(np.uint32)


def _sign(batches, size: int, count: int):
    a, b = _coefficients(count)
    for batch in batches:
        ids, keys = batch.column("id"), batch.column("key")
        n, digest, signature = [], [], []
        for text in batch.column("text").to_pylist():
            found = shingles(text, size)
            n.append(len(found))
            digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            signature.append(minima(found, a, b).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays([ids, keys, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary())], ["id", "key", "n", "digest", "signature"])


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint32).reshape(len(rows), -1)


def _band(batches, bands: int):
    for batch in batches:
        if not batch.num_rows:
            continue
        m = _matrix(batch.column("signature")).astype(np.uint64).reshape(batch.num_rows, bands, -1)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), m.shape[:2]).copy()
        for r in range(m.shape[2]):
            key = mix(key + m[:, :, r])
        ids = np.repeat(batch.column("id").to_numpy(), bands)
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(ids)], ["band", "id"])


def _agreeing(batches, slack: float):
    for batch in batches:
        if not batch.num_rows:
            continue
        same = (_matrix(batch.column("sa")) == _matrix(batch.column("sb"))).mean(axis=1) >= slack
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(same)), batch.column("b").filter(pa.array(same))], ["a", "b"])


def _meet(table: pa.Table, slack: float, percent: float) -> pa.Table:
    """Pairs of a bucket, apart so far, whose signatures agree and whose sizes allow a link, for each bucket in two of its blocks; at most one a member."""
    bucket, class_, id_, size, part = (table.column(c).to_numpy() for c in ("band", "class", "id", "n", "family"))
    m = _matrix(table.column("signature").combine_chunks())
    order = np.lexsort((id_, class_, bucket))
    bucket, class_, id_, size, part, m = bucket[order], class_[order], id_[order], size[order], part[order], m[order]
    cuts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (class_[1:] != class_[:-1]), [True]]))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, stop in zip(cuts[:-1], cuts[1:]):
        first = start + np.unique(id_[start:stop], return_index=True)[1]
        ids, n, family = id_[first], size[first], part[first]
        near = (family[:, None] != family[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
        if not near.any():
            continue
        same = np.zeros(near.shape, np.uint16)
        for column in m[first].T:
            same += column[:, None] == column[None, :]
        near &= same >= slack * m.shape[1]
        np.fill_diagonal(near, True)
        label = ids
        while True:
            new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
            if (new == label).all():
                break
            label = new
        keep = label != ids
        a.append(ids[keep])
        b.append(label[keep])
    return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _met(buckets: DataFrame, centres: DataFrame, known: DataFrame, one: DataFrame, slack: float, percent: float, meet: int, wide: int) -> DataFrame:
    """What the stars miss: pairs of a bucket's members that neither are its centre nor in one component yet."""
    known = known.select(F.col("node").alias("id"), F.col("component").alias("family"))
    rest = buckets.join(centres, "band").where("id > a").select("band", "id").distinct().join(known, "id", "left").withColumn("family", F.coalesce("family", "id"))
    apart = lambda df, *by: df.groupBy(*by).agg(F.min("family").alias("lo"), F.max("family").alias("hi"), F.count("*").alias("in")).where("lo < hi").select(*by, F.ceil(F.col("in") / meet).cast("int").alias("blocks"))
    mixed = stored(rest.join(apart(rest, "band"), "band").join(one.select("id", "n"), "id"))
    # a bucket of many members, all holding one passage say, is dealt again by every second bucket that a member stands in
    second = buckets.select(F.col("band").alias("other"), "id").distinct()
    deep = mixed.where(F.col("blocks") > wide).join(second, "id").where("band <> other")
    deep = deep.withColumn("band", F.xxhash64(F.least("band", "other"), F.greatest("band", "other"))).select("band", "id", "family", "n").distinct()
    met = mixed.where(F.col("blocks") <= wide).select("band", "id", "family", "n").unionByName(deep)
    # a link's sizes differ by one class at most, so each member stands in its own and in the next
    grade = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9)
    classed = met.withColumn("class", F.explode(F.array(grade, grade + 1)))
    dealt = stored(classed.join(apart(classed, "band", "class"), ["band", "class"]).withColumn("part", F.expr("cast(pmod(xxhash64(id, 8), blocks) as int)")))
    lots = max(1, math.ceil((dealt.agg(F.sum("blocks")).first()[0] or 0) / (4 * meet)))  # small buckets share a task's call
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other"), "lot": F.expr(f"cast(pmod(xxhash64(band, class, least(part, other), greatest(part, other)), {lots}) as int)")})
    alone = F.when(F.col("blocks") > 1, F.struct("band", "class", "x", "y"))
    signed = spread.select("band", "class", "lot", alone.alias("alone"), "id", "n", "family").join(one.select("id", "signature"), "id")
    return stored(signed.groupBy("lot", "alone").applyInArrow(lambda t: _meet(t, slack, percent), "a long, b long").distinct())


def _shingle_rows(batches, size: int):
    for batch in batches:
        found = [shingles(t, size).tobytes() for t in batch.column("text").to_pylist()]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.binary())], [*names, "shingles"])


def _links(table: pa.Table, percent: float) -> pa.Table:
    """For each document of the group the smallest one it is connected to inside it."""
    ids = table.column("id").to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets], np.int64)
    every, of, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, column = np.repeat(np.arange(len(sets)), sizes), (np.cumsum(n > 1) - 1)[of]
    row, column = row[n[of] > 1], column[n[of] > 1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        part = slice(*np.searchsorted(column, [at, at + 4096]))
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[part], column[part] - at] = 1
        shared += m @ m.T
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    np.fill_diagonal(linked, True)
    label = ids.copy()
    while True:
        new = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            break
        label = new
    keep = label != ids
    return pa.table([pa.array(ids[keep]), pa.array(label[keep])], ["a", "b"])


def _exact_links(sets: DataFrame, percent: float, block: int) -> DataFrame:
    """Links inside families: sets has id, family, blocks (of its family), part and shingles."""
    compare = lambda df: df.groupBy("family", "x", "y").applyInArrow(lambda t: _links(t, percent), "a long, b long")
    one = F.lit(0).cast("int")
    others = F.sequence(F.lit(1), F.col("blocks") - 1)
    to = F.when(F.col("part") > 0, F.array("part")).when(F.col("blocks") > 1, others).otherwise(F.array(one))
    first = stored(compare(sets.select("id", "family", "shingles", one.alias("x"), F.explode(to).alias("y"))))
    large = sets.where("blocks > 1")
    if large.isEmpty():
        return first
    parts = connected_components(first, "a", "b").withColumnRenamed("node", "id")
    known = large.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    blocks = F.greatest(F.lit(1) / block, F.octet_length("shingles") / (8.0 * BLOCK_SHINGLES))  # of a block, for each document
    count = known.groupBy("family", "component").agg(F.sum(blocks).alias("n"))
    largest = count.groupBy("family").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("all"))
    rest = F.greatest(F.ceil(F.col("all") - F.col("most.n") - 1e-9), F.lit(1)).cast("int")
    largest = largest.where("parts > 1").select("family", F.col("most.component").alias("main"), rest.alias("rest"))
    apart = known.join(largest, "family").withColumn("left", F.col("component") != F.col("main"))
    own = F.expr("cast(pmod(xxhash64(id, 5), rest) as int)")
    every_rest = apart.select("id", "family", "shingles", F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("x"), (F.col("part") + 1).alias("y"))
    leftover = apart.where("left").withColumn("x", own).withColumn("y", F.explode(F.sequence(F.lit(1), F.col("blocks"))))
    second = every_rest.unionByName(leftover.select("id", "family", "shingles", "x", "y")).dropDuplicates(["id", "family", "x", "y"])
    return first.unionByName(stored(compare(second)))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    threshold: float = 0.75,
    bands: int = 36,
    rows: int = 4,
    slack: float = 0.5,
    block: int = 512,
    meet: int = 2048,
    wide: int = 2,
) -> DataFrame:
    """docs plus n_shingles (long), component_id (the smallest id reachable) and kept (it is its own component's)."""
    docs = docs.drop("n_shingles", "component_id", "kept")
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    source = docs.select(id_.alias("id"), text_key(text).alias("key"), text.alias("text"))
    signed = stored(source.mapInArrow(lambda it: _sign(it, size, bands * rows), SIGNED))
    usable = signed.where("n > 0 and id is not null")
    first = usable.groupBy("digest").agg(F.min(F.struct("id", "key")).alias("f")).select("digest", F.col("f.id").alias("rep"), F.col("f.key").alias("rep_key"))
    named = usable.join(first, "digest")
    reps = named.where("id = rep and key = rep_key").dropDuplicates(["id", "key"]).select("id", F.col("id").alias("doc"), "key", "n", "signature")
    # a node is a text: where an id has several, all but its first get numbers above all ids, and links to the id
    several = stored(usable.groupBy("id").agg(F.count_distinct("digest").alias("n"), F.min("key").alias("least")).where("n > 1").select(F.col("id").alias("doc"), "least"))
    many = not several.isEmpty()
    node = F.when(F.col("least") != F.col("key"), F.shiftrightunsigned(F.xxhash64("doc", "key"), 2) + F.lit(OWN_NODES)).otherwise(F.col("doc"))
    if many:
        reps = reps.join(several, "doc", "left").withColumn("id", node).drop("least")
    reps = stored(reps)

    buckets = reps.mapInArrow(lambda it: _band(it, bands), "band long, id long")
    centres = buckets.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("z > a").drop("z")
    stars = buckets.join(centres, "band").where("id > a").select("a", F.col("id").alias("b")).distinct()
    one = reps
    pairs = stars.join(one.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(one.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
    likely = stored(pairs.mapInArrow(lambda it: _agreeing(it, slack), "a long, b long"))
    known = stored(connected_components(likely, "a", "b"))
    met = _met(buckets, centres, known, one, slack, 100 * threshold, meet, wide)
    # components so far stand for their pairs
    families = connected_components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(met), "a", "b").select(F.col("node").alias("id"), F.col("component").alias("family"))
    held = F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES)
    sizes = families.join(one.select("id", "n"), "id").groupBy("family").agg(F.ceil(held).cast("int").alias("blocks"))
    members = stored(reps.select("id", "doc", "key").join(families, "id").join(sizes, "family").withColumn("part", F.expr("cast(pmod(xxhash64(id), blocks) as int)")))
    # one plan at every size: a small table of members would otherwise be broadcast, and only a large one shuffled
    texts = source.withColumnRenamed("id", "doc").join(members.hint("merge"), ["doc", "key"]).dropDuplicates(["doc", "key"])
    sets = stored(texts.select("id", "family", "blocks", "part", "text").mapInArrow(lambda it: _shingle_rows(it, size), "id long, family long, blocks int, part int, shingles binary"))
    links = _exact_links(sets, 100 * threshold, block)

    of_rep = connected_components(links, "a", "b").select(F.col("node").alias("rep"), "component")
    if many:
        at = named.join(several.select(F.col("doc").alias("rep"), "least"), "rep", "left").withColumn("node", F.when(F.col("least") != F.col("rep_key"), F.shiftrightunsigned(F.xxhash64("rep", "rep_key"), 2) + F.lit(OWN_NODES)).otherwise(F.col("rep")))
        own = at.join(several.select(F.col("doc").alias("id")), "id", "left_semi").select(F.col("id").alias("a"), F.col("node").alias("b"))
        of_rep = connected_components(links.unionByName(own).unionByName(at.where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))), "a", "b").select(F.col("node").alias("rep"), "component")
    labels = (
        named.select("id", "key", "rep").distinct().join(of_rep, "rep", "left")
        .select(F.col("id").alias("__near_id"), F.col("key").alias("__near_key"), F.coalesce("component", "rep").alias("__near_component"))
    )
    counts = signed.select(F.col("id").alias("__near_id"), F.col("key").alias("__near_key"), F.col("n").alias("__near_n")).distinct()
    result = stored(counts.join(labels, ["__near_id", "__near_key"], "left"))
    keyed = docs.withColumns({"__near_i": id_, "__near_k": text_key(text)})
    joined = keyed.join(result, F.col("__near_i").eqNullSafe(F.col("__near_id")) & (F.col("__near_k") == F.col("__near_key")), "left")
    component = F.coalesce("__near_component", "__near_i")
    return joined.withColumns({"n_shingles": F.col("__near_n"), "component_id": component, "kept": F.coalesce(component == F.col("__near_i"), F.lit(True))}).drop("__near_i", "__near_k", "__near_id", "__near_key", "__near_component", "__near_n")
