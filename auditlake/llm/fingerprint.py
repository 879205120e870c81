"""Document fingerprints: content-defined chunks, and digest sets weighted by length.

A gear hash over the last 32 bytes proposes boundaries. Chunking is normalised: after `least` bytes a
boundary needs `normal_bits + 2` zero bits until the chunk has reached its normal size, then
`normal_bits - 2`, and at `most` bytes a chunk ends anyway. Since a boundary depends on the bytes just
before it, an insertion shifts only the chunks around it. A fingerprint is the set of distinct chunk
digests, each with its length; the likeness of two is how much of the shorter one's length the other
contains.

Each document is also compared with the one before it in order of id, and with a text edited from both.
Neighbours are brought together by ranges of (id, hash of the text): their bounds are those of Spark's own
range partitioning of ids alone, about one for RANGE_BYTES of text and at most MAX_RANGES, so 16 MB on the
driver and in each task; rows find theirs by bisection. The first document of a range also goes to the
range before it. Texts are shuffled once, and ranges are read row by row, never held whole, so an id that a
third of all rows have needs no more memory than another; its different texts are in different ranges.

Defined results: null text counts as empty; an empty text has an empty fingerprint, and the likeness of
two empty fingerprints is 1, of one empty 0; rows that share an id follow each other in order of a hash
of the text; null ids come after all others; a single document is its own neighbour; texts of any length
are cut whole; an empty table gives none; columns other than id and text don't reach the result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm._shared import text_key

LEAST, NORMAL_BITS, MOST = 32, 7, 1024
RANGE_BYTES, MAX_RANGES = 16 << 20, 1 << 20
_GEAR = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):  # each step doubles the bytes that the hash covers
        if len(h) > width:
            wider = h.copy()
            wider[width:] += h[:-width] << np.uint32(width)
            h = wider
    top = np.uint32(32 - NORMAL_BITS + 2)
    loose = np.flatnonzero(h >> top == 0) + 1  # the strict ones are among them
    strict = loose[(h[loose - 1] >> np.uint32(32 - NORMAL_BITS - 2)) == 0]
    loose, strict = loose.tolist(), strict.tolist()
    ends, at, i, j, n, normal = [], 0, 0, 0, len(data), 1 << NORMAL_BITS
    while at < n:
        while i < len(strict) and strict[i] < at + LEAST:
            i += 1
        while j < len(loose) and loose[j] < at + normal:
            j += 1
        if i < len(strict) and strict[i] < at + normal:
            end = strict[i]
        elif j < len(loose):
            end = loose[j]
        else:
            end = n
        at = min(end, at + MOST, n)
        ends.append(at)
    return ends


def fingerprint(text: bytes) -> dict[bytes, int]:
    """Digest of each distinct chunk, and its length."""
    if not text:
        return {}
    out, at = {}, 0
    for end in boundaries(np.frombuffer(text, np.uint8)):
        chunk = text[at:end]
        out[hashlib.blake2b(chunk, digest_size=8).digest()] = len(chunk)
        at = end
    return out


def as_text(print_: dict[bytes, int]) -> str:
    """Eleven letters for each digest and three for its length, by digest."""
    return "".join((base64.b64encode(d)[:11] + base64.b64encode(n.to_bytes(2, "big"))[:3]).decode() for d, n in sorted(print_.items()))


def likeness(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Length of the chunks they share, of the length of the shorter one's chunks."""
    if not a or not b:
        return float(not a and not b)
    shared = sum(n for d, n in a.items() if d in b)
    return shared / min(sum(a.values()), sum(b.values()))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    # order: smaller ids later; null ids first, as they come after all others from below
    order = F.coalesce(-F.col("id"), F.lit(-(2**63)).cast("long"))
    rows = rows.withColumns({"o": order, "key": text_key(F.col("text"))})
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    schema = T._parse_datatype_string(
        f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    if not size["n"]:
        return docs.sparkSession.createDataFrame([], schema)
    ranges = min(MAX_RANGES, max(1, math.ceil(size["bytes"] / RANGE_BYTES)))
    dealt = rows.select("o", "key").repartitionByRange(ranges, "o", "key").groupBy(F.spark_partition_id()).agg(F.min(F.struct("o", "key")).alias("f"))
    bounds = sorted((r["f"]["o"], r["f"]["key"]) for r in dealt.collect())  # at most MAX_RANGES; each is the first row of its range
    by_order, by_key = np.array([b[0] for b in bounds], np.int64), [b[1] for b in bounds]

    def place(batches):
        for batch in batches:
            o, key = batch.column("o").to_numpy(), batch.column("key").to_numpy()
            low, high = np.searchsorted(by_order, o, "left"), np.searchsorted(by_order, o, "right")
            to, firsts = high - 1, {}
            for i in np.flatnonzero(high > low):  # rows that share their order with a bound go by key
                to[i] = bisect.bisect_right(by_key, key[i], low[i], high[i]) - 1
                if to[i] >= low[i] and by_key[to[i]] == key[i]:
                    firsts[int(to[i])] = int(i)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.int64()), pa.array(np.zeros(n, bool))], [*batch.schema.names, "to", "guest"])
            if firsts:  # order is a ring: the last range is before the first one
                guests = batch.take(pa.array(list(firsts.values())))
                before = pa.array([(r - 1) % len(bounds) for r in firsts], pa.int64())
                yield pa.RecordBatch.from_arrays([*guests.columns, before, pa.array([True] * len(firsts))], [*batch.schema.names, "to", "guest"])

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        now, out = None, []  # the row that still waits for the next one: range, id, text, fingerprint
        for batch in batches:
            for to, id_, text, guest in zip(*(batch.column(c).to_pylist() for c in ("to", "id", "text", "guest"))):
                if guest and (now is None or now[0] != to):
                    continue  # another copy of the range's guest
                print_ = fingerprint(text.encode())
                if now is not None and now[0] == to:
                    other = _edited(now[2], text).encode()
                    edited = fingerprint(other)
                    out.append((now[1], len(now[2]), hashlib.sha256(other).hexdigest(), as_text(now[3]), as_text(edited), likeness(now[3], edited), likeness(now[3], print_)))
                now = None if guest else (to, id_, text, print_)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], [f.name for f in schema])
            out = []

    placed = rows.mapInArrow(place, "id long, text string, o long, key long, to long, guest boolean")
    return placed.repartition("to").sortWithinPartitions("to", "guest", "o", "key").mapInArrow(run, schema)
