"""Substring dedup: fixed-block anchors that rolling windows probe.

A window is `window` consecutive words of one document; it is a repeat when its words also start in a
document with a smaller id, and repeats' words go. With blocks of (window + 1) // 2 words, any window
holds one whole block of its document's grid. So the index holds the non-overlapping blocks only, every
rolling block-long window probes it, and only around hits are full windows compared; adjacent repeated
windows merge to maximal repeats.

The work goes by pages: up to about 1 MB of documents in one compressed row, made once where the input
is read. Pages send the distinct hashes they hold to hash buckets (see `_exchange`), each with the
smallest id among the page's documents that have it as an anchor and the largest of those that have it at
all, and get back, for the hashes that are repeated, the smallest id overall. Beyond 4096 pages hashes are combined by groups
of pages before they meet in their bucket, and answered by groups. So a passage in a third of
all documents is one entry a page, and one a group of pages in its bucket, and no pairs are made. Around hits, windows are
extended by the same exchange of full windows: neighbours that repeat merge to maximal repeats. Anchors
and probes go as 32 bits beside the bucket, whose size is fixed: a false match only costs one more
comparison. Full windows go as 64 bits beside theirs.

Defined results: null text has no words and stays null; empty text stays empty; ids that are null come
after all others and don't count as smaller than each other; rows that share an id don't remove each
other's words; rows repeated get the same result each; very long texts are read whole, a page each; an empty table gives none.
Extra columns stay; ones named like an output column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from auditlake.llm._exchange import ROWS, Exchange, Segments, unzip, zip_
from auditlake.llm._hashing import windows, word_hashes
from auditlake.llm._shared import stored

PAGE_BYTES, PAGE_ROWS, BUCKET_BYTES, FAN = 1 << 20, 20_000, 16 << 20, 4096
NONE, NEVER = np.uint16(0xFFFF), np.int64(2**63 - 1)
PAGES = "page long, size long, rows binary"
NARROW, WIDE, BACK = ("<u4", "<i8", "<i8"), ("<u8", "<i8", "<i8"), ("<i8",)


def _page_rows(batches: Iterator[pa.RecordBatch], text_col: str, page_bytes: int = PAGE_BYTES) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    page = TaskContext.get().partitionId() << 32
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            run = np.cumsum(lengths[at : at + PAGE_ROWS])
            n = max(1, int(np.searchsorted(run, page_bytes, "right")))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
                out.write_batch(batch.slice(at, n))
            yield pa.RecordBatch.from_arrays([pa.array([page]), pa.array([int(run[min(n, len(run)) - 1])]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["page", "size", "rows"])
            page, at = page + 1, at + n


class _Page:
    """The rows of a page in order of id, and the hashes of their words."""

    def __init__(self, rows: bytes, id_col: str, text_col: str, window: int):
        table = pa.ipc.open_stream(rows).read_all()
        ids = np.array([2**63 - 1 if i is None else i for i in table.column(id_col).to_pylist()], np.int64)
        order = np.argsort(ids, kind="stable")
        self.table, self.ids = table.take(pa.array(order)), ids[order]
        self.texts = [None if t is None else t.encode() for t in self.table.column(text_col).to_pylist()]
        each = [word_hashes(t or b"") for t in self.texts]
        self.n_words = np.array([len(x) for x in each], np.int64)
        self.words = np.concatenate(each) if each else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(each)), self.n_words)
        self.start = np.concatenate([[0], np.cumsum(self.n_words)])
        self.window, self.block = window, (window + 1) // 2

    def _within(self, size: int) -> np.ndarray:
        """Where runs of so many words of one document start."""
        n = len(self.words) - size + 1
        return np.flatnonzero(self.doc[:n] == self.doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def probes(self, buckets: int) -> "_Keys":
        at = self._within(self.block)
        h = windows(self.words, self.block, 7)[at]
        anchor = (at - self.start[self.doc[at]]) % self.block == 0
        return _Keys(((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), h & np.uint64(0xFFFFFFFF), at, self.doc[at], anchor)

    def windows_at_hits(self, hit_at: np.ndarray, buckets: int) -> "_Keys":
        hits = np.zeros(len(self.words) + 1, np.int64)
        hits[hit_at + 1] = 1
        hits = np.cumsum(hits)
        at = self._within(self.window)
        at = at[hits[at + self.window - self.block + 1] > hits[at]]
        h = windows(self.words, self.window, 13)[at]
        other = windows(self.words, self.window, 17)[at]
        return _Keys((other % np.uint64(buckets)).astype(np.int64), h, at, self.doc[at], np.ones(len(at), bool))


class _Keys:
    """Hashes at places of a page; the distinct ones by bucket, in order of place, with first and last documents."""

    def __init__(self, bucket, key, at, doc, anchor):
        self.at, self.doc = at, doc
        both = np.stack([bucket.astype(np.uint64), key]) if len(key) else np.zeros((2, 0), np.uint64)
        order = np.lexsort((at, both[1], both[0]))
        same = np.zeros(len(order), bool)
        same[1:] = (both[:, order[1:]] == both[:, order[:-1]]).all(axis=0)
        group = np.cumsum(~same) - 1
        first = order[~same]
        rank = np.lexsort((first, bucket[first]))  # by bucket, then place
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        self.of = np.empty(len(order), np.int64)
        self.of[order] = place[group]
        self.bucket, self.key = bucket[first][rank], key[first][rank]
        n = len(first)
        self.low = np.full(n, 0xFFFF, np.uint16)  # the first document with an anchor
        np.minimum.at(self.low, self.of[anchor], doc[anchor].astype(np.uint16))
        self.high = np.zeros(n, np.uint16)
        np.maximum.at(self.high, self.of, doc.astype(np.uint16))

    def sent(self, page: int, ids: np.ndarray, wide: bool) -> Segments:
        """Keys with the smallest id that anchors them and the largest that has them, by bucket."""
        to, n = np.unique(self.bucket, return_counts=True)
        low = np.where(self.low == NONE, NEVER, ids[np.where(self.low == NONE, 0, self.low)]) if len(ids) else np.zeros(0, np.int64)
        return Segments(np.full(len(to), page), to, np.repeat(n[:, None], 3, axis=1), [self.key.astype(WIDE[0] if wide else NARROW[0]), low, ids[self.high]])

    def first(self, back: pa.Table) -> np.ndarray:
        """For each place the smallest id that the buckets know of."""
        firsts, s = np.full(len(self.key), NEVER), Segments.read(back, BACK)
        at = s.starts(0)
        for i, b in enumerate(s.buckets):
            a = np.searchsorted(self.bucket, b)
            firsts[a : a + s.lens[i, 0]] = s.columns[0][at[i] : at[i + 1]]
        return firsts[self.of]


def _combined(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the smallest id that anchors them and the largest that has them."""
    every, of = np.unique(keys, return_inverse=True)
    first, last = np.full(len(every), NEVER), np.full(len(every), np.int64(-(2**63)))
    np.minimum.at(first, of, low)
    np.maximum.at(last, of, high)
    return every, first, last


def _answer(sent: Segments, every: np.ndarray, first: np.ndarray) -> Segments:
    """For the segments that hold any repeated key, of those listed in every: the first document of each such key."""
    keys = sent.columns[0]
    at = np.minimum(np.searchsorted(every, keys), max(len(every) - 1, 0))
    value = np.where(every[at] == keys, first[at], NEVER) if len(every) else np.full(len(keys), NEVER)
    hit = np.add.reduceat(value != NEVER, sent.starts(0)[:-1]) > 0 if len(value) else np.zeros(0, bool)
    return Segments(sent.pages, sent.buckets, sent.lens[:, :1], [value]).taken(np.flatnonzero(hit))


def _repeated(every: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that are anchored in one document and found in a later one."""
    keep = last > first
    return every[keep], first[keep]


def _kept(text: bytes | None, gone: np.ndarray) -> str | None:
    if text is None or not gone.any():
        return None if text is None else text.decode()
    return b" ".join([w for w, g in zip(text.split(), gone.tolist()) if not g]).decode()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """docs, its text less repeated words (kept words joined by one space where any went), plus n_words and n_removed (long)."""
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    names = {a.name for a in added}
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *added])
    arrow = to_arrow_schema(schema)

    pages = stored(docs.mapInArrow(lambda it: _page_rows(it, text_col), PAGES))
    size, n_pages = pages.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ways = Exchange(n_pages, max(1, math.ceil(size / BUCKET_BYTES)), FAN)
    empty = to_arrow_schema(T._parse_datatype_string(ROWS)).empty_table()

    def send_probes(batches):
        for batch in batches:
            for page, rows in zip(batch.column("page").to_pylist(), batch.column("rows").to_pylist()):
                p = _Page(rows, id_col, text_col, window)
                yield ways.sent(p.probes(ways.buckets).sent(page, p.ids, wide=False))

    def answers(rows: DataFrame, kinds: tuple[str, ...], step: int) -> DataFrame:
        """What the buckets answer. With several groups of pages, keys are combined group by group, then by bucket, and
        answered group by group: a key that every page has is one entry a group where its bucket is in one place."""
        dealt, reply = ways.forward(rows, kinds), lambda s, known: pa.Table.from_batches([ways.answered(_answer(s, *known))])
        if ways.groups == 1:
            found = dealt.groupBy("to").applyInArrow(lambda t: reply(s := Segments.read(t, kinds), _repeated(*_combined(*s.columns))), ROWS)
            return stored(ways.back(found, BACK).withColumn("step", F.lit(step)))
        dealt = stored(dealt)

        def one(t: pa.Table, arrays) -> pa.Table:
            return pa.table([pa.array([t.column("to")[0].as_py()], pa.int64()), *(pa.array([zip_(x)], pa.binary()) for x in arrays)], ["to", "keys", "low", "high"][: len(arrays) + 1])

        def read(t: pa.Table, names: tuple[str, ...], types: tuple[str, ...]) -> list[np.ndarray]:
            return [np.concatenate([np.zeros(0, k), *(unzip(x, k) for x in t.column(n).to_pylist())]) for n, k in zip(names, types)]

        parts = dealt.groupBy("to", "via").applyInArrow(lambda t: one(t, _combined(*Segments.read(t, kinds).columns)), "to long, keys binary, low binary, high binary")
        whole = parts.groupBy("to").applyInArrow(lambda t: one(t, _repeated(*_combined(*read(t, ("keys", "low", "high"), kinds)))), "to long, keys binary, low binary")
        copies = whole.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways.groups - 1).cast("long"))).alias("via"))
        by = ("to", "via")
        found = dealt.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(
            lambda t, k: reply(Segments.read(t, kinds), read(k, ("keys", "low"), kinds)) if t.num_rows else empty, ROWS
        )
        return stored(ways.back(found, BACK).withColumn("step", F.lit(step)))

    def of_step(back: pa.Table, step: int) -> pa.Table:
        return back.filter(pc.equal(back.column("step"), step))

    def hits(p: _Page, back: pa.Table) -> _Keys:
        probes = p.probes(ways.buckets)
        return p.windows_at_hits(probes.at[p.ids[probes.doc] >= probes.first(of_step(back, 1))], ways.buckets)

    def send_windows(left: pa.Table, back: pa.Table) -> pa.Table:
        out = [empty]
        for page, rows in zip(left.column("page").to_pylist(), left.column("rows").to_pylist()):
            p = _Page(rows, id_col, text_col, window)
            out.append(pa.Table.from_batches([ways.sent(hits(p, back).sent(page, p.ids, wide=True))]).cast(empty.schema))
        return pa.concat_tables(out)

    def finish(left: pa.Table, back: pa.Table) -> pa.Table:
        out = []
        for rows in left.column("rows").to_pylist():
            p = _Page(rows, id_col, text_col, window)
            keys = hits(p, back)
            edge = np.zeros(len(p.words) + window + 1, np.int64)
            at = keys.at[p.ids[keys.doc] > keys.first(of_step(back, 2))]
            edge[at] += 1
            edge[at + window] -= 1
            gone = np.cumsum(edge)[: len(p.words)] > 0
            each = [gone[a:z] for a, z in zip(p.start, p.start[1:])]
            text = pa.array([_kept(t, g) for t, g in zip(p.texts, each)], pa.string())
            table = p.table.set_column(p.table.column_names.index(text_col), text_col, text)
            for name, values in (("n_words", p.n_words), ("n_removed", np.array([g.sum() for g in each], np.int64))):
                table = table.append_column(name, pa.array(values, pa.int64()))
            out.append(table.cast(arrow))
        return pa.concat_tables(out) if out else arrow.empty_table()

    first = answers(pages.mapInArrow(send_probes, ROWS), NARROW, 1)
    by_page = pages.select("page", "rows").groupBy("page")
    second = answers(by_page.cogroup(first.groupBy("to")).applyInArrow(send_windows, ROWS), WIDE, 2)
    return by_page.cogroup(first.unionByName(second).groupBy("to")).applyInArrow(finish, schema)
