"""Packed exchange between pages of documents and hash buckets, in a bounded number of rows a page.

A page sends what it holds in segments, one a bucket: arrays of numbers, several of them. Segments travel
many to a row, so that rows stay few whatever the number of buckets: with `fan` or fewer buckets a page
sends one row to each; with up to fan ** 2 it sends a row to each of `fan` groups of buckets, where the
rows of about `fan` pages are dealt out again by bucket, and so on. Every level moves the data once more
and has about pages * fan rows; no level has pages * buckets. Answers go back the same way: from a bucket
to groups of pages, and on to the pages. A bucket's size is that of the data over the number of buckets,
which callers keep fixed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from auditlake.llm._hashing import mix

ROWS = "to long, via long, pages binary, buckets binary, lens binary, columns array<binary>"
_pack, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def zip_(x: np.ndarray) -> bytes:
    return _pack.compress(np.ascontiguousarray(x).tobytes())


def unzip(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_unpack.decompress(x), kind)


class Segments:
    """pages, buckets: of each segment; lens: numbers in it, a column for each array; columns: the arrays end to end."""

    def __init__(self, pages: np.ndarray, buckets: np.ndarray, lens: np.ndarray, columns: list[np.ndarray]):
        self.pages, self.buckets, self.lens, self.columns = pages, buckets, lens.reshape(len(pages), len(columns)), columns

    @staticmethod
    def read(rows: pa.Table | pa.RecordBatch, kinds: tuple[str, ...]) -> "Segments":
        cells = {c: rows.column(c).to_pylist() for c in ("pages", "buckets", "lens", "columns")}
        whole = lambda parts, kind: np.concatenate([np.zeros(0, kind), *(unzip(x, kind) for x in parts)])
        columns = [whole([c[j] for c in cells["columns"]], kind) for j, kind in enumerate(kinds)]
        return Segments(whole(cells["pages"], "<i8"), whole(cells["buckets"], "<i8"), whole(cells["lens"], "<i8"), columns)

    def taken(self, which: np.ndarray) -> "Segments":
        """The segments at these places, in this order."""
        if len(which) == len(self.pages) and (which[1:] > which[:-1]).all():
            return self
        columns = []
        for j, column in enumerate(self.columns):
            n, start = self.lens[which, j], (np.cumsum(self.lens[:, j]) - self.lens[:, j])[which]
            at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
            columns.append(column[at])
        return Segments(self.pages[which], self.buckets[which], self.lens[which], columns)

    def starts(self, j: int) -> np.ndarray:
        """Where each segment's numbers of a column start, and the end of the last."""
        return np.concatenate([[0], np.cumsum(self.lens[:, j])])

    def rows(self, to: np.ndarray, via: np.ndarray) -> pa.RecordBatch:
        """A row for each pair of to and via."""
        order = np.lexsort((via, to))
        moved, to, via = self.taken(order), to[order], via[order]
        new = np.ones(len(to), bool)
        new[1:] = (to[1:] != to[:-1]) | (via[1:] != via[:-1])
        cuts = [*np.flatnonzero(new).tolist(), len(to)]
        parts = list(zip(cuts, cuts[1:]))
        starts = [moved.starts(j) for j in range(len(self.columns))]
        packed = [[zip_(c[s[a] : s[b]]) for c, s in zip(moved.columns, starts)] for a, b in parts]
        blob = lambda x: pa.array([zip_(x[a:b]) for a, b in parts], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(to[cuts[:-1]], pa.int64()), pa.array(via[cuts[:-1]], pa.int64()), blob(moved.pages), blob(moved.buckets), blob(moved.lens), pa.array(packed, pa.list_(pa.binary()))],
            ["to", "via", "pages", "buckets", "lens", "columns"],
        )


class Exchange:
    """The ways between so many pages and so many buckets."""

    def __init__(self, pages: int, buckets: int, fan: int = 4096):
        self.fan, self.buckets, self.groups = fan, buckets, max(1, math.ceil(pages / fan))
        self.levels = 1
        while fan**self.levels < buckets:
            self.levels += 1

    def _group(self, pages: np.ndarray, level: int) -> np.ndarray:
        """The group of pages at a level: 0 is the page itself, each next one holds about fan times as many."""
        if level == 0:
            return pages
        return (mix(pages.astype(np.uint64)) % np.uint64(self.groups)).astype(np.int64) // self.fan ** (level - 1)

    def sent(self, s: Segments) -> pa.RecordBatch:
        """A page's segments as the rows of the first level."""
        return s.rows(s.buckets // self.fan ** (self.levels - 1), self._group(s.pages, 1))

    def forward(self, rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
        """Rows whose `to` is the bucket and whose `via` is a group of about fan pages, one of `groups`; no row mixes groups."""
        for level in range(self.levels - 2, -1, -1):
            rows = self._dealt(rows, kinds, lambda s, at=level: (s.buckets // self.fan**at, self._group(s.pages, self.levels - at) if at else self._group(s.pages, 1)))
        return rows

    @staticmethod
    def _dealt(rows: DataFrame, kinds: tuple[str, ...], where) -> DataFrame:
        """Rows with the same to and via dealt out again; where gives the new ones of segments."""

        def deal(table: pa.Table) -> pa.Table:
            s = Segments.read(table, kinds)
            return pa.Table.from_batches([s.rows(*where(s))])

        return rows.groupBy("to", "via").applyInArrow(deal, ROWS)

    def answered(self, s: Segments) -> pa.RecordBatch:
        """A bucket's answers as the rows of the first level back."""
        top = self.levels - 1
        return s.rows(self._group(s.pages, top), s.buckets // self.fan if top else np.zeros(len(s.pages), np.int64))

    def back(self, rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
        """Rows whose `to` is the page."""
        for level in range(self.levels - 2, -1, -1):
            rows = self._dealt(rows, kinds, lambda s, at=level: (self._group(s.pages, at), s.buckets // self.fan ** (self.levels - at) if at else np.zeros_like(s.pages)))
        return rows
