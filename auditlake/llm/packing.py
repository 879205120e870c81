"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Documents' token counts (words and one end mark) are dealt by a hash of the id into groups of about
`group` documents, and every group is packed by itself, longest item first. An item goes to the open bin
it fits best (least room left); where none has room, the least-cost bin size is opened: each permitted
length is filled on trial from the sizes that are left in the group, always the largest that fits, and
the one with the least padding a token wins, the longer of equals. So the lengths are weighed against
each other on the same remaining items. At the end each bin shrinks to the smallest permitted length
that holds its contents. An item longer
than the largest length is cut into pieces of that length and a rest. Groups are bounded by a count
that doesn't change with the input, so more data is more tasks, not larger ones.

Defined results: null and empty texts hold their end mark only; null ids are packed like any other and
keep their null; rows repeated are packed once each, and equal lengths go in order of id and row; a text longer than the largest
capacity is packed in pieces; an empty table gives none.
Extra columns stay; ones named like an output column are replaced.
"""

from __future__ import annotations

import bisect
import collections
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm._shared import stored

LENGTHS = (512, 1024, 2048, 4096)
PIECE = "array<struct<piece:int,bin_id:string,capacity:int,at:int,n:int>>"


class _Open:
    """Open bins by room left."""

    def __init__(self):
        self.rooms: list[int] = []  # sorted rooms with at least one bin
        self.bins: dict[int, list[int]] = {}  # room to a heap of bins, oldest first

    def add(self, room: int, bin_: int) -> None:
        if room not in self.bins:
            bisect.insort(self.rooms, room)
            self.bins[room] = []
        heapq.heappush(self.bins[room], bin_)

    def take(self, need: int) -> tuple[int, int] | None:
        i = bisect.bisect_left(self.rooms, need)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        bin_ = heapq.heappop(self.bins[room])
        if not self.bins[room]:
            del self.bins[room]
            self.rooms.pop(i)
        return room, bin_


class _Left:
    """Sizes of the items not yet packed, with their counts, and what a bin filled from them would hold."""

    def __init__(self, items: list[int]):
        self.count = collections.Counter(items)
        self.sizes = sorted(self.count)

    def drop(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.sizes[bisect.bisect_left(self.sizes, n)]

    def fill(self, room: int) -> int:
        """Tokens that go into so much room, always the largest that still fits."""
        filled, i = 0, len(self.sizes)
        while room and (i := bisect.bisect_right(self.sizes, room, 0, i) - 1) >= 0:
            n = self.sizes[i]
            times = min(self.count[n], room // n)
            filled, room = filled + n * times, room - n * times
        return filled


def pack(items: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """For items in falling order of size, none above the largest length: bin of each, place in it, and each bin's length."""
    lengths = tuple(sorted(lengths))
    opened, left, bins, at, used = _Open(), _Left(items), [], [], []
    for n in items:
        left.drop(n)
        got = opened.take(n)
        if got is None:
            best = None
            for c in lengths:
                if c >= n:
                    held = n + left.fill(c - n)
                    cost = ((next(x for x in lengths if x >= held) - held) / held, -c)  # padding a token, of the bin as it would end
                    best = min(best, (*cost, c)) if best else (*cost, c)
            got = best[2], len(used)
            used.append(0)
        room, b = got
        bins.append(b)
        at.append(used[b])
        used[b] += n
        if room > n:
            opened.add(room - n, b)
    return bins, at, [next(c for c in lengths if c >= u) for u in used]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, group: int = 8192) -> DataFrame:
    """docs plus n_tokens (long) and pieces: array of (piece, bin_id, capacity, at, n), one for each part of the document."""
    lengths, docs = tuple(sorted(lengths)), docs.drop("n_tokens", "pieces")
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    sized = stored(docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), (words + 1).alias("n_tokens")).groupBy("id", "key", "n_tokens").agg(F.count("*").alias("copies")))
    n = sized.agg(F.sum("copies")).first()[0] or 0
    groups = max(1, math.ceil(n / group))
    dealt = sized.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    dealt = dealt.withColumn("g", F.expr(f"cast(pmod(xxhash64(id, key, copy), {groups}) as int)"))
    most = lengths[-1]
    schema = T._parse_datatype_string(f"id long, key long, copy int, n_tokens long, pieces {PIECE}")

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("id", "key", "copy", "n_tokens", "g"))), key=lambda r: (r[3], r[0] is None, r[0] or 0, r[1], r[2]), reverse=True)
        parts = [(min(most, r[3] - start), i, p) for i, r in enumerate(rows) for p, start in enumerate(range(0, r[3], most))]
        parts.sort(key=lambda x: (-x[0], x[1], x[2]))
        bins, at, size = pack([x[0] for x in parts], lengths)
        pieces: list[list] = [[] for _ in rows]
        for (m, i, p), b, a in zip(parts, bins, at):
            pieces[i].append({"piece": p, "bin_id": f"{rows[i][4]}-{b}", "capacity": size[b], "at": a, "n": m})
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("bin_id", pa.string()), ("capacity", pa.int32()), ("at", pa.int32()), ("n", pa.int32())]))
        return pa.table(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()),
             pa.array([sorted(p, key=lambda x: x["piece"]) for p in pieces], kind)],
            ["id", "key", "copy", "n_tokens", "pieces"],
        )

    packed = stored(dealt.groupBy("g").applyInArrow(run, schema))
    keyed = docs.withColumns({"_id": F.col(id_col).cast("long"), "_key": key})
    if packed.where("copy > 1").isEmpty():
        keyed = keyed.withColumn("_copy", F.lit(1))
    else:  # repeated rows: each takes the place of one copy
        from pyspark.sql.window import Window

        keyed = keyed.withColumn("_copy", F.row_number().over(Window.partitionBy("_id", "_key").orderBy(F.lit(1))))
    place = packed.select(F.col("id").alias("_i"), F.col("key").alias("_k"), F.col("copy").alias("_c"), "n_tokens", "pieces")
    out = keyed.join(place, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")) & (F.col("_copy") == F.col("_c")))
    return out.drop("_id", "_key", "_copy", "_i", "_k", "_c")
