"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is brought to length one, centred on the corpus mean, rotated by one random orthogonal
matrix and reduced to its signs: a packed bit for each dimension, plus two scalars, its distance from
the mean and the inner product of its direction with its code. A query is rotated alike and rounded to
four bits a dimension, in four packed planes, so its inner product with a code is four counts of common
bits. From these the inner product with the vector is estimated without bias, with an error bound that
holds with high probability (`bound` standard deviations, of the code's and the rounding's errors). The
vectors whose upper bound reaches the `k`-th exact cosine so far are ranked exactly, in double precision
on the original vectors; a product in single precision passes over most of them before. The others can't be
among the nearest.

The query rows meet all rows in blocks: candidates are dealt into blocks of `block` at most by hash, a block
of `query_block` queries goes to each, and each pair of blocks returns at most k rows a query; the last
ranking reads those only. Within a block, some queries meet some codes at a time. Nothing is skipped: every
row has a code and every query meets every code. The work is that of all queries times all rows, and each
side is copied once for every block of the other.

Defined results: vectors that are null, zero, or hold nulls or non-finite components take no part, nor
do those whose length isn't the commonest one; null ids take no part; equal scores go by smaller id;
repeated rows count once; of several vectors of one id the nearest counts, and a query id with several
asks with each; vectors of any finite magnitude are scaled by a power of two first, so nothing overflows;
fewer than k candidates give fewer rows; an empty table gives none; other columns don't reach the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm._shared import stored

#: Candidates are dealt into so many blocks, if these have so many rows at least; larger tables have more blocks.
BLOCKS, LEAST_BLOCK = 24, 2048


def rotation(dimensions: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = _scaled(vectors)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _dense(column: pa.ListArray, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimensions)


def encode(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, distance from the mean, and inner product of direction and code, for each row."""
    rest = (_unit(vectors) - mean) @ turn
    far = np.sqrt((rest * rest).sum(axis=1))
    inner = np.abs(rest).sum(axis=1) / (np.maximum(far, 1e-300) * math.sqrt(rest.shape[1]))
    return _packed(rest > 0), far, np.maximum(inner, 1e-9)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits of each row as 64-bit words."""
    pad = np.zeros((*bits.shape[:-1], -bits.shape[-1] % 64), bool)
    return np.packbits(np.concatenate([bits, pad], axis=-1), axis=-1).view(np.uint64)


def planes(rest: np.ndarray, bits: int = 4) -> tuple[np.ndarray, float, float, np.ndarray]:
    """A rotated query rounded to `bits` bits: packed planes from the lowest bit, least value, step, and the rounded query."""
    low = float(rest.min())
    step = max(float(rest.max()) - low, 1e-300) / ((1 << bits) - 1)
    level = np.rint((rest - low) / step).astype(np.int64)
    return _packed((level[None, :] >> np.arange(bits)[:, None]) & 1 == 1), low, step, low + step * level


def _common(codes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Of each query (its planes, from the lowest bit) with each code: the sum of the levels where the code has a one."""
    out = np.zeros((len(levels), len(codes)), np.uint16 if codes.shape[1] * 64 << levels.shape[1] < 1 << 16 else np.int64)
    for j in range(levels.shape[1] - 1, -1, -1):
        out <<= 1
        for w in range(codes.shape[1]):
            out += np.bitwise_count(codes[:, w][None, :] & levels[:, j, w][:, None])
    return out


def _products(codes: np.ndarray, ones: np.ndarray, plane: np.ndarray, low: float, step: float, rounded: np.ndarray) -> np.ndarray:
    """Inner products of the rounded query with all codes, as signs."""
    return 2 * (low * ones + step * _common(codes, plane[None])[0]) - rounded.sum()


class _Bounds:
    """Upper bounds of the cosines of queries with codes, in single precision and never below those that the method states.

    A bound is one over unit vectors, 1 - |o - q|^2 / 2 from the centred parts, with the estimated product and `bound` deviations of its
    errors. The deviation is the root of a sum of two products of a query's and a code's part; r <= (r^2 / c + c) / 2 for any c, and with a
    c near the root that is a sum of products itself, larger by a hundredth or less.
    """

    def __init__(self, packed: np.ndarray, far: np.ndarray, inner: np.ndarray, rest: np.ndarray, bound: float):
        d, s = rest.shape[1], np.maximum(np.sqrt((rest * rest).sum(axis=1)), 1e-12)
        asked = [planes(r) for r in rest]
        low, step, rounded = np.array([x[1] for x in asked]), np.array([x[2] for x in asked]), np.stack([x[3] for x in asked])
        lost = ((rest - rounded) ** 2).sum(axis=1)
        of_code, of_rounding = (1 - np.minimum(inner, 1) ** 2) / inner**2 / max(d - 1, 1), 1 / (d * inner**2)
        near = np.maximum(far * np.sqrt(of_code + of_rounding * np.mean(lost / s**2)), 1e-12)
        gain = far / (math.sqrt(d) * inner)
        ones = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
        wide = (far**2 * of_code / near + near, far**2 * of_rounding / near)
        self.codes, self.levels = packed, np.stack([x[0] for x in asked])
        self.gain, self.step = gain.astype(np.float32), (2 * step).astype(np.float32)
        self.code = np.stack([1 - far**2 / 2, gain * ones, gain, np.ones(len(far)), *wide]).astype(np.float32)
        self.query = np.stack([np.ones(len(s)), 2 * low, -rounded.sum(axis=1), 1e-4 - s**2 / 2, bound / 2 * s, bound / 2 * lost / s], axis=1).astype(np.float32)  # 1e-4: of single precision

    def __call__(self, rows: slice, at: slice) -> np.ndarray:
        out = np.multiply(_common(self.codes[at], self.levels[rows]), self.gain[at], dtype=np.float32)
        out *= self.step[rows, None]
        out += self.query[rows] @ self.code[:, at]
        return out


def _passing(u: np.ndarray, c: np.ndarray, let: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of unit vectors that are let through and whose cosine reaches the floor, but for single precision.

    Few pairs are measured one by one; of many, products are taken for all at once, which costs less.
    """
    if np.count_nonzero(let) * 16 >= let.size:
        return np.nonzero(let & (u @ c.T >= floor[:, None]))
    row, at = np.nonzero(let)
    few = max(1, (1 << 20) // u.shape[1])
    dots = [np.einsum("pd,pd->p", u[row[i : i + few]], c[at[i : i + few]]) for i in range(0, len(row), few)]
    keep = np.concatenate([np.zeros(0, np.float32), *dots]) >= floor[row]
    return row[keep], at[keep]


def _search(queries: pa.Table, codes: pa.Table, k: int, dimensions: int, mean: np.ndarray, turn: np.ndarray, bound: float, some: int = 32, most: int = 1024) -> pa.Table:
    """Each query's k nearest of one block of candidates.

    Queries go through the codes by tiles of `some` by `most`, the first ones narrower; the k best so far, by cosines in double precision,
    are the floor that a code's bound has to reach.
    """
    ids, cid = queries.column("id").to_numpy(), codes.column("id").to_numpy()
    if not len(ids) or not len(cid):
        return pa.table([np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], ["query_id", "id", "score"])
    q, c = (_scaled(_dense(x.column("v").combine_chunks(), dimensions)) for x in (queries, codes))
    u, o = (_unit(x).astype(np.float32) for x in (q, c))
    packed = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint64).reshape(len(cid), -1)
    bounds = _Bounds(packed, *(codes.column(n).to_numpy() for n in ("far", "inner")), (_unit(q) - mean) @ turn, bound)
    repeated, slack = len(np.unique(cid)) < len(cid), 1e-6 + 1.2e-7 * dimensions  # of products in single precision
    cuts = [0]
    while cuts[-1] < len(cid):
        cuts.append(min(len(cid), cuts[-1] + min(most, max(some, cuts[-1]))))
    out: tuple[list, list, list] = ([], [], [])
    for first in range(0, len(ids), some):
        rows = slice(first, min(first + some, len(ids)))
        n, floor = rows.stop - first, np.full(rows.stop - first, -np.inf)
        row, at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for lo, hi in zip(cuts, cuts[1:]):
            least = (floor - slack).astype(np.float32)
            r, a = _passing(u[rows], o[lo:hi], bounds(rows, slice(lo, hi)) >= least[:, None], least)
            a = a + lo
            other = cid[a] != ids[first + r]
            r, a = r[other], a[other]
            if not len(r):
                continue
            row, at, score = np.concatenate([row, r]), np.concatenate([at, a]), np.concatenate([score, _pairs(c, q[rows], a, r)])
            if repeated:  # the best row of each id
                order = np.lexsort((-score, cid[at], row))
                row, at, score = row[order], at[order], score[order]
                best = np.concatenate([[True], (row[1:] != row[:-1]) | (cid[at[1:]] != cid[at[:-1]])])
                row, at, score = row[best], at[best], score[best]
            order = np.lexsort((cid[at], -score, row))
            row, at, score = row[order], at[order], score[order]
            rank = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
            floor[row[rank == k - 1]] = score[rank == k - 1]
            keep = rank < k
            row, at, score = row[keep], at[keep], score[keep]
        for held, x in zip(out, (ids[first + row], cid[at], score)):
            held.append(x)
    return pa.table([np.concatenate(x) for x in out], ["query_id", "id", "score"])


def _pairs(c: np.ndarray, q: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Cosines of these pairs of rows, some at a time."""
    few = max(1, (1 << 20) // c.shape[1])
    return np.concatenate([_cosines(c[at[i : i + few]].T, q[row[i : i + few]].T) for i in range(0, len(at), few)])


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to 0.5..1: no rounding, no overflow."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _cosines(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of the columns of q with those of c, in plain double precision, summed in the order of the components."""
    dot, cc, qq = (np.zeros(c.shape[1]) for _ in range(3))
    for j in range(len(c)):
        dot += c[j] * q[j]
        cc += c[j] * c[j]
        qq += q[j] * q[j]
    return np.clip(dot / np.sqrt(cc * qq), -1, 1)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    bound: float = 4.5,
    block: int = 65536,
    query_block: int = 4096,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k nearest other rows by cosine."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = rows.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    most = max(lengths, key=lambda r: (r["n"], -r["d"]))
    d, q_blocks = most["d"], max(1, math.ceil(most["q"] / query_block))
    blocks = max(math.ceil(most["n"] / block), min(BLOCKS, math.ceil(most["n"] / LEAST_BLOCK)))
    good = good.where(F.size("v") == d).groupBy("id", "v").agg(F.max("asks").alias("asks"))

    def sums(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([_unit(_dense(batch.column("v"), d)).sum(axis=0).tolist()])], ["s"])

    part = good.mapInArrow(sums, "s array<double>")
    total = part.select(F.posexplode("s").alias("j", "x")).groupBy("j").agg(F.sum("x").alias("x")).collect()  # one row a dimension
    mean = np.zeros(d)
    for r in total:
        mean[r["j"]] = r["x"] / most["n"]
    turn = rotation(d)

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                bits, far, inner = encode(_dense(batch.column("v"), d), mean, turn)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(far), pa.array(inner)], [*batch.schema.names, "code", "far", "inner"])

    dealt = F.expr(f"cast(pmod(xxhash64(id), {blocks}) as int)").alias("block")
    index = good.select("id", "v").mapInArrow(code, "id long, v array<double>, code binary, far double, inner double").select("*", dealt)
    asked = good.where("asks").select("id", "v", F.expr(f"cast(pmod(xxhash64(id, 9), {q_blocks}) as int)").alias("part"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    index = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("part"))
    found = asked.groupBy("block", "part").cogroup(index.groupBy("block", "part")).applyInArrow(
        lambda a, b: _search(a, b, k, d, mean, turn, bound), "query_id long, id long, score double"
    )
    best = stored(found.groupBy("query_id", "id").agg(F.max("score").alias("score")))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
