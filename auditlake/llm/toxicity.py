"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over hashed features of a text's distinct words: the word, and its first four
and first five letters. It is trained in numpy from at most `max_positive` confirmed toxic texts and
at most `max_unlabelled` texts taken without their labels, with the risk

    prior * E_p[loss(f)] + max(0, E_u[loss(-f)] - prior * E_p[loss(-f)])

where the prior is the toxic share of the labelled rows. When the bracket goes below zero the step goes
up its gradient instead, so flexible weights can't drive it negative. Both samples are the texts whose
hashed id is smallest, each text of an id once, `max_features` distinct features in all, and only from rows outside the
fold held out; labels, lang, source and id are no features. Features seen in fewer than `min_texts` toxic texts, or not `surprise` standard deviations more
often than their share of unlabelled texts lets expect, are dropped: they say nothing.
The model is 2**bits floats, the same size for any input. Whole texts are scored, in Arrow batches.

A text with none of the features scores the bias that training found, but no more than the prior.

Defined results: null and empty texts score what the bias alone gives; a null id isn't held out; with
no confirmed toxic text every score is 0; an id that some label row calls toxic counts as confirmed,
whatever its other rows say, and each of its texts is an example, once however often it is repeated; ties at the samples'
bounds go by smaller id, then by the text's hash; an empty table gives none; very long texts are read whole, and a word of over a megabyte is one word. Extra columns stay, ones named like an output are
replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm._hashing import SLICE, mix, word_tables
from auditlake.llm._shared import text_key

_WORD = np.zeros(256, bool)
_WORD[0x80:] = _WORD[ord("a") : ord("z") + 1] = _WORD[ord("0") : ord("9") + 1] = True


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % folds


def _slice_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes by kind (word, first four letters, first five) of the words of at most SLICE bytes."""
    word = _WORD[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    values, up, down = word_tables()
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * up[: len(data)])])
    letters = np.flatnonzero((data & 0xC0) != 0x80)  # where code points begin
    letters = np.append(letters, np.full(6, len(data)))
    first = np.searchsorted(letters, start)
    stops = (end, np.minimum(letters[first + 4], end), np.minimum(letters[first + 5], end))
    return np.stack([mix((total[stop] - total[start]) * down[start] + np.uint64(kind)) for kind, stop in enumerate(stops, 1)])


def features(text: str | None, bits: int = 18) -> np.ndarray:
    """Sorted distinct feature numbers of a text's words and their first four and five letters."""
    raw = (text or "").encode().lower()
    inside, out, at = _WORD[np.frombuffer(raw, np.uint8)], [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        to = min(at + SLICE, len(raw))
        if to < len(raw) and inside[to - 1] and inside[to]:  # cut after the last byte of the slice that is in no word
            gaps = np.flatnonzero(~inside[at:to])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:  # one word longer than a slice
                more = np.flatnonzero(~inside[to:])
                to = to + int(more[0]) if len(more) else len(raw)
                hashes = _slice_hashes(np.frombuffer(raw[at : at + 32], np.uint8))[:, :1]
                hashes[0, 0] = int.from_bytes(hashlib.blake2b(raw[at:to], digest_size=8).digest(), "big")
                out.append(hashes.reshape(-1))
                at = to
                continue
        out.append(_slice_hashes(np.frombuffer(raw[at:to], np.uint8)).reshape(-1))
        at = to
    return np.unique(np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    return np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows)


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk under the logistic loss of margins of positive and unlabelled texts, and the step's direction by margin.

    Where the bracket is below zero the direction is the bracket's own, turned round.
    """
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    value = prior * np.logaddexp(0, -fp).mean() + max(0.0, negative)
    # d loss(f) = sigmoid(f) - 1, d loss(-f) = sigmoid(f)
    if negative >= 0:
        return value, prior * (_sigmoid(fp) - 1) / len(fp) - prior * _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)
    return value, prior * _sigmoid(fp) / len(fp), -_sigmoid(fu) / len(fu)


def _texts_with(rows: list[np.ndarray], size: int) -> np.ndarray:
    """How many texts have each feature; a text's are distinct, so texts are counted one by one and never laid end to end."""
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r] += 1
    return out


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int = 18, min_texts: int = 4, surprise: float = 6.0, steps: int = 300, rate: float = 0.05, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights of all features, and the bias."""
    size = 1 << bits
    seen, among = _texts_with(positive, size), _texts_with(unlabelled, size)
    expected = (among + 1) * len(positive) / len(unlabelled)
    use = np.flatnonzero((seen >= min_texts) & (seen - expected > surprise * np.sqrt(expected)))
    to = np.full(size, -1, np.int64)
    to[use] = np.arange(len(use))
    pick = lambda rows: [k[k >= 0] for k in (to[r] for r in rows)]
    (pj, pi, p), (uj, ui, u) = _csr(pick(positive)), _csr(pick(unlabelled))
    w, b = np.zeros(len(use)), np.log(prior / (1 - prior))
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        fp = np.bincount(pi, w[pj], p) + b
        fu = np.bincount(ui, w[uj], u) + b
        gp, gu = risk(fp, fu, prior)[1:]
        gw = np.bincount(pj, gp[pi], len(use)) + np.bincount(uj, gu[ui], len(use)) + decay * w
        gb = gp.sum() + gu.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (mw / c1) / (np.sqrt(vw / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[use] = w
    return weights, float(min(b, np.log(prior / (1 - prior))))


def _sample(docs: DataFrame, wanted: DataFrame, most: int, most_features: int, bits: int) -> list[np.ndarray]:
    """Features of at most `most` different texts of wanted's ids, in the order of a hash, and of no more than `most_features` in all."""

    def run(batches):
        for batch in batches:
            found = pa.array([features(t, bits).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), found], ["id", "key", "f"])

    keyed = docs.select("id", text_key(F.col("text")).alias("key"), "text")
    order = (F.xxhash64("id"), F.col("id"), F.col("key"))
    chosen = keyed.select("id", "key").join(wanted, "id", "left_semi").distinct().orderBy(*order).limit(most)
    texts = keyed.join(F.broadcast(chosen), ["id", "key"], "left_semi").mapInArrow(run, "id long, key long, f binary")
    out, held = [], 0
    for r in texts.groupBy("id", "key").agg(F.max("f").alias("f")).orderBy(*order).toLocalIterator():
        out.append(np.frombuffer(r["f"], np.int32))
        held += len(out[-1])
        if held > most_features:
            break
    return out


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.3,
    folds: int = 4,
    held: int = 2,
    max_positive: int = 4000,
    max_unlabelled: int = 12000,
    max_features: int = 30_000_000,
    bits: int = 18,
) -> DataFrame:
    """docs plus held_out (boolean), score (double, 0 to 1) and predicted (int)."""
    docs = docs.drop("held_out", "score", "predicted")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    train = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where((fold(F.col("id"), folds) != held) & F.col("y").isNotNull())
    total = train.agg(F.count("*").alias("n"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("toxic")).first()
    if total["toxic"]:
        positive = _sample(plain, train.where("y = 1").select(F.col("id").cast("long").alias("id")).distinct(), max_positive, max_features, bits)
        others = plain.where(fold(F.col("id"), folds) != held).select("id").distinct()
        unlabelled = _sample(plain, others, max_unlabelled, max_features, bits)
        prior = min(max(total["toxic"] / total["n"], 1e-3), 0.5)
        weights, bias = fit_nnpu(positive, unlabelled, prior, bits) if positive and unlabelled else (None, 0.0)
    else:
        weights, bias = None, 0.0

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def score(batches):
        for batch in batches:
            found = [features(t, bits) for t in batch.column(text_col).to_pylist()]
            f = np.array([0.0 if weights is None else float(_sigmoid(weights[x].sum(dtype=np.float64) + bias)) for x in found], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f)], [*batch.schema.names, "score"])

    scored = docs.mapInArrow(score, schema)
    return scored.withColumns({"held_out": F.coalesce(fold(F.col(id_col), folds) == held, F.lit(False)), "predicted": F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int")})
