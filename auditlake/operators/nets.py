"""A small classifier net trained data-parallel: the same numpy step in barrier tasks that average their weights.

Each task keeps its share of all rows in a file of its own, mapped into memory, and steps through batches of it with Adam; every `sync`
steps the tasks gather each other's weights and moments and go on from their mean, so all end with the same net. With one task it is plain
mini-batch Adam. Draws depend on the seed, the task's number and the step only: a rerun gives the same weights.

What the tasks gather goes through files in the folder that the cluster shares, if all of them see it as a path; else through Spark's
barrier, which waits a second at least each time. The numbers are the same.
"""

from __future__ import annotations

import base64
import math
import os
import tempfile
import time
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame

from auditlake.sources.scratch import delete, local_folder

Net = list[np.ndarray]


def new_net(sizes: list[int], seed: int) -> Net:
    """Weights and biases by layer, uniform within one over the root of a layer's inputs."""
    rng, out = np.random.default_rng(seed), []
    for a, b in zip(sizes, sizes[1:]):
        out += [rng.uniform(-1, 1, (a, b)) / math.sqrt(a), rng.uniform(-1, 1, b) / math.sqrt(a)]
    return out


def logits(net: Net, x: np.ndarray) -> np.ndarray:
    for k in range(0, len(net), 2):
        x = x @ net[k] + net[k + 1]
        x = np.maximum(x, 0) if k + 2 < len(net) else x
    return x


def gradient(net: Net, x: np.ndarray, y: np.ndarray) -> tuple[float, Net]:
    """Mean cross-entropy of two classes, and its gradient."""
    held = [x]
    for k in range(0, len(net), 2):
        z = held[-1] @ net[k]
        z += net[k + 1]
        held.append(np.maximum(z, 0, out=z) if k + 2 < len(net) else z)
    z = held[-1] - held[-1].max(axis=1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    rows = np.arange(len(y))
    loss = -float(np.log(np.maximum(p[rows, y], np.finfo(p.dtype).tiny)).mean())
    p[rows, y] -= 1
    back, out = p / len(y), [None] * len(net)
    for k in range(len(net) - 2, -1, -2):
        out[k], out[k + 1] = held[k // 2].T @ back, back.sum(axis=0)
        if k:
            back = back @ net[k].T
            back *= held[k // 2] > 0
    return loss, out


def adam(net: Net, moments: tuple[Net, Net], g: Net, step: int, rate: float = 1e-3) -> None:
    """One step in place, with one array beside a layer's own; steps count from 1."""
    for w, m, v, x in zip(net, *moments, g):
        t = x - m
        t *= 0.1
        m += t
        np.multiply(x, x, out=t)
        t -= v
        t *= 0.001
        v += t
        np.sqrt(np.multiply(v, 1 / (1 - 0.999**step), out=t), out=t)
        t += 1e-8
        np.divide(m, t, out=t)
        t *= rate / (1 - 0.9**step)
        w -= t


def _flat(*nets: Net) -> np.ndarray:
    return np.concatenate([a.ravel() for n in nets for a in n])


def _gatherer(here: BarrierTaskContext, folder: str | None) -> Callable[[bytes], list[bytes]]:
    """What gathers the bytes of all tasks, in their order. Folders count as shared only if every task reads what every other wrote."""
    own, at = f"{here.stageId()}-{here.taskAttemptId()}", 0  # another one in every attempt
    try:
        if folder:
            Path(folder, f"{own}-0").touch()
    except OSError:
        pass
    names = here.allGather(own)
    shared = here.allGather("yes" if folder and all(Path(folder, f"{name}-0").exists() for name in names) else "no")

    def gather(data: bytes) -> list[bytes]:
        """A file a task and turn; who has the others' next files knows that all have read the last ones."""
        nonlocal at
        at += 1
        written = Path(folder, f"{own}-{at}")
        written.with_suffix(".part").write_bytes(data)
        os.replace(written.with_suffix(".part"), written)
        out = []
        for name in names:
            while not (found := Path(folder, f"{name}-{at}")).exists():
                time.sleep(0.0005)
            out.append(found.read_bytes())
        Path(folder, f"{own}-{at - 1}").unlink(missing_ok=True)
        return out

    if "no" in shared:
        return lambda data: [base64.b64decode(x) for x in here.allGather(base64.b64encode(data).decode())]
    return gather


def _share(batches, dimensions: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A task's rows as a matrix, which is a mapped file without a name, and their classes."""
    held, sides = tempfile.TemporaryFile(), [np.zeros(0, np.int8)]
    for batch in batches:
        lists = batch.column("v")
        if lists.null_count or batch.column("y").null_count or (lists.value_lengths().to_numpy(zero_copy_only=False) != dimensions).any():
            raise ValueError("vectors and classes must be there, and vectors of one length")
        held.write(lists.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes())
        sides.append(batch.column("y").to_numpy(zero_copy_only=False).astype(np.int8))
    held.flush()
    y = np.concatenate(sides)
    x = np.asarray(np.memmap(held, kind, "r", shape=(len(y), dimensions))) if len(y) else np.zeros((0, dimensions), kind)
    return x, y


def train_net(rows: DataFrame, key: str, dimensions: int, steps: int, hidden: tuple[int, ...] = (256, 256), batch: int = 256, sync: int = 50, seed: int = 1, each: int = 100_000, kind: str = "float64") -> Net:
    """A net that tells y = 1 from y = 0: rows of key, v (array<double>) and y (int).

    All rows are trained on; a task has about `each` of them, more only where there would be more tasks than the session runs at a time,
    since all must run together. kind is the numbers' type while it trains.
    """
    spark = rows.sparkSession
    tasks = max(1, min(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / each)))
    sizes = [dimensions, *hidden, 2]
    made, folder = local_folder(spark, f"net-{uuid.uuid4().hex}") if tasks > 1 else (None, None)

    def run(batches):
        x, y = _share(batches, dimensions, kind)
        here = BarrierTaskContext.get()
        gather = _gatherer(here, folder) if tasks > 1 else None
        flat = _flat(new_net(sizes, seed)).astype(kind)
        state = np.concatenate([flat, np.zeros(2 * len(flat), kind)])  # weights and both moments
        weights, *moments = np.split(state, 3)
        net, g = [a.astype(kind) for a in new_net(sizes, seed)], np.empty_like(flat)
        at = 0
        for k, a in enumerate(net):  # layers are views of the weights
            net[k] = weights[at : at + a.size].reshape(a.shape)
            at += a.size
        own = max(1, batch // tasks)
        for step in range(1, steps + 1):
            if len(x):
                at = np.random.default_rng([seed, here.partitionId(), step]).integers(0, len(x), own)
                np.concatenate([a.ravel() for a in gradient(net, x[at], y[at].astype(int))[1]], out=g)
                adam([weights], ([moments[0]], [moments[1]]), [g], step)
            if tasks > 1 and (step % sync == 0 or step == steps):
                others = [np.frombuffer(m, kind) for m in gather(state.tobytes() if len(x) else b"") if m]
                if others:
                    state[:] = np.mean(others, axis=0)
        if here.partitionId() == 0:
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(net)), pa.int32()), "w": [a.ravel().astype(float) for a in net]})

    dealt = rows.select(key, "v", "y").repartition(tasks, key).sortWithinPartitions(key, "y", "v").select("v", "y")
    try:
        got = {r["k"]: np.array(r["w"]) for r in dealt.mapInArrow(run, "k int, w array<double>", barrier=True).collect()}  # the net's own numbers
    finally:
        if made:
            delete(spark, made)
    net = new_net(sizes, seed)
    for k, w in got.items():
        net[k] = w.reshape(net[k].shape)
    return net


def score_net(rows: DataFrame, net: Net, key: str) -> DataFrame:
    """(id, score): the raw output of class 1."""
    held = rows.sparkSession.sparkContext.broadcast(net)

    def run(frames):
        for pdf in frames:
            if len(pdf):
                yield pd.DataFrame({"id": pdf[key], "score": logits(held.value, np.stack(pdf["v"].to_numpy()).astype(float))[:, 1]})

    return rows.select(key, "v").mapInPandas(run, f"id {dict(rows.dtypes)[key]}, score double")
