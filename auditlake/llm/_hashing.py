"""Hashes of words and word windows over whole byte strings, in numpy."""

from __future__ import annotations

import functools

import numpy as np

SLICE = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@functools.lru_cache
def word_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte; powers of the multiplier and of its inverse."""
    values = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
    inverse = np.uint64(pow(int(_MULTIPLIER), -1, 2**64))
    powers = lambda m: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(SLICE, m, np.uint64))])
    with np.errstate(over="ignore"):
        return values, powers(_MULTIPLIER), powers(inverse)


def _one_slice(data: np.ndarray) -> np.ndarray:
    values, up, down = word_tables()
    word = ~SPACE[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * up[: len(data)])])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run of bytes other than space and 09 to 0D), as bytes.split() finds them."""
    data = np.frombuffer(text, np.uint8)
    out, at = [], 0
    while at < len(data):
        to = min(at + SLICE, len(data))
        if to < len(data):  # cut at the last white space of the slice
            gap = np.flatnonzero(SPACE[data[at:to]])
            if not len(gap):  # a word longer than a slice
                more = np.flatnonzero(SPACE[data[to:]])
                stop = to + more[0] if len(more) else len(data)
                out.append(_long_word(data[at:stop]))
                at = stop
                continue
            to = at + gap[-1] + 1
        out.append(_one_slice(data[at:to]))
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _long_word(data: np.ndarray) -> np.ndarray:
    parts = np.array([_one_slice(data[i : i + SLICE])[0] for i in range(0, len(data), SLICE)], np.uint64)
    return windows(parts, len(parts), 29)


def windows(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.full(n, np.uint64(seed)), np.uint64(1)
    step = np.uint64(0xD6E8FEB86659FD93 + 2 * seed)
    with np.errstate(over="ignore"):
        for k in range(size):
            out += words[k : k + n] * factor
            factor = factor * step
    return mix(out)
