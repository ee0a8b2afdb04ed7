"""Linear PCM as bytes, with dither that splits over tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Shifts of the generator's three steps. Fixed values.
LEFT, RIGHT, LAST = 13, 7, 17


def _step(x: np.ndarray) -> np.ndarray:
    x = x ^ (x << np.uint64(LEFT))
    x = x ^ (x >> np.uint64(RIGHT))
    return x ^ (x << np.uint64(LAST))


@lru_cache(maxsize=64)
def _leap(power: int) -> np.ndarray:
    """What 2**power steps make of each single bit. A step is linear in the bits, so a leap is one in two."""
    if power == 0:
        return _step(np.uint64(1) << np.arange(64, dtype=np.uint64))
    half = _leap(power - 1)
    return np.array([_applied(half, x) for x in half], np.uint64)


def _applied(leap: np.ndarray, state: np.uint64) -> np.uint64:
    bits = (state >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    return np.bitwise_xor.reduce(np.where(bits == 1, leap, np.uint64(0)))


def state_after(seed: int, steps: int) -> np.uint64:
    """The generator's state after any number of steps, by leaps of powers of two; a seed of 0 is 1."""
    state, power = np.uint64(max(seed, 1)), 0
    while steps:
        if steps & 1:
            state = _applied(_leap(power), state)
        steps, power = steps >> 1, power + 1
    return state


def draws(seed: int, first: int, n: int) -> np.ndarray:
    """The upper halves of states ``first`` + 1 to ``first`` + n. Lanes that begin a power of two apart are
    stepped together."""
    power = max((n - 1).bit_length() + 1 >> 1, 0) if n else 0
    width = 1 << power
    starts = [state_after(seed, first)]
    while len(starts) * width < n:
        starts.append(_applied(_leap(power), starts[-1]))
    state, out = np.array(starts, np.uint64), np.empty((len(starts), width), np.uint64)
    for i in range(width):
        state = _step(state)
        out[:, i] = state
    return (out.reshape(-1)[:n] >> np.uint64(32)).astype(np.uint32)


def dither(seed: int, first: int, n: int) -> np.ndarray:
    """Triangular noise of one step each way for samples ``first`` on: the difference of two draws, in
    single precision."""
    pairs = draws(seed, 2 * first, 2 * n).astype(np.float32).reshape(-1, 2) / np.float32(4294967295)
    return pairs[:, 0] - pairs[:, 1]


def encoded(samples: np.ndarray, depth: int, noise: np.ndarray | None = None) -> bytes:
    """Samples from -1 to 1 as big-endian integers of 16, 20 or 24 bits (20 in the upper bits of three
    bytes), rounded half away from zero and clamped."""
    most = 1 << depth - 1
    level = np.clip(samples.astype(np.float32), np.float32(-1), np.float32(1)) * np.float32(most)
    level = (level if noise is None else level + noise).astype(np.float64)
    whole = np.clip(np.trunc(level + np.copysign(0.5, level)), -most, most - 1).astype(np.int64) << (4 if depth == 20 else 0)
    size = 2 if depth == 16 else 3
    return whole.astype(">i4").view(np.uint8).reshape(-1, 4)[:, 4 - size :].tobytes()


def encode_pcm(depth: int, channels: int, seed: int | None = None):
    """A function of columns (pcm: interleaved floats, first_frame: the stream's own count) to bytes. With
    ``seed`` dither is added, two draws a sample; each row leaps to its own place in the generator's sequence,
    so rows may be encoded anywhere and in any order. Null samples give null."""

    @F.pandas_udf("binary")
    def run(pcm: pd.Series, first_frame: pd.Series) -> pd.Series:
        def one(samples, first) -> bytes | None:
            if samples is None:
                return None
            given = np.asarray(samples, np.float32)
            return encoded(given, depth, None if seed is None else dither(seed, int(first) * channels, len(given)))

        return pd.Series([one(s, f) for s, f in zip(pcm, first_frame, strict=True)], dtype=object)

    return run
