"""Loudness by K-weighting and gating, and true peak, of linear PCM.

The weighting filter remembers all that went before, so a stream can't just be cut. But it is linear: what a
stretch of samples leaves in it is what it would leave from silence, plus what is left of the state before
it. So stretches are filtered at the same time (``scan.block_scan``) and give sums of squares for each tenth
of a second, from which windows and gates, plain aggregates, make all loudness figures."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import Scan, block_scan

#: The two stages of the weighting: a shelf (frequency, gain in dB, quality) and a high pass (frequency,
#: quality), from the recommendation's filters at 48 kHz. Fixed values.
SHELF, PASS = (1681.974450955533, 3.999843853973347, 0.7071752369554196), (38.13547087602444, 0.5003270373238773)
#: Weights of left, right, centre, low effects and the surrounds; further channels don't count. Fixed values.
WEIGHTS = [1.0, 1.0, 1.0, 0.0, 1.41, 1.41]
#: The same without centre and effects (four channels), and without effects (five). Fixed values.
WEIGHTS_OF = {4: [1.0, 1.0, 1.41, 1.41], 5: [1.0, 1.0, 1.0, 1.41, 1.41]}
#: LUFS = OFFSET + 10 log10(energy); blocks below GATE don't count. Fixed values.
OFFSET, GATE = -0.691, -70.0
#: Samples that the weighting goes through at a time.
STEP = 64
#: Taps of the interpolation for true peak. Fixed value.
TAPS = 49


def _sections(rate: int) -> list[tuple[list[float], list[float]]]:
    """(b, a) of each stage at a sample rate, by the bilinear transform."""
    f, gain, q = SHELF
    k, vh = np.tan(np.pi * f / rate), 10 ** (gain / 20)
    vb, a0 = vh**0.4996667741545416, 1 + k / q + k * k
    shelf = ([(vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0], [2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
    f, q = PASS
    k = np.tan(np.pi * f / rate)
    a0 = 1 + k / q + k * k
    return [shelf, ([1.0, -2.0, 1.0], [2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])]


@lru_cache(maxsize=16)
def weighting(rate: int) -> tuple[np.ndarray, ...]:
    """The filter over STEP samples at once: states after them (by state, by samples) and outputs (by state, by
    samples), and the states after one sample by state. A state is four numbers a channel."""

    def one(state: np.ndarray, x: float) -> tuple[np.ndarray, float]:
        out = []
        for (b, a), (s, t) in zip(_sections(rate), (state[:2], state[2:])):
            y = b[0] * x + s
            out += [b[1] * x - a[0] * y + t, b[2] * x - a[1] * y]
            x = y
        return np.array(out), x

    def steps(state: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ys = []
        for x in xs:
            state, y = one(state, x)
            ys.append(y)
        return state, np.array(ys)

    silence, rest = np.zeros(STEP), np.zeros(4)
    by_state = [steps(e, silence) for e in np.eye(4)]
    by_sample = [steps(rest, e) for e in np.eye(STEP)]
    after, shown = (np.array([x[i] for x in by_state]) for i in (0, 1))
    pushed, heard = (np.array([x[i] for x in by_sample]) for i in (0, 1))
    single = np.array([one(e, 0.0)[0] for e in np.eye(4)])
    return after, pushed, shown, heard, single


def weigh(samples: np.ndarray, state: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples (time, channel) through the filter from ``state`` (channel, 4): outputs, and the state after."""
    n, channels = samples.shape
    after, pushed, shown, heard, _ = weighting(rate)
    whole = n // STEP * STEP
    blocks = samples[:whole].reshape(-1, STEP, channels).transpose(0, 2, 1)
    fresh, left = blocks @ heard, blocks @ pushed
    states = np.empty((len(blocks), channels, 4))
    for i in range(len(blocks)):
        states[i] = state
        state = state @ after + left[i]
    out = [(fresh + states @ shown).transpose(0, 2, 1).reshape(whole, channels)]
    if whole < n:
        rest = np.zeros((STEP, channels))
        rest[: n - whole] = samples[whole:]
        out.append((rest.T @ heard + state @ shown).T[: n - whole])
        state = state_after(state, n - whole, rate) + rest.T[:, : n - whole] @ pushed[STEP - (n - whole) :]
    return np.concatenate(out), state


def state_after(state: np.ndarray, n: int, rate: int) -> np.ndarray:
    """What is left of ``state`` after ``n`` samples of silence."""
    return state @ np.linalg.matrix_power(weighting(rate)[4], n)


@lru_cache(maxsize=16)
def interpolation(rate: int) -> np.ndarray:
    """The filter of each phase (phase, tap), a windowed sinc: four samples for one below 96 kHz, two below
    192 kHz, else one, which is the sample itself."""
    factor = 4 if rate < 96_000 else 2 if rate < 192_000 else 1
    if factor == 1:
        return np.ones((1, 1))
    j = np.arange(TAPS)
    whole = np.sinc((j - (TAPS - 1) / 2) / factor) * 0.5 * (1 - np.cos(2 * np.pi * j / (TAPS - 1)))
    length = -(-TAPS // factor)
    phases = np.zeros((factor, length))
    phases[j % factor, j // factor] = whole
    return phases


def peaks(samples: np.ndarray, before: np.ndarray, rate: int) -> np.ndarray:
    """The largest interpolated magnitude at each sample, of all channels; ``before`` are the samples that
    precede them."""
    phases = interpolation(rate)
    reach = phases.shape[1] - 1
    joined = np.concatenate([np.zeros((max(reach - len(before), 0), samples.shape[1])), before[max(len(before) - reach, 0) :], samples])
    windows = np.lib.stride_tricks.sliding_window_view(joined, reach + 1, axis=0)
    # one product of two flat matrices, not one for each sample
    return np.abs(windows.reshape(-1, reach + 1) @ phases[:, ::-1].T).reshape(len(samples), -1).max(axis=1) if len(samples) else np.zeros(0)


class _Weighting(Scan):
    """Slots' energies of rows (first_sample, pcm: interleaved floats). A state is the filter's and the samples
    that interpolation looks back on."""

    def __init__(self, keys: list[str], rate: int, channels: int, decode: Callable[[Any], np.ndarray] | None = None):
        self.keys, self.rate, self.channels, self.decode = keys, rate, channels, decode or (lambda pcm: np.asarray(pcm, dtype=float))
        weights = WEIGHTS_OF.get(channels, [*WEIGHTS, *[0.0] * channels])[:channels]
        self.weights, self.slot = np.array(weights), (rate + 5) // 10

    def start(self):
        return np.zeros((self.channels, 4)), np.zeros((0, self.channels))

    def _samples(self, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = [self.decode(p).reshape(-1, self.channels) for p in frame["pcm"]]
        places = [first + np.arange(len(r)) for first, r in zip(frame["first_sample"], rows, strict=True)]
        return np.concatenate(rows), np.concatenate(places)

    def summarise(self, frame):
        samples, _ = self._samples(frame)
        return weigh(samples, self.start()[0], self.rate)[1], len(samples), samples[-TAPS:]

    def carry(self, state, summary):
        left, n, last = summary
        return state_after(state[0], n, self.rate) + left, np.concatenate([state[1], last])[-TAPS:]

    def run(self, state, frame):
        samples, places = self._samples(frame)
        weighted, _ = weigh(samples, state[0], self.rate)
        slots, at, n = np.unique(places // self.slot, return_inverse=True, return_counts=True)
        highest = np.zeros(len(slots))
        np.maximum.at(highest, at, peaks(samples, state[1], self.rate))
        energy = np.bincount(at, (weighted**2) @ self.weights, len(slots))
        return pd.DataFrame({k: frame[k].iloc[0] for k in self.keys} | {"slot": slots, "energy": energy, "peak": highest, "samples": n})


def slot_energies(pcm: DataFrame, keys: list[str], rate: int, channels: int, bucket_s: int = 10, decode: Callable[[Any], np.ndarray] | None = None) -> DataFrame:
    """(keys, slot, energy, peak, samples) of ``pcm`` (keys, first_sample, pcm): for each tenth of a second the sum
    of the weighted channels' squares, and the largest interpolated magnitude. pcm are interleaved floats,
    full scale 1, and first_sample is the stream's own count of samples, by which slots go; the filter goes
    on over what is missing. A null or empty pcm is left out. With ``decode``, pcm is what that makes such floats of
    (one at least), in the tasks that go through them, so that no row holds them."""
    rows = pcm.where(F.col("pcm").isNotNull() if decode else F.size("pcm") > 0).select(*keys, "first_sample", "pcm")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", slot long, energy double, peak double, samples long"
    found = block_scan(rows, keys, ["first_sample"], F.floor(F.col("first_sample") / (rate * bucket_s)), _Weighting(keys, rate, channels, decode), schema)
    return found.groupBy(*keys, "slot").agg(F.sum("energy").alias("energy"), F.max("peak").alias("peak"), F.sum("samples").alias("samples"))


def lufs(energy: Column) -> Column:
    """Loudness of a mean square; null for none."""
    return F.when(energy > 0, OFFSET + 10 * F.log10(energy))


def _energy_of(lufs_: float) -> float:
    return 10 ** ((lufs_ - OFFSET) / 10)


def _with_means(slots: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """Slots with the mean squares over the last 4 (m) and 30 (s) slots; what is missing is silence."""
    by = Window.partitionBy(*keys).orderBy("slot")
    mean = lambda n: F.sum("energy").over(by.rangeBetween(1 - n, 0)) / (n * ((rate + 5) // 10))
    return slots.withColumns({"m": mean(4), "s": mean(30), "first_slot": F.min("slot").over(by)})


def loudness_over_time(slots: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """(keys, slot, momentary, short_term, true_peak_db) at the end of each tenth of a second."""
    told = _with_means(slots, keys, rate)
    return told.select(*keys, "slot", lufs(F.col("m")).alias("momentary"), lufs(F.col("s")).alias("short_term"), F.when(F.col("peak") > 0, 20 * F.log10("peak")).alias("true_peak_db"))


def programme_loudness(slots: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """(keys, integrated, loudness_range, true_peak_db) of each stream from its beginning.

    Integrated: the mean of all 400 ms blocks, one each tenth of a second, that are above GATE and not over
    10 LU below the mean of those above GATE; null if there is none. Range: from the tenth to the 95th
    percentile (nearest rank) of the 3 s blocks, one each second, above GATE and not over 20 LU below their
    mean; 0 if there is none."""
    told = _with_means(slots, keys, rate)
    nth = F.col("slot") - F.col("first_slot")
    gate = _energy_of(GATE)
    short = F.when((nth >= 29) & ((nth + 1) % 10 == 0) & (F.col("s") >= gate), F.col("s"))
    blocks = told.select(*keys, "peak", F.when((nth >= 3) & (F.col("m") >= gate), F.col("m")).alias("m"), short.alias("s"))
    means = blocks.groupBy(*keys).agg(F.avg("m").alias("m_mean"), F.avg("s").alias("s_mean"), F.max("peak").alias("peak"))
    judged = blocks.drop("peak").join(means, keys).select(*keys, F.when(F.col("m") >= F.col("m_mean") / 10, F.col("m")).alias("m"), F.when(F.col("s") >= F.col("s_mean") / 100, F.col("s")).alias("s"), "peak")
    by = Window.partitionBy(*keys)
    ranked = judged.withColumns({"n": F.count("s").over(by), "i": F.row_number().over(by.orderBy(F.col("s").asc_nulls_last())) - 1})
    at = lambda p: F.max(F.when(F.col("i") == F.floor((F.col("n") - 1) * p + 0.5), F.col("s")))
    found = ranked.groupBy(*keys).agg(F.avg("m").alias("m"), at(0.1).alias("low"), at(0.95).alias("high"), F.max("peak").alias("peak"))
    width = F.coalesce(10 * F.log10(F.col("high") / F.col("low")), F.lit(0.0))
    return found.select(*keys, lufs(F.col("m")).alias("integrated"), width.alias("loudness_range"), F.when(F.col("peak") > 0, 20 * F.log10("peak")).alias("true_peak_db"))
