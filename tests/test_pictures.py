"""Figures of pictures and encoded sound against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import media, pcm
from tidegauge.operators import frames


def plain_figures(y):
    h, w = y.shape
    lap = [int(y[r - 1, c]) + int(y[r + 1, c]) + int(y[r, c - 1]) + int(y[r, c + 1]) - 4 * int(y[r, c]) for r in range(1, h - 1, 4) for c in range(1, w - 1, 4)]
    edge, inside = [], []
    for r in range(h):
        for c in range(w):
            for at, d in ((c, abs(int(y[r, c]) - int(y[r, c - 1])) if c else None), (r, abs(int(y[r, c]) - int(y[r - 1, c])) if r else None)):
                if d is not None:
                    (edge if at % 8 == 0 else inside).append(d)
    block = max(np.mean(edge) - np.mean(inside), 0) if min(h, w) >= 16 else 0
    return float(np.var(lap)) if lap else 0.0, float(block)


@pytest.mark.parametrize("shape", [(16, 16), (33, 70), (3, 3), (2, 9), (15, 40)])
def test_kernels(shape):
    y = np.random.default_rng(shape[0]).integers(0, 256, shape, dtype=np.int32)
    blur, block = plain_figures(y)
    assert np.isclose(frames.blur_variance(y), blur) and np.isclose(frames.blockiness(y), block)


def test_edges_and_bars():
    y = np.full((40, 80), 100, np.int32)
    y[:4], y[-7:], y[:, :3], y[:, -5:] = 16, 20, 0, 0
    assert (frames.black_edges(y), frames.black_edges(y.T)) == (11, 8)
    dark = np.zeros((40, 80), np.int32)
    assert frames.black_edges(dark) == 10 + 20
    bars = np.repeat(np.arange(0, 210, 30), 32)[None, :].repeat(128, axis=0)
    assert frames.is_bars(bars) and not frames.is_bars(bars.T) and not frames.is_bars(bars[:60])


def test_frames_of_a_stream(spark):
    """Whatever the bucket; null, cut-off and resized planes have their defined results."""
    still, other = bytes([100]) * 64, bytes([101]) * 64
    rows = [(1, 0, 8, 8, still), (1, 1, 8, 8, still), (1, 2, 8, 8, other), (1, 3, 8, 8, None), (1, 4, 8, 8, still), (1, 5, 4, 16, still), (1, 6, 4, 16, still[:10]), (2, 0, 8, 8, bytes(64)), (2, 1, 8, 8, bytes(64))]
    df = spark.createDataFrame(rows, "k int, n int, width int, height int, plane binary")
    for size in (1, 3, 100):
        got = [(r["k"], r["n"], r["difference"], r["slate"]) for r in frames.frame_metrics(df, ["k"], "n", F.floor(F.col("n") / size)).orderBy("k", "n").collect()]
        assert got == [(1, 0, None, False), (1, 1, 0.0, True), (1, 2, 1.0, False), (1, 3, None, None), (1, 4, None, False), (1, 5, None, False), (1, 6, None, None), (2, 0, None, False), (2, 1, 0.0, False)]


def plain_states(seed, n):
    x, out = seed, []
    for _ in range(n):
        x ^= x << 13 & (1 << 64) - 1
        x ^= x >> 7
        x ^= x << 17 & (1 << 64) - 1
        out.append(x)
    return out


def test_the_generator_leaps():
    assert plain_states(1, 1) == [1082269761]
    states = plain_states(77, 5000)
    for n in (1, 2, 63, 64, 1000, 4999, 5000):
        assert int(pcm.state_after(77, n)) == states[n - 1]
    for first, n in ((0, 1), (0, 5000), (17, 100), (1234, 3000), (5, 0)):
        assert pcm.draws(77, first, n).tolist() == [s >> 32 for s in states[first : first + n]]
    assert pcm.state_after(0, 0) == 1


@pytest.mark.parametrize("depth", [16, 20, 24])
def test_encoding_reads_back(spark, depth):
    samples = [0.0, 0.5, -0.5, 1.0, -1.0, 1.5, -2.0, 0.25, 1 / 3, -1 / 3]
    df = spark.createDataFrame([(samples, 0), (None, 5)], "pcm array<float>, first long")
    coded = df.select(pcm.encode_pcm(depth, 2)("pcm", "first").alias("b"))
    got = coded.select(media.decode_pcm(F.col("b"), depth, 2).alias("x")).collect()
    step = 1 / (1 << depth - 1)
    want = [min(max(x, -1), 1 - step) for x in samples]
    assert got[1]["x"] is None and np.allclose([v for pair in zip(*got[0]["x"]) for v in pair], want, atol=step)


def test_dither_is_the_same_however_rows_are_cut(spark):
    samples = np.sin(np.arange(600)).astype(np.float32)
    whole = pcm.encoded(samples, 16, pcm.dither(5, 0, 600))
    cuts = [0, 2, 100, 350, 600]
    rows = [(samples[a:b].tolist(), a // 2) for a, b in zip(cuts, cuts[1:])]
    got = spark.createDataFrame(rows, "pcm array<float>, first long").repartition(3).select("first", pcm.encode_pcm(16, 2, seed=5)("pcm", "first").alias("b")).orderBy("first").collect()
    assert b"".join(r["b"] for r in got) == whole
    noise = pcm.dither(5, 0, 20_000)
    assert abs(noise.mean()) < 0.02 and abs(noise.std() - 6**-0.5) < 0.01 and np.abs(noise).max() <= 1
