"""Loudness against a plain version, sample by sample, and on signals whose loudness is laid down."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import aggregates, loudness, scan


def pcm(spark, parts, rate, channels=2, chunk=None, lost=()):
    """Rows of a tone: parts are (seconds, dBFS, Hz)."""
    x, n = [], 0
    for seconds, level, hertz in parts:
        t = np.arange(int(seconds * rate)) + n
        x.append(10 ** (level / 20) * np.sin(2 * np.pi * hertz * t / rate))
        n += len(t)
    x, chunk = np.concatenate(x), chunk or rate // 10
    rows = [(1, i, np.repeat(x[i : i + chunk, None], channels, axis=1).ravel().tolist()) for i in range(0, len(x), chunk) if i // chunk not in lost]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["flow_id", "first_sample", "pcm"]), "flow_id long, first_sample long, pcm array<double>")


def plain(samples, rate):
    """Energies of tenths of a second, one sample after another (one channel)."""
    stages = [[b, a, [0.0, 0.0]] for b, a in loudness._sections(rate)]
    out, slot = {}, (rate + 5) // 10
    for n, x in enumerate(samples):
        for b, a, s in stages:
            y = b[0] * x + s[0]
            s[0], s[1] = b[1] * x - a[0] * y + s[1], b[2] * x - a[1] * y
            x = y
        out[n // slot] = out.get(n // slot, 0.0) + x * x
    return out


def test_coefficients_of_the_recommendation():
    (b, a), (c, e) = loudness._sections(48_000)
    assert np.allclose([*b, *a], [1.53512485958697, -2.69169618940638, 1.19839281085285, -1.69065929318241, 0.73248077421585], atol=1e-10)
    assert np.allclose([*c, *e], [1, -2, 1, -1.99004745483398, 0.99007225036621], atol=1e-10)


@pytest.mark.parametrize("bucket_s,chunk", [(1, 777), (10, 160), (100, 5000)])
def test_slots_equal_a_plain_version(spark, bucket_s, chunk):
    """However the stream is cut, into rows or buckets."""
    df = pcm(spark, [(1.5, -6, 440), (1.0, -120, 50), (1.03, -20, 1000)], 8000, 1, chunk)
    got = {r["slot"]: r["energy"] for r in loudness.slot_energies(df, ["flow_id"], 8000, 1, bucket_s).collect()}
    x = [v for r in df.orderBy("first_sample").collect() for v in r["pcm"]]
    want = plain(x, 8000)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-15) for k in want)


@pytest.mark.parametrize(
    "parts,want",
    [([(20, -23, 1000)], -23.0), ([(20, -33, 1000)], -33.0), ([(4, -36, 1000), (20, -23, 1000), (4, -36, 1000)], -23.0), ([(4, -72, 1000), (6, -36, 1000), (20, -23, 1000), (6, -36, 1000), (4, -72, 1000)], -23.0)],
)
def test_integrated_loudness_of_the_test_set(spark, parts, want):
    slots = loudness.slot_energies(pcm(spark, parts, 48_000), ["flow_id"], 48_000, 2).cache()
    found = loudness.programme_loudness(slots, ["flow_id"], 48_000).first()
    assert abs(found["integrated"] - want) <= 0.1
    if len(parts) == 1:
        last = loudness.loudness_over_time(slots, ["flow_id"], 48_000).orderBy(F.desc("slot")).first()
        assert abs(last["momentary"] - want) <= 0.1 and abs(last["short_term"] - want) <= 0.1


@pytest.mark.parametrize("parts,want", [([(20, -20, 1000), (20, -30, 1000)], 10.0), ([(20, -20, 1000), (20, -15, 1000)], 5.0), ([(1, -20, 1000)], 0.0)])
def test_loudness_range_of_the_test_set(spark, parts, want):
    slots = loudness.slot_energies(pcm(spark, parts, 16_000, chunk=16_000), ["flow_id"], 16_000, 2)
    assert abs(loudness.programme_loudness(slots, ["flow_id"], 16_000).first()["loudness_range"] - want) <= 0.5


@pytest.mark.parametrize("phase,level", [(0, 0.5), (45, 0.5), (60, 0.5), (67.5, 0.5)])
def test_true_peak_between_samples(phase, level):
    n = np.arange(4800)
    x = level * np.sin(2 * np.pi * n / 4 + np.radians(phase))
    x[:200] *= np.linspace(0, 1, 200)
    got = 20 * np.log10(loudness.peaks(x[:, None], np.zeros((0, 1)), 48_000)[300:].max())
    assert -0.4 <= got + 6.02 <= 0.2
    parts = [loudness.peaks(x[a:b, None], x[max(a - 49, 0) : a, None], 48_000) for a, b in ((0, 5), (5, 1000), (1000, 4800))]
    assert np.allclose(np.concatenate(parts), loudness.peaks(x[:, None], np.zeros((0, 1)), 48_000))


def test_channels_and_gaps(spark):
    """Low effects don't count, surrounds count 1.41 fold; a lost row is silence in its slots."""
    six = loudness.slot_energies(pcm(spark, [(1, -20, 1000)], 8000, 6), ["flow_id"], 8000, 6).where("slot = 5").first()["energy"]
    one = loudness.slot_energies(pcm(spark, [(1, -20, 1000)], 8000, 1), ["flow_id"], 8000, 1).where("slot = 5").first()["energy"]
    assert math.isclose(six, one * 5.82, rel_tol=1e-6)
    slots = loudness.slot_energies(pcm(spark, [(1, -20, 1000)], 8000, 1, lost=(4, 5)), ["flow_id"], 8000, 1)
    told = {r["slot"]: r["momentary"] for r in loudness.loudness_over_time(slots, ["flow_id"], 8000).collect()}
    assert 4 not in told and abs(told[7] - told[3] + 3.01) < 0.1
    silent = loudness.slot_energies(pcm(spark, [(1, -400, 1000)], 8000, 1), ["flow_id"], 8000, 1)
    found = loudness.programme_loudness(silent, ["flow_id"], 8000).first()
    assert found["integrated"] is None and found["loudness_range"] == 0
    none = spark.createDataFrame([(1, 0, None), (1, 1, [])], "flow_id long, first_sample long, pcm array<double>")
    assert loudness.programme_loudness(loudness.slot_energies(none, ["flow_id"], 8000, 1), ["flow_id"], 8000).count() == 0


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_a_scan_over_any_buckets(spark, size):
    """Running totals that are reset by a zero: a state is a number, a summary what follows the last zero."""

    class Total(scan.Scan):
        def start(self):
            return 0

        def summarise(self, frame):
            zeros = np.flatnonzero(frame["x"] == 0)
            return bool(len(zeros)), int(frame["x"].iloc[zeros[-1] if len(zeros) else 0 :].sum())

        def carry(self, state, summary):
            return summary[1] + (0 if summary[0] else state)

        def run(self, state, frame):
            out = []
            for k, n, x in zip(frame["k"], frame["n"], frame["x"]):
                state = state + x if x else 0
                out.append((k, n, state))
            return pd.DataFrame(out, columns=["k", "n", "total"])

    rng = np.random.default_rng(1)
    rows = [(k, n, int(x)) for k in (1, 2) for n, x in enumerate(rng.integers(0, 5, 200))]
    df = spark.createDataFrame(rows, "k long, n long, x long").repartition(3)
    got = {(r["k"], r["n"]): r["total"] for r in scan.block_scan(df, ["k"], ["n"], F.floor(F.col("n") / size), Total(), "k long, n long, total long").collect()}
    want, state = {}, {}
    for k, n, x in rows:
        state[k] = state.get(k, 0) + x if x else 0
        want[k, n] = state[k]
    assert got == want


def test_silence_by_measured_loudness(spark):
    df = pcm(spark, [(2, -20, 1000), (4, -90, 1000), (2, -20, 1000)], 8000, 2)
    told = loudness.loudness_over_time(loudness.slot_energies(df, ["flow_id"], 8000, 2), ["flow_id"], 8000)
    held = aggregates.held_for(told.withColumn("us", F.col("slot") * 100_000), ["flow_id"], "us", aggregates.silent(F.col("momentary"), F.lit(10**6)), 2_000_000).collect()
    assert [(r["begin_us"], r["until_us"]) for r in held] == [(2_300_000, 5_900_000)] and held[0]["alarm_us"] == 4_300_000
