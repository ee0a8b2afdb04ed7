"""Rules that are easily taken for their neighbours: each case pins the one that is meant."""

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import aggregates, alarms, rewrite, sequence, timers, windows
from tidegauge.plans.binding import PCR_WRAP

SECOND = 1_000_000


def test_a_clock_that_wraps_goes_backward(spark):
    rows = [(1, 0, PCR_WRAP - 10, False), (1, 1, 5, False), (1, 2, 2_700_005, False), (1, 3, 5_400_006, False), (1, 4, 0, True), (1, 5, 2_700_000, False)]
    df = spark.createDataFrame(rows, "flow_id int, vseq int, pcr27 long, discontinuity boolean")
    got = windows.pcr_discontinuities(df, ["flow_id"]).orderBy("vseq").collect()
    assert [r["jump"] for r in got] == [False, True, False, True, False, False]


def errors(spark, rows, named=(), until=None):
    df = spark.createDataFrame([(1, *r) for r in rows], "flow_id int, kind string, pid int, at long")
    known = spark.createDataFrame([(1, *r) for r in named], "flow_id int, kind string, pid int, at long")
    end = None if until is None else F.lit(until)
    return {r["kind"]: r["errors"] for r in timers.timer_errors(df, ["flow_id"], "kind", "at", end, named=known).collect()}


def every(kind, pid, step, to, since=0):
    return [(kind, pid, t) for t in range(since, to + 1, step)]


def test_no_errors_before_the_first_association_table(spark):
    silent = [("pmt", 32, 0), ("pcr", 33, 0)]
    assert errors(spark, silent, until=10 * SECOND) == {"pmt": 0, "pcr": 0}
    late = silent + every("pat", None, 400_000, 10 * SECOND, 6 * SECOND)
    assert errors(spark, late, until=10 * SECOND) == {"pmt": 1, "pcr": 1, "pat": 0}


def test_named_pids_have_a_grace(spark):
    pats = every("pat", None, 100_000, 3 * SECOND)
    named = [("pmt", 32, 0), ("es", 33, 0), ("es", 34, 2_900_000)]
    assert errors(spark, pats + [("es", 33, 900_000)] + every("es", 33, 400_000, 3 * SECOND, 900_000), named) == {"pat": 0, "pmt": 1, "es": 1}
    assert errors(spark, every("pat", None, 100_000, SECOND), named[:2]) == {"pat": 0, "pmt": 0, "es": 0}


def test_each_pid_has_its_own_latch(spark):
    rows = every("pat", None, 100_000, 5 * SECOND) + [("pmt", 32, 0), ("pmt", 33, 0), ("pmt", 32, 3 * SECOND)]
    assert errors(spark, rows) == {"pat": 0, "pmt": 3}
    assert errors(spark, [("pat", None, 0), ("cat", None, 0), ("sdt", None, 0)], until=4 * SECOND) == {"pat": 4, "cat": 7, "sdt": 4}


def test_a_stretch_that_stays_stale_fires_again(spark):
    """At the boundary of the dwell, not on the row after it, and again a dwell after that row."""
    times = [0, 999_000, SECOND, 1_040_000, 2_039_000, 2_040_000, 2_080_000]
    rows = [(1, t, True) for t in times] + [(2, 0, True), (2, 500_000, False), (2, SECOND, True), (2, 1_999_000, True), (3, 0, None), (3, SECOND, True)]
    df = spark.createDataFrame(rows, "flow_id long, at long, stale boolean")
    got = aggregates.dwells(df, ["flow_id"], "at", F.col("stale"), SECOND).collect()
    assert sorted(map(tuple, got)) == [(1, SECOND), (1, 2_040_000)]


@pytest.mark.parametrize(
    "rows,want",
    [
        ([(9, 120), (9, 140), (9, 100), (9, 150), (9, 151), (9, 120), (9, -100)], ["holdover", "holdover", "locked", "locked", "holdover", "holdover", "locked"]),
        ([(9, 0), (9, 140), (4, 0), (9, 140), (6, 0), (None, 0), (9, 90)], ["locked", "locked", "acquiring", "holdover", "master", "unknown", "locked"]),
        ([(8, 5), (5, 5), (9, -140), (9, -100), (9, -149)], ["acquiring", "acquiring", "holdover", "locked", "locked"]),
    ],
)
def test_clock_states(spark, rows, want):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "flow_id int, n int, port int, off long")
    assert [r["state"] for r in alarms.clock_states(df, ["flow_id"], ["n"], "port", "off", 100).orderBy("n").collect()] == want


BASE, VIDEO, AUDIO = 900_000, float(1 << 32), float(1 << 32) * 90_000 / 48_000


@pytest.mark.parametrize(
    "raw,wrap,anchor,anchor_wrap,elapsed,want",
    [
        (None, VIDEO, None, None, 0, BASE),
        (5000, AUDIO, 1000, VIDEO, 3900, BASE + 4000),
        (5000, VIDEO, (1 << 32) - 1000, VIDEO, 6500, BASE + 6000),  # the joiner wrapped
        ((1 << 32) - 7000, AUDIO, 1000, VIDEO, 0, BASE + (1 << 32) - 8000 - (1 << 32)),  # the anchor wrapped
        (3_600_000_000, AUDIO, 123, VIDEO, 50, BASE + 50),  # no turn comes within ten seconds
        (1000 + 5_000_000, VIDEO, 1000, VIDEO, 4_200_000, BASE + 5_000_000),
        (1000 + 5_000_000, VIDEO, 1000, VIDEO, 4_000_000, BASE + 4_000_000),
    ],
)
def test_timeline(spark, raw, wrap, anchor, anchor_wrap, elapsed, want):
    df = spark.createDataFrame([(raw, wrap, anchor, anchor_wrap, elapsed)], "raw long, wrap double, anchor_raw long, anchor_wrap double, elapsed long")
    assert windows.timeline(df).first()["resolved"] == want


def plain_line(packets, delay, most, room):
    """The line, packet by packet: which are shed."""
    held, shed = [], set()
    for i, (at, size) in enumerate(packets):
        held = [h for h in held if packets[h][0] + delay > at]
        while held and (len(held) >= most or sum(packets[h][1] for h in held) + size > room):
            shed.add(held.pop(0))
        held.append(i)
    return shed


@pytest.mark.parametrize("seed", range(4))
def test_a_bounded_delay_line(spark, seed):
    import random

    rng = random.Random(seed)
    packets, at = [], 0
    for _ in range(300):
        at += rng.choice([0, 1, 5, 40])
        packets.append((at, rng.choice([10, 50, 100, 900])))
    df = spark.createDataFrame([(1, i, *p) for i, p in enumerate(packets)], "flow_id int, event_id int, recv_us long, bytes long")
    got = {r["event_id"] for r in sequence.delay_line(df, 100, 8, 700).where("shed").collect()}
    assert got == plain_line(packets, 100, 8, 700) and got


def test_bundles_leave_at_ticks(spark):
    times = [0, 1, 2, 3, 4, 5, 6, 7, 9_999, 10_000, 35_000]
    df = spark.createDataFrame([(1, n, t) for n, t in enumerate(times)], "k int, n long, t long")
    got = [(r["datagram"], r["cells"], r["first"], r["last"]) for r in rewrite.bundle(df, ["k"], "n", time="t").orderBy("datagram").collect()]
    assert got == [(0, 7, 0, 6), (1, 2, 7, 8), (2, 1, 9, 9), (3, 1, 10, 10)]


def plain_shares(members, capacity):
    """Tier by tier, member by member in order of cap / weight."""
    out, left = {}, capacity
    for tier in sorted({m[3] for m in members}):
        own = sorted(((min(d, h) / w, i, min(d, h), w) for i, d, h, t, w in members if t == tier))
        weights, rest = sum(m[3] for m in own), left
        for _, i, cap, w in own:
            out[i] = min(cap, rest * w / weights)
            rest, weights = rest - out[i], weights - w
        left = max(rest, 0.0)
    return out


@pytest.mark.parametrize("capacity", [0.0, 1.0, 57.0, 150.0, 1e9])
def test_shares(spark, capacity):
    import random

    rng = random.Random(int(capacity))
    members = [(i, rng.uniform(0, 30), rng.choice([5.0, 20.0, 100.0]), rng.randint(0, 2), rng.choice([1.0, 2.0, 5.0])) for i in range(12)]
    df = spark.createDataFrame([(1, *m) for m in members], "leg_id long, member_id long, demand double, hard_cap double, tier int, weight double")
    caps = spark.createDataFrame([(1, capacity)], "leg_id long, capacity double")
    got = {r["member_id"]: r["share"] for r in aggregates.max_min_shares(df, caps).collect()}
    want = plain_shares(members, capacity)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("lost_of_ten", [1, 3, 5])
def test_recovery_is_right_and_complete(spark, lost_of_ten):
    """Whatever is restored is what was lost, and no line is left that lacks a single cell."""
    import random

    rng = random.Random(lost_of_ten)
    rows = [(1, n, rng.randint(0, 1 << 40)) for n in range(400)]
    df = spark.createDataFrame(rows, "flow_id long, vseq long, v long")
    kept = [r for r in rows if rng.random() * 10 >= lost_of_ten]
    parities = sequence.parity(df, 5, 4, ["v"])
    got = {(r["cycle"], r["cell"]): r["value"] for r in sequence.recover(spark.createDataFrame(kept, df.schema), parities, 5, 4, "v").collect()}
    truth = {divmod(n, 20): v for _, n, v in rows}
    have = {divmod(n, 20) for _, n, _ in kept}
    assert all(truth[k] == v and k not in have for k, v in got.items()) and got
    have |= set(got)
    for cycle in range(20):
        for line in [[c + 5 * r for r in range(4)] for c in range(5)] + [[r * 5 + c for c in range(5)] for r in range(4)]:
            assert sum((cycle, cell) not in have for cell in line) != 1


@pytest.mark.parametrize("lost_of_ten", [1, 3, 5])
def test_byte_recovery_is_that_of_a_plain_loop(spark, lost_of_ten, monkeypatch):
    """Payloads of any length, an empty one included, from matrices that begin at odd bases, first packets and
    parities lost, in slices of a few matrices."""
    import random

    from tidegauge.operators import erasure

    monkeypatch.setattr(erasure, "AT_ONCE", 3000)
    rng = random.Random(lost_of_ten)
    sent = {(f, n): rng.randbytes(rng.choice([0, 1, 7, 40])) for f in (1, 2) for n in range(200)}
    rows = [(f, n, bytearray(data)) for (f, n), data in sent.items()]
    bases = [(f, b) for f in (1, 2) for b in range(f, 200, 12)]
    media = spark.createDataFrame(rows, "flow_id long, vseq long, payload binary")
    parities = erasure.byte_parity(media, spark.createDataFrame(bases, "flow_id long, base long"), 4, 3)
    told = parities.collect()
    assert len(told) == 7 * sum(b + 12 <= 200 for _, b in bases)
    checks = [r for r in told if rng.random() > 0.1]
    kept = {k: v for k, v in sent.items() if rng.random() * 10 >= lost_of_ten}
    arrived = spark.createDataFrame([(*k, bytearray(v)) for k, v in kept.items()], media.schema)
    got = {(r["flow_id"], r["vseq"]): bytes(r["payload"]) for r in erasure.recover_bytes(arrived, spark.createDataFrame(checks, parities.schema), 4, 3).collect()}
    lines = [{(r["flow_id"], r["base"] + (r["index"] + 4 * i if r["is_column"] else 4 * r["index"] + i)) for i in range(3 if r["is_column"] else 4)} for r in checks]
    have = set(kept)
    while more := {next(iter(line - have)) for line in lines if len(line - have) == 1}:
        have |= more
    assert got == {k: sent[k] for k in have - set(kept)} and got


def test_byte_recovery_of_nothing(spark):
    from tidegauge.operators import erasure

    media = spark.createDataFrame([], "flow_id long, vseq long, payload binary")
    parities = erasure.byte_parity(media, spark.createDataFrame([(1, 0)], "flow_id long, base long"), 4, 3)
    assert parities.count() == 0 and erasure.recover_bytes(media, parities, 4, 3).count() == 0
