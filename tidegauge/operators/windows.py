"""Rates, smoothed estimators and clock metrics."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.clock import PCR_WRAP, PTS_WRAP, forward_gap, pts_delta_ms
from .aggregates import between_ranks, ends_of
from .fold import ordered_fold

MOST_STEP_US = 500_000


def throughput(rows: DataFrame, *keys: str) -> DataFrame:
    """Bits of each second."""
    return rows.groupBy(*keys, F.floor(F.col("recv_us") / 1_000_000).alias("second")).agg((F.sum("bytes") * 8).alias("bps"))


def freshness(samples: DataFrame, keys: list[str], at: str, value: str, within: int) -> DataFrame:
    """Whether a counter has gone up within the window, at each sample; the first one counts as going
    up. One that fell back is stale until it goes up again."""
    w = Window.partitionBy(*keys).orderBy(at)
    moved = F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(True))
    last = F.max(F.when(F.col("_m"), F.col(at))).over(w)
    return samples.withColumn("_m", moved).withColumn("fresh", F.col("_m") | (F.col(at) - last < within)).drop("_m")


class Jitter:
    """RFC 3550 jitter in time-stamp units, J += (min(|D|, cap) - J) / 16."""

    def __init__(self):
        self.j, self.last = 0.0, None

    def add(self, arrival: float, stamp: int) -> float:
        if self.last is not None:
            step = (stamp - self.last[1] + (1 << 31)) % (1 << 32) - (1 << 31)
            d = abs((arrival - self.last[0]) - step / 90)
            if d <= 10_000:
                self.j += (min(d * 1000, 1e6) - self.j) / 16
        self.last = (arrival, stamp)
        return self.j


def jitter(rows: DataFrame) -> DataFrame:
    """W3 of each flow, in microseconds: (flow_id, jitter_us) after its last packet."""
    def step(s: list, r) -> tuple:
        s[1] = r.flow_id
        s[0].add(r.recv_us / 1000, r.rtp_ts)
        return ()

    return ordered_fold(rows.select("flow_id", "vseq", "recv_us", "rtp_ts"), ["flow_id"], ["vseq"], lambda: [Jitter(), None], step, "flow_id long, jitter_us double", lambda s: [(s[1], round(s[0].j, 6))])


def ewma(rows: DataFrame, keys: list[str], order: str, value: str, alpha: float, whole: bool = False, decay: bool = False) -> DataFrame:
    """W4 (whole numbers, seconds without a row decay), W5: exponentially weighted mean after each row:
    (keys, order, ewma). The first value (W4: also the first after zero) counts in full."""
    def step(s: dict, r) -> list[tuple]:
        at, x = getattr(r, order), float(getattr(r, value))
        out = []
        if decay and "at" in s:
            for t in range(s["at"] + 1, at):
                s["v"] = int(s["v"] * (1 - alpha)) if whole else s["v"] * (1 - alpha)
                out.append((*(getattr(r, k) for k in keys), t, float(s["v"])))
        if "v" not in s or whole and s["v"] == 0:
            s["v"] = int(x) if whole else x
        else:
            v = s["v"] * (1 - alpha) + x * alpha
            s["v"] = int(v) if whole else v
        s["at"] = at
        return [*out, (*(getattr(r, k) for k in keys), at, float(s["v"]))]

    return ordered_fold(rows.select(*keys, order, value), keys, [order], dict, step, ", ".join([f"{k} long" for k in keys] + [f"{order} long", "ewma double"]))


def pcr_drift(rows: DataFrame, keys: list[str]) -> DataFrame:
    """|clock step - wall step| in microseconds against the previous row, for steps of up to
    500 ms in both; other rows give none."""
    w = Window.partitionBy(*keys).orderBy("vseq")
    pcr = F.floor(forward_gap(F.col("pcr27"), F.lag("pcr27").over(w), PCR_WRAP) / 27)
    wall = F.greatest(F.col("recv_us") - F.lag("recv_us").over(w), F.lit(0))
    steps = rows.withColumns({"pcr_us": pcr, "wall_us": wall})
    return steps.where((F.col("pcr_us") <= MOST_STEP_US) & (F.col("wall_us") <= MOST_STEP_US)).withColumn("drift_us", F.abs(F.col("pcr_us") - F.col("wall_us")))


def trust(drifts: DataFrame, keys: list[str], reservoir: int = 4096, short: int = 256) -> DataFrame:
    """Percentiles over the last ``reservoir`` drifts and the last ``short``; the mean is over
    all of them."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("vseq")))
    among = lambda n: F.when(F.col("back") <= n, F.col("drift_us"))
    ranked = drifts.withColumn("back", back).withColumns({"held": among(reservoir), "recent": among(short)})
    mean = F.floor(F.sum("drift_us") / F.count(F.lit(1)))
    summed = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("cumulative_samples"), mean.alias("avg_us"), F.count("held").alias("samples"), F.max("held").alias("max_us"), F.collect_list("held").alias("held"), F.collect_list("recent").alias("recent"))
    asked = {"p50_us": ("held", 0.5), "p95_us": ("held", 0.95), "p99_us": ("held", 0.99), "window_p95_us": ("recent", 0.95)}
    met = summed.withColumns({name: ends_of(F.col(c), q) for name, (c, q) in asked.items()})
    p = {name: between_ranks(F.col(f"{name}.low"), F.col(f"{name}.high"), F.col(f"{name}.place")).alias(name) for name in asked}
    return met.select(*keys, "cumulative_samples", "avg_us", "samples", p["p50_us"], p["p95_us"], p["p99_us"], "max_us", p["window_p95_us"])


def running_percentile(rows: DataFrame, keys: list[str], order: str, value: str, size: int, p: float) -> DataFrame:
    """W6 at every row: percentile of the last ``size`` values."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - size, 0)
    met = rows.withColumn("_e", ends_of(F.collect_list(value).over(w), p))
    return met.withColumn("value", between_ranks(F.col("_e.low"), F.col("_e.high"), F.col("_e.place"))).drop("_e")


def pcr_accuracy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distance in ns of each clock reference from the line through the previous up to 16 (four at
    least); none if it is over a second, as then the line doesn't know the source yet. The line is fitted
    to differences from the row itself, in whole numbers, which keeps the sums small."""
    w = Window.partitionBy(*keys).orderBy("vseq").rowsBetween(-16, -1)
    before = rows.withColumn("before", F.collect_list(F.struct(F.col("recv_us").alias("x"), F.col("pcr27").alias("y"))).over(w))
    moved = before.withColumn("before", F.transform("before", lambda b: F.struct((b["x"] - F.col("recv_us")).cast("double").alias("x"), (b["y"] - F.col("pcr27")).cast("double").alias("y"))))
    total = lambda f: F.aggregate("before", F.lit(0.0), lambda s, b: s + f(b))
    n, sx, sy = F.size("before"), total(lambda b: b["x"]), total(lambda b: b["y"])
    spread = n * total(lambda b: b["x"] * b["x"]) - sx * sx
    middle = (sy - (n * total(lambda b: b["x"] * b["y"]) - sx * sy) / spread * sx) / n
    residual = F.round(F.abs(middle) * 1000 / 27)
    return moved.withColumn("residual_ns", F.when((n >= 4) & (spread > 0) & (residual <= 1e9), residual.cast("long"))).drop("before")


def pcr_discontinuities(rows: DataFrame, keys: list[str], most_us: int = 100_000) -> DataFrame:
    """Steps backward or of over 100 ms, unless the cell says so (column discontinuity). Values are
    compared as they are, so a clock that wraps goes backward."""
    step = F.col("pcr27") - F.lag("pcr27").over(Window.partitionBy(*keys).orderBy("vseq"))
    said = F.col("discontinuity") if "discontinuity" in rows.columns else F.lit(False)
    return rows.withColumn("step", step).withColumn("jump", F.coalesce(((F.col("step") < 0) | (F.col("step") > most_us * 27)) & ~said, F.lit(False)))


def repetition_errors(rows: DataFrame, keys: list[str], time: str, most_us: int) -> DataFrame:
    """W10, latching kinds: gaps longer than allowed, one each."""
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    return rows.select(*keys, time).withColumn("gap", gap).groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("gap") > most_us).alias("errors"))


class DelayFactor:
    """Windows that open at the first packet a second or more after the last opened; the arrival
    over the edge belongs to none."""

    def __init__(self, size_us: int = 1_000_000):
        self.size, self.start = size_us, None

    def add(self, now_us: int, cc_error: bool):
        out = None
        if self.start is None:
            self._open(now_us)
        elif now_us - self.start >= self.size:
            mean = self.sum / self.n if self.n else 0.0
            df = max(self.most - mean, 0.0) / 1000 if self.n >= 2 else 0.0
            out = (self.start, now_us, df, self.errors / ((now_us - self.start) / 1e6))
            self._open(now_us)
        if self.last is not None:
            gap = now_us - self.last
            self.most, self.sum, self.n = max(self.most, gap), self.sum + gap, self.n + 1
        self.last, self.errors = now_us, self.errors + cc_error
        return out

    def _open(self, now_us: int) -> None:
        self.start, self.last, self.most, self.sum, self.n, self.errors = now_us, None, 0, 0, 0, 0


def delay_factor(rows: DataFrame, size_us: int = 1_000_000) -> DataFrame:
    """(flow_id, from_us, to_us, df_ms, mlr) of rows (flow_id, recv_us, vseq, cc_error)."""
    return ordered_fold(rows.select("flow_id", "recv_us", "vseq", "cc_error"), ["flow_id"], ["recv_us", "vseq"], lambda: DelayFactor(size_us), lambda s, r: [(r.flow_id, *x)] if (x := s.add(r.recv_us, bool(r.cc_error))) else (), "flow_id long, from_us long, to_us long, df_ms double, mlr double")


class Segmenter:
    """Segments begin at the first key unit once ``target`` has passed; what comes before the
    first key unit is dropped. Without keys (audio) time alone cuts."""

    def __init__(self, target: int):
        self.target, self.start, self.number = target, None, -1

    def place(self, at: int, key: bool) -> int | None:
        if self.start is None and not key:
            return None
        if self.start is None or key and at - self.start >= self.target:
            self.start, self.number = at, self.number + 1
        return self.number


def segments(units: DataFrame, target_us: int) -> DataFrame:
    """(flow_id, segment, units, begin_us, end_us)."""
    placed = ordered_fold(units.select("flow_id", "recv_us", "event_id", "key"), ["flow_id"], ["recv_us", "event_id"], lambda: Segmenter(target_us), lambda s, r: [(r.flow_id, r.recv_us, n)] if (n := s.place(r.recv_us, bool(r.key))) is not None else (), "flow_id long, recv_us long, segment long")
    return placed.groupBy("flow_id", "segment").agg(F.count(F.lit(1)).alias("units"), F.min("recv_us").alias("begin_us"), F.max("recv_us").alias("end_us"))


def unwrap_pts(rows: DataFrame, keys: list[str], order: str, pts: str) -> DataFrame:
    """2**33 is added each time a stamp falls by more than half the range."""
    w = Window.partitionBy(*keys).orderBy(order)
    wrapped = (F.lag(pts).over(w) > 1 << 32) & (F.col(pts) < F.lag(pts).over(w) - (1 << 32))
    return rows.withColumn("_w", F.coalesce(wrapped, F.lit(False)).cast("long")).withColumn("unwrapped", F.col(pts) + F.sum("_w").over(w) * (1 << 33)).drop("_w")


class Pll:
    """Recovers a clock's rate in ticks a nanosecond. Gains, clamps, lock rules."""

    RATE, KP, KI = 27 / 1000, 0.10, 0.005
    LEAST_NS, MOST_US = 100_000, 500_000
    OFF, GATE = 500e-6, 0.1

    def __init__(self, lock_us: int = 100, unlock_us: int = 500):
        self.rate, self.integral, self.last, self.locked = self.RATE, 0.0, None, False
        self.window, self.samples, self.bad, self.limits = deque(maxlen=64), 0, 0, (lock_us, unlock_us)

    def add(self, pcr: int, wall_ns: int) -> bool:
        """Whether the sample counted."""
        if self.last is None:
            self.last = (pcr, wall_ns)
            return False
        ticks, ns = (pcr - self.last[0]) % PCR_WRAP, max(wall_ns - self.last[1], 0)
        if ticks // 27 > self.MOST_US or ns // 1000 > self.MOST_US:
            self.last = (pcr, wall_ns)
            self.window.clear()
            return False
        if ns < self.LEAST_NS or abs(ticks / ns / self.RATE - 1) > self.GATE:
            return False
        seen, most = ticks / ns, self.RATE * self.OFF
        self.window.append(int(abs(ticks - self.rate * ns) / 27))
        self.integral = min(max(self.integral + self.KI * (seen - self.rate), -most), most)
        self.rate = min(max(self.rate + self.KP * (seen - self.rate) + self.integral, self.RATE - most), self.RATE + most)
        self.last, self.samples = (pcr, wall_ns), self.samples + 1
        p99 = sorted(self.window)[int((len(self.window) - 1) * 0.99 + 0.5)]
        if not self.locked:
            self.locked, self.bad = self.samples >= 100 and p99 <= self.limits[0], 0
        elif p99 > self.limits[1]:
            self.bad += 1
            if self.bad >= 16:
                self.locked, self.bad = False, 0
        elif p99 <= self.limits[0]:
            self.bad = 0
        return True


def clock_lock(rows: DataFrame) -> DataFrame:
    """(flow_id, samples, ppm, locked) after each flow's last clock reference."""
    def step(s: list, r) -> tuple:
        s[1] = r.flow_id
        s[0].add(r.pcr27, r.recv_us * 1000)
        return ()

    return ordered_fold(rows.select("flow_id", "vseq", "pcr27", "recv_us"), ["flow_id"], ["vseq"], lambda: [Pll(), None], step, "flow_id long, samples long, ppm double, locked boolean", lambda s: [(s[1], s[0].samples, round((s[0].rate / Pll.RATE - 1) * 1e6, 3), s[0].locked)])


def projected_clock(rows: DataFrame, anchors: DataFrame, rate: float = 27.0) -> DataFrame:
    """The clock at each row: the last anchor (flow_id, recv_us, pcr27) at or before it, run on at
    ``rate`` ticks a microsecond."""
    a = anchors.select("flow_id", "recv_us", F.lit(0).alias("what"), F.struct("recv_us", "pcr27").alias("anchor"), F.lit(None).cast("long").alias("event_id"))
    r = rows.select("flow_id", "recv_us", F.lit(1).alias("what"), F.lit(None).cast("struct<recv_us:bigint,pcr27:bigint>").alias("anchor"), "event_id")
    last = F.last("anchor", True).over(Window.partitionBy("flow_id").orderBy("recv_us", "what", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    found = a.unionAll(r).withColumn("anchor", last).where("what = 1 AND anchor IS NOT NULL")
    now = F.pmod(F.col("anchor.pcr27") + ((F.col("recv_us") - F.col("anchor.recv_us")) * rate).cast("long"), F.lit(PCR_WRAP))
    return found.select("flow_id", "event_id", now.alias("now_27mhz"))


def slot_stalls(units: DataFrame, slots: DataFrame, keys: list[str], time: str, scan_us: int = 1_000_000, stall: int = 5, grace: int = 10) -> DataFrame:
    """(keys, stalled_at, resumed_at) in scans since the start, for slots (keys, start_us, until_us,
    continuous). A scan each ``scan_us`` sees which slots got units since the last. A slot that got none for
    ``stall`` scans, or none since the start, stalls once, though not before ``grace`` scans; resumed_at is
    null if nothing came by until_us. Slots of sparse streams are never judged."""
    judged = slots.where("continuous")
    scan = lambda at: F.ceil((F.col(at) - F.col("start_us")) / scan_us)
    data = units.join(judged, keys).select(*keys, scan(time).alias("scan"), scan("until_us").alias("until"))
    moved = data.unionAll(judged.select(*keys, F.lit(0).cast("long").alias("scan"), scan("until_us").alias("until"))).distinct()
    after = F.lead("scan").over(Window.partitionBy(*keys).orderBy("scan"))
    stalled = F.greatest(F.col("scan") + stall, F.lit(grace))
    found = moved.withColumn("resumed_at", after).where(stalled < F.coalesce("resumed_at", F.col("until") + 1))
    return found.select(*keys, stalled.alias("stalled_at"), "resumed_at")


def timecode_breaks(rows: DataFrame, keys: list[str], order: str, frames: str, day: int, back: int = 5) -> DataFrame:
    """Frames whose time code goes back by more than ``back``, except from the last ten frames of the
    day to its first ten."""
    last = F.lag(frames).over(Window.partitionBy(*keys).orderBy(order))
    stepped = rows.withColumns({"last": last, "step": F.col(frames) - last})
    return stepped.where((F.col("step") < -back) & ((F.col("last") < day - 10) | (F.col(frames) > 10))).drop("last")


def av_skew(units: DataFrame, trim_90k: int = 0) -> DataFrame:
    """Trim + audio - video in ms at each unit that has both before it, and the worst so far."""
    w = Window.partitionBy("flow_id").orderBy("vseq").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda kind: F.last(F.when(F.col("kind") == kind, F.col("pts90")), True).over(w)
    both = units.withColumns({"a": last("audio"), "v": last("video")}).where("a IS NOT NULL AND v IS NOT NULL")
    skew = both.withColumn("skew_ms", pts_delta_ms(F.col("a") + trim_90k, F.col("v")))
    return skew.withColumn("worst_ms", F.max(F.abs("skew_ms")).over(Window.partitionBy("flow_id").orderBy("vseq"))).drop("a", "v")


def timeline(essences: DataFrame, reach: int = 16, base_90k: int = 900_000, trust_90k: int = 900_000) -> DataFrame:
    """Where each essence joins its flow's timeline, in 90 kHz ticks: ``essences`` (raw, wrap, anchor_raw,
    anchor_wrap, elapsed), all but elapsed null for the anchor itself, which is at ``base_90k``, get resolved.

    Stamps are cut off by their own wrap (k and j turns) and the source's clock by its own (m turns), so the
    offset from the anchor is raw + k wrap + m 2**33 - anchor_raw - j anchor_wrap. Of all j and m within
    ``reach``, each with the k that comes nearest, the offset nearest to the time elapsed is taken (first the
    lowest j, then m); if none is within ``trust_90k`` of it, the time elapsed."""

    @F.pandas_udf("struct<off:long,d:long>")
    def best(raw: pd.Series, wrap: pd.Series, anchor_raw: pd.Series, anchor_wrap: pd.Series, elapsed: pd.Series) -> pd.DataFrame:
        given = np.stack([x.to_numpy(float, na_value=np.nan) for x in (raw, wrap, anchor_raw, anchor_wrap, elapsed)])
        found = np.concatenate([nearest_turns(*given[:, at : at + 1024], reach) for at in range(0, given.shape[1], 1024)])
        return pd.DataFrame(found, columns=["off", "d"]).astype("Int64")

    found = essences.withColumn("_b", F.when(F.col("anchor_raw").isNotNull(), best(*[F.col(c).cast("double") for c in ("raw", "wrap", "anchor_raw", "anchor_wrap", "elapsed")])))
    joined = F.when(F.col("_b.off") <= trust_90k, F.col("_b.d")).otherwise(F.col("elapsed"))
    return found.withColumn("resolved", base_90k + F.when(F.col("anchor_raw").isNull(), 0).otherwise(joined)).drop("_b")


def half_up(x: np.ndarray) -> np.ndarray:
    """Whole numbers, halves away from zero, as SQL rounds."""
    low = np.floor(np.abs(x))
    return np.copysign(low + (np.abs(x) - low >= 0.5), x)


def nearest_turns(raw: np.ndarray, wrap: np.ndarray, anchor_raw: np.ndarray, anchor_wrap: np.ndarray, elapsed: np.ndarray, reach: int) -> np.ndarray:
    """(off, d) of each row: the offset d of all turns within ``reach`` that is nearest to elapsed, and how far
    it is; no number where any of them is missing."""
    turns = np.arange(-reach, reach + 1, dtype=float)
    at = (slice(None), None, None)
    whole = raw[at] + turns * float(PTS_WRAP) - (anchor_raw[at] + turns[:, None] * anchor_wrap[at])
    d = half_up(whole + half_up((elapsed[at] - whole) / wrap[at]) * wrap[at]).reshape(len(raw), -1)
    off = np.abs(d - elapsed[:, None])
    rows, first = np.arange(len(raw)), off.argmin(1)
    return np.stack([off[rows, first], d[rows, first]], axis=1)


def frame_rate(units: DataFrame, keys: list[str], order: str, stamp: str, least: int = 30) -> DataFrame:
    """90000 / mean of the first ``least`` steps within [1200, 90000], once there are as many."""
    step = F.pmod(F.col(stamp) - F.lag(stamp).over(Window.partitionBy(*keys).orderBy(order)), F.lit(1 << 33))
    good = units.select(*keys, order, step.alias("step")).where(F.col("step").between(1200, 90000))
    first = good.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("n") <= least)
    return first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (90000 / F.avg("step")).alias("fps")).where(F.col("n") == least).drop("n")


def vblank_cadence(frames: DataFrame, n: str, ratio: Column) -> DataFrame:
    """How long each frame stays up."""
    from ..functions.clock import vblank_hold

    return frames.withColumn("hold", vblank_hold(F.col(n), ratio))
