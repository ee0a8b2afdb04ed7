"""Rewriting streams: identifiers, counters, clocks, padding, bundling."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.clock import PCR_WRAP
from .fold import ordered_fold


def remap_pids(cells: DataFrame, pids: dict[int, int], pid: str = "pid") -> DataFrame:
    """Identity where the map has no entry; an empty map changes nothing."""
    if not pids:
        return cells
    table = F.create_map(*[F.lit(x) for kv in pids.items() for x in kv])
    return cells.withColumn(pid, F.coalesce(F.try_element_at(table, F.col(pid).cast("int")), F.col(pid)).cast("long"))


def override_pids(streams: DataFrame, overrides: DataFrame) -> DataFrame:
    """(program, role) of a stream may be given another pid; others keep theirs."""
    return streams.join(overrides.select("program", "role", F.col("pid").alias("forced")), ["program", "role"], "left").withColumn("out_pid", F.coalesce("forced", "pid")).drop("forced")


def ingress_chain(cells: DataFrame, allowed: list[int], pids: dict[int, int], shift_90k: int) -> DataFrame:
    """Keep a program's pids, remap them, move their stamps."""
    kept = cells.where(F.col("pid").isin(allowed))
    return remap_pids(kept, pids).withColumn("pts90", F.pmod(F.col("pts90") + shift_90k, F.lit(1 << 33)))


class PcrAnchor:
    """out = out0 + (src - src0), and a jump of over 500 ms is marked discontinuous. Backward it is
    bridged: the output goes on from its last value by the wall time since, 40 ms at most. Forward it
    passes if the wall clock saw it, to within 500 ms, and is bridged else (a file that loops)."""

    JUMP, BRIDGE = 13_500_000, 1_080_000

    def __init__(self):
        self.src = self.out = self.wall = None

    def rewrite(self, pcr: int, wall_us: int) -> tuple[int, bool]:
        if self.src is None:
            self.src, self.out, self.wall = pcr, pcr, wall_us
            return pcr, False
        step = (pcr - self.src + PCR_WRAP // 2) % PCR_WRAP - PCR_WRAP // 2
        jumped = abs(step) > self.JUMP
        if jumped:
            seen = max(wall_us - self.wall, 0) * 27
            if step < 0 or step - seen > self.JUMP:
                step = min(seen, self.BRIDGE)
        self.src, self.wall, self.out = pcr, wall_us, (self.out + step) % PCR_WRAP
        return self.out, jumped


def reanchor_pcr(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vseq, out_pcr, jumped) of rows (keys, vseq, pcr27, recv_us)."""
    schema = ", ".join(f"{k} long" for k in keys) + ", vseq long, out_pcr long, jumped boolean"
    return ordered_fold(rows.select(*keys, "vseq", "pcr27", "recv_us"), keys, ["vseq"], PcrAnchor, lambda s, r: [(*(getattr(r, k) for k in keys), r.vseq, *s.rewrite(r.pcr27, r.recv_us))], schema)


def reanchor_pts(units: DataFrame, anchors: DataFrame, lipsync_90k: int = 0) -> DataFrame:
    """Stamps move by their clock's last shift (flow_id, vseq, pcr27, out_pcr) at or before them;
    audio by the lip-sync trim besides."""
    a = anchors.select("flow_id", "vseq", F.lit(0).alias("what"), F.floor((F.col("out_pcr") - F.col("pcr27")) / 300).alias("shift"), F.lit(None).cast("long").alias("pts90"), F.lit(None).cast("string").alias("kind"))
    u = units.select("flow_id", "vseq", F.lit(1).alias("what"), F.lit(None).cast("long").alias("shift"), "pts90", "kind")
    last = F.last("shift", True).over(Window.partitionBy("flow_id").orderBy("vseq", "what").rowsBetween(Window.unboundedPreceding, 0))
    trim = F.when(F.col("kind") == "audio", lipsync_90k).otherwise(0)
    moved = a.unionAll(u).withColumn("shift", last).where("what = 1")
    return moved.select("flow_id", "vseq", "kind", F.pmod(F.col("pts90") + F.coalesce("shift", F.lit(0)) + trim, F.lit(1 << 33)).alias("out_pts"))


def repetition_padding(rows: DataFrame, keys: list[str], time: str, most_us: int) -> DataFrame:
    """(keys, time) of what has to be put in so that no gap is over ``most_us``."""
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    missing = F.floor((F.col(time) - F.col("before") - 1) / most_us).cast("int")
    gaps = rows.select(*keys, time, before.alias("before")).withColumn("missing", missing).where("missing > 0")
    return gaps.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.col("missing")), lambda i: F.col("before") + i * most_us)).alias(time))


def fix_continuity(cells: DataFrame, epoch: str, order: str) -> DataFrame:
    """After each switch (``epoch``) a pid's counter begins again from 0."""
    return renumber(cells, ["flow_id", epoch, "pid"], order)


def renumber(cells: DataFrame, keys: list[str], order: str) -> DataFrame:
    """out_cc counts payload-bearing cells; others repeat the last value."""
    return cells.withColumn("out_cc", F.sum(F.col("has_payload").cast("long")).over(Window.partitionBy(*keys).orderBy(order)) % 16)


def bundle(cells: DataFrame, keys: list[str], order: str, size: int = 7, time: str | None = None, flush_us: int = 10_000) -> DataFrame:
    """Datagrams of ``size`` cells: (keys, datagram, cells, first, last); the last may be short. With ``time``
    what has gathered leaves at each tick too, one every ``flush_us`` from a key's first cell, so a cell never
    waits longer, and a window is no longer than a tick."""
    if time is None:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
        numbered = cells.withColumn("datagram", F.floor(n / size))
        return numbered.groupBy(*keys, "datagram").agg(F.count(F.lit(1)).alias("cells"), F.min(order).alias("first"), F.max(order).alias("last"))
    begin = cells.groupBy(*keys).agg(F.min(time).alias("_begin"))
    ticked = cells.join(begin, keys).withColumn("_tick", F.floor((F.col(time) - F.col("_begin")) / flush_us))
    n = F.row_number().over(Window.partitionBy(*keys, "_tick").orderBy(order)) - 1
    found = ticked.withColumn("_part", F.floor(n / size)).groupBy(*keys, "_tick", "_part").agg(F.count(F.lit(1)).alias("cells"), F.min(order).alias("first"), F.max(order).alias("last"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_tick", "_part")) - 1
    return found.withColumn("datagram", number.cast("long")).select(*keys, "datagram", "cells", "first", "last")


class NullPadder:
    """After each datagram null cells follow while what was sent stays within rate * time, 350
    at most at a time."""

    def __init__(self, bits_per_second: int, burst: int = 350):
        self.rate, self.burst, self.first, self.sent = bits_per_second, burst, None, 0

    def pad(self, now_us: int, size: int) -> int:
        self.first = now_us if self.first is None else self.first
        self.sent += size
        budget = self.rate * (now_us - self.first) // 8_000_000
        n = min(max((budget - self.sent) // 188, 0), self.burst)
        self.sent += 188 * n
        return n


def pad_to_rate(rows: DataFrame, bits_per_second: int) -> DataFrame:
    """(flow_id, event_id, nulls)."""
    return ordered_fold(rows.select("flow_id", "recv_us", "event_id", "bytes"), ["flow_id"], ["recv_us", "event_id"], lambda: NullPadder(bits_per_second), lambda s, r: [(r.flow_id, r.event_id, s.pad(r.recv_us, r.bytes))], "flow_id long, event_id long, nulls long")


class Realign:
    """Audio is held until video gets near it; all else passes at once. After each video unit, and at
    the end of each chunk, held audio leaves in order while the first of it is no more than 150 ms ahead of
    the last video stamp, or within 120 ms of the clock reference, or over 3 s behind the last audio
    stamp, or more than 512 units are held."""

    LEAD_MS, FLOOR_MS, HOLD_MS, MOST = 150, 120, 3000, 512

    def __init__(self):
        self.video = self.clock = self.audio = None
        self.held: deque = deque()

    @staticmethod
    def _ms(a: int, b: int) -> int:
        d = (a - b + (1 << 32)) % (1 << 33) - (1 << 32)
        return -(-d // 90) if d < 0 else d // 90

    def add(self, unit, kind: str, pts: int, clock: int | None) -> list:
        out = []
        if kind == "audio":
            self.audio = pts
            self.held.append((pts, unit))
        else:
            out.append(unit)
            if kind == "video":
                self.video, self.clock = pts, self.clock if clock is None else clock
        return out + self.drain()

    def drain(self, all_: bool = False) -> list:
        """The units that leave: as many from the front as have one of their bounds reached."""
        ahead = [(mark, ms) for mark, ms in ((self.video, self.LEAD_MS), (self.clock, self.FLOOR_MS)) if mark is not None]
        surplus = len(self.held) - self.MOST

        def waits(place: int, pts: int) -> bool:
            return place >= surplus and self._ms(self.audio, pts) <= self.HOLD_MS and all(self._ms(pts, mark) > ms for mark, ms in ahead)

        n = len(self.held) if all_ else next((i for i, (pts, _) in enumerate(self.held) if waits(i, pts)), len(self.held))
        return [self.held.popleft()[1] for _ in range(n)]


def realign(units: DataFrame) -> DataFrame:
    """J14 of rows (flow_id, vseq, event_id, kind, pts90, pcr27), in order: (flow_id, event_id, place)."""
    def rows(s, found):
        s[1] += len(found)
        return [(flow, event, s[1] - len(found) + i + 1) for i, (flow, event) in enumerate(found)]

    def step(s, r):
        return rows(s, s[0].add((r.flow_id, r.event_id), r.kind, r.pts90, r.pcr27 // 300))

    cols = units.select("flow_id", "vseq", "event_id", "kind", "pts90", "pcr27")
    return ordered_fold(cols, ["flow_id"], ["vseq"], lambda: [Realign(), 0], step, "flow_id long, event_id long, place int", lambda s: rows(s, s[0].drain(True)))


def splice_time_adjusted(adjustment: Column, pts: Column) -> Column:
    """A cue's splice time after its section's adjustment, 33 bits."""
    return F.pmod(adjustment + pts, F.lit(1 << 33))
