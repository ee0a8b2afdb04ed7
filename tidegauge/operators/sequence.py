"""Sequence algebra: merging legs, loss, continuity, re-ordering, parity.

Window forms shuffle once by stream; state machines run as ordered folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fold import ordered_fold
from .joins import met_in_spans

HALF = 0x8000


class GapFillMerge:
    """Q1: emits a 16-bit sequence number the first time any leg delivers it.

    Forward of the highest by less than half the range: emitted, and from ``window`` on everything
    seen is forgotten (the stream has restarted). Behind by less than ``window``: emitted if it
    wasn't yet. Else dropped."""

    def __init__(self, window: int = 1024):
        if not 64 <= window <= 16384 or window & window - 1:
            raise ValueError(f"window {window} is no power of two from 64 to 16384")
        self.window, self.highest, self.seen = window, None, set()

    def accept(self, seq: int) -> bool:
        if self.highest is None:
            self.highest, self.seen = seq, {seq}
            return True
        ahead, behind = (seq - self.highest) % 65536, (self.highest - seq) % 65536
        if 0 < ahead < HALF:
            if ahead >= self.window:
                self.seen = set()
            else:  # what falls out of the window is forgotten, or it would stand for the next lap's numbers
                self.seen.difference_update((self.highest - self.window + i) % 65536 for i in range(1, ahead + 1))
            self.highest = seq
            self.seen.add(seq)
            return True
        if behind >= self.window or seq in self.seen:
            return False
        self.seen.add(seq)
        return True


class Unwrap:
    """Q2: 16-bit numbers to a line; the anchor moves forward only."""

    def __init__(self):
        self.real = self.virtual = None

    def project(self, seq: int) -> int:
        if self.real is None:
            self.real, self.virtual = seq, 0
            return 0
        ahead = (seq - self.real + HALF) % 65536 - HALF
        at = self.virtual + ahead
        if ahead > 0:
            self.real, self.virtual = seq, at
        return at


class ReorderBuffer:
    """Q3, Q4: holds packets for the longest path difference from their first arrival, and releases
    them in sequence order. A copy that comes while its packet is held makes it seen by both legs;
    one that comes after its release is late."""

    def __init__(self, hold_us: int, window: int = 1024, most: int = 12_000):
        self.hold, self.most, self.merge, self.line = hold_us, most, GapFillMerge(window), Unwrap()
        self.held: dict[int, list] = {}
        self.cursor = None
        self.late = self.dups = self.lost = self.overflow = self.failovers = 0

    def drain(self, now: int) -> Iterator[tuple[int, int, int, int]]:
        """(virtual number, leg, legs seen, path difference) of what is due, in order."""
        last = None
        while self.held and now >= self.held[at := min(self.held)][1]:
            leg, due, legs, apart = self.held.pop(at)
            if self.cursor is not None and at > self.cursor:
                self.lost += at - self.cursor
            self.cursor = at + 1
            self.failovers += last is not None and last != leg
            last = leg
            yield at, leg, legs, apart

    def arrive(self, seq: int, leg: int, now: int) -> Iterator[tuple[int, int, int, int]]:
        at = self.line.project(seq)
        if at in self.held:
            entry = self.held[at]
            if not entry[2] & 1 << leg:
                entry[2] |= 1 << leg
                entry[3] = now - (entry[1] - self.hold)
            self.dups += 1
        elif not self.merge.accept(seq) or self.cursor is not None and at < self.cursor:
            self.late += 1
        elif len(self.held) >= self.most:
            self.overflow += 1
        else:
            self.held[at] = [leg, now + self.hold, 1 << leg, 0]
        yield from self.drain(now)


def merge_legs(legs: DataFrame, window: int = 1024) -> DataFrame:
    """Q1 over (flow_id, recv_leg_us, leg, event_id): the rows emitted."""
    return ordered_fold(
        legs.select("flow_id", "recv_leg_us", "leg", "event_id", "seq"), ["flow_id"], ["recv_leg_us", "leg", "event_id"], lambda: GapFillMerge(window),
        lambda s, r: [(r.flow_id, r.event_id, r.seq, r.leg)] if s.accept(r.seq) else (), "flow_id long, event_id long, seq long, leg int",
    )


def first_arrivals(legs: DataFrame) -> DataFrame:
    """Q1 where no stream restarts and the paths differ by less than the window: the first copy of
    each unwrapped number. No state, and it can be grouped by the number."""
    first = F.min_by(F.struct("event_id", "leg"), F.struct("recv_leg_us", "leg"))
    return legs.groupBy("flow_id", "vseq").agg(first.alias("first")).select("flow_id", "vseq", "first.event_id", "first.leg")


def unwrap(rows: DataFrame, keys: list[str], order: list[str], seq: str = "seq") -> DataFrame:
    """Q2 for streams that go forward: running sum of signed 16-bit steps."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.pmod(F.col(seq) - F.lag(seq).over(w) + HALF, F.lit(65536)) - HALF
    return rows.withColumn("step", F.coalesce(step, F.lit(0))).withColumn("virtual", F.sum("step").over(w)).drop("step")


def reorder(legs: DataFrame, hold_us: int = 20_000) -> DataFrame:
    """Q3 over legs: a row for each packet released, at the first arrival that finds it due, the
    rest at the end."""

    def step(s: tuple[ReorderBuffer, list], r) -> list[tuple]:
        s[1][:] = [r.flow_id]
        return [(r.flow_id, *x) for x in s[0].arrive(r.seq, r.leg, r.recv_leg_us)]

    return ordered_fold(
        legs.select("flow_id", "recv_leg_us", "leg", "event_id", "seq"), ["flow_id"], ["recv_leg_us", "leg", "event_id"], lambda: (ReorderBuffer(hold_us), []),
        step, "flow_id long, virtual long, leg int, legs int, path_us long", lambda s: [(*s[1], *x) for x in s[0].drain(1 << 62)],
    )


def reorder_counts(legs: DataFrame, hold_us: int = 20_000) -> DataFrame:
    """Q3, Q4: emitted, via both, leg 0 only, leg 1 only, duplicates, late, lost, widest path
    difference; D11's stream_resets is always 0."""

    def step(s: dict, r) -> list[tuple]:
        s["flow"] = r.flow_id
        count(s, s["buffer"].arrive(r.seq, r.leg, r.recv_leg_us))
        return []

    def count(s: dict, out) -> None:
        for _, _, legs_seen, apart in out:
            s[legs_seen] = s.get(legs_seen, 0) + 1
            s["apart"] = max(s.get("apart", 0), apart)

    def finish(s: dict) -> list[tuple]:
        b = s["buffer"]
        count(s, b.drain(1 << 62))
        one, two, both = (s.get(k, 0) for k in (1, 2, 3))
        return [(s["flow"], one + two + both, both, one, two, b.dups, b.late, b.lost, s.get("apart", 0), 0)]

    return ordered_fold(
        legs.select("flow_id", "recv_leg_us", "leg", "event_id", "seq"), ["flow_id"], ["recv_leg_us", "leg", "event_id"], lambda: {"buffer": ReorderBuffer(hold_us)}, step,
        "flow_id long, emitted long, via_both long, leg0_only long, leg1_only long, dups long, late long, gap_lost long, max_path_us long, stream_resets long", finish,
    )


def leg_merge_counts(legs: DataFrame, hold_us: int) -> DataFrame:
    """Q4 by grouping: a second copy within the hold is a duplicate seen by both legs, a later one is
    late."""
    apart = F.max("recv_leg_us") - F.min("recv_leg_us")
    one = legs.groupBy("flow_id", "vseq").agg(F.expr("bit_or(1 << leg)").alias("legs"), apart.alias("apart"), F.min_by("leg", F.struct("recv_leg_us", "leg")).alias("first"))
    both = (F.col("legs") == 3) & (F.col("apart") < hold_us)
    return one.groupBy("flow_id").agg(
        F.count(F.lit(1)).alias("emitted"), F.count_if(both).alias("via_both"), F.count_if(~both & (F.col("first") == 0)).alias("leg0_only"), F.count_if(~both & (F.col("first") == 1)).alias("leg1_only"),
        F.count_if((F.col("legs") == 3) & (F.col("apart") >= hold_us)).alias("late_dropped"), F.coalesce(F.max(F.when(both, F.col("apart"))), F.lit(0)).alias("max_path_us"),
    )


def leg_down(legs: DataFrame, silent_us: int = 1_000_000) -> DataFrame:
    """Q5: intervals in which a leg was silent for longer; up_us is null for a leg that is still silent at
    its flow's last arrival."""
    before = F.lag("recv_leg_us").over(Window.partitionBy("flow_id", "leg").orderBy("recv_leg_us", "event_id"))
    gaps = legs.select("flow_id", "leg", before.alias("from_us"), F.col("recv_leg_us").alias("up_us"))
    last = legs.groupBy("flow_id", "leg").agg(F.max("recv_leg_us").alias("from_us"))
    open_ = last.join(last.groupBy("flow_id").agg(F.max("from_us").alias("until_us")), "flow_id").where(F.col("until_us") - F.col("from_us") > silent_us)
    closed = gaps.where(F.col("up_us") - F.col("from_us") > silent_us)
    return closed.unionAll(open_.select("flow_id", "leg", "from_us", F.lit(None).cast("long"))).select("flow_id", "leg", (F.col("from_us") + silent_us).alias("down_us"), "up_us")


def red_blue(legs: DataFrame) -> DataFrame:
    """Q15: of each leg what came, what was passed on as a number's first copy, what was a duplicate, and
    how often the output changed over to it."""
    firsts = legs.groupBy("flow_id", "vseq").agg(F.min(F.struct("recv_leg_us", "leg")).alias("f"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("leg") == 0).alias("red"))
    last = F.lag("f.leg").over(Window.partitionBy("flow_id").orderBy("f.recv_leg_us", "f.leg", "vseq"))
    won = firsts.withColumn("switched", F.coalesce(F.col("f.leg") != last, F.lit(False)))
    seen = won.withColumn("leg", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("came", F.when(F.col("leg") == 0, F.col("red")).otherwise(F.col("n") - F.col("red")))
    mine = F.col("leg") == F.col("f.leg")
    counts = seen.groupBy("flow_id", "leg").agg(F.sum("came").alias("received"), F.count_if(mine).alias("forwarded"), F.count_if(mine & F.col("switched")).alias("switches"))
    return counts.where("received > 0").select("flow_id", "leg", "received", "forwarded", (F.col("received") - F.col("forwarded")).alias("duplicates"), "switches")


def realigned(base: Column, new_base: Column, seqs: Column, size: int) -> Column:
    """Q14: where the packets of a matrix of ``size`` cells lie once its first number is ``new_base``: their
    new places, or null if the new first number is a matrix or more away. Those outside are given up."""
    ahead = lambda a, b: F.pmod(a - b, F.lit(65536))
    places = F.filter(F.transform(seqs, lambda s: ahead(s, new_base)), lambda x: x < size)
    return F.when((ahead(new_base, base) < size) | (ahead(base, new_base) < size), places)


def ssrc_mismatches(rows: DataFrame, ssrc: str) -> DataFrame:
    """Q6: times a leg's source id changed to one that differs from the other leg's last."""
    by_leg, by_flow = Window.partitionBy("flow_id", "leg").orderBy("recv_leg_us", "event_id"), Window.partitionBy("flow_id").orderBy("recv_leg_us", "leg", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    other = F.when(F.col("leg") == 0, F.last(F.when(F.col("leg") == 1, F.col(ssrc)), True).over(by_flow)).otherwise(F.last(F.when(F.col("leg") == 0, F.col(ssrc)), True).over(by_flow))
    seen = rows.withColumn("own_last", F.coalesce(F.lag(ssrc).over(by_leg), F.lit(0))).withColumn("other", F.coalesce(other, F.lit(0)))
    bad = (F.col("other") != 0) & (F.col("other") != F.col(ssrc)) & (F.col("own_last") != F.col(ssrc))
    return seen.groupBy("flow_id").agg(F.count_if(bad).alias("ssrc_mismatch"))


def primary_preference(legs: DataFrame, stall_us: int = 200_000) -> DataFrame:
    """Q7: leg 0 always passes, leg 1 only when leg 0 has been silent longer than the stall; until leg 0's
    first packet the silence counts from the flow's first."""
    w = Window.partitionBy("flow_id").orderBy("recv_leg_us", "leg", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("leg") == 0, F.col("recv_leg_us")), True).over(w)
    began = F.first("recv_leg_us").over(w)
    return legs.withColumn("primary_us", F.coalesce(last, began)).where((F.col("leg") == 0) | (F.col("recv_leg_us") - F.col("primary_us") > stall_us))


def sequence_loss(rows: DataFrame, order: list[str]) -> DataFrame:
    """Q8: gaps against the previous packet, counted if below 1000; late packets move the mark back,
    so re-ordering counts too. true_missing beside it counts numbers that never came."""
    gap = F.pmod(F.col("seq") - F.lag("seq").over(Window.partitionBy("flow_id").orderBy(*order)) - 1, F.lit(65536))
    gaps = rows.withColumn("gap", gap)
    return gaps.groupBy("flow_id").agg(
        F.count(F.lit(1)).alias("packets"), F.coalesce(F.sum(F.when(F.col("gap").between(1, 999), F.col("gap"))), F.lit(0)).alias("lost"),
        (F.max("vseq") - F.min("vseq") + 1 - F.count_distinct("vseq")).alias("true_missing"),
    )


def delay_line(rows: DataFrame, delay_us: int, most_packets: int | None = None, most_bytes: int = 64 << 20, keys: tuple[str, ...] = ("flow_id",), order: str = "event_id") -> DataFrame:
    """Q10: when each packet leaves a fixed delay. With ``most_packets`` also whether it is shed before: a packet
    that comes pushes the oldest out until it fits among ``most_packets`` and ``most_bytes``; one that is larger
    than all that has the line for itself.

    What is pushed out is always the front, so a packet is shed just if those that come before its release
    are, with itself, too many or too large: a difference of running sums at the last of them."""
    due = rows.withColumn("release_us", F.col("recv_us") + delay_us)
    if most_packets is None:
        return due
    by = Window.partitionBy(*keys)
    so_far = by.orderBy("recv_us", order).rowsBetween(Window.unboundedPreceding, 0)
    held = by.orderBy("recv_us").rangeBetween(0, delay_us - 1)
    summed = due.withColumns({"_n": F.count(F.lit(1)).over(so_far), "_s": F.sum("bytes").over(so_far)})
    met = summed.withColumns({"_held": F.max("_n").over(held) - F.col("_n") + 1, "_bytes": F.max("_s").over(held) - F.col("_s") + F.col("bytes")})
    shed = (F.col("_held") > most_packets) | ((F.col("_bytes") > most_bytes) & (F.col("_held") > 1))
    return met.withColumn("shed", shed).drop("_n", "_s", "_held", "_bytes")


def continuity_errors(cells: DataFrame, allow_duplicate: bool = True) -> DataFrame:
    """Q16 (duplicates allowed), Q17 (strict) over payload-bearing cells of one stream: (flow_id, pid,
    cells, errors)."""
    w = Window.partitionBy("flow_id", "pid").orderBy("vseq")
    step = F.pmod(F.col("cc") - F.lag("cc").over(w), F.lit(16))
    bad = (step != 1) & (step != 0) if allow_duplicate else step != 1
    marked = cells.where("has_payload").withColumn("bad", F.coalesce(bad, F.lit(False)))
    return marked.groupBy("flow_id", "pid").agg(F.count(F.lit(1)).alias("cells"), F.count_if("bad").alias("errors"))


class SyncLock:
    """Q18: lost after ``n`` bad sync bytes in a row, regained after ``n`` good ones."""

    def __init__(self, n: int = 5):
        self.n, self.locked, self.run = n, True, 0

    def see(self, good: bool) -> str | None:
        self.run = 0 if good == self.locked else self.run + 1
        if self.run < self.n:
            return None
        self.locked, self.run = not self.locked, 0
        return "regained" if self.locked else "lost"


def sync_events(cells: DataFrame, good: Column) -> DataFrame:
    """Q18: the cells at which sync is lost or regained."""
    def step(s: SyncLock, r) -> list[tuple]:
        return [(r.flow_id, r.vseq, x)] if (x := s.see(r.good)) else []

    return ordered_fold(cells.select("flow_id", "vseq", good.alias("good")), ["flow_id"], ["vseq"], SyncLock, step, "flow_id long, vseq long, change string")


def reassemble(cells: DataFrame, keys: list[str], order: str, begins: Column, payload: str) -> DataFrame:
    """Q19, Q20: units that begin where ``begins`` holds; cells before the first beginning go. One
    row a unit: keys, unit, first (order), cells, data. A unit is bounded by its format."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = cells.withColumn("unit", F.sum(F.when(begins, 1).otherwise(0)).over(w)).where("unit > 0")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, payload))), lambda x: x[payload])
    data = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))
    return numbered.groupBy(*keys, "unit").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("cells"), data.alias("data"))


def parity(rows: DataFrame, columns: int, depth: int, values: list[str], seq: str = "vseq") -> DataFrame:
    """Q12: exclusive-or parity of each column and row of the L x D matrix, for complete ones:
    (flow_id, cycle, is_column, index, values)."""
    cell = F.col(seq) % (columns * depth)
    grid = rows.withColumns({"cycle": F.floor(F.col(seq) / (columns * depth)), "col": cell % columns, "row": F.floor(cell / columns)})
    xor = [F.expr(f"bit_xor({v})").alias(v) for v in values]
    down = grid.groupBy("flow_id", "cycle", F.col("col").alias("index")).agg(F.count(F.lit(1)).alias("n"), *xor).where(F.col("n") == depth).withColumn("is_column", F.lit(True))
    across = grid.groupBy("flow_id", "cycle", F.col("row").alias("index")).agg(F.count(F.lit(1)).alias("n"), *xor).where(F.col("n") == columns).withColumn("is_column", F.lit(False))
    return down.unionByName(across).select("flow_id", "cycle", "is_column", "index", *values)


def recover(rows: DataFrame, parities: DataFrame, columns: int, depth: int, value: str, seq: str = "vseq") -> DataFrame:
    """Q13: (flow_id, cycle, cell, value) of lost cells that column and row parities restore, by
    solving single erasures until none is left. A cycle is one group, of L * D cells at most; Q14's
    re-alignment is the caller's choice of ``seq``."""
    size = columns * depth
    media = rows.select("flow_id", F.floor(F.col(seq) / size).alias("cycle"), F.lit(0).alias("what"), (F.col(seq) % size).cast("long").alias("at"), F.col(value).cast("long").alias("v"))
    checks = parities.select("flow_id", "cycle", F.when(F.col("is_column"), 1).otherwise(2).alias("what"), F.col("index").cast("long").alias("at"), F.col(value).cast("long").alias("v"))

    places = {(1, a): [a + columns * r for r in range(depth)] for a in range(columns)} | {(2, a): [a * columns + c for c in range(columns)] for a in range(depth)}

    def solved(parts: list[dict]) -> list[tuple[int, int]]:
        have = {p["at"]: p["v"] for p in parts if p["what"] == 0}
        lines = [(places[p["what"], p["at"]], p["v"]) for p in parts if p["what"]]
        out, found = [], True
        while found:
            found = False
            for cells, v in lines:
                missing = [c for c in cells if c not in have]
                if len(missing) == 1:
                    for c in cells:
                        v ^= have.get(c, 0)
                    have[missing[0]] = v
                    out.append((missing[0], v))
                    found = True
        return out

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(f, c, cell, v) for f, c, parts in zip(frame["flow_id"], frame["cycle"], frame["parts"], strict=True) for cell, v in solved(parts)]
            yield pd.DataFrame(out, columns=["flow_id", "cycle", "cell", "value"]).astype("int64")

    # many cycles to a batch: a frame of its own for each takes longer than solving it
    cycles = media.unionByName(checks).groupBy("flow_id", "cycle").agg(F.collect_list(F.struct("what", "at", "v")).alias("parts"))
    return cycles.mapInPandas(solve, "flow_id long, cycle long, cell long, value long")


def splice_points(switches: DataFrame, units: DataFrame, span_us: int = 1_000_000) -> DataFrame:
    """Q21: for each switch (switch_id, flow_id, at_us, pts, timeout_us) the first unit (flow_id, recv_us, pts90,
    key) of the flow after it whose stamp has reached the switch's (modulo 2**33, half range ahead)
    and that is a key unit; switches without one within timeout_us are timed out."""
    keys = units.where("key").select("flow_id", F.col("recv_us").alias("unit_us"), "pts90")
    met = met_in_spans(switches, keys, ["flow_id"], F.col("at_us"), F.col("at_us") + F.col("timeout_us"), F.col("unit_us"), span_us)
    ahead = F.pmod(F.col("pts90") - F.col("pts"), F.lit(1 << 33)) < (1 << 32)
    return met.groupBy("switch_id", "flow_id").agg(F.min(F.when(ahead, F.col("unit_us"))).alias("splice_us")).withColumn("timed_out", F.col("splice_us").isNull())


def assemble(parts: list[DataFrame]) -> DataFrame:
    """One stream from several."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
