"""Time-out errors on a grid of sweeps (W10), and the rate that a de-jitter buffer drains at (Q9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fold import ordered_fold

SWEEP_US = 500_000

#: Kinds: longest allowed gap in microseconds, and what happens while it lasts: latch (one error until the
#: kind is seen again), repeat (one at every sweep), anchor (an error counts as seen). Fixed values.
TIMERS = {
    "pat": (500_000, "anchor"), "pmt": (500_000, "latch"), "es": (500_000, "latch"), "pcr": (100_000, "latch"), "pts": (700_000, "latch"), "cat": (500_000, "repeat"),
    "sdt": (2_000_000, "repeat"), "eit": (2_000_000, "repeat"), "nit": (10_000_000, "repeat"), "tdt": (30_000_000, "repeat"), "rst": (60_000_000, "repeat"),
}


#: Kinds that are watched for each pid of their own. Fixed values.
BY_PID = ["pmt", "es", "pcr", "pts"]
#: How long after the first association table a pid that tables name may stay unseen. Fixed value.
GRACE_US = 1_000_000


def timer_errors(rows: DataFrame, keys: list[str], kind: str, time: str, until: Column | None = None, pid: str = "pid", named: DataFrame | None = None) -> DataFrame:
    """(keys, kind, errors, si_repetition) of rows (keys, kind, pid, time), one each time a kind was seen.

    Sweeps come every SWEEP_US from a key's first row of any kind to its last (or ``until``); none counts
    before the first pat, so a key without one has no errors. Kinds of BY_PID are watched for each pid. Of the
    pids that tables name (``named``: keys, kind, pid, time of the table) one that is unseen has an error at
    the first sweep over GRACE_US after the first pat. si_repetition counts the errors of sdt alone. Kinds
    that aren't in TIMERS are left out; a kind whose errors are none is listed if it was seen or named."""
    limits = F.create_map(*[F.lit(x) for k, (us, _) in TIMERS.items() for x in (k, us)])
    modes = F.create_map(*[F.lit(x) for k, (_, mode) in TIMERS.items() for x in (k, mode)])
    known = rows.where(F.col(kind).isin(list(TIMERS)))
    ends = known.groupBy(*keys).agg(F.min(time).alias("_f"), F.max(time if until is None else until).alias("_e"), F.min(F.when(F.col(kind) == "pat", F.col(time))).alias("_p"))
    sweep = lambda t: F.floor((t - F.col("_f")) / SWEEP_US)
    one = F.when(F.col(kind).isin(BY_PID), F.col(pid)).alias("_pid")
    seen = known.select(*keys, kind, one, F.col(time).alias("_t"))
    after = F.lead("_t").over(Window.partitionBy(*keys, kind, "_pid").orderBy("_t"))
    spans = seen.withColumn("_n", after).join(ends, keys)
    begins = F.greatest(sweep(F.col("_t") + limits[F.col(kind)]), F.ceil((F.col("_p") - F.col("_f")) / SWEEP_US) - 1)
    stale = F.greatest(sweep(F.coalesce("_n", F.col("_e") + 1) - 1) - begins, F.lit(0))
    mode = modes[F.col(kind)]
    errors = F.when(F.col("_p").isNull(), 0).when(mode == "latch", F.least(stale, F.lit(1))).when(mode == "anchor", F.ceil(stale / 2)).otherwise(stale)
    told = spans.select(*keys, kind, errors.cast("long").alias("n"))
    if named is not None:
        first = seen.groupBy(*keys, kind, "_pid").agg(F.min("_t").alias("_s"))
        due = named.groupBy(*keys, kind, F.col(pid).alias("_pid")).agg(F.min(time).alias("_a")).join(first, [*keys, kind, "_pid"], "left").join(ends, keys)
        begins = F.greatest(sweep(F.col("_p") + GRACE_US), F.ceil((F.col("_a") - F.col("_f")) / SWEEP_US) - 1)
        missed = sweep(F.coalesce("_s", F.col("_e") + 1) - 1) > begins
        told = told.unionByName(due.select(*keys, kind, F.when(F.col("_p").isNotNull() & missed, 1).otherwise(0).cast("long").alias("n")))
    out = told.groupBy(*keys, kind).agg(F.sum("n").alias("errors"))
    return out.withColumn("si_repetition", F.when(F.col(kind) == "sdt", F.col("errors")).otherwise(0))


class DrainRate:
    """Q9: the stream's own rate, from clock references and the bytes between them, smoothed as
    (3 old + new) / 4, and when the next datagram is due: a buffer that is fuller than its set point
    drains up to ``authority`` thousandths faster, an emptier one as much slower."""

    LONGEST, LEAST_NS = 13_500_000, 1_000_000

    def __init__(self, setpoint_ms: int = 100, authority: int = 50):
        self.setpoint, self.authority, self.rate, self.anchor, self.bytes, self.last = max(setpoint_ms, 1), authority, 0, None, 0, 0

    def measure(self, pcr: int | None, size: int) -> int:
        if pcr is not None:
            step = None if self.anchor is None else pcr - self.anchor
            if step is not None and 0 <= step <= self.LONGEST and (ns := step * 1000 // 27) >= self.LEAST_NS and self.bytes:
                seen = self.bytes * 8_000_000_000 // ns
                self.rate = (3 * self.rate + seen) // 4 if self.rate else seen
            if self.anchor is not None:
                self.bytes = 0
            self.anchor = pcr
        self.bytes += size
        return self.rate

    def due(self, size: int, depth: int, now_us: int) -> int:
        if not self.rate:
            return now_us
        off = (depth * size * 8000 // self.rate - self.setpoint) * 1000
        error = min(max(abs(off) // self.setpoint * (1 if off >= 0 else -1), -1000), 1000)
        product = self.authority * error
        factor = max(1000 + abs(product) // 1000 * (1 if product >= 0 else -1), 1)
        rate = max(self.rate * factor // 1000, 1)
        self.last = max(self.last + size * 8_000_000 // rate, now_us)
        return self.last


def drain_rates(rows: DataFrame) -> DataFrame:
    """Q9: (flow_id, event_id, rate) after each row (flow_id, vseq, event_id, pcr27, bytes)."""
    step = lambda s, r: [(r.flow_id, r.event_id, s.measure(None if r.pcr27 != r.pcr27 else int(r.pcr27), r.bytes))]
    return ordered_fold(rows.select("flow_id", "vseq", "event_id", "pcr27", "bytes"), ["flow_id"], ["vseq"], DrainRate, step, "flow_id long, event_id long, rate long")
