"""Selection: allow-lists, plausibility, rate and gate filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bits import DATA_ONLY
from .fold import ordered_fold


def allow_sources(rows: DataFrame, allowed: DataFrame, source: str) -> DataFrame:
    """rows whose source is allowed."""
    return rows.join(allowed.select(source).distinct(), source, "left_semi")


def filtered_counts(rows: DataFrame, allowed: DataFrame, source: str) -> DataFrame:
    """per flow, rows that pass and rows filtered."""
    marked = rows.join(allowed.select(source).distinct().withColumn("ok", F.lit(True)), source, "left")
    return marked.groupBy("flow_id").agg(F.count_if("ok").alias("passed"), F.count_if(F.col("ok").isNull()).alias("filtered"))


def allow_payload_types(rows: DataFrame, payload_type: Column, allowed: list[int]) -> DataFrame:
    """F4."""
    return rows.where(payload_type.isin(allowed))


class TokenBucket:
    """holds ten milliseconds of the rate at most; starts full."""

    def __init__(self, bits_per_second: int):
        self.rate, self.most = bits_per_second, bits_per_second / 100
        self.tokens, self.last = self.most, None

    def consume(self, now_us: int, bits: int) -> bool:
        if self.last is not None:
            self.tokens = min(self.most, self.tokens + (now_us - self.last) * self.rate / 1e6)
        self.last = now_us
        if self.tokens < bits:
            return False
        self.tokens -= bits
        return True


def rate_limit(rows: DataFrame, bits_per_second: int) -> DataFrame:
    """(flow_id, event_id, passed)."""
    return ordered_fold(
        rows.select("flow_id", "recv_us", "event_id", "bytes"), ["flow_id"], ["recv_us", "event_id"], lambda: TokenBucket(bits_per_second),
        lambda s, r: [(r.flow_id, r.event_id, s.consume(r.recv_us, r.bytes * 8))], "flow_id long, event_id long, passed boolean",
    )


def block_gate(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """how many of a flow's rows came, and how many of them one of its intervals [from_us, to_us)
    blocks. Edges of intervals and rows are merged in order, and open intervals counted along."""
    edge = lambda at, by: blocks.select("flow_id", F.col(at).alias("t"), F.lit(by).alias("by"), F.lit(0).alias("what"))
    merged = edge("from_us", 1).unionAll(edge("to_us", -1)).unionAll(rows.select("flow_id", F.col("recv_us").alias("t"), F.lit(0).alias("by"), F.lit(1).alias("what")))
    now = F.sum("by").over(Window.partitionBy("flow_id").orderBy("t", "what").rowsBetween(Window.unboundedPreceding, 0))
    return merged.withColumn("now", now).where("what = 1").groupBy("flow_id").agg(F.count(F.lit(1)).alias("received"), F.count_if(F.col("now") > 0).alias("blocked"))


def counts_for_continuity(pid: Column, has_payload: Column) -> Column:
    """F8: null cells and cells of adaptation only are left out."""
    return (pid != 0x1FFF) & has_payload


def is_data_only(stream_type: Column) -> Column:
    """F9."""
    return stream_type.isin(DATA_ONLY)


def is_continuous_media(stream_type: Column, audio_kind: Column | None = None) -> Column:
    """types whose stream is expected to flow all the time: video and audio, not cues, sections or
    subtitles. Private data (0x06) counts if its descriptors name an audio kind. Fixed values."""
    video = [0x01, 0x02, 0x10, 0x1B, 0x1F, 0x20, 0x21, 0x24, 0x42, 0xEA]
    audio = [0x03, 0x04, 0x0F, 0x11, 0x81, 0x87]
    described = F.lit(False) if audio_kind is None else (stream_type == 0x06) & audio_kind.isNotNull()
    return stream_type.isin(video + audio) | described


def plausible_drift(rows: DataFrame, keys: list[str], order: str, value: str, most: int) -> DataFrame:
    """rows whose step to the previous one is at most ``most``; a larger step is discarded and
    the next is measured from there."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    return rows.withColumn("step", step).where(F.col("step") <= most)


class Quiet:
    """lets an event pass if none has for ``gap_us``."""

    def __init__(self, gap_us: int):
        self.gap, self.last = gap_us, None

    def passes(self, now_us: int) -> bool:
        if self.last is not None and now_us - self.last < self.gap:
            return False
        self.last = now_us
        return True


def event_rate_limit(events: DataFrame, gap_us: int) -> DataFrame:
    """F12 for each flow: the events that are reported."""
    return ordered_fold(events.select("flow_id", "recv_us", "event_id"), ["flow_id"], ["recv_us", "event_id"], lambda: Quiet(gap_us), lambda s, r: [(r.flow_id, r.event_id)] if s.passes(r.recv_us) else (), "flow_id long, event_id long")


def active_input(rows: DataFrame, switches: DataFrame) -> DataFrame:
    """rows of the leg that the flow's last switch (flow_id, at_us, active) before them chose; leg
    0 until the first."""
    s = switches.select("flow_id", F.col("at_us").alias("t"), F.lit(0).alias("what"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("int").alias("leg"), F.col("active").cast("int").alias("active"))
    r = rows.select("flow_id", F.col("recv_leg_us").alias("t"), F.lit(1).alias("what"), "event_id", F.col("leg").cast("int").alias("leg"), F.lit(None).cast("int").alias("active"))
    now = F.last("active", True).over(Window.partitionBy("flow_id").orderBy("t", "what", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return s.unionAll(r).withColumn("now", F.coalesce(now, F.lit(0))).where((F.col("what") == 1) & (F.col("leg") == F.col("now"))).select("flow_id", "event_id", "leg")
