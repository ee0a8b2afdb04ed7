"""Grouped statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fold import ordered_fold
from .joins import met_in_spans


def lagged(rows: DataFrame, value: str, keys: list[str], order: list[str], name: str) -> DataFrame:
    return rows.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def traffic(rows: DataFrame, *keys: str) -> DataFrame:
    """A1."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"))


def inter_arrival(rows: DataFrame, *epoch: str) -> DataFrame:
    """A2: least, largest and mean time between arrivals since the last switch (``epoch``)."""
    gaps = lagged(rows, "recv_us", ["flow_id", *epoch], ["vseq"], "iat")
    return gaps.groupBy("flow_id", *epoch).agg(F.min("iat").alias("min_us"), F.max("iat").alias("max_us"), F.avg("iat").alias("avg_us"))


def per_pid(rows: DataFrame) -> DataFrame:
    """A3: packets, bytes, continuity errors (strict) and clock discontinuities of each pid."""
    from .windows import pcr_discontinuities

    w = Window.partitionBy("flow_id", "pid").orderBy("vseq")
    paid = rows.where("has_payload").withColumn("bad", F.coalesce(F.pmod(F.col("cc") - F.lag("cc").over(w), F.lit(16)) != 1, F.lit(False)))
    errors = paid.groupBy("flow_id", "pid").agg(F.count_if("bad").alias("cc_errors"))
    jumps = pcr_discontinuities(rows, ["flow_id", "pid"]).groupBy("flow_id", "pid").agg(F.count_if("jump").alias("pcr_errors"))
    return traffic(rows, "flow_id", "pid").join(errors, ["flow_id", "pid"], "left").join(jumps, ["flow_id", "pid"], "left").withColumn("cc_errors", F.coalesce("cc_errors", F.lit(0)))


def tumbling(rows: DataFrame, keys: list[str], time_us: str, size_us: int, *aggs: Column) -> DataFrame:
    """Aggregates of windows of ``size_us``; window is its number."""
    return rows.groupBy(*keys, F.floor(F.col(time_us) / size_us).alias("window")).agg(*aggs)


def between_ranks(low: Column, high: Column, place: Column) -> Column:
    """The value at ``place`` (from 0) between those at the ranks around it, rounded to a whole number; null where
    there is none. Both take their shares, and the lower one's is added without being rounded first, as SQL's
    quantile_cont does it: what lies half between two whole numbers comes out on the same side."""
    share = place - F.floor(place)
    added = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low.cast("double"), F.floor(place) + 1 - place, high.cast("double") * share)
    return F.when(low.isNotNull(), F.round(added.cast("double"))).cast("long")


def ends_of(values: Column, p: float) -> Column:
    """(low, high, place) of ``between_ranks`` for an array; nulls are left out."""
    def of(v):
        place = (F.size(v) - 1) * F.lit(p)
        return F.struct(F.get(v, F.floor(place).cast("int")).alias("low"), F.get(v, F.ceil(place).cast("int")).alias("high"), place.alias("place"))

    return F.get(F.transform(F.array(F.array_sort(F.array_compact(values))), of), F.lit(0))


def percentiles(rows: DataFrame, keys: list[str], value: str, ps: list[float]) -> DataFrame:
    """A5: exact, interpolated between ranks, rounded to integers. Ranked by a window, so no group is
    gathered in one row."""
    w = Window.partitionBy(*keys)
    ranked = rows.select(*keys, F.col(value).alias("_v")).withColumn("_n", F.count("_v").over(w)).withColumn("_i", F.row_number().over(w.orderBy(F.asc_nulls_last("_v"))) - 1)
    place = {p: (F.col("_n") - 1) * F.lit(p) for p in ps}
    at = lambda rank: F.max(F.when(F.col("_i") == rank, F.col("_v")))
    ends = ranked.groupBy(*keys, "_n").agg(*[at(end(place[p])).alias(f"_{side}{k}") for k, p in enumerate(ps) for side, end in (("low", F.floor), ("high", F.ceil))])
    return ends.select(*keys, *[between_ranks(F.col(f"_low{k}"), F.col(f"_high{k}"), place[p]).alias(f"p{p * 100:g}".replace(".", "_")) for k, p in enumerate(ps)])


def nearest_rank(rows: DataFrame, keys: list[str], order: list[str], value: str, p: float) -> DataFrame:
    """The value at index round((n - 1) * p), not interpolated. Ranked by a window, so no group is
    gathered in one row."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(value, *order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("_i") == F.floor((F.col("_n") - 1) * p + 0.5)).select(*keys, F.col(value).alias("value"))


def worst_of(stats: DataFrame, keys: list[str], columns: list[str], by: str, name: str) -> DataFrame:
    """Largest of each percentile over outputs, sum of samples, and the output with the worst ``by``."""
    return stats.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns], F.sum("samples").alias("samples"), F.max_by(name, F.struct(by, name)).alias(f"worst_{name}"))


def window_and_total(rows: DataFrame, keys: list[str], time_us: str, size_us: int, counters: dict[str, Column]) -> DataFrame:
    """Counters of each window, their running totals, and ok_<name> where the window has none."""
    sums = tumbling(rows, keys, time_us, size_us, *[F.count_if(c).alias(n) for n, c in counters.items()])
    w = Window.partitionBy(*keys).orderBy("window")
    return sums.withColumns({f"total_{n}": F.sum(n).over(w) for n in counters} | {f"ok_{n}": F.col(n) == 0 for n in counters})


def over_limit_runs(rates: DataFrame, keys: list[str], order: str, over: Column, grace: int) -> DataFrame:
    """Runs of at least ``grace`` rows for which ``over`` holds: (keys, begin, alarm_at,
    until, n)."""
    w = Window.partitionBy(*keys).orderBy(order)
    island = F.sum(F.when(F.col("_o"), 0).otherwise(1)).over(w)
    marked = rates.withColumn("_o", over).withColumn("_i", island).where("_o")
    nth = F.row_number().over(Window.partitionBy(*keys, "_i").orderBy(order))
    runs = marked.withColumn("_n", nth).groupBy(*keys, "_i").agg(F.min(order).alias("begin"), F.max(F.when(F.col("_n") == grace, F.col(order))).alias("alarm_at"), F.max(order).alias("until"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("n") >= grace).drop("_i")


def held_for(rows: DataFrame, keys: list[str], time: str, on: Column, hold_us: int) -> DataFrame:
    """H8: stretches of rows for which ``on`` holds that last ``hold_us`` at least: (keys, begin_us,
    alarm_us, until_us); the alarm comes with the first row that is so much after the beginning."""
    w = Window.partitionBy(*keys).orderBy(time)
    marked = rows.select(*keys, time, F.coalesce(on, F.lit(False)).alias("_o"))
    marked = marked.withColumn("_i", F.sum(F.when(F.col("_o"), 0).otherwise(1)).over(w)).where("_o")
    timed = marked.withColumn("_b", F.min(time).over(Window.partitionBy(*keys, "_i").orderBy(time)))
    late = F.when(F.col(time) - F.col("_b") >= hold_us, F.col(time))
    return timed.groupBy(*keys, "_i").agg(F.min(time).alias("begin_us"), F.min(late).alias("alarm_us"), F.max(time).alias("until_us")).where("alarm_us IS NOT NULL").drop("_i")


class Dwell:
    """Fires with the first row that is stale so long after the first stale one, and then begins anew
    with the stale row after it."""

    def __init__(self, hold_us: int):
        self.hold, self.since = hold_us, None

    def add(self, stale: bool, at: int) -> bool:
        fires = stale and self.since is not None and at - self.since >= self.hold
        self.since = None if fires or not stale else at if self.since is None else self.since
        return fires


def dwells(rows: DataFrame, keys: list[str], time: str, stale: Column, hold_us: int) -> DataFrame:
    """(keys, time) of the rows at which a stale stretch fires, each time it has lasted ``hold_us``.
    Rows that aren't stale matter only where they end a stretch, so only stale ones are gone through."""
    w = Window.partitionBy(*keys).orderBy(time)
    marked = rows.select(*keys, time, F.coalesce(stale, F.lit(False)).alias("_o"))
    stretch = marked.withColumn("stretch_nr", F.sum(F.when(F.col("_o"), 0).otherwise(1)).over(w)).where("_o")
    by = [*keys, "stretch_nr"]
    schema = ", ".join(f"{c} {dict(stretch.dtypes)[c]}" for c in [*keys, time])
    return ordered_fold(stretch.drop("_o"), by, [time], lambda: Dwell(hold_us), lambda s, r: [(*(getattr(r, c) for c in [*keys, time]),)] if s.add(True, getattr(r, time)) else [], schema)


def silent(loudness: Column, bitrate: Column, most: float = -60.0) -> Column:
    """H8: whether a block is silent: by its loudness, ``most`` at most, or where no decoder gives one by its bitrate. A
    loudness that isn't finite is no silence."""
    finite = ~F.isnan(loudness) & (F.abs(loudness) != float("inf"))
    return F.when(loudness.isNotNull(), finite & (loudness <= most)).otherwise(bitrate < 1000)


def hard_mutes(frames: DataFrame, keys: list[str], order: str, channels: str, sample_rate: int) -> DataFrame:
    """H8: runs of frames in which all channels are exactly zero, of 40 ms or more."""
    rate = sample_rate or 48_000
    return over_limit_runs(frames, keys, order, F.forall(channels, lambda x: x == 0), max(rate * 40 // 1000, 1))


def sliding_ratio(rows: DataFrame, keys: list[str], order: str, part: str, whole: str, size: int, floor: int, least: float) -> DataFrame:
    """A10: part / whole over the last ``size`` rows, and whether it is at least ``least`` with at
    least ``floor`` in whole."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - size, 0)
    sums = rows.withColumns({"_p": F.sum(part).over(w), "_w": F.sum(whole).over(w)})
    return sums.withColumn("ratio", F.col("_p") / F.nullif(F.col("_w"), F.lit(0))).withColumn("degraded", F.coalesce((F.col("_w") >= floor) & (F.col("ratio") >= least), F.lit(False))).drop("_p", "_w")


def pid_gauges(seen: DataFrame, referenced: DataFrame) -> DataFrame:
    """Pids sent but not referenced, and referenced but not sent."""
    both = seen.select("flow_id", "pid").distinct().withColumn("s", F.lit(True)).join(referenced.select("flow_id", "pid").distinct().withColumn("r", F.lit(True)), ["flow_id", "pid"], "full")
    return both.groupBy("flow_id").agg(F.count_if(F.col("r").isNull()).alias("unreferenced"), F.count_if(F.col("s").isNull()).alias("missing"))


def gop(frames: DataFrame) -> DataFrame:
    """Key frames and their mean distance in frames, distances of 1 to 9999 only."""
    numbered = frames.withColumn("frame", F.row_number().over(Window.partitionBy("flow_id").orderBy("vseq")))
    keys = lagged(numbered.where("key"), "frame", ["flow_id"], ["frame"], "apart")
    return keys.groupBy("flow_id").agg(F.count(F.lit(1)).alias("idr_count"), F.avg(F.when(F.col("apart").between(1, 9999), F.col("apart"))).alias("mean_interval"))


def captions(rows: DataFrame, now_us: Column, service: str) -> DataFrame:
    """Packets, services, and whether one came within the last five seconds."""
    return rows.groupBy("flow_id").agg(F.count(F.lit(1)).alias("packets"), F.array_join(F.array_sort(F.collect_set(F.col(service).cast("string"))), ",").alias("services"), (now_us - F.max("recv_us") <= 5_000_000).alias("present"))


def cues(rows: DataFrame, command: str) -> DataFrame:
    """Cues, and the last one's command and stamp."""
    last = F.max_by(F.struct(command, "pts90"), F.struct("recv_us", "event_id")).alias("last")
    return rows.groupBy("flow_id").agg(F.count(F.lit(1)).alias("cues"), last).select("flow_id", "cues", F.col(f"last.{command}").alias("last_command"), F.col("last.pts90").alias("last_pts"))


def file_probe(cells: DataFrame, wrap: int) -> DataFrame:
    """Per flow, cells, first and last clock reference, and the duration between in ms."""
    found = cells.groupBy("flow_id").agg(F.count(F.lit(1)).alias("cells"), F.min_by("pcr27", "vseq").alias("first_pcr"), F.max_by("pcr27", "vseq").alias("last_pcr"))
    return found.withColumn("duration_ms", F.floor(F.pmod(F.col("last_pcr") - F.col("first_pcr"), F.lit(wrap)) / 27000))


def recordings(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """Per recording, segments, bytes, span and clips."""
    s = segments.groupBy("recording_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("bytes").alias("bytes"), (F.max("end_pts") - F.min("start_pts")).alias("span"))
    return s.join(clips.groupBy("recording_id").agg(F.count(F.lit(1)).alias("clips")), "recording_id", "left").withColumn("clips", F.coalesce("clips", F.lit(0)))


def bytes_in_range(segments: DataFrame, ranges: DataFrame, span: int = 64) -> DataFrame:
    """For each range (range_id, recording_id, from_segment, from_offset, to_segment, to_offset)
    the bytes between; a range without segments isn't listed."""
    sized = segments.select("recording_id", "segment_id", F.col("bytes").alias("segment_bytes"))
    met = met_in_spans(ranges, sized, ["recording_id"], F.col("from_segment"), F.col("to_segment"), F.col("segment_id"), span, "inner")
    end = F.when(F.col("segment_id") == F.col("to_segment"), F.col("to_offset")).otherwise(F.col("segment_bytes"))
    begin = F.when(F.col("segment_id") == F.col("from_segment"), F.col("from_offset")).otherwise(0)
    return met.groupBy("range_id").agg(F.sum(F.greatest(end - begin, F.lit(0))).alias("bytes"))


def worst_label(rows: DataFrame, keys: list[str], ordinal: str, labels: list[str]) -> DataFrame:
    """Label of the largest ordinal."""
    names = F.array(*map(F.lit, labels))
    return rows.groupBy(*keys).agg(F.max(ordinal).alias("worst")).withColumn("label", F.element_at(names, F.col("worst").cast("int") + 1))


def capacity_totals(flows: DataFrame, keys: list[str]) -> DataFrame:
    """Cost units and hardware sessions of running flows."""
    return flows.where("running").groupBy(*keys).agg(F.sum("cost_units").alias("cost_units"), F.sum("hw_sessions").alias("hw_sessions"))


def leg_probe(rounds: DataFrame, knee: float = 0.05) -> DataFrame:
    """From (leg_id, round, rate, sent, acked, rtt_us): the rate of the last round before loss
    passed the knee, the round it did, and the least round trip."""
    loss = (F.col("sent") - F.col("acked")) / F.nullif(F.col("sent"), F.lit(0))
    judged = rounds.withColumn("bad", F.coalesce(loss > knee, F.lit(False)))
    first = judged.groupBy("leg_id").agg(F.min(F.when(F.col("bad"), F.col("round"))).alias("failed_round"), F.min("rtt_us").alias("min_rtt_us"))
    met = judged.join(first, "leg_id")
    good = F.max(F.when(F.col("failed_round").isNull() | (F.col("round") < F.col("failed_round")), F.col("rate")))
    return met.groupBy("leg_id", "failed_round", "min_rtt_us").agg(F.coalesce(good, F.lit(0)).alias("capacity"))


def clipping(frames: DataFrame, samples: str, size: int, level: float = 0.9975) -> DataFrame:
    """Clipped samples in each bucket of ``size`` frames."""
    n = F.size(F.filter(samples, lambda x: F.abs(x) >= level))
    return frames.groupBy(F.floor(F.col("frame") / size).alias("bucket")).agg(F.sum(n).alias("clipped"))


def frame_difference(frames: DataFrame, plane: str, order: str, keys: list[str]) -> DataFrame:
    """Mean absolute difference to the previous frame."""
    before = F.lag(plane).over(Window.partitionBy(*keys).orderBy(order))
    sad = F.aggregate(F.zip_with(plane, "_b", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(plane)
    return frames.withColumn("_b", before).withColumn("sad", sad).drop("_b")


def levels(frames: DataFrame, samples: str, floor_db: float = -90.0) -> DataFrame:
    """Peak and RMS of a block in dB of full scale, kept in [floor, 0]."""
    db = lambda a: F.when(a <= 0, F.lit(floor_db)).otherwise(F.least(F.greatest(20 * F.log10(F.when(a > 0, a).otherwise(1)), F.lit(floor_db)), F.lit(0.0)))
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
    square = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return frames.withColumn("peak_dbfs", db(peak)).withColumn("rms_dbfs", db(F.sqrt(square / F.size(samples))))


class PeakHold:
    """The peak shown stays until one as high comes or it has stood for ``hold_us``."""

    def __init__(self, hold_us: int = 1_500_000):
        self.hold_us, self.shown, self.until = hold_us, float("-inf"), 0

    def add(self, now_us: int, peak: float) -> float:
        if peak >= self.shown or now_us >= self.until:
            self.shown, self.until = peak, now_us + self.hold_us
        return self.shown


def peak_hold(blocks: DataFrame, time: str, peak: str, hold_us: int = 1_500_000) -> DataFrame:
    """(flow_id, pid, event_id, shown) over the blocks of each flow_id and pid."""
    rows = blocks.select("flow_id", "pid", F.col(time).alias("at"), "event_id", F.col(peak).cast("double").alias("peak"))
    return ordered_fold(rows, ["flow_id", "pid"], ["at", "event_id"], lambda: PeakHold(hold_us), lambda s, r: [(r.flow_id, r.pid, r.event_id, s.add(r.at, r.peak))], "flow_id long, pid long, event_id long, shown double")


#: Cost of a flow, in units. Fixed values.
COST_BASE = 1
COST = {
    "hw_video_encode_units": 1,
    "sw_video_encode_units": 1,
    "audio_encodes": 5,
    "display_outputs": 275,
    "display_hw_outputs": 100,
    "audio_bars": 15,
    "analysis_lite": 2,
    "analysis_audio": 20,
    "analysis_video": 50,
    "recording": 5,
    "thumbnail_units": 1,
}


def flow_cost() -> Column:
    """A27 over the columns of COST (flags as 0 or 1), at most 2**32 - 1."""
    total = F.lit(COST_BASE).cast("long")
    for name, weight in COST.items():
        total = total + F.col(name).cast("long") * weight
    return F.least(total, F.lit((1 << 32) - 1))


def programs(streams: DataFrame) -> DataFrame:
    """Per program its bitrate and its streams in pid order, as text."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pid", "bitrate"))), lambda x: F.concat_ws(":", x["pid"], x["bitrate"])), ",")
    return streams.groupBy("flow_id", "program").agg(F.sum("bitrate").alias("bitrate"), listed.alias("streams"))


def max_min_shares(members: DataFrame, capacities: DataFrame) -> DataFrame:
    """(leg_id, member_id, share) by strict tiers (tier 0 first) and, within a tier, weighted
    max-min fairness. caps are min(demand, hard_cap), 0 at least; a capacity that isn't positive and finite is 0.

    A tier gets what the caps of those before it leave. Its level is the largest, over members in order of
    cap / weight, of (what is left less the caps before) / (weights from here on): it rises as long as caps
    stay below it and falls after. Every share is the smaller of the cap and the weight times that level."""
    capacity = F.when((F.col("capacity") > 0) & (F.col("capacity") < float("inf")), F.col("capacity").cast("double")).otherwise(0.0)
    given = members.join(capacities, "leg_id").withColumns({"left": capacity, "cap": F.greatest(F.least("demand", "hard_cap"), F.lit(0.0)), "w": F.greatest("weight", F.lit(1e-9))})
    tier, leg = Window.partitionBy("leg_id", "tier"), Window.partitionBy("leg_id").orderBy("tier")
    used = F.sum("cap").over(leg.rangeBetween(Window.unboundedPreceding, -1))
    filled = given.withColumn("left", F.greatest(F.col("left") - F.coalesce(used, F.lit(0.0)), F.lit(0.0)))
    by_fill = tier.orderBy(F.col("cap") / F.col("w"), "member_id")
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    here_on = F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    level = filled.withColumn("g", (F.col("left") - before) / here_on).withColumn("level", F.max("g").over(tier))
    return level.select("leg_id", "member_id", F.least(F.col("cap"), F.greatest(F.col("level"), F.lit(0.0)) * F.col("w")).alias("share"))
