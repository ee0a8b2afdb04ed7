"""Queries of loudness. Every packet carries 40 ms of a tone in two channels, whose level goes by the packet's
place and value; the gating queries take energies of slots from the packets' values instead, whole numbers,
whose sums are exact in any order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, loudness
from ..sources.stored import stored
from .binding import packets
from .registry import query

RATE, FRAME = 8000, 320


def tone(sent: list[int]) -> np.ndarray:
    """The samples of a packet (its place and value): a louder, a softer and a silent second after one another."""
    n, c = (int(x) for x in sent)
    t = n * FRAME + np.arange(FRAME)
    level = (0.5, 0.05, 0.0)[n // 25 % 3] * (1 + c % 100 / 1000)
    return np.repeat(level * np.sin(2 * np.pi * 997 * t / RATE), 2)


def tones(spark, d) -> DataFrame:
    """(flow_id, first_sample, pcm), of which ``tone`` makes the samples."""
    return packets(spark, d).select("flow_id", (F.col("vseq") * FRAME).alias("first_sample"), F.array("vseq", "cents").alias("pcm"))


@query("a22_loudness")
def a22(spark, d):
    slots = stored(loudness.slot_energies(tones(spark, d), ["flow_id"], RATE, 2, bucket_s=2, decode=tone), "slots")
    found = loudness.programme_loudness(slots, ["flow_id"], RATE)
    return found.select("flow_id", *[F.round(c, 3).alias(c) for c in ("integrated", "loudness_range", "true_peak_db")])


def valued_slots(spark, d) -> DataFrame:
    energy = F.when(F.col("event_type") == "view", 0).otherwise((F.col("cents") % 1000) * (F.col("cents") % 1000)).cast("double")
    return packets(spark, d).select("flow_id", F.col("vseq").alias("slot"), energy.alias("energy"), (F.col("cents") % 997 / 997).alias("peak"))


_SLOTS = """sl AS (SELECT flow_id, vseq AS slot, CASE WHEN event_type = 'view' THEN 0 ELSE (cents % 1000) * (cents % 1000) END::DOUBLE AS energy, (cents % 997 / 997)::DOUBLE AS peak FROM p),
ms AS MATERIALIZED (SELECT *, (sum(energy) OVER (PARTITION BY flow_id ORDER BY slot ROWS 3 PRECEDING)) / 3200 AS m, (sum(energy) OVER (PARTITION BY flow_id ORDER BY slot ROWS 29 PRECEDING)) / 24000 AS s FROM sl)"""


@query("a22_momentary", "SELECT flow_id, slot, CASE WHEN m > 0 THEN round(-0.691 + 10 * log10(m), 6) END AS momentary, CASE WHEN s > 0 THEN round(-0.691 + 10 * log10(s), 6) END AS short_term FROM ms", _SLOTS)
def a22_momentary(spark, d):
    told = loudness.loudness_over_time(valued_slots(spark, d), ["flow_id"], RATE)
    return told.select("flow_id", "slot", F.round("momentary", 6).alias("momentary"), F.round("short_term", 6).alias("short_term"))


@query("a22_gating", """SELECT flow_id, round(-0.691 + 10 * log10(avg(m) FILTER (m >= mm / 10)), 6) AS integrated, coalesce(round(10 * log10(any_value(high) / any_value(low)), 6), 0) AS loudness_range, round(20 * log10(max(peak)), 6) AS true_peak_db
  FROM (SELECT flow_id, CASE WHEN slot >= 3 AND m >= pow(10, (-70 + 0.691) / 10) THEN m END AS m, peak FROM ms) JOIN x USING (flow_id) LEFT JOIN r USING (flow_id) GROUP BY flow_id""",
    _SLOTS + """, sh AS (SELECT flow_id, s FROM ms WHERE slot >= 29 AND slot % 10 = 9 AND s >= pow(10, (-70 + 0.691) / 10)),
x AS (SELECT flow_id, avg(m) FILTER (slot >= 3 AND m >= pow(10, (-70 + 0.691) / 10)) AS mm FROM ms GROUP BY flow_id),
g AS (SELECT flow_id, s, row_number() OVER (PARTITION BY flow_id ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY flow_id) AS n FROM sh JOIN (SELECT flow_id, avg(s) AS sm FROM sh GROUP BY flow_id) USING (flow_id) WHERE s >= sm / 100),
r AS (SELECT flow_id, max(s) FILTER (i = floor((n - 1) * 0.1 + 0.5)) AS low, max(s) FILTER (i = floor((n - 1) * 0.95 + 0.5)) AS high FROM g GROUP BY flow_id)""")  # fmt: skip
def a22_gating(spark, d):
    found = loudness.programme_loudness(valued_slots(spark, d), ["flow_id"], RATE)
    return found.select("flow_id", *[F.round(c, 6).alias(c) for c in ("integrated", "loudness_range", "true_peak_db")])


@query("h8_measured_silence", """SELECT flow_id, min(us) AS begin_us, min(CASE WHEN us - b >= 300000 THEN us END) AS alarm_us, max(us) AS until_us FROM (SELECT *, min(us) OVER (PARTITION BY flow_id, run) AS b FROM (
  SELECT *, sum((NOT o)::INT) OVER (PARTITION BY flow_id ORDER BY us) AS run FROM (SELECT flow_id, slot * 100000 AS us, coalesce(m > 0 AND -0.691 + 10 * log10(CASE WHEN m > 0 THEN m END) <= 18, false) AS o FROM ms)) WHERE o) GROUP BY flow_id, run HAVING max(us) - min(us) >= 300000""", _SLOTS)
def h8(spark, d):
    """The limit is set among the values of these slots; full scale isn't 1 here."""
    told = loudness.loudness_over_time(valued_slots(spark, d), ["flow_id"], RATE).withColumn("us", F.col("slot") * 100_000)
    return aggregates.held_for(told, ["flow_id"], "us", aggregates.silent(F.col("momentary"), F.lit(1 << 40), 18.0), 300_000)
