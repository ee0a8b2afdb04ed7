"""Queries whose windows and machines are cut into buckets of time, so that one flow spreads over many tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..operators import joins, scan
from .binding import packets
from .registry import query

#: Packets a bucket; small here, so that the smallest tables have several.
BUCKET = 64


def _bucket():
    return F.floor(F.col("vseq") / BUCKET)


@query("w9_split_discontinuity", "SELECT event_id, CASE WHEN s < 0 OR s > 2700000 THEN true ELSE false END AS jump FROM (SELECT event_id, pcr27 - lag(pcr27) OVER (PARTITION BY flow_id ORDER BY vseq) AS s FROM p)")
def w9(spark, d):
    rows = scan.lagged(packets(spark, d), ["flow_id"], ["vseq"], ["pcr27"], _bucket())
    step = F.col("pcr27") - F.col("before.pcr27")
    return rows.select("event_id", F.coalesce((step < 0) | (step > 2_700_000), F.lit(False)).alias("jump"))


@query("q8_split_loss", """SELECT flow_id, leg, count(*) AS packets, coalesce(sum(CASE WHEN gap BETWEEN 1 AND 999 THEN gap END), 0)::BIGINT AS lost FROM (
  SELECT *, (seq - lag(seq) OVER (PARTITION BY flow_id, leg ORDER BY recv_leg_us, event_id) - 1 + 65536) % 65536 AS gap FROM legs) GROUP BY flow_id, leg""")
def q8(spark, d):
    from .binding import legs

    rows = scan.lagged(legs(spark, d), ["flow_id", "leg"], ["recv_leg_us", "event_id"], ["seq"], F.floor(F.col("recv_leg_us") / (40_000 * BUCKET)))
    gap = F.pmod(F.col("seq") - F.col("before.seq") - 1, F.lit(65536))
    return rows.withColumn("gap", gap).groupBy("flow_id", "leg").agg(F.count(F.lit(1)).alias("packets"), F.coalesce(F.sum(F.when(F.col("gap").between(1, 999), F.col("gap"))), F.lit(0)).cast("long").alias("lost"))


@query("j10_split_counter", "SELECT event_id, (sum(has_payload::INT) OVER (PARTITION BY flow_id, pid ORDER BY vseq) % 16)::BIGINT AS out_cc FROM p")
def j10(spark, d):
    rows = scan.running_sum(packets(spark, d), ["flow_id", "pid"], ["vseq"], F.col("has_payload").cast("long"), "sent", _bucket())
    return rows.select("event_id", (F.col("sent") % 16).alias("out_cc"))


@query("w5_split_interleave", "SELECT flow_id, vseq, round(v, 3) AS ewma FROM r", """o AS (SELECT flow_id, vseq, kind, pts90, CASE kind WHEN 'audio' THEN last_value(CASE WHEN kind = 'video' THEN pts90 END IGNORE NULLS) OVER w WHEN 'video' THEN last_value(CASE WHEN kind = 'audio' THEN pts90 END IGNORE NULLS) OVER w END AS other
  FROM p WINDOW w AS (PARTITION BY flow_id ORDER BY vseq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS MATERIALIZED (SELECT flow_id, vseq, row_number() OVER (PARTITION BY flow_id ORDER BY vseq) AS n, trunc(((CASE kind WHEN 'audio' THEN pts90 - other ELSE other - pts90 END + 12884901888) % 8589934592 - 4294967296) / 90.0)::DOUBLE AS x FROM o WHERE other IS NOT NULL),
r AS (SELECT flow_id, vseq, n, x AS v FROM m WHERE n = 1 UNION ALL SELECT m.flow_id, m.vseq, m.n, r.v * (1 - 1 / 256::DOUBLE) + m.x * (1 / 256::DOUBLE) FROM r JOIN m ON m.flow_id = r.flow_id AND m.n = r.n + 1)""")
def w5(spark, d):
    """Audio against video, from the pairs of L5."""
    pairs = joins.av_pairs(packets(spark, d))
    audio, video = (F.when(F.col("kind") == kind, F.col("pts90")).otherwise(F.col("other_pts")) for kind in ("audio", "video"))
    apart = pairs.withColumn("ms", clock.pts_delta_ms(audio, video))
    return scan.split_ewma(apart, ["flow_id"], "vseq", "ms", 1 / 256, _bucket()).withColumn("ewma", F.round("ewma", 3))
