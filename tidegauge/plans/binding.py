"""Packet tables derived from the events table, as no captures are at hand.

Every event becomes one packet of its flow (eight users share one, so flows grow with the users), 25
a second each, in arrival order. ``CTES``
is the same in SQL: e (events), p (packets), legs (their copies on two paths)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.clock import PCR_WRAP, PTS_WRAP


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, flow_id, pid, cents, vseq, seq, recv_us, bytes, pcr27, rtp_ts,
    pts90, kind, has_payload, cc."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    e = e.withColumns({"flow_id": F.expr("user_id div 8"), "pid": 256 + F.col("user_id") % 16})
    by_flow = Window.partitionBy("flow_id").orderBy("event_id")
    p = e.withColumn("vseq", F.row_number().over(by_flow).cast("long") - 1)
    jump = F.when((F.col("event_type") == "error") & (F.col("cents") % 5 == 0), 5_400_000).otherwise(0)
    p = p.withColumns({
        "seq": F.col("vseq") % 65536,
        "recv_us": F.col("vseq") * 40000 + F.col("cents") % 5000,
        "bytes": 188 * (1 + F.col("cents") % 7),
        "pcr27": (F.col("vseq") * 1_080_000 + jump) % PCR_WRAP,
        "rtp_ts": (F.col("vseq") * 3600) % (1 << 32),
        "pts90": (F.col("vseq") * 3600 + F.col("cents") % 90 * 10) % PTS_WRAP,
        "kind": F.when(F.col("pid") % 3 == 0, "audio").when(F.col("pid") % 3 == 1, "video").otherwise("data"),
        "has_payload": F.col("event_type") != "view",
    })
    sent = F.sum(F.col("has_payload").cast("long")).over(Window.partitionBy("flow_id", "pid").orderBy("vseq"))
    return p.withColumn("cc", (sent + (F.col("event_id") % 101 == 0).cast("long")) % 16)


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets as two paths deliver them: leg 0 or 1, recv_leg_us."""
    p = packets(spark, sf_dir).withColumn("leg", F.explode(F.array(F.lit(0), F.lit(1))))
    lost = ((F.col("leg") == 0) & (F.col("event_type") == "error")) | ((F.col("leg") == 1) & (F.col("event_id") % 7 == 0))
    return p.where(~lost).withColumn("recv_leg_us", F.col("recv_us") + F.col("leg") * (F.col("cents") % 30000))


CTES = """
e AS (SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, user_id // 8 AS flow_id, 256 + user_id % 16 AS pid FROM events),
p0 AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY event_id) - 1 AS vseq FROM e),
p1 AS (SELECT *, vseq % 65536 AS seq, vseq * 40000 + cents % 5000 AS recv_us, 188 * (1 + cents % 7) AS bytes,
    (vseq * 1080000 + CASE WHEN event_type = 'error' AND cents % 5 = 0 THEN 5400000 ELSE 0 END) % 2576980377600 AS pcr27,
    (vseq * 3600) % 4294967296 AS rtp_ts, (vseq * 3600 + cents % 90 * 10) % 8589934592 AS pts90,
    CASE WHEN pid % 3 = 0 THEN 'audio' WHEN pid % 3 = 1 THEN 'video' ELSE 'data' END AS kind, event_type <> 'view' AS has_payload FROM p0),
p AS (SELECT *, CAST((sum(has_payload::INT) OVER (PARTITION BY flow_id, pid ORDER BY vseq) + (event_id % 101 = 0)::INT) % 16 AS BIGINT) AS cc FROM p1),
legs AS (SELECT p.*, leg, recv_us + leg * (cents % 30000) AS recv_leg_us FROM p, (VALUES (0), (1)) l(leg)
    WHERE NOT (leg = 0 AND event_type = 'error') AND NOT (leg = 1 AND event_id % 7 = 0))
"""
