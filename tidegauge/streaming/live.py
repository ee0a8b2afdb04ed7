"""Streaming forms of the operators: event time, watermarks, and state that the watermark clears.

Streams have the columns of packets, and ``at``, the time of arrival as a timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def throughput(stream: DataFrame, late: str = "2 seconds", size: str = "1 second", *keys: str) -> DataFrame:
    """Bits a second in tumbling windows; a window is out once the watermark has passed it."""
    keys = keys or ("flow_id",)
    by_window = stream.withWatermark("at", late).groupBy(*keys, F.window("at", size).alias("w"))
    return by_window.agg(F.count(F.lit(1)).alias("packets"), (F.sum("bytes") * 8).alias("bits")).select(*keys, F.col("w.start").alias("from"), "packets", "bits")


def first_arrivals(stream: DataFrame, late: str = "2 seconds") -> DataFrame:
    """Q1 for clean numbering: the copy of a packet that comes first; copies further apart than
    ``late`` count as new. State is one entry for each number still within the watermark."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["flow_id", "vseq"])


def two_legs(one: DataFrame, two: DataFrame, apart: str = "2 seconds") -> DataFrame:
    """L3: both copies of a packet side by side if they come within ``apart`` of each other, and
    those without a partner once the watermark shows that none can come."""
    a = one.withWatermark("at", apart).select(F.col("flow_id").alias("a_flow"), F.col("vseq").alias("a_vseq"), F.col("at").alias("a_at"))
    b = two.withWatermark("at", apart).select(F.col("flow_id").alias("b_flow"), F.col("vseq").alias("b_vseq"), F.col("at").alias("b_at"))
    near = f"a_flow = b_flow AND a_vseq = b_vseq AND b_at BETWEEN a_at - INTERVAL {apart} AND a_at + INTERVAL {apart}"
    out = a.join(b, F.expr(near), "full_outer")
    return out.select(F.coalesce("a_flow", "b_flow").alias("flow_id"), F.coalesce("a_vseq", "b_vseq").alias("vseq"), "a_at", "b_at")
