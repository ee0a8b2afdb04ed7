"""Streaming forms against their batch results, over files read as a stream."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tidegauge.plans.binding import legs, packets
from tidegauge.operators import alarms, timers
from tidegauge.operators.fold import ordered_fold
from tidegauge.streaming import live, machines


def streamed(spark, rows, operator):
    """All rows that ``operator`` gives for the stream; a last row far ahead moves the watermark."""
    path, name = tempfile.mkdtemp(prefix="spark-"), f"out_{abs(hash(operator))}"
    rows.coalesce(1).write.mode("append").parquet(path)
    out = operator(spark.readStream.schema(rows.schema).parquet(path))
    query = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).start()
    query.awaitTermination()
    return spark.table(name)


@pytest.fixture(scope="module")
def timed(spark, sf_dir):
    return packets(spark, sf_dir).withColumn("at", F.timestamp_micros("recv_us")).select("flow_id", "vseq", "bytes", "at")


def test_throughput(spark, timed):
    got = {tuple(r) for r in streamed(spark, timed, live.throughput).collect()}
    second = F.date_trunc("second", "at")
    want = {tuple(r) for r in timed.groupBy("flow_id", second.alias("from")).agg(F.count(F.lit(1)), F.sum("bytes") * 8).collect()}
    last = max(r[1] for r in want)
    # windows that the watermark has passed are out, and none is wrong
    assert got <= want and {r for r in want if (last - r[1]).total_seconds() > 4} <= got


def test_first_arrivals(spark, sf_dir):
    rows = legs(spark, sf_dir).withColumn("at", F.timestamp_micros("recv_leg_us")).select("flow_id", "vseq", "at")
    got = streamed(spark, rows, live.first_arrivals)
    assert got.count() == got.select("flow_id", "vseq").distinct().count() == rows.select("flow_id", "vseq").distinct().count()


def test_two_legs(spark, sf_dir):
    rows = legs(spark, sf_dir).withColumn("at", F.timestamp_micros("recv_leg_us")).select("flow_id", "vseq", "leg", "at")
    got = {tuple(r) for r in streamed(spark, rows, lambda s: live.two_legs(s.where("leg = 0"), s.where("leg = 1"))).collect()}
    a, b = (rows.where(F.col("leg") == i).select("flow_id", "vseq", F.col("at").alias(n)) for i, n in enumerate(("a_at", "b_at")))
    want = {tuple(r) for r in a.join(b, ["flow_id", "vseq"], "full_outer").select("flow_id", "vseq", "a_at", "b_at").collect()}
    # every pair is out, and of those without a partner only such as the watermark has passed
    assert got <= want and {r for r in want if r[2] and r[3]} <= got


@pytest.mark.parametrize("start,step,schema", [
    (lambda: alarms.Escalation(2000, 6000, 2), lambda s, r: [(r.flow_id, r.vseq, s.add(r.cents))], "flow_id long, vseq long, state int"),
    (timers.DrainRate, lambda s, r: [(r.flow_id, r.vseq, s.measure(r.pcr27, r.bytes))], "flow_id long, vseq long, rate long"),
])
def test_machines_keep_their_state_between_batches(spark, sf_dir, start, step, schema):
    rows = packets(spark, sf_dir).select("flow_id", "vseq", "cents", "pcr27", "bytes")
    path, name = tempfile.mkdtemp(prefix="spark-"), "machine_" + schema.split()[-2]
    for part in ("vseq < 20", "vseq between 20 and 45", "vseq > 45"):
        rows.where(part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = machines.stream_fold(stream, ["flow_id"], ["vseq"], start, step, schema)
    out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).start().awaitTermination()
    want = ordered_fold(rows, ["flow_id"], ["vseq"], start, step, schema)
    got = sorted(map(tuple, spark.table(name).collect()))
    assert got and got == sorted(map(tuple, want.collect()))
