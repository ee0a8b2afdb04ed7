"""Timers and snapshots of streams against their batch results, over a restart."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from tidegauge.plans.binding import packets
from tidegauge.streaming import live, timed

LIMIT = 300_000


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def with_times(df):
    return df.withColumn("at", F.timestamp_micros("recv_us"))


def run(spark, folder, schema, out, checkpoint, operator):
    stream = operator(spark.readStream.schema(schema).parquet(folder))
    timed.write_snapshots(stream, out, None).option("checkpointLocation", checkpoint).start().awaitTermination()


def lines(spark, out):
    return [json.loads(r["value"]) for r in spark.read.text(out).collect()]


def test_silences_over_a_restart(rocks, sf_dir):
    """Two runs over one checkpoint, cut in the middle of every flow, give what one table gives."""
    spark = rocks
    rows = with_times(packets(spark, sf_dir).where("event_type <> 'view'").withColumn("flow_id", F.col("flow_id") * 100 + F.col("pid")).select("flow_id", "recv_us"))
    half = rows.selectExpr("percentile(recv_us, 0.5)").first()[0]
    folder, out, checkpoint = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    end = rows.agg(F.max("recv_us")).first()[0] + 60_000_000
    late = with_times(spark.createDataFrame([(-1, end)], "flow_id long, recv_us long"))
    watch = lambda s: timed.watch_silences(s, ["flow_id"], "recv_us", LIMIT)
    for part in (rows.where(F.col("recv_us") <= half), rows.where(F.col("recv_us") > half), late, late.withColumn("flow_id", F.lit(-2).cast("long"))):
        part.coalesce(1).write.mode("append").parquet(folder)
        run(spark, folder, rows.schema, out, checkpoint, watch)
    got = sorted((r["flow_id"], r["at_us"], r["change"]) for r in lines(spark, out))
    want = sorted((r["flow_id"], r["at_us"], r["change"]) for r in timed.silences(rows, ["flow_id"], "recv_us", LIMIT, F.lit(end)).collect())
    assert got == want and {c for _, _, c in got} == {"silent", "resumed"}


def test_a_key_is_forgotten(rocks):
    spark = rocks
    folder, out, checkpoint = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    watch = lambda s: timed.watch_silences(s, ["flow_id"], "recv_us", LIMIT, "1 second", forget_us=5_000_000)
    rows = [[(1, 0), (1, 100_000)], [(2, 20_000_000)], [(2, 20_100_000)], [(1, 30_000_000), (1, 30_100_000)]]
    for part in rows:
        df = with_times(spark.createDataFrame(part, "flow_id long, recv_us long"))
        df.coalesce(1).write.mode("append").parquet(folder)
        run(spark, folder, df.schema, out, checkpoint, watch)
    got = [(r["flow_id"], r["change"], r["at_us"]) for r in lines(spark, out)]
    assert (1, "silent", 400_000) in got and (1, "resumed", 30_000_000) not in got


def test_snapshots_of_windows(spark, sf_dir):
    """Each batch has a folder, which a second run of it replaces."""
    rows = with_times(packets(spark, sf_dir).select("flow_id", "bytes", "recv_us"))
    folder, out, checkpoint = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    rows.coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, rows.schema, out, checkpoint, live.throughput)
    once = sorted(map(str, lines(spark, out)))
    second = tempfile.mkdtemp(prefix="spark-")
    run(spark, folder, rows.schema, out, second, live.throughput)
    assert once and sorted(map(str, lines(spark, out))) == once
