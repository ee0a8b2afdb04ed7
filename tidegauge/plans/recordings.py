"""Queries of recordings, capacity, and text output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as a
from ..sources import export, fragments, library
from .binding import packets, table
from .registry import query

#: Segments of 500 packets, one recording a flow.
SEGMENTS = "seg AS (SELECT flow_id AS recording_id, vseq // 500 AS segment_id, sum(bytes)::BIGINT AS bytes, min(vseq) * 3600 AS start_pts, max(vseq) * 3600 + 3600 AS end_pts FROM p GROUP BY ALL)"


def segments(spark, d):
    p = packets(spark, d).groupBy(F.col("flow_id").alias("recording_id"), F.expr("vseq div 500").alias("segment_id"))
    return p.agg(F.sum("bytes").alias("bytes"), (F.min("vseq") * 3600).alias("start_pts"), (F.max("vseq") * 3600 + 3600).alias("end_pts"))


@query("a16_recordings", """SELECT s.*, coalesce(clips, 0) AS clips FROM (SELECT recording_id, count(*) AS segments, sum(bytes)::BIGINT AS bytes, max(end_pts) - min(start_pts) AS span FROM seg GROUP BY 1) s
  LEFT JOIN (SELECT flow_id, count(*) AS clips FROM p WHERE event_type = 'signup' GROUP BY 1) c ON c.flow_id = s.recording_id""", SEGMENTS)
def a16(spark, d):
    return a.recordings(segments(spark, d), packets(spark, d).where("event_type = 'signup'").select(F.col("flow_id").alias("recording_id")))


@query("a17_bytes_in_range", """SELECT range_id, sum(greatest(CASE WHEN segment_id = last THEN 9000 ELSE bytes END - CASE WHEN segment_id = 0 THEN start ELSE 0 END, 0))::BIGINT AS bytes FROM seg
  JOIN (SELECT event_id AS range_id, flow_id, cents % 1000 AS start, event_id % 3 AS last FROM p WHERE event_type = 'signup') r ON r.flow_id = recording_id AND segment_id BETWEEN 0 AND last GROUP BY range_id""", SEGMENTS)
def a17(spark, d):
    names = {"range_id": F.col("event_id"), "recording_id": F.col("flow_id"), "from_segment": F.lit(0), "from_offset": F.col("cents") % 1000, "to_segment": F.col("event_id") % 3, "to_offset": F.lit(9000)}
    return a.bytes_in_range(segments(spark, d), packets(spark, d).where("event_type = 'signup'").select(*[c.alias(n) for n, c in names.items()]))


@query("a19_capacity_totals", "SELECT c_nationkey, sum(c_custkey % 50)::BIGINT AS cost_units, sum(c_custkey % 4)::BIGINT AS hw_sessions FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1")
def a19(spark, d):
    flows = table(spark, d, "customer").withColumns({"running": F.expr("c_custkey % 3 != 0"), "cost_units": F.expr("c_custkey % 50"), "hw_sessions": F.expr("c_custkey % 4")})
    return a.capacity_totals(flows, ["c_nationkey"])


ROUNDS = """r AS (SELECT flow_id AS leg_id, vseq // 100 AS round, (vseq // 100 + 1) * 1000000 AS rate, count(*) AS sent, count_if(cents % 100 >= vseq // 100) AS acked, min(cents) AS rtt_us FROM p GROUP BY ALL),
  f AS (SELECT leg_id, min(round) FILTER ((sent - acked) / sent > 0.05) AS failed_round, min(rtt_us) AS min_rtt_us FROM r GROUP BY 1)"""


@query("a20_leg_probe", "SELECT f.*, coalesce(max(rate) FILTER (failed_round IS NULL OR round < failed_round), 0) AS capacity FROM f JOIN r USING (leg_id) GROUP BY ALL", ROUNDS)
def a20(spark, d):
    step = F.expr("vseq div 100")
    rounds = packets(spark, d).groupBy(F.col("flow_id").alias("leg_id"), step.alias("round"), ((step + 1) * 1_000_000).alias("rate"))
    return a.leg_probe(rounds.agg(F.count(F.lit(1)).alias("sent"), F.count_if(F.col("cents") % 100 >= step).alias("acked"), F.min("cents").alias("rtt_us")))


@query("a27_flow_cost", f"SELECT p_partkey AS flow_id, {a.COST_BASE} + " + " + ".join(f"p_partkey % {i + 2} * {w}" for i, w in enumerate(a.COST.values())) + " AS cost FROM part")
def a27(spark, d):
    flows = table(spark, d, "part").select(F.col("p_partkey").alias("flow_id"), *[(F.col("p_partkey") % (i + 2)).alias(n) for i, n in enumerate(a.COST)])
    return flows.select("flow_id", a.flow_cost().alias("cost"))


@query("k6_live_playlist", r"""SELECT recording_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:' || ceil(max(ms) / 1000)::BIGINT || chr(10) || '#EXT-X-MEDIA-SEQUENCE:' || min(segment_id) || chr(10)
  || string_agg(format('#EXTINF:{:.3f},', ms / 1000) || chr(10) || format('seg-{:05d}.m4s', segment_id), chr(10) ORDER BY segment_id) || chr(10) AS playlist
  FROM (SELECT *, (end_pts - start_pts) // 90 AS ms, row_number() OVER (PARTITION BY recording_id ORDER BY segment_id DESC) AS n FROM seg) WHERE n <= 6 GROUP BY 1""", SEGMENTS)
def k6(spark, d):
    return export.live_playlist(segments(spark, d).withColumn("duration_ms", F.expr("(end_pts - start_pts) div 90")), "recording_id")


@query("k16_metric_lines", """SELECT 'flow_packets_total{flow_id="' || flow_id || '"} ' || count(*) AS line FROM p GROUP BY flow_id UNION ALL SELECT 'flow_bytes_total{flow_id="' || flow_id || '"} ' || sum(bytes) FROM p GROUP BY flow_id""")
def k16(spark, d):
    stats = packets(spark, d).groupBy("flow_id").agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"))
    return export.metric_lines(stats, ["flow_id"], {"packets": "flow_packets_total", "bytes": "flow_bytes_total"})


@query("k18_json_lines", """SELECT '{"event_id":' || event_id || ',"flow_id":' || flow_id || ',"event_type":"' || event_type || '"}' AS line FROM p WHERE event_type = 'error'""")
def k18(spark, d):
    return export.json_lines(packets(spark, d).where("event_type = 'error'"), "event_id", "flow_id", "event_type")


@query("k19_event_channel", """SELECT flow_id, event_id, sent, dropped FROM r""", """m AS MATERIALIZED (SELECT flow_id, event_id, recv_us, row_number() OVER (PARTITION BY flow_id ORDER BY recv_us, event_id) AS n FROM p),
r AS (SELECT flow_id, n, event_id, recv_us, true AS sent, 1000000::BIGINT AS held, 0::BIGINT AS dropped FROM m WHERE n = 1 UNION ALL
  SELECT flow_id, n, event_id, recv_us, left_ + 1000000 <= 8000000, left_ + CASE WHEN left_ + 1000000 <= 8000000 THEN 1000000 ELSE 0 END, dropped + (left_ + 1000000 > 8000000)::INT
  FROM (SELECT m.*, r.dropped, greatest(r.held - (m.recv_us - r.recv_us) * 20, 0) AS left_ FROM r JOIN m ON m.flow_id = r.flow_id AND m.n = r.n + 1))""")
def k19(spark, d):
    return export.bounded_channel(packets(spark, d), "flow_id", "recv_us", 8, 20)


def configs(spark, d):
    """A configuration as JSON text for each flow, whose pids are its inputs."""
    pids = packets(spark, d).groupBy("flow_id", "pid", "kind").agg(F.count_if("has_payload").alias("n"))
    one = F.struct(F.col("pid").cast("string").alias("id"), F.concat(F.lit("in-"), "kind").alias("name"), F.col("kind").alias("type"))
    own = pids.groupBy("flow_id").agg(F.array_sort(F.collect_list(one)).alias("inputs"), F.sum("n").alias("n"))
    flow = F.struct(F.col("flow_id").cast("string").alias("id"), F.concat(F.lit("flow "), "flow_id").alias("name"), (F.col("n") % 2 == 0).alias("enabled"), F.transform("inputs", lambda x: x["id"]).alias("input_ids"))
    text = F.to_json(F.struct(F.array(flow).alias("flows"), "inputs", F.lit("passed over").alias("comment")))
    return own.select(F.col("flow_id").cast("string").alias("node"), library.parse_config(text).alias("config"))


@query("t2_flows", """SELECT flow_id::VARCHAR AS node, flow_id::VARCHAR AS id, 'flow ' || flow_id AS name, count_if(has_payload) % 2 = 0 AS enabled, count(DISTINCT pid) AS inputs FROM p GROUP BY flow_id""")
def t2(spark, d):
    return library.dimension(configs(spark, d), "flows").select("node", "id", "name", "enabled", F.size("input_ids").cast("long").alias("inputs"))


@query("t6_inputs", """SELECT DISTINCT flow_id::VARCHAR AS node, pid::VARCHAR AS id, 'in-' || kind AS name, kind AS type FROM p WHERE pid = 257""")
def t6(spark, d):
    return library.dimension(configs(spark, d), "inputs", "257")


@query("s19_media_library")
def s19(spark, d):
    return library.library_use(library.media_files(spark, d))


@query("k6_media_segments", """SELECT flow_id, segment_id, count(*) AS samples, (min(vseq) * 3600)::BIGINT AS first_dts, (count(*) * 3600)::BIGINT AS duration, (24 + 8 + 16 + 8 + 16 + 20 + 20 + 16 * count(*) + 8 + sum(bytes // 188))::INTEGER AS size
  FROM (SELECT *, vseq // 50 AS segment_id FROM p) GROUP BY flow_id, segment_id""")
def k6_segments(spark, d):
    p = packets(spark, d).withColumns({"segment_id": F.expr("vseq div 50"), "dts": F.col("vseq") * 3600, "duration": F.lit(3600).cast("long"), "offset": F.lit(0).cast("long"), "key": F.col("vseq") % 50 == 0})
    made = fragments.media_segments(p.withColumn("data", F.encode(F.repeat(F.lit("x"), F.expr("int(bytes div 188)")), "utf-8")), ["flow_id"])
    return made.select("flow_id", "segment_id", "samples", "first_dts", "duration", F.length("data").alias("size"))
