"""Queries of filters, rewriting, joins, grouped statistics, windows and clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..operators import aggregates as a
from ..operators import filters, joins, rewrite, windows
from .binding import PCR_WRAP, legs, packets, table
from .health import TILES, tiles
from .registry import query

# Filters


@query("f1_source_filter", "SELECT flow_id, count_if(user_id % 3 <> 0) AS passed, count_if(user_id % 3 = 0) AS filtered FROM p GROUP BY flow_id")
def f1(spark, d):
    p = packets(spark, d)
    return filters.filtered_counts(p, p.where("user_id % 3 != 0").select("user_id"), "user_id")


@query("f4_payload_types", "SELECT event_id FROM p WHERE cents % 128 IN (33, 96)")
def f4(spark, d):
    return filters.allow_payload_types(packets(spark, d), F.col("cents") % 128, [33, 96]).select("event_id")


@query("f5_rate_limit", """SELECT flow_id, event_id, passed FROM r""", """m AS MATERIALIZED (SELECT flow_id, vseq, event_id, recv_us, bytes * 8 AS bits FROM p),
r AS (SELECT flow_id, vseq, event_id, recv_us, 5000::DOUBLE - CASE WHEN bits <= 5000 THEN bits ELSE 0 END AS tokens, bits <= 5000 AS passed FROM m WHERE vseq = 0 UNION ALL
  SELECT flow_id, vseq, event_id, recv_us, t - CASE WHEN t >= bits THEN bits ELSE 0 END, t >= bits
  FROM (SELECT m.*, least(5000::DOUBLE, r.tokens + (m.recv_us - r.recv_us) * 500000 / 1000000::DOUBLE) AS t FROM r JOIN m ON m.flow_id = r.flow_id AND m.vseq = r.vseq + 1))""")
def f5(spark, d):
    return filters.rate_limit(packets(spark, d), 500_000)


@query("f6_block_gate", """SELECT flow_id, count(*) AS received, count_if(EXISTS (SELECT 1 FROM p b WHERE b.event_type = 'error' AND b.flow_id = p.flow_id AND p.recv_us >= b.recv_us AND p.recv_us < b.recv_us + 100000)) AS blocked FROM p GROUP BY flow_id""")
def f6(spark, d):
    p = packets(spark, d)
    blocks = p.where("event_type = 'error'").select("flow_id", F.col("recv_us").alias("from_us"), (F.col("recv_us") + 100_000).alias("to_us"))
    return filters.block_gate(p, blocks)


@query("f7_program_filter", "SELECT event_id FROM p WHERE pid IN (SELECT r.pid FROM p r WHERE r.flow_id = p.flow_id AND r.kind <> 'data')")
def f7(spark, d):
    p = packets(spark, d)
    return joins.semi_pids(p, p.where("kind != 'data'")).select("event_id")


@query("f8_continuity_cells", "SELECT event_id FROM p WHERE has_payload AND pid <> 8191")
def f8(spark, d):
    return packets(spark, d).where(filters.counts_for_continuity(F.col("pid"), F.col("has_payload"))).select("event_id")


@query("f11_plausible_drift", "SELECT flow_id, event_id, step FROM (SELECT *, abs(pcr27 - lag(pcr27) OVER (PARTITION BY flow_id ORDER BY vseq)) AS step FROM p) WHERE step <= 2000000")
def f11(spark, d):
    return filters.plausible_drift(packets(spark, d), ["flow_id"], "vseq", "pcr27", 2_000_000).select("flow_id", "event_id", "step")


@query("f12_event_rate_limit", """SELECT flow_id, event_id FROM r WHERE passed""", """m AS MATERIALIZED (SELECT flow_id, event_id, recv_us, row_number() OVER (PARTITION BY flow_id ORDER BY recv_us, event_id) AS n FROM p WHERE event_type = 'error'),
r AS (SELECT flow_id, n, event_id, recv_us AS last, true AS passed FROM m WHERE n = 1 UNION ALL
  SELECT m.flow_id, m.n, m.event_id, CASE WHEN m.recv_us - r.last < 30000000 THEN r.last ELSE m.recv_us END, m.recv_us - r.last >= 30000000 FROM r JOIN m ON m.flow_id = r.flow_id AND m.n = r.n + 1)""")
def f12(spark, d):
    return filters.event_rate_limit(packets(spark, d).where("event_type = 'error'"), 30_000_000)


@query("f13_active_input", """SELECT flow_id, event_id, leg FROM (SELECT l.*, coalesce((SELECT arg_max((s.event_type = 'error')::INT, s.event_id) FROM p s WHERE s.event_type IN ('error', 'signup') AND s.flow_id = l.flow_id AND s.recv_us <= l.recv_leg_us), 0) AS active FROM legs l) WHERE leg = active""")
def f13(spark, d):
    switches = packets(spark, d).where("event_type IN ('error', 'signup')").select("flow_id", F.col("recv_us").alias("at_us"), (F.col("event_type") == "error").cast("int").alias("active"))
    return filters.active_input(legs(spark, d), switches)


# Rewriting


@query("j3_pid_remap", "SELECT event_id, CASE pid WHEN 256 THEN 4097 WHEN 259 THEN 4098 ELSE pid END AS pid FROM p")
def j3(spark, d):
    return rewrite.remap_pids(packets(spark, d), {256: 4097, 259: 4098}).select("event_id", "pid")


@query("j5_ingress_chain", "SELECT event_id, CASE pid WHEN 256 THEN 300 ELSE pid END AS pid, (pts90 + 8589900000) % 8589934592 AS pts90 FROM p WHERE pid IN (256, 257)")
def j5(spark, d):
    return rewrite.ingress_chain(packets(spark, d), [256, 257], {256: 300}, 8_589_900_000).select("event_id", "pid", "pts90")


def jumping(p):
    """Clock references that go on two seconds at once, twice, and then four back, every forty rows."""
    return p.withColumn("pcr27", (F.col("pcr27") + F.expr("vseq div 40 % 3 * 54000000L")) % clock.PCR_WRAP)


@query("j6_pcr_anchor", """SELECT flow_id, vseq, out_pcr, jumped FROM r""", """m AS MATERIALIZED (SELECT flow_id, vseq, event_id, recv_us, pts90, kind, (pcr27 + vseq // 40 % 3 * 54000000) % 2576980377600 AS pcr FROM p),
r AS (SELECT flow_id, vseq, pcr AS src, recv_us AS wall, pcr AS out_pcr, false AS jumped FROM m WHERE vseq = 0 UNION ALL
  SELECT flow_id, vseq, pcr, recv_us, (o + CASE WHEN abs(step) > 13500000 AND (step < 0 OR step - seen > 13500000) THEN least(seen, 1080000) ELSE step END + 2576980377600) % 2576980377600, abs(step) > 13500000
  FROM (SELECT m.flow_id, m.vseq, m.pcr, m.recv_us, r.out_pcr AS o, (m.pcr - r.src + 2576980377600 + 1288490188800) % 2576980377600 - 1288490188800 AS step, greatest(m.recv_us - r.wall, 0) * 27 AS seen FROM r JOIN m ON m.flow_id = r.flow_id AND m.vseq = r.vseq + 1))""")
def j6(spark, d):
    return rewrite.reanchor_pcr(jumping(packets(spark, d)), ["flow_id"])


@query("j7_pts_anchor", """SELECT flow_id, vseq, kind, (pts90 + floor((out_pcr - pcr) / 300::DOUBLE)::BIGINT + CASE WHEN kind = 'audio' THEN 900 ELSE 0 END + 17179869184) % 8589934592 AS out_pts FROM r JOIN m USING (flow_id, vseq)""", """m AS MATERIALIZED (SELECT flow_id, vseq, event_id, recv_us, pts90, kind, (pcr27 + vseq // 40 % 3 * 54000000) % 2576980377600 AS pcr FROM p),
r AS (SELECT flow_id, vseq, pcr AS src, recv_us AS wall, pcr AS out_pcr, false AS jumped FROM m WHERE vseq = 0 UNION ALL
  SELECT flow_id, vseq, pcr, recv_us, (o + CASE WHEN abs(step) > 13500000 AND (step < 0 OR step - seen > 13500000) THEN least(seen, 1080000) ELSE step END + 2576980377600) % 2576980377600, abs(step) > 13500000
  FROM (SELECT m.flow_id, m.vseq, m.pcr, m.recv_us, r.out_pcr AS o, (m.pcr - r.src + 2576980377600 + 1288490188800) % 2576980377600 - 1288490188800 AS step, greatest(m.recv_us - r.wall, 0) * 27 AS seen FROM r JOIN m ON m.flow_id = r.flow_id AND m.vseq = r.vseq + 1))""")
def j7(spark, d):
    p = jumping(packets(spark, d))
    anchors = rewrite.reanchor_pcr(p, ["flow_id"]).join(p.select("flow_id", "vseq", "pcr27"), ["flow_id", "vseq"])
    return rewrite.reanchor_pts(p, anchors, 900)


@query("j8_repetition_padding", "SELECT pid, flow_id, b + i * 500000 AS recv_us FROM (SELECT *, lag(recv_us) OVER (PARTITION BY flow_id, pid ORDER BY recv_us) AS b FROM p), range(1, 1000) r(i) WHERE i <= (recv_us - b - 1) // 500000")
def j8(spark, d):
    return rewrite.repetition_padding(packets(spark, d), ["flow_id", "pid"], "recv_us", 500_000)


@query("j9_continuity_fix", "SELECT event_id, (sum(has_payload::INT) OVER (PARTITION BY flow_id, vseq // 500, pid ORDER BY vseq) % 16)::BIGINT AS out_cc FROM p")
def j9(spark, d):
    return rewrite.fix_continuity(packets(spark, d).withColumn("epoch", F.expr("vseq div 500")), "epoch", "vseq").select("event_id", "out_cc")


@query("j12_bundle", "SELECT flow_id, vseq // 7 AS datagram, count(*) AS cells, min(vseq) AS first, max(vseq) AS last FROM p GROUP BY ALL")
def j12(spark, d):
    return rewrite.bundle(packets(spark, d), ["flow_id"], "vseq")


@query("j13_null_padding", """SELECT flow_id, event_id, nulls FROM r""", """m AS MATERIALIZED (SELECT flow_id, vseq, event_id, recv_us, bytes FROM p),
r AS (SELECT flow_id, vseq, event_id, recv_us AS first, bytes AS sent, 0::BIGINT AS nulls FROM m WHERE vseq = 0 UNION ALL
  SELECT flow_id, vseq, event_id, first, sent + 188 * n, n
  FROM (SELECT m.flow_id, m.vseq, m.event_id, r.first, r.sent + m.bytes AS sent, least(greatest((300000 * (m.recv_us - r.first) // 8000000 - r.sent - m.bytes) // 188, 0), 350)::BIGINT AS n FROM r JOIN m ON m.flow_id = r.flow_id AND m.vseq = r.vseq + 1))""")
def j13(spark, d):
    return rewrite.pad_to_rate(packets(spark, d), 300_000)


@query("j14_realign")
def j14(spark, d):
    p = packets(spark, d)
    return rewrite.realign(p.withColumn("pts90", F.col("pts90") + F.when(F.col("kind") == "audio", 90 * (F.col("cents") % 700)).otherwise(0)))


# Joins


def flows(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("flow_id")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("ids"))


@query("l1_resolve", """SELECT o_custkey AS flow_id, 'input' AS role, o_orderpriority AS id, CASE WHEN o_orderpriority < '4' THEN lower(o_orderpriority) END AS name, o_orderpriority >= '4' AS missing FROM orders GROUP BY ALL
  UNION ALL SELECT o_custkey, 'output', o_orderpriority, lower(o_orderpriority), false FROM orders GROUP BY ALL""")
def l1(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderpriority").alias("id"), F.lower("o_orderpriority").alias("name")).distinct()
    f = flows(spark, d).select("flow_id", F.col("ids").alias("input_ids"), F.col("ids").alias("output_ids"))
    return joins.resolve(f, ids.where("id < '4'"), ids)


@query("l2_snapshots", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON c_custkey = o_custkey")
def l2(spark, d):
    live = table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return joins.with_snapshots(table(spark, d, "customer").select("c_custkey"), live, "c_custkey", ["n"])


@query("l3_two_leg", """SELECT coalesce(a.flow_id, b.flow_id) AS flow_id, coalesce(a.vseq, b.vseq) AS vseq, a.recv_leg_us AS t0, b.recv_leg_us AS t1 FROM (SELECT * FROM legs WHERE leg = 0) a FULL JOIN (SELECT * FROM legs WHERE leg = 1) b
  ON a.flow_id = b.flow_id AND a.vseq = b.vseq AND abs(a.recv_leg_us - b.recv_leg_us) <= 15000""")
def l3(spark, d):
    return joins.two_leg(legs(spark, d), 15_000)


@query("l4_floor_lookup", """SELECT event_id, coalesce((SELECT max(i.vseq) FROM p i WHERE i.event_type = 'purchase' AND i.flow_id = t.flow_id AND i.vseq <= t.vseq), (SELECT min(i.vseq) FROM p i WHERE i.event_type = 'purchase' AND i.flow_id = t.flow_id)) AS found_vseq FROM p t""")
def l4(spark, d):
    p = packets(spark, d)
    targets = p.select("flow_id", "event_id", F.col("vseq").alias("want"))
    return joins.floor_lookup(targets, p.where("event_type = 'purchase'"), "flow_id", "vseq", "want", ["vseq"]).select("event_id", "found_vseq")


@query("l5_av_pairs", """SELECT event_id, other_pts FROM (SELECT *, CASE kind WHEN 'audio' THEN last_value(CASE WHEN kind = 'video' THEN pts90 END IGNORE NULLS) OVER w WHEN 'video' THEN last_value(CASE WHEN kind = 'audio' THEN pts90 END IGNORE NULLS) OVER w END AS other_pts
  FROM p WINDOW w AS (PARTITION BY flow_id ORDER BY vseq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE other_pts IS NOT NULL""")
def l5(spark, d):
    return joins.av_pairs(packets(spark, d)).select("event_id", "other_pts")


@query("l6_clip_ranges", """SELECT c.clip_id, c.flow_id, s.start_pts, count(i.vseq) AS entries, max(i.vseq) AS end_pts FROM c JOIN s USING (clip_id) LEFT JOIN i ON i.flow_id = c.flow_id AND i.vseq >= s.start_pts AND i.vseq <= c.out_pts GROUP BY ALL""",
       """c AS (SELECT event_id AS clip_id, flow_id, vseq AS in_pts, vseq + 60 AS out_pts FROM p WHERE event_type = 'signup'), i AS (SELECT flow_id, vseq FROM p WHERE event_type = 'purchase'),
s AS (SELECT clip_id, coalesce((SELECT max(vseq) FROM i WHERE i.flow_id = c.flow_id AND vseq <= in_pts), (SELECT min(vseq) FROM i WHERE i.flow_id = c.flow_id)) AS start_pts FROM c)""")  # fmt: skip
def l6(spark, d):
    p = packets(spark, d)
    clips = p.where("event_type = 'signup'").select(F.col("event_id").alias("clip_id"), "flow_id", F.col("vseq").alias("in_pts"), (F.col("vseq") + 60).alias("out_pts"))
    return joins.clip_ranges(clips, p.where("event_type = 'purchase'"), "flow_id", "vseq", span=64)


@query("l8_unreferenced_pids", "SELECT DISTINCT flow_id, pid FROM p WHERE (flow_id, pid) NOT IN (SELECT flow_id, pid FROM p WHERE kind = 'video')")
def l8(spark, d):
    p = packets(spark, d)
    return joins.unreferenced_pids(p, p.where("kind = 'video'"))


@query("l9_version_as_of", """SELECT event_id, (SELECT arg_max(v.version, v.vseq) FROM v WHERE v.flow_id = p.flow_id AND v.vseq <= p.vseq) AS version FROM p""", "v AS (SELECT flow_id, vseq, vseq // 300 % 32 AS version FROM p WHERE event_type = 'signup')")
def l9(spark, d):
    p = packets(spark, d)
    held = joins.version_intervals(p.where("event_type = 'signup'").select("flow_id", "vseq", F.expr("vseq div 300 % 32").alias("version")), ["flow_id"], "vseq")
    return joins.as_of_version(p.select("event_id", "flow_id", "vseq"), held, ["flow_id"], "vseq").select("event_id", "version")


@query("l10_first_of_kind", "SELECT flow_id, kind, arg_min(pid, pid % 5 * 1000 + pid % 16) AS pid FROM p WHERE kind IN ('audio', 'video') GROUP BY ALL")
def l10(spark, d):
    streams = packets(spark, d).select("flow_id", "pid", "kind", (F.col("pid") % 5).alias("program"), (F.col("pid") % 16).alias("position")).distinct()
    return joins.first_of_kind(streams, ["audio", "video"])


@query("l11_clock_conflicts", "SELECT o_custkey AS assembly_id, count(DISTINCT o_orderstatus) AS clocks FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def l11(spark, d):
    return joins.clock_conflicts(table(spark, d, "orders").select(F.col("o_custkey").alias("assembly_id"), F.col("o_orderstatus").alias("clock_id")))


@query("l13_overlapping_tiles", """SELECT a.board, a.tile_id AS a, b.tile_id AS b FROM t a JOIN t b ON a.board = b.board AND a.tile_id < b.tile_id AND a.x < b.x + b.width AND b.x < a.x + a.width AND a.y < b.y + b.height AND b.y < a.y + a.height""", f"t AS ({TILES})")
def l13(spark, d):
    return joins.overlapping_tiles(tiles(spark, d), "board")


# Grouped statistics


@query("a1_traffic", "SELECT flow_id, count(*) AS packets, sum(bytes)::BIGINT AS bytes FROM p GROUP BY flow_id")
def a1(spark, d):
    return a.traffic(packets(spark, d), "flow_id")


@query("a2_inter_arrival", "SELECT flow_id, min(g) AS min_us, max(g) AS max_us, round(avg(g), 6) AS avg_us FROM (SELECT flow_id, recv_us - lag(recv_us) OVER (PARTITION BY flow_id ORDER BY vseq) AS g FROM p) GROUP BY flow_id")
def a2(spark, d):
    return a.inter_arrival(packets(spark, d)).withColumn("avg_us", F.round("avg_us", 6))


@query("a3_per_pid", """SELECT flow_id, pid, count(*) AS packets, sum(bytes)::BIGINT AS bytes, coalesce(max(e), 0)::BIGINT AS cc_errors, count_if(s < 0 OR s > 2700000) AS pcr_errors FROM (SELECT *, pcr27 - lag(pcr27) OVER (PARTITION BY flow_id, pid ORDER BY vseq) AS s FROM p)
  LEFT JOIN (SELECT flow_id, pid, count_if(c <> 1) AS e FROM (SELECT flow_id, pid, (cc - lag(cc) OVER (PARTITION BY flow_id, pid ORDER BY vseq) + 16) % 16 AS c FROM p WHERE has_payload) GROUP BY ALL) USING (flow_id, pid) GROUP BY flow_id, pid""")
def a3(spark, d):
    return a.per_pid(packets(spark, d))


@query("a4_latency_windows", "SELECT flow_id, recv_us // 5000000 AS window, min(cents) AS low, max(cents) AS high, round(avg(cents), 6) AS mean FROM p GROUP BY ALL")
def a4(spark, d):
    return a.tumbling(packets(spark, d), ["flow_id"], "recv_us", 5_000_000, F.min("cents").alias("low"), F.max("cents").alias("high"), F.round(F.avg("cents"), 6).alias("mean"))


@query("a5_percentiles", "SELECT flow_id, round(quantile_cont(cents, 0.5))::BIGINT AS p50, round(quantile_cont(cents, 0.95))::BIGINT AS p95, round(quantile_cont(cents, 0.99))::BIGINT AS p99 FROM p GROUP BY flow_id")
def a5(spark, d):
    return a.percentiles(packets(spark, d), ["flow_id"], "cents", [0.5, 0.95, 0.99])


@query("a6_nearest_rank", "SELECT flow_id, cents AS value FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY cents, event_id) - 1 AS i, count(*) OVER (PARTITION BY flow_id) AS n FROM p) WHERE i = floor((n - 1) * 0.99 + 0.5)")
def a6(spark, d):
    return a.nearest_rank(packets(spark, d), ["flow_id"], ["event_id"], "cents", 0.99)


@query("a7_worst_of", "SELECT flow_id, max(p95) AS p95, sum(samples)::BIGINT AS samples, arg_max(pid, p95 * 10000 + pid) AS worst_pid FROM (SELECT flow_id, pid, max(cents) AS p95, count(*) AS samples FROM p GROUP BY ALL) GROUP BY flow_id")
def a7(spark, d):
    stats = packets(spark, d).groupBy("flow_id", "pid").agg(F.max("cents").alias("p95"), F.count(F.lit(1)).alias("samples"))
    return a.worst_of(stats, ["flow_id"], ["p95"], "p95", "pid")


@query("a8_window_counters", "SELECT flow_id, \"window\", bad, sum(bad) OVER (PARTITION BY flow_id ORDER BY \"window\")::BIGINT AS total_bad, bad = 0 AS ok_bad FROM (SELECT flow_id, recv_us // 1000000 AS \"window\", count_if(event_type = 'error') AS bad FROM p GROUP BY ALL)")
def a8(spark, d):
    return a.window_and_total(packets(spark, d), ["flow_id"], "recv_us", 1_000_000, {"bad": F.col("event_type") == "error"})


@query("a9_bandwidth_grace", """SELECT flow_id, min(second) AS begin, max(CASE WHEN n = 3 THEN second END) AS alarm_at, max(second) AS until, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY flow_id, run ORDER BY second) AS n FROM (
  SELECT *, sum((bps <= 140000)::INT) OVER (PARTITION BY flow_id ORDER BY second) AS run FROM (SELECT flow_id, recv_us // 1000000 AS second, sum(bytes) * 8 AS bps FROM p GROUP BY ALL)) WHERE bps > 140000) GROUP BY flow_id, run HAVING count(*) >= 3""")
def a9(spark, d):
    return a.over_limit_runs(windows.throughput(packets(spark, d), "flow_id"), ["flow_id"], "second", F.col("bps") > 140_000, 3)


@query("a10_recovery_ratio", """SELECT flow_id, second, round(e / nullif(n, 0), 9) AS ratio, n >= 100 AND e / n >= 0.2 AS degraded FROM (SELECT flow_id, second, sum(e) OVER w AS e, sum(n) OVER w AS n FROM (SELECT flow_id, recv_us // 1000000 AS second, count_if(event_type = 'error') AS e, count(*) AS n FROM p GROUP BY ALL)
  WINDOW w AS (PARTITION BY flow_id ORDER BY second ROWS 9 PRECEDING))""")
def a10(spark, d):
    counts = packets(spark, d).groupBy("flow_id", F.expr("recv_us div 1000000").alias("second")).agg(F.count_if(F.col("event_type") == "error").alias("e"), F.count(F.lit(1)).alias("n"))
    return a.sliding_ratio(counts, ["flow_id"], "second", "e", "n", 10, 100, 0.2).select("flow_id", "second", F.round("ratio", 9).alias("ratio"), "degraded")


@query("a11_pid_gauges", """SELECT coalesce(s.flow_id, r.flow_id) AS flow_id, count_if(r.pid IS NULL) AS unreferenced, count_if(s.pid IS NULL) AS missing FROM (SELECT DISTINCT flow_id, pid FROM p) s FULL JOIN (SELECT DISTINCT flow_id, pid + 8 * (event_id % 2) AS pid FROM p WHERE kind = 'video') r ON s.flow_id = r.flow_id AND s.pid = r.pid GROUP BY 1""")
def a11(spark, d):
    p = packets(spark, d)
    return a.pid_gauges(p, p.where("kind = 'video'").select("flow_id", (F.col("pid") + 8 * (F.col("event_id") % 2)).alias("pid")))


@query("a12_gop", """SELECT flow_id, count(*) AS idr_count, round(avg(CASE WHEN g BETWEEN 1 AND 9999 THEN g END), 9) AS mean_interval FROM (SELECT flow_id, frame - lag(frame) OVER (PARTITION BY flow_id ORDER BY frame) AS g FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY vseq) AS frame FROM p WHERE kind = 'video') WHERE event_type = 'purchase') GROUP BY flow_id""")
def a12(spark, d):
    return a.gop(packets(spark, d).where("kind = 'video'").withColumn("key", F.col("event_type") == "purchase")).withColumn("mean_interval", F.round("mean_interval", 9))


@query("a13_captions", "SELECT flow_id, count(*) AS packets, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS services, 40000000 - max(recv_us) <= 5000000 AS present FROM p WHERE kind = 'data' GROUP BY flow_id")
def a13(spark, d):
    return a.captions(packets(spark, d).where("kind = 'data'"), F.lit(40_000_000), "event_type")


@query("a14_cues", "SELECT flow_id, count(*) AS cues, arg_max(event_type, event_id) AS last_command, arg_max(pts90, event_id) AS last_pts FROM p WHERE event_type IN ('purchase', 'signup') GROUP BY flow_id")
def a14(spark, d):
    return a.cues(packets(spark, d).where("event_type IN ('purchase', 'signup')"), "event_type")


@query("a15_file_probe", "SELECT flow_id, count(*) AS cells, arg_min(pcr27, vseq) AS first_pcr, arg_max(pcr27, vseq) AS last_pcr, (arg_max(pcr27, vseq) - arg_min(pcr27, vseq) + 2576980377600) % 2576980377600 // 27000 AS duration_ms FROM p GROUP BY flow_id")
def a15(spark, d):
    return a.file_probe(packets(spark, d), PCR_WRAP)


@query("a18_worst_label", "SELECT source, max(toxic) AS worst, CASE max(toxic) WHEN 0 THEN 'clean' ELSE 'toxic' END AS label FROM documents JOIN labels USING (doc_id) GROUP BY source")
def a18(spark, d):
    return a.worst_label(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"), ["source"], "toxic", ["clean", "toxic"])


@query("a21_clipping", "SELECT vec_id // 16 AS bucket, sum(len(list_filter(embedding, lambda x: abs(x) >= 0.25)))::BIGINT AS clipped FROM embeddings GROUP BY 1")
def a21(spark, d):
    return a.clipping(table(spark, d, "embeddings").withColumnRenamed("vec_id", "frame"), "embedding", 16, 0.25)


@query("a25_last_critical", "SELECT flow_id, arg_max(event_id, recv_us) AS event_id FROM p WHERE event_type = 'error' GROUP BY flow_id")
def a25(spark, d):
    return packets(spark, d).where("event_type = 'error'").groupBy("flow_id").agg(F.max_by("event_id", F.struct("recv_us", "event_id")).alias("event_id"))


@query("a26_levels", """SELECT vec_id, round(20 * log10(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))), 6) AS peak_dbfs, round(10 * log10(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 6) AS rms_dbfs FROM embeddings""")
def a26(spark, d):
    return a.levels(table(spark, d, "embeddings"), "embedding").select("vec_id", F.round("peak_dbfs", 6).alias("peak_dbfs"), F.round("rms_dbfs", 6).alias("rms_dbfs"))


@query("a26_peak_hold", """SELECT flow_id, pid, event_id, shown FROM r""", """m AS MATERIALIZED (SELECT flow_id, pid, event_id, recv_us, (-(cents % 90))::DOUBLE AS peak, row_number() OVER (PARTITION BY flow_id, pid ORDER BY recv_us, event_id) AS n FROM p),
r AS (SELECT flow_id, pid, n, event_id, peak AS shown, recv_us + 1500000 AS until FROM m WHERE n = 1 UNION ALL
  SELECT m.flow_id, m.pid, m.n, m.event_id, CASE WHEN m.peak >= r.shown OR m.recv_us >= r.until THEN m.peak ELSE r.shown END, CASE WHEN m.peak >= r.shown OR m.recv_us >= r.until THEN m.recv_us + 1500000 ELSE r.until END
  FROM r JOIN m ON m.flow_id = r.flow_id AND m.pid = r.pid AND m.n = r.n + 1)""")
def a26_hold(spark, d):
    return a.peak_hold(packets(spark, d).withColumn("peak", -(F.col("cents") % 90)), "recv_us", "peak")


@query("a28_programs", "SELECT flow_id, program, sum(b)::BIGINT AS bitrate, string_agg(pid || ':' || b, ',' ORDER BY pid) AS streams FROM (SELECT flow_id, pid % 3 AS program, pid, (sum(bytes) * 8)::BIGINT AS b FROM p GROUP BY ALL) GROUP BY ALL")
def a28(spark, d):
    streams = packets(spark, d).groupBy("flow_id", "pid").agg((F.sum("bytes") * 8).alias("bitrate")).withColumn("program", F.col("pid") % 3)
    return a.programs(streams)


@query("a24_max_min_shares", """SELECT leg_id, member_id, round(least(cap, greatest(level, 0) * w), 6) AS share FROM (SELECT *, max((rest - before) / here_on) OVER (PARTITION BY leg_id, tier) AS level FROM (
  SELECT *, greatest(50000 - coalesce(used, 0), 0) AS rest, coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here_on
  FROM (SELECT *, sum(cap) OVER (PARTITION BY leg_id ORDER BY tier RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM mem) WINDOW f AS (PARTITION BY leg_id, tier ORDER BY cap / w, member_id)))""",
    "mem AS (SELECT flow_id AS leg_id, pid AS member_id, least(sum(bytes), 40000)::DOUBLE AS cap, (1 + max(cents) % 3)::DOUBLE AS w, (pid % 3)::INTEGER AS tier FROM p GROUP BY flow_id, pid)")
def a24(spark, d):
    members = packets(spark, d).groupBy(F.col("flow_id").alias("leg_id"), F.col("pid").alias("member_id")).agg(F.sum("bytes").cast("double").alias("demand"), F.lit(40_000.0).alias("hard_cap"), (1 + F.max("cents") % 3).cast("double").alias("weight"), (F.max("pid") % 3).cast("int").alias("tier"))
    return a.max_min_shares(members, members.select("leg_id").distinct().withColumn("capacity", F.lit(50_000.0))).withColumn("share", F.round("share", 6))


# Windows and clocks


@query("w1_throughput", "SELECT flow_id, recv_us // 1000000 AS second, (sum(bytes) * 8)::BIGINT AS bps FROM p GROUP BY ALL")
def w1(spark, d):
    return windows.throughput(packets(spark, d), "flow_id")


@query("w2_freshness", """SELECT flow_id, event_id, m OR recv_us - max(CASE WHEN m THEN recv_us END) OVER (PARTITION BY flow_id ORDER BY recv_us) < 100000 AS fresh FROM (SELECT *, coalesce(counter > lag(counter) OVER (PARTITION BY flow_id ORDER BY recv_us), true) AS m
  FROM (SELECT *, sum(CASE WHEN event_type = 'view' THEN bytes ELSE 0 END) OVER (PARTITION BY flow_id ORDER BY vseq) % 5000 AS counter FROM p))""")
def w2(spark, d):
    from pyspark.sql.window import Window

    counter = F.sum(F.when(F.col("event_type") == "view", F.col("bytes")).otherwise(0)).over(Window.partitionBy("flow_id").orderBy("vseq")) % 5000
    return windows.freshness(packets(spark, d).withColumn("counter", counter), ["flow_id"], "recv_us", "counter", 100_000).select("flow_id", "event_id", "fresh")


@query("w3_jitter", """SELECT flow_id, round(arg_max(j, vseq), 6) AS jitter_us FROM r GROUP BY flow_id""", """m AS MATERIALIZED (SELECT flow_id, vseq, recv_us, rtp_ts FROM p),
r AS (SELECT flow_id, vseq, recv_us, rtp_ts, 0::DOUBLE AS j FROM m WHERE vseq = 0 UNION ALL
  SELECT flow_id, vseq, recv_us, rtp_ts, CASE WHEN d <= 10000 THEN j + (least(d * 1000, 1000000) - j) / 16 ELSE j END
  FROM (SELECT m.*, r.j, abs((m.recv_us / 1000::DOUBLE - r.recv_us / 1000::DOUBLE) - ((m.rtp_ts - r.rtp_ts + 4294967296 + 2147483648) % 4294967296 - 2147483648) / 90::DOUBLE) AS d FROM r JOIN m ON m.flow_id = r.flow_id AND m.vseq = r.vseq + 1))""")
def w3(spark, d):
    return windows.jitter(packets(spark, d))


@query("w4_pid_bitrate_ewma", """SELECT flow_id, pid, second, v AS ewma FROM r""", """s AS MATERIALIZED (SELECT flow_id, pid, recv_us // 1000000 AS second, (sum(bytes) * 8)::DOUBLE AS bps FROM p GROUP BY ALL),
b AS (SELECT flow_id, pid, min(second) AS first, max(second) AS last FROM s GROUP BY ALL),
r AS (SELECT s.flow_id, s.pid, s.second, s.bps AS v, b.last FROM s JOIN b ON s.flow_id = b.flow_id AND s.pid = b.pid AND s.second = b.first UNION ALL
  SELECT r.flow_id, r.pid, r.second + 1, CASE WHEN s.bps IS NULL THEN floor(r.v * 0.875::DOUBLE) WHEN r.v = 0 THEN s.bps ELSE floor(r.v * 0.875::DOUBLE + s.bps * 0.125::DOUBLE) END, r.last
  FROM r LEFT JOIN s ON s.flow_id = r.flow_id AND s.pid = r.pid AND s.second = r.second + 1 WHERE r.second < r.last)""")
def w4(spark, d):
    rates = windows.throughput(packets(spark, d), "flow_id", "pid")
    return windows.ewma(rates, ["flow_id", "pid"], "second", "bps", 0.125, whole=True, decay=True)


@query("w5_interleave_ewma", """SELECT flow_id, vseq, round(v, 6) AS ewma FROM r""", """m AS MATERIALIZED (SELECT flow_id, vseq, cents::DOUBLE AS x FROM p),
r AS (SELECT flow_id, vseq, x AS v FROM m WHERE vseq = 0 UNION ALL SELECT m.flow_id, m.vseq, r.v * (1 - 1 / 256::DOUBLE) + m.x * (1 / 256::DOUBLE) FROM r JOIN m ON m.flow_id = r.flow_id AND m.vseq = r.vseq + 1)""")
def w5(spark, d):
    return windows.ewma(packets(spark, d), ["flow_id"], "vseq", "cents", 1 / 256).withColumn("ewma", F.round("ewma", 6))


@query("w6_trust", """SELECT flow_id, count(*) AS cumulative_samples, sum(drift_us)::BIGINT // count(*) AS avg_us, least(count(*), 4096) AS samples, round(quantile_cont(drift_us, 0.5) FILTER (back <= 4096))::BIGINT AS p50_us, round(quantile_cont(drift_us, 0.95) FILTER (back <= 4096))::BIGINT AS p95_us,
  round(quantile_cont(drift_us, 0.99) FILTER (back <= 4096))::BIGINT AS p99_us, max(drift_us) FILTER (back <= 4096) AS max_us, round(quantile_cont(drift_us, 0.95) FILTER (back <= 256))::BIGINT AS window_p95_us FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY vseq DESC) AS back FROM drift) GROUP BY flow_id""",
       """steps AS (SELECT *, (pcr27 - lag(pcr27) OVER (PARTITION BY flow_id ORDER BY vseq) + 2576980377600) % 2576980377600 // 27 AS pcr_us, recv_us - lag(recv_us) OVER (PARTITION BY flow_id ORDER BY vseq) AS wall_us FROM p),
drift AS (SELECT *, abs(pcr_us - wall_us) AS drift_us FROM steps WHERE pcr_us <= 500000 AND wall_us <= 500000)""")  # fmt: skip
def w6(spark, d):
    return windows.trust(windows.pcr_drift(packets(spark, d), ["flow_id"]), ["flow_id"])


@query("w9_pcr_discontinuity", "SELECT flow_id, count_if(s < 0 OR s > 2700000) AS jumps FROM (SELECT flow_id, pcr27 - lag(pcr27) OVER (PARTITION BY flow_id ORDER BY vseq) AS s FROM p) GROUP BY flow_id")
def w9(spark, d):
    return windows.pcr_discontinuities(packets(spark, d), ["flow_id"]).groupBy("flow_id").agg(F.count_if("jump").alias("jumps"))


@query("w8_pcr_accuracy", """SELECT flow_id, event_id, CASE WHEN n >= 4 AND r <= 1e9 THEN r::BIGINT END AS residual_ns FROM (
  SELECT a.flow_id, a.event_id, count(b.vseq) AS n, round(abs(regr_intercept((b.pcr27 - a.pcr27)::DOUBLE, (b.recv_us - a.recv_us)::DOUBLE)) * 1000 / 27) AS r
  FROM p a LEFT JOIN p b ON a.flow_id = b.flow_id AND b.vseq BETWEEN a.vseq - 16 AND a.vseq - 1 GROUP BY a.flow_id, a.event_id)""")
def w8(spark, d):
    return windows.pcr_accuracy(packets(spark, d), ["flow_id"]).select("flow_id", "event_id", "residual_ns")


@query("w10_repetition", "SELECT flow_id, pid, count(*) AS seen, count_if(g > 500000) AS errors FROM (SELECT *, recv_us - lag(recv_us) OVER (PARTITION BY flow_id, pid ORDER BY recv_us) AS g FROM p) GROUP BY flow_id, pid")
def w10(spark, d):
    return windows.repetition_errors(packets(spark, d), ["flow_id", "pid"], "recv_us", 500_000)


@query("w11_delay_factor")
def w11(spark, d):
    return windows.delay_factor(packets(spark, d).withColumn("cc_error", F.col("event_type") == "error")).withColumns({"df_ms": F.round("df_ms", 6), "mlr": F.round("mlr", 6)})


@query("w12_segments", """SELECT flow_id, number AS segment, count(*) AS units, min(recv_us) AS begin_us, max(recv_us) AS end_us FROM r WHERE number >= 0 GROUP BY ALL""", """m AS MATERIALIZED (SELECT flow_id, vseq, recv_us, event_type = 'purchase' AS key FROM p),
r AS (SELECT flow_id, vseq, recv_us, CASE WHEN key THEN recv_us END AS start, CASE WHEN key THEN 0::BIGINT ELSE -1::BIGINT END AS number FROM m WHERE vseq = 0 UNION ALL
  SELECT flow_id, vseq, recv_us, CASE WHEN new THEN recv_us ELSE start END, number + new::BIGINT
  FROM (SELECT m.*, r.start, r.number, m.key AND (r.start IS NULL OR m.recv_us - r.start >= 2000000) AS new FROM r JOIN m ON m.flow_id = r.flow_id AND m.vseq = r.vseq + 1))""")
def w12(spark, d):
    return windows.segments(packets(spark, d).withColumn("key", F.col("event_type") == "purchase"), 2_000_000)


@query("w14_pts_delta", "SELECT event_id, trunc((((pts90 - b) % 8589934592 + 8589934592 + 4294967296) % 8589934592 - 4294967296) / 90)::BIGINT AS delta_ms FROM (SELECT *, lag(pts90) OVER (PARTITION BY flow_id ORDER BY vseq) AS b FROM p)")
def w14(spark, d):
    from pyspark.sql.window import Window

    return packets(spark, d).select("event_id", clock.pts_delta_ms(F.col("pts90"), F.lag("pts90").over(Window.partitionBy("flow_id").orderBy("vseq"))).alias("delta_ms"))


@query("w16_clock_lock")
def w16(spark, d):
    return windows.clock_lock(packets(spark, d))


@query("w19_vblank_hold", "SELECT event_id, (floor(0.5 + (vseq + 1) * 2.5) - floor(0.5 + vseq * 2.5))::BIGINT AS hold FROM p")
def w19(spark, d):
    return packets(spark, d).select("event_id", clock.vblank_hold(F.col("vseq") + 1, F.lit(2.5)).alias("hold"))


@query("w20_frame_rate_conversion", "SELECT event_id, vseq * 30000 // 25025 AS source FROM p")
def w20(spark, d):
    return packets(spark, d).select("event_id", clock.source_index("vseq", 30000, 1001, 25, 1).alias("source"))


@query("w21_slot_stalls", """SELECT flow_id, pid, greatest(scan + 5, 10) AS stalled_at, resumed_at FROM (SELECT *, lead(scan) OVER (PARTITION BY flow_id, pid ORDER BY scan) AS resumed_at FROM m) WHERE greatest(scan + 5, 10) < coalesce(resumed_at, until + 1)""", """u AS (SELECT flow_id, max(recv_us) AS until_us FROM p GROUP BY 1),
m AS (SELECT p.flow_id, pid, CAST(ceil(recv_us / 100000) AS BIGINT) AS scan, CAST(ceil(until_us / 100000) AS BIGINT) AS until FROM p JOIN u ON u.flow_id = p.flow_id WHERE kind <> 'data' UNION SELECT p.flow_id, pid, 0, CAST(ceil(until_us / 100000) AS BIGINT) FROM p JOIN u ON u.flow_id = p.flow_id WHERE kind <> 'data')""")
def w21(spark, d):
    p = packets(spark, d)
    ends = p.groupBy("flow_id").agg(F.lit(0).cast("long").alias("start_us"), F.max("recv_us").alias("until_us"))
    slots = p.select("flow_id", "pid", (F.col("kind") != "data").alias("continuous")).distinct().join(ends, "flow_id")
    return windows.slot_stalls(p.select("flow_id", "pid", "recv_us"), slots, ["flow_id", "pid"], "recv_us", 100_000)


@query("w23_av_skew", """SELECT event_id, skew_ms, max(abs(skew_ms)) OVER (PARTITION BY flow_id ORDER BY vseq) AS worst_ms FROM (SELECT *, trunc((a - v) / 90)::BIGINT AS skew_ms FROM (SELECT *, last_value(CASE WHEN kind = 'audio' THEN pts90 END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN kind = 'video' THEN pts90 END IGNORE NULLS) OVER w AS v
  FROM p WINDOW w AS (PARTITION BY flow_id ORDER BY vseq ROWS UNBOUNDED PRECEDING)) WHERE a IS NOT NULL AND v IS NOT NULL)""")
def w23(spark, d):
    return windows.av_skew(packets(spark, d)).select("event_id", "skew_ms", "worst_ms")


@query("w25_frame_rate", """SELECT flow_id, round(90000 / avg(s), 6) AS fps FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY vseq) AS n FROM (SELECT *, (pts90 - lag(pts90) OVER (PARTITION BY flow_id ORDER BY vseq) + 8589934592) % 8589934592 AS s FROM p) WHERE s BETWEEN 1200 AND 90000) WHERE n <= 30 GROUP BY flow_id HAVING count(*) = 30""")
def w25(spark, d):
    return windows.frame_rate(packets(spark, d), ["flow_id"], "vseq", "pts90").withColumn("fps", F.round("fps", 6))
