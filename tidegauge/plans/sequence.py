"""Queries of sequence algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import erasure
from ..operators import sequence as q
from .binding import legs, packets
from .registry import query


@query("q1_leg_merge", """SELECT flow_id, event_id, vseq % 65536 AS seq, leg FROM (SELECT *, row_number() OVER (PARTITION BY flow_id, vseq ORDER BY recv_leg_us, leg) AS n FROM legs) WHERE n = 1""")
def q1(spark, d):
    return q.merge_legs(legs(spark, d))


@query("q1_first_arrivals", """SELECT flow_id, vseq, event_id, leg FROM (SELECT *, row_number() OVER (PARTITION BY flow_id, vseq ORDER BY recv_leg_us, leg) AS n FROM legs) WHERE n = 1""")
def q1f(spark, d):
    return q.first_arrivals(legs(spark, d))


@query("q2_unwrap", "SELECT flow_id, event_id, vseq AS virtual FROM p")
def q2(spark, d):
    return q.unwrap(packets(spark, d), ["flow_id"], ["vseq"]).select("flow_id", "event_id", "virtual")


@query("q3_reorder_counts")
def q3(spark, d):
    return q.reorder_counts(legs(spark, d))


@query("q3_reorder_release")
def q3r(spark, d):
    return q.reorder(legs(spark, d))


@query("q4_leg_split", """SELECT flow_id, count(*) AS emitted, count_if(b) AS via_both, count_if(NOT b AND leg = 0) AS leg0_only, count_if(NOT b AND leg = 1) AS leg1_only,
  count_if(legs = 3 AND NOT b) AS late_dropped, coalesce(max(CASE WHEN b THEN apart END), 0) AS max_path_us FROM (
  SELECT flow_id, vseq, bit_or(1 << leg) AS legs, max(recv_leg_us) - min(recv_leg_us) AS apart, arg_min(leg, recv_leg_us * 2 + leg) AS leg, bit_or(1 << leg) = 3 AND max(recv_leg_us) - min(recv_leg_us) < 20000 AS b
  FROM legs GROUP BY flow_id, vseq) GROUP BY flow_id""")
def q4(spark, d):
    return q.leg_merge_counts(legs(spark, d), 20_000)


@query("q5_leg_down", """SELECT flow_id, leg, last + 100000 AS down_us, recv_leg_us AS up_us FROM (SELECT *, lag(recv_leg_us) OVER (PARTITION BY flow_id, leg ORDER BY recv_leg_us, event_id) AS last FROM legs) WHERE recv_leg_us - last > 100000
  UNION ALL SELECT a.flow_id, leg, max(recv_leg_us) + 100000, NULL FROM legs a JOIN (SELECT flow_id, max(recv_leg_us) AS until FROM legs GROUP BY 1) b ON a.flow_id = b.flow_id GROUP BY a.flow_id, leg, until HAVING until - max(recv_leg_us) > 100000""")
def q5(spark, d):
    return q.leg_down(legs(spark, d), 100_000)


@query("q6_ssrc_mismatch", """SELECT flow_id, count_if(other <> 0 AND other <> ssrc AND own_last <> ssrc) AS ssrc_mismatch FROM (
  SELECT flow_id, ssrc, coalesce(lag(ssrc) OVER (PARTITION BY flow_id, leg ORDER BY recv_leg_us, event_id), 0) AS own_last,
   coalesce(CASE WHEN leg = 0 THEN last_value(CASE WHEN leg = 1 THEN ssrc END IGNORE NULLS) OVER w ELSE last_value(CASE WHEN leg = 0 THEN ssrc END IGNORE NULLS) OVER w END, 0) AS other
  FROM (SELECT *, 1000 + vseq // 300 + CASE WHEN leg = 1 AND vseq % 900 > 850 THEN 7 ELSE 0 END AS ssrc FROM legs)
  WINDOW w AS (PARTITION BY flow_id ORDER BY recv_leg_us, leg, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY flow_id""")
def q6(spark, d):
    ssrc = 1000 + F.floor(F.col("vseq") / 300) + F.when((F.col("leg") == 1) & (F.col("vseq") % 900 > 850), 7).otherwise(0)
    return q.ssrc_mismatches(legs(spark, d).withColumn("ssrc", ssrc), "ssrc")


@query("q7_primary_preference", """SELECT flow_id, event_id, leg FROM (SELECT *, last_value(CASE WHEN leg = 0 THEN recv_leg_us END IGNORE NULLS) OVER (PARTITION BY flow_id ORDER BY recv_leg_us, leg, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m, min(recv_leg_us) OVER (PARTITION BY flow_id) AS began FROM legs)
  WHERE leg = 0 OR recv_leg_us - coalesce(m, began) > 80000""")
def q7(spark, d):
    return q.primary_preference(legs(spark, d), 80_000).select("flow_id", "event_id", "leg")


@query("q8_rtp_loss", """SELECT flow_id, count(*) AS packets, coalesce(sum(CASE WHEN gap BETWEEN 1 AND 999 THEN gap END), 0)::BIGINT AS lost, max(vseq) - min(vseq) + 1 - count(DISTINCT vseq) AS true_missing FROM (
  SELECT *, (seq - lag(seq) OVER (PARTITION BY flow_id ORDER BY recv_leg_us, event_id) - 1 + 65536) % 65536 AS gap FROM legs WHERE leg = 1) GROUP BY flow_id""")
def q8(spark, d):
    return q.sequence_loss(legs(spark, d).where("leg = 1"), ["recv_leg_us", "event_id"])


@query("q10_delay_line", "SELECT event_id, recv_us + 250000 AS release_us FROM p")
def q10(spark, d):
    return q.delay_line(packets(spark, d), 250_000).select("event_id", "release_us")


@query("q12_fec_encode", """SELECT flow_id, vseq // 20 AS cycle, true AS is_column, vseq % 20 % 5 AS index, bit_xor(cents) AS cents FROM p GROUP BY ALL HAVING count(*) = 4
  UNION ALL SELECT flow_id, vseq // 20, false, vseq % 20 // 5, bit_xor(cents) FROM p GROUP BY ALL HAVING count(*) = 5""")
def q12(spark, d):
    return q.parity(packets(spark, d), 5, 4, ["cents"])


@query("q13_fec_recover")
def q13(spark, d):
    p = packets(spark, d)
    return q.recover(p.where("event_id % 13 != 0"), q.parity(p, 5, 4, ["cents"]), 5, 4, "cents")


def _sent(spark, d):
    """Packets with payloads of one to some 20 bytes, and the bases of matrices that begin at another number in each flow."""
    sent = packets(spark, d).select("event_id", "flow_id", "vseq", F.repeat(F.hex("cents"), 1 + (F.col("event_id") % 3).cast("int")).cast("binary").alias("payload"))
    last = sent.groupBy("flow_id").agg(F.max("vseq").alias("last"))
    return sent, last.select("flow_id", F.explode(F.sequence(F.col("flow_id") % 20, F.col("last") + F.col("flow_id") % 20, F.lit(20).cast("long"))).alias("base"))


@query("q12_byte_parity", """SELECT flow_id, base, count_if(is_column) AS columns, count_if(NOT is_column) AS rows FROM (SELECT flow_id, base, unnest([true, true, true, true, true, false, false, false, false]) AS is_column FROM (
  SELECT flow_id, (vseq - flow_id % 20) // 20 * 20 + flow_id % 20 AS base FROM p WHERE vseq >= flow_id % 20 GROUP BY ALL HAVING count(DISTINCT vseq) = 20)) GROUP BY ALL""")
def q12_bytes(spark, d):
    sent, bases = _sent(spark, d)
    return erasure.byte_parity(sent, bases, 5, 4).groupBy("flow_id", "base").agg(F.count_if("is_column").alias("columns"), F.count_if(~F.col("is_column")).alias("rows"))


@query("q13_byte_recovery")
def q13_bytes(spark, d):
    """Packets lost on the way that parity restores; one parity packet in eleven is lost too."""
    sent, bases = _sent(spark, d)
    arrived = erasure.byte_parity(sent, bases, 5, 4).where((F.col("base") + F.col("index")) % 11 != 0)
    return erasure.recover_bytes(sent.where("event_id % 7 != 0"), arrived, 5, 4).select("flow_id", "vseq", F.col("payload").cast("string").alias("payload"))


@query("q14_realign", """SELECT flow_id, m, CASE WHEN (new_base - base + 65536) % 65536 < 20 OR (base - new_base + 65536) % 65536 < 20 THEN array_to_string(list_filter(list_transform(seqs, lambda s: (s - new_base + 65536) % 65536), lambda x: x < 20), ',') END AS places
  FROM (SELECT flow_id, vseq // 20 AS m, min(vseq) % 65536 AS base, (min(vseq) + arg_min(cents, vseq) % 60 - 30 + 65536) % 65536 AS new_base, list(seq ORDER BY vseq) AS seqs FROM p GROUP BY ALL)""")
def q14(spark, d):
    one = packets(spark, d).groupBy("flow_id", F.expr("vseq div 20").alias("m"))
    cells = one.agg((F.min("vseq") % 65536).alias("base"), F.min_by("cents", "vseq").alias("off"), F.transform(F.array_sort(F.collect_list(F.struct("vseq", "seq"))), lambda x: x["seq"]).alias("seqs"), F.min("vseq").alias("first"))
    places = q.realigned(F.col("base"), F.pmod(F.col("first") + F.col("off") % 60 - 30, F.lit(65536)), F.col("seqs"), 20)
    return cells.select("flow_id", "m", F.array_join(places, ",").alias("places"))


@query("q15_red_blue", """SELECT l.flow_id, l.leg, count(*) AS received, count(f.event_id) AS forwarded, count(*) - count(f.event_id) AS duplicates, count_if(f.leg <> f.last) AS switches FROM legs l LEFT JOIN
  (SELECT *, lag(leg) OVER (PARTITION BY flow_id ORDER BY recv_leg_us, leg, vseq) AS last FROM (SELECT *, row_number() OVER (PARTITION BY flow_id, vseq ORDER BY recv_leg_us, leg) AS n FROM legs) WHERE n = 1) f ON f.event_id = l.event_id AND f.leg = l.leg GROUP BY l.flow_id, l.leg""")
def q15(spark, d):
    return q.red_blue(legs(spark, d))


CC = """SELECT flow_id, pid, count(*) AS cells, count_if(step NOT IN ({ok})) AS errors FROM (SELECT *, (cc - lag(cc) OVER (PARTITION BY flow_id, pid ORDER BY vseq) + 16) % 16 AS step FROM p WHERE has_payload) GROUP BY flow_id, pid"""


@query("q16_cc_errors_tr101290", CC.format(ok="0, 1"))
def q16(spark, d):
    return q.continuity_errors(packets(spark, d))


@query("q17_cc_errors_strict", CC.format(ok="1"))
def q17(spark, d):
    return q.continuity_errors(packets(spark, d), allow_duplicate=False)


@query("q18_sync_loss", """SELECT flow_id, vseq, CASE WHEN locked THEN 'regained' ELSE 'lost' END AS change FROM r WHERE flipped""", """m AS MATERIALIZED (SELECT flow_id, vseq, cents % 9 < 5 AS good FROM p),
r AS (SELECT flow_id, vseq, true AS locked, (NOT good)::INTEGER AS run, false AS flipped FROM m WHERE vseq = 0 UNION ALL
  SELECT flow_id, vseq, CASE WHEN more >= 5 THEN NOT locked ELSE locked END, CASE WHEN more >= 5 THEN 0 ELSE more END, more >= 5
  FROM (SELECT m.*, r.locked, CASE WHEN m.good = r.locked THEN 0 ELSE r.run + 1 END AS more FROM r JOIN m ON m.flow_id = r.flow_id AND m.vseq = r.vseq + 1))""")
def q18(spark, d):
    return q.sync_events(packets(spark, d), F.col("cents") % 9 < 5)


@query("q20_unit_reassembly", """SELECT flow_id, pid, unit, min(vseq) AS first, count(*) AS cells, string_agg(hex(event_id), '' ORDER BY vseq) AS data FROM (
  SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY flow_id, pid ORDER BY vseq)::BIGINT AS unit FROM p) WHERE unit > 0 GROUP BY flow_id, pid, unit""")
def q20(spark, d):
    rows = packets(spark, d).withColumn("payload", F.hex("event_id").cast("binary"))
    return q.reassemble(rows, ["flow_id", "pid"], "vseq", F.col("event_type") == "purchase", "payload").withColumn("data", F.col("data").cast("string"))


@query("q21_splice", """SELECT s.switch_id, s.flow_id, min(u.recv_us) AS splice_us, min(u.recv_us) IS NULL AS timed_out FROM (SELECT event_id AS switch_id, flow_id, recv_us AS at_us, pts90 + 1800 AS pts FROM p WHERE event_type = 'signup') s
  LEFT JOIN p u ON u.flow_id = s.flow_id AND u.recv_us >= s.at_us AND u.recv_us <= s.at_us + 200000 AND (u.pts90 - s.pts + 8589934592) % 8589934592 < 4294967296 AND u.event_type = 'purchase' GROUP BY s.switch_id, s.flow_id""")
def q21(spark, d):
    p = packets(spark, d)
    switches = p.where("event_type = 'signup'").select(F.col("event_id").alias("switch_id"), "flow_id", F.col("recv_us").alias("at_us"), (F.col("pts90") + 1800).alias("pts"), F.lit(200_000).alias("timeout_us"))
    return q.splice_points(switches, p.withColumn("key", F.col("event_type") == "purchase"))


@query("q23_assembly", """SELECT out_pid, count(*) AS cells, sum(has_payload::INT)::BIGINT AS payloads, max(cc) AS last_cc FROM (SELECT flow_id * 2 + (kind = 'audio')::INT AS out_pid, has_payload,
  (sum(has_payload::INT) OVER (PARTITION BY flow_id, kind ORDER BY vseq) % 16)::BIGINT AS cc FROM p WHERE kind <> 'data') GROUP BY out_pid""")
def q23(spark, d):
    from ..operators.rewrite import renumber

    p = packets(spark, d).where("kind != 'data'")
    slots = [p.where(F.col("kind") == kind).withColumn("out_pid", F.col("flow_id") * 2 + n) for n, kind in enumerate(("video", "audio"))]
    out = renumber(q.assemble(slots), ["out_pid"], "vseq")
    return out.groupBy("out_pid").agg(F.count(F.lit(1)).alias("cells"), F.count_if("has_payload").alias("payloads"), F.max("out_cc").alias("last_cc"))
