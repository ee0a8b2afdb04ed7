"""Queries of small rules: one expression a row, or one lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, clock
from ..operators import filters, rewrite, sequence, windows
from .binding import packets
from .registry import query


def _p(spark, d):
    return packets(spark, d)


@query("f2_fec_prefix", "SELECT event_id, event_id % 3 = 0 AND event_id % 20 >= 10 AS is_fec FROM p")
def f2(spark, d):
    prefix = F.when(F.col("event_id") % 3 == 0, F.lit(b"PRTY")).otherwise(F.lit(b"\x80\x21\0\0"))
    data = F.concat(prefix, F.unhex(F.repeat(F.lit("00"), (F.col("event_id") % 20).cast("int"))))
    return _p(spark, d).select("event_id", bits.is_fec(data, b"PRTY").alias("is_fec"))


@query("f9_data_only", "SELECT event_id, cents % 32 IN (5, 11, 12, 13, 20) AS data_only FROM p")
def f9(spark, d):
    return _p(spark, d).select("event_id", filters.is_data_only(F.col("cents") % 32).alias("data_only"))


@query("f10_continuous_media", "SELECT event_id, cents % 256 IN (1, 2, 3, 4, 15, 16, 17, 27, 31, 32, 33, 36, 66, 129, 135, 234) OR (cents % 256 = 6 AND pid % 2 = 0) AS continuous FROM p")
def f10(spark, d):
    described = F.when(F.col("pid") % 2 == 0, "ac3")
    return _p(spark, d).select("event_id", filters.is_continuous_media(F.col("cents") % 256, described).alias("continuous"))


@query("j4_pid_overrides", "SELECT program, role, pid, CASE WHEN role = 'audio' AND program % 2 = 0 THEN 7000 + program ELSE pid END AS out_pid FROM (SELECT flow_id AS program, kind AS role, min(pid) AS pid FROM p GROUP BY ALL)")
def j4(spark, d):
    streams = _p(spark, d).groupBy(F.col("flow_id").alias("program"), F.col("kind").alias("role")).agg(F.min("pid").alias("pid"))
    forced = streams.where("role = 'audio' AND program % 2 = 0").select("program", "role", (7000 + F.col("program")).alias("pid"))
    return rewrite.override_pids(streams, forced)


@query("j15_table_versions", "SELECT event_id, (cents % 32 + 3) % 32 AS version FROM p")
def j15(spark, d):
    return _p(spark, d).select("event_id", clock.version_after(F.col("cents") % 32, 3).alias("version"))


@query("j19_splice_times", "SELECT event_id, (cents * 1000003 + pts90) % 8589934592 AS splice_pts FROM p")
def j19(spark, d):
    return _p(spark, d).select("event_id", rewrite.splice_time_adjusted(F.col("cents") * 1_000_003, F.col("pts90")).alias("splice_pts"))


@query("q11_output_delay", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN cents % 500 WHEN cents % 7 = 0 THEN 250 ELSE least(greatest(cents % 500 * 40, 1), 10000) END AS delay_ms FROM p")
def q11(spark, d):
    mode, fps = F.when(F.col("event_id") % 2 == 0, "fixed").otherwise("frames"), F.when(F.col("cents") % 7 > 0, 25.0).otherwise(0.0)
    return _p(spark, d).select("event_id", clock.output_delay_ms(mode, F.col("cents") % 500, fps, 250).alias("delay_ms"))


@query("w13_unwrapped_stamps", "SELECT event_id, vseq * 1500000000 AS unwrapped FROM p")
def w13(spark, d):
    stamped = _p(spark, d).withColumn("stamp", F.col("vseq") * 1_500_000_000 % (1 << 33))
    return windows.unwrap_pts(stamped, ["flow_id"], "vseq", "stamp").select("event_id", F.col("unwrapped").cast("long").alias("unwrapped"))


@query("w17_projected_clock", """SELECT flow_id, event_id, (a.pcr + (recv_us - a.at) * 27) % 2576980377600 AS now_27mhz FROM (SELECT flow_id, event_id, recv_us,
  last_value(CASE WHEN event_type = 'purchase' THEN {'at': recv_us, 'pcr': pcr27} END IGNORE NULLS) OVER (PARTITION BY flow_id ORDER BY recv_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM p) WHERE a IS NOT NULL""")
def w17(spark, d):
    p = _p(spark, d)
    return windows.projected_clock(p, p.where("event_type = 'purchase'"))


@query("w18_wall_clock", "SELECT event_id, (((1700000000000000000 + event_id * 1000000007)::HUGEINT * 27 // 1000 + cents) % 2576980377600)::BIGINT AS pcr FROM p")
def w18(spark, d):
    ns = F.lit(1_700_000_000_000_000_000) + F.col("event_id") * 1_000_000_007
    return _p(spark, d).select("event_id", clock.pcr_from_unix_ns(ns, F.col("cents")).alias("pcr"))


@query("p21_timecodes", """SELECT event_id, CASE WHEN h < 24 AND f < 25 THEN printf('%02d:%02d:%02d:%02d', h, m, s, f) END AS shown, CASE WHEN h < 24 AND f < 25 THEN ((h * 60 + m) * 60 + s) * 25 + f END AS frames
  FROM (SELECT event_id, event_id % 26 AS h, cents % 60 AS m, vseq % 60 AS s, cents % 27 AS f FROM p)""")
def p21(spark, d):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat_ws(":", two(F.col("event_id") % 26), two(F.col("cents") % 60), two(F.col("vseq") % 60), two(F.col("cents") % 27))
    read = _p(spark, d).select("event_id", bits.parse_timecode(text, 25).alias("t"))
    return read.select("event_id", F.when(F.col("t").isNotNull(), bits.format_timecode(F.col("t"))).alias("shown"), bits.timecode_frames(F.col("t"), 25).alias("frames"))


@query("p25_index_entries", """SELECT event_id, array_to_string(list_transform(range(8), lambda i: printf('%02X', (pts90 >> (8 * i)) & 255)), '') || array_to_string(list_transform([cents, flow_id, vseq * 188, (event_id % 4)], lambda v: array_to_string(list_transform(range(4), lambda i: printf('%02X', (v >> (8 * i)) & 255)), '')), '') AS entry,
  pts90 AS pts, cents AS smpte_tc, flow_id AS segment_id, vseq * 188 AS byte_offset, event_id % 4 AS flags FROM p""")
def p25(spark, d):
    entry = bits.index_entry(F.col("pts90"), F.col("cents"), F.col("flow_id"), F.col("vseq") * 188, F.col("event_id") % 4)
    made = _p(spark, d).select("event_id", entry.alias("e"))
    return made.select("event_id", F.hex("e").alias("entry"), bits.parse_index_entry(F.col("e")).alias("x")).select("event_id", "entry", "x.*")


@query("p26_durations", "SELECT event_id, greatest(cents * 70 - vseq * 90, 0) // 90 AS duration_ms, greatest(least(cents * 97, 3145728) // 188 * 188, 188) AS chunk FROM p")
def p26(spark, d):
    return _p(spark, d).select("event_id", clock.duration_ms(F.col("vseq") * 90, F.col("cents") * 70).alias("duration_ms"), clock.clamp_chunk(F.col("cents") * 97).alias("chunk"))


@query("p29_letterbox", """SELECT p_partkey, greatest(w - w % 2, 2) AS width, greatest(h - h % 2, 2) AS height FROM (SELECT p_partkey, least(640, floor(360 * sw / sh))::BIGINT AS w, least(360, floor(640 * sh / sw))::BIGINT AS h
  FROM (SELECT p_partkey, (p_size * 16)::BIGINT AS sw, (180 + p_partkey % 9 * 36)::BIGINT AS sh FROM part))""")
def p29(spark, d):
    from .binding import table

    sized = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 16).alias("sw"), (180 + F.col("p_partkey") % 9 * 36).alias("sh"))
    c = [F.col("sw"), F.col("sh"), F.lit(640), F.lit(360)]
    return sized.select("p_partkey", bits.fit_width(*c).alias("width"), bits.fit_height(*c).alias("height"))


@query("p34_transfer_curves", """SELECT event_id, round(pow(greatest(r - 3424 / 4096::DOUBLE, 0) / (2413 / 4096::DOUBLE * 32 - 2392 / 4096::DOUBLE * 32 * r), 1 / (2610 / 16384::DOUBLE)), 6) AS light, round(CASE WHEN x <= 0.0031308 THEN 12.92::DOUBLE * x ELSE 1.055::DOUBLE * pow(x, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END, 6) AS srgb
  FROM (SELECT event_id, x, pow(x, 1 / (2523 / 4096::DOUBLE * 128)) AS r FROM (SELECT event_id, least(cents % 1100 / 1000::DOUBLE, 1) AS x FROM p))""")
def p34(spark, d):
    x = F.col("cents") % 1100 / 1000
    return _p(spark, d).select("event_id", F.round(clock.pq_eotf(x), 6).alias("light"), F.round(clock.srgb_oetf(x), 6).alias("srgb"))


@query("w24_timeline", """SELECT event_id, 900000 + CASE WHEN anchor IS NULL THEN 0 WHEN b.off <= 900000 THEN b.d ELSE elapsed END AS resolved FROM (
  SELECT event_id, elapsed, anchor, list_min(list_transform(flatten(list_transform(range(-16, 17), lambda j: list_transform(range(-16, 17), lambda m: {'j': j, 'm': m, 'w': raw + m * 8589934592::DOUBLE - (anchor + j * 4294967296::DOUBLE)}))),
    lambda x: {'off': abs(round(x.w + round((elapsed - x.w) / wrap) * wrap) - elapsed)::BIGINT, 'j': x.j, 'm': x.m, 'd': round(x.w + round((elapsed - x.w) / wrap) * wrap)::BIGINT})) AS b FROM o)""",
    """o AS MATERIALIZED (SELECT event_id, (cents * 7919 * 65537 + vseq * 3600) % 4294967296 AS raw, CASE WHEN pid % 2 = 0 THEN 4294967296 ELSE 8053063680 END::DOUBLE AS wrap, (recv_us - min(recv_us) OVER w) * 9 // 100 AS elapsed,
  CASE WHEN row_number() OVER w > 1 THEN first_value((cents * 7919 * 65537 + vseq * 3600) % 4294967296) OVER w END AS anchor FROM p WHERE event_type = 'signup' WINDOW w AS (PARTITION BY flow_id ORDER BY vseq))""")  # fmt: skip
def w24(spark, d):
    """Each signup is an essence that joins its flow's timeline; the first is the anchor."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("flow_id").orderBy("vseq")
    joins = _p(spark, d).where("event_type = 'signup'").withColumn("raw", (F.col("cents") * 7919 * 65537 + F.col("vseq") * 3600) % (1 << 32))
    first = F.when(F.row_number().over(w) > 1, F.first("raw").over(w))
    wrap = F.when(F.col("pid") % 2 == 0, float(1 << 32)).otherwise(float(1 << 32) * 90_000 / 48_000)
    given = joins.withColumns({"anchor_raw": first, "wrap": wrap, "anchor_wrap": F.lit(float(1 << 32)), "elapsed": F.expr("(recv_us - min(recv_us) OVER (PARTITION BY flow_id ORDER BY vseq)) * 9 div 100")})
    return windows.timeline(given).select("event_id", "resolved")


@query("q10_bounded_delay", """SELECT event_id, recv_us + 250000 AS release_us, (h > 5 OR (b > 4000 AND h > 1)) AS shed FROM (SELECT event_id, recv_us, max(n) OVER w - n + 1 AS h, max(s) OVER w - s + bytes AS b
  FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY recv_us, event_id) AS n, sum(bytes) OVER (PARTITION BY flow_id ORDER BY recv_us, event_id ROWS UNBOUNDED PRECEDING) AS s FROM p)
  WINDOW w AS (PARTITION BY flow_id ORDER BY recv_us RANGE BETWEEN CURRENT ROW AND 249999 FOLLOWING))""")
def q10(spark, d):
    return sequence.delay_line(_p(spark, d), 250_000, 5, 4000).select("event_id", "release_us", "shed")


@query("j12_flushed_bundles", """SELECT flow_id, row_number() OVER (PARTITION BY flow_id ORDER BY tick, part) - 1 AS datagram, cells, first, last FROM (SELECT flow_id, tick, part, count(*) AS cells, min(vseq) AS first, max(vseq) AS last FROM (
  SELECT *, (row_number() OVER (PARTITION BY flow_id, tick ORDER BY vseq) - 1) // 7 AS part FROM (SELECT *, (recv_us - min(recv_us) OVER (PARTITION BY flow_id)) // 200000 AS tick FROM p)) GROUP BY ALL)""")
def j12(spark, d):
    return rewrite.bundle(_p(spark, d), ["flow_id"], "vseq", time="recv_us", flush_us=200_000)
