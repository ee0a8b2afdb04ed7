"""Queries of essence headers, ancillary data, cues, pixels, manifests and replay."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ancillary, essence
from ..functions.bits import big_endian
from ..operators import joins
from ..sources import datagrams, export
from .binding import packets
from .recordings import SEGMENTS, segments
from .registry import query


def _cents():
    return F.col("cents")


def _div(n: int):
    return F.expr(f"cents div {n}")


@query("p17_adts", """SELECT event_id, [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350][cents % 14 + 1] AS sample_rate,
  CASE WHEN cents % 14 < 13 THEN cents // 14 % 8 END AS channels, CASE WHEN cents % 14 < 13 THEN ['AAC-Main', 'AAC-LC', 'AAC-SSR', 'AAC-LTP'][cents // 112 % 4 + 1] END AS profile FROM p""")
def p17_adts(spark, d):
    channels = _div(14) % 8
    data = F.concat(F.lit(b"\xff\xf1"), big_endian(_div(112) % 4 * 16384 + _cents() % 14 * 1024 + channels * 64, 2), F.lit(bytes(3)))
    return packets(spark, d).select("event_id", essence.adts(data).alias("a")).select("event_id", "a.*")


@query("p17_mpeg_audio", """SELECT event_id, CASE WHEN good THEN [44100, 48000, 32000][r + 1] // CASE v WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 4 END END AS sample_rate, CASE WHEN good THEN CASE m WHEN 3 THEN 1 ELSE 2 END END AS channels,
  CASE WHEN good THEN ['MPEG-2.5', '', 'MPEG-2', 'MPEG-1'][v + 1] || ' Layer ' || ['', 'III', 'II', 'I'][l + 1] END AS profile FROM (SELECT *, v <> 1 AND l <> 0 AND r < 3 AS good FROM (SELECT event_id, cents % 4 AS v, cents // 4 % 4 AS l, cents // 16 % 4 AS r, cents // 64 % 4 AS m FROM p))""")
def p17_mpeg_audio(spark, d):
    data = big_endian(F.lit(0xFFE0 * 65536) + (_cents() % 4 * 8 + _div(4) % 4 * 2) * 65536 + _div(16) % 4 * 1024 + _div(64) % 4 * 64, 4)
    return packets(spark, d).select("event_id", essence.mpeg_audio(data).alias("a")).select("event_id", "a.*")


@query("p17_loas", """SELECT event_id, t AS reused, CASE WHEN NOT t THEN [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350][r + 1] END AS sample_rate,
  CASE WHEN NOT t THEN CASE WHEN c = 7 THEN 8 WHEN c = 0 THEN 2 ELSE c END END AS channels, CASE WHEN NOT t THEN CASE k WHEN 1 THEN 'AAC-Main' WHEN 2 THEN 'AAC-LC' WHEN 3 THEN 'AAC-SSR' WHEN 4 THEN 'AAC-LTP' WHEN 5 THEN 'HE-AAC' WHEN 29 THEN 'HE-AAC v2' ELSE 'AAC-LATM' END END AS profile
  FROM (SELECT event_id, event_type = 'view' AS t, cents % 13 AS r, cents // 13 % 8 AS c, cents // 104 % 31 AS k FROM p)""")
def p17_loas(spark, d):
    config = _div(104) % 31 * 2048 + _cents() % 13 * 128 + _div(13) % 8 * 8
    data = F.concat(F.lit(b"\x56\xe0\0"), big_endian(F.when(F.col("event_type") == "view", 0xA000).otherwise(0x2000), 2), big_endian(config, 2), F.lit(bytes(4)))
    return packets(spark, d).select("event_id", essence.loas(data).alias("a")).select("event_id", "a.reused", "a.audio.*")


@query("p16_h264", "SELECT event_id, ((cents % 120 + 1) * 16)::INTEGER AS width, ((cents // 120 % 68 + 1) * 16)::INTEGER AS height, CASE WHEN event_type = 'view' THEN 'Main' ELSE 'Baseline' END AS profile, (cents % 6 // 2 + 3) || '.' || cents % 2 AS level FROM p")
def p16_h264(spark, d):
    def code(value):
        digits = F.bin(value + 1)
        return F.lpad(digits, 2 * F.length(digits) - 1, "0")

    byte = lambda value: F.lpad(F.bin(value), 8, "0")
    level = (F.floor(_cents() % 6 / 2) + 3) * 10 + _cents() % 2
    bits = F.concat(byte(F.when(F.col("event_type") == "view", 77).otherwise(66)), F.lit("0" * 8), byte(level), F.lit("1" + "1" + "011" + "1" + "0"), code(_cents() % 120), code(_div(120) % 68), F.lit("11001"))
    unit = F.concat(F.lit(b"\0\0\0\1\x67"), F.unhex(F.lpad(F.conv(F.rpad(bits, 64, "0"), 2, 16), 16, "0")))
    return packets(spark, d).select("event_id", essence.picture_parameters(unit).alias("a")).select("event_id", "a.width", "a.height", "a.profile", "a.level")


@query("p16_h265", """SELECT event_id, (cents % 3840 + 9 - 2 * (cents % 4))::INTEGER AS width, (cents % 2160 + 9 - 2 * (cents % 3))::INTEGER AS height, round((cents % 120 + 1) * 1000 / 1001::DOUBLE, 6) AS frame_rate,
  CASE WHEN event_type = 'view' THEN 'Main 10' ELSE 'Main' END AS profile, (cents % 4 + 3) || '.' || cents % 2 AS level FROM p""")
def p16_h265(spark, d):
    """Sets with one lower layer where events are views, each escaped as streams are."""
    def code(value):
        digits = F.bin(value + 1)
        return F.lpad(digits, 2 * F.length(digits) - 1, "0")

    fixed = lambda value, n: F.lpad(F.bin(value), n, "0")
    view, ones = F.col("event_type") == "view", F.lit("1" * 80)
    level = (_cents() % 4 + 3) * 30 + _cents() % 2 * 3
    layers = F.concat(fixed(F.when(view, 2).otherwise(1), 8), ones, fixed(level, 8), F.when(view, F.concat(F.lit("11" + "0" * 14 + "00000010"), ones, F.lit("01011101"))).otherwise(""))
    size = F.concat(F.lit("1" + "010"), code(_cents() % 3840 + 9), code(_cents() % 2160 + 9), F.lit("1"), code(_cents() % 4), F.lit("1"), code(_cents() % 3), F.lit("1"))
    middle = F.concat(F.lit("111" + "1"), F.when(view, F.lit("1" * 6)).otherwise("1" * 3), F.lit("1" * 6 + "0" * 4), F.lit("1" + "0" * 3))
    rate = F.concat(F.lit("1" + "0000" + "000" + "0" + "1"), fixed(F.lit(1001), 32), fixed((_cents() % 120 + 1) * 1000, 32), F.lit("1"))
    bits = F.concat(F.when(view, "00000011").otherwise("00000001"), layers, size, middle, rate)
    octets = F.transform(F.sequence(F.lit(0), F.floor((F.length(bits) - 1) / 8).cast("int")), lambda i: F.lpad(F.conv(F.rpad(F.substring(bits, i * 8 + 1, F.lit(8)), 8, "0"), 2, 16), 2, "0"))
    escaped = F.regexp_replace(F.array_join(octets, ""), r"\G((?:..)*?)0000(?=0[0-3])", "$1000003")
    unit = F.concat(F.lit(b"\0\0\0\1\x40\1\x0c\1\0\0\1\x42\1"), F.unhex(escaped))
    told = packets(spark, d).select("event_id", essence.picture_parameters_h265(unit).alias("a"))
    return told.select("event_id", "a.width", "a.height", F.round("a.frame_rate", 6).alias("frame_rate"), "a.profile", "a.level")


@query("p16_mpeg2", """SELECT event_id, (cents % 4000 + 1)::INTEGER AS width, (cents % 3000 + 1)::INTEGER AS height, CASE WHEN cents % 16 BETWEEN 1 AND 8 THEN round([24000 / 1001::DOUBLE, 24, 25, 30000 / 1001::DOUBLE, 30, 50, 60000 / 1001::DOUBLE, 60][cents % 16], 6) END AS frame_rate FROM p""")
def p16_mpeg2(spark, d):
    data = F.concat(F.lit(b"\0\0\1\xb3"), big_endian((_cents() % 4000 + 1) * (1 << 20) + (_cents() % 3000 + 1) * 256 + 16 + _cents() % 16, 4), F.lit(b"\xff" * 4))
    return packets(spark, d).select("event_id", essence.picture_parameters(data).alias("a")).select("event_id", "a.width", "a.height", F.round("a.frame_rate", 6).alias("frame_rate"))


def _message():
    """A splice message of every packet: opcode, event_id, pre_roll_ms, break_ms, auto_return."""
    opcode = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "cancel").otherwise("end")
    return opcode, F.col("event_id"), _cents() % 7 * 500, F.when(_cents() % 3 > 0, _cents() % 1000 * 100), F.col("event_type") == "signup"


MESSAGES = """m AS (SELECT event_id, pts90, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'cancel' ELSE 'end' END AS opcode, cents % 7 * 500 AS wait, CASE WHEN cents % 3 > 0 THEN cents % 1000 * 100 END AS lasts, event_type = 'signup' AS back FROM p)"""


@query("j18_splice_sections", """SELECT event_id, 'splice_insert' AS command, CASE WHEN opcode = 'start' AND wait > 0 THEN (pts90 + wait * 90) % 8589934592 END AS pts, opcode, event_id AS cue_id,
  CASE opcode WHEN 'cancel' THEN 0 ELSE wait END AS pre_roll_ms, CASE WHEN opcode <> 'cancel' THEN lasts END AS break_ms, CASE WHEN opcode <> 'cancel' AND lasts IS NOT NULL THEN back END AS auto_return FROM m""", MESSAGES)
def j18(spark, d):
    section = ancillary.splice_section(*_message(), F.col("pts90"))
    rows = packets(spark, d).select("event_id", "pts90", section.alias("s"))
    told = rows.select("event_id", ancillary.cue(F.col("s")).alias("c"), ancillary.splice_message(F.col("s"), F.col("pts90")).alias("m"))
    return told.select("event_id", "c.command", "c.pts", "m.opcode", F.col("m.event_id").alias("cue_id"), "m.pre_roll_ms", "m.break_ms", "m.auto_return")


@query("p20_splice_messages", """SELECT event_id, opcode, event_id AS cue_id, wait AS pre_roll_ms, nullif(lasts, 0) AS break_ms, CASE WHEN lasts > 0 THEN back END AS auto_return FROM m""", MESSAGES)
def p20(spark, d):
    data = ancillary.build_message(*_message())
    return packets(spark, d).select("event_id", ancillary.parse_message(data).alias("m")).select("event_id", "m.opcode", F.col("m.event_id").alias("cue_id"), "m.pre_roll_ms", "m.break_ms", "m.auto_return")


@query("p22_captions", """SELECT event_id, place, (cents % 2048)::INTEGER AS line_number, did, sdid, kind, CASE WHEN kind IS NOT NULL THEN CASE WHEN sdid = 1 THEN CASE WHEN event_type = 'view' THEN 0 ELSE cents % 32 END ELSE 3 END END AS count FROM (
  SELECT *, CASE WHEN did = 97 THEN CASE sdid WHEN 1 THEN 'cea708' ELSE 'cea608' END END AS kind FROM (SELECT * EXCLUDE (kind), CASE WHEN place = 1 OR event_type = 'click' THEN 65 ELSE 97 END AS did, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS sdid FROM p, (VALUES (0), (1)) l(place)))""")
def p22(spark, d):
    """Two packets a datagram, packed, unpacked and looked through for captions."""
    data = F.concat(F.lit(b"\x96\x69\x0f\x4f\x43\0\0"), big_endian(F.when(F.col("event_type") == "view", 0x71).otherwise(0x72), 1), big_endian(0xE0 + _cents() % 32, 1))
    one = lambda did: F.struct(F.lit(False).alias("color_difference"), (_cents() % 2048).cast("int").alias("line_number"), F.lit(4095).alias("horizontal_offset"), F.lit(True).alias("stream_flag"), F.lit(5).alias("stream_num"),
                               did.cast("int").alias("did"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("sdid"), data.alias("user_data"))
    built = F.array(one(F.when(F.col("event_type") == "click", 0x41).otherwise(0x61)), one(F.lit(0x41)))
    sent = packets(spark, d).select("event_id", ancillary.pack_packets(built, F.lit(0), F.lit(0)).alias("data"))
    read = sent.select("event_id", F.posexplode(ancillary.unpack_packets("data")).alias("place", "x"))
    return read.withColumn("c", ancillary.captions(F.col("x"))).select("event_id", "place", "x.line_number", "x.did", "x.sdid", "c.kind", "c.count")


@query("p24_pixels", """SELECT event_id, upper(printf('%010x', b * 1073741824 + y * 1048576 + r * 1024 + y) || printf('%010x', r * 1073741824 + b * 1048576 + y * 1024 + r)) AS ten, [y % 256, b % 256]::BIGINT[]::VARCHAR AS luma, [r % 256]::BIGINT[]::VARCHAR AS blue
  FROM (SELECT event_id, cents % 1024 AS y, cents // 3 % 1024 AS b, cents // 7 % 1024 AS r FROM p)""")
def p24(spark, d):
    y, b, r = _cents() % 1024, _div(3) % 1024, _div(7) % 1024
    ten = ancillary.pack_422(F.array(y, y, b, r), F.array(b, r), F.array(r, y), 10)
    eight = ancillary.unpack_422(ancillary.pack_422(F.array(y, b), F.array(r), F.array(y), 8), 8)
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    return packets(spark, d).select("event_id", F.hex(ten).alias("ten"), eight.alias("e")).select("event_id", "ten", listed(F.col("e.y")).alias("luma"), listed(F.col("e.cb")).alias("blue"))


@query("k7_dash_manifest", """SELECT recording_id, '<?xml version="1.0" encoding="UTF-8"?><MPD availabilityStartTime="' || strftime(make_timestamp((1704067200 + recording_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ')
  || '" minBufferTime="PT6.0S" minimumUpdatePeriod="PT4.0S" profiles="urn:mpeg:dash:profile:cmaf:2019,urn:mpeg:dash:profile:isoff-live:2011"' || CASE WHEN recording_id % 2 = 1 THEN ' suggestedPresentationDelay="PT1.5S"' ELSE '' END
  || ' timeShiftBufferDepth="PT' || greatest(n * 4, 30) || 'S" type="dynamic" xmlns="urn:mpeg:dash:schema:mpd:2011" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="urn:mpeg:dash:schema:mpd:2011 DASH-MPD.xsd"><Period id="0" start="PT0S">'
  || '<AdaptationSet codecs="avc1.64001F" contentType="video" mimeType="video/mp4" segmentAlignment="true" startWithSAP="1"><Representation bandwidth="' || bytes || '" frameRate="25" height="720" id="video" width="1280"><SegmentTemplate' || late
  || ' duration="360000" initialization="init.mp4" media="seg-$Number%05d$.m4s" startNumber="' || greatest(latest, 1) || '" timescale="90000"></SegmentTemplate></Representation></AdaptationSet>'
  || '<AdaptationSet codecs="mp4a.40.2" contentType="audio" lang="und" mimeType="audio/mp4" segmentAlignment="true" startWithSAP="1"><Representation audioSamplingRate="48000" bandwidth="128000" id="audio"><AudioChannelConfiguration schemeIdUri="urn:mpeg:mpegB:cicp:ChannelConfiguration" value="2"></AudioChannelConfiguration><SegmentTemplate' || late
  || ' duration="192000" initialization="init.mp4" media="aud-$Number%05d$.m4s" startNumber="' || greatest(latest, 1) || '" timescale="48000"></SegmentTemplate></Representation></AdaptationSet></Period></MPD>' AS manifest
  FROM (SELECT recording_id, count(*) AS n, max(segment_id) AS latest, sum(bytes)::BIGINT AS bytes, CASE WHEN recording_id % 2 = 1 THEN ' availabilityTimeComplete="false" availabilityTimeOffset="0.500"' ELSE '' END AS late FROM seg GROUP BY recording_id)""", SEGMENTS)
def k7(spark, d):
    live = segments(spark, d).groupBy("recording_id").agg(F.count(F.lit(1)).alias("available"), F.max("segment_id").alias("latest"), F.sum("bytes").alias("bytes"))
    video = F.struct(F.lit("avc1.64001F").alias("codecs"), F.lit(1280).alias("width"), F.lit(720).alias("height"), F.lit("25").alias("frame_rate"), F.lit(90_000).alias("timescale"), F.col("bytes").alias("bandwidth"))
    audio = F.struct(F.lit("mp4a.40.2").alias("codecs"), F.lit(2).alias("channels"), F.lit(48_000).alias("sample_rate"), F.lit(128_000).alias("bandwidth"))
    given = live.withColumns({"start_s": 1_704_067_200 + F.col("recording_id"), "target_s": F.lit(4.0), "offset_s": F.col("recording_id") % 2 * 0.5, "video": video, "audio": audio})
    return given.select("recording_id", export.dash_manifest().alias("manifest"))


@query("s13_replay", """SELECT clip_id, i.event_id, ((i.vseq - start) * 80000)::BIGINT AS due_us FROM (SELECT event_id AS clip_id, flow_id, vseq + 30 AS until, coalesce((SELECT max(vseq) FROM p i WHERE i.event_type = 'purchase' AND i.flow_id = c.flow_id AND i.vseq <= c.vseq), (SELECT min(vseq) FROM p i WHERE i.event_type = 'purchase' AND i.flow_id = c.flow_id)) AS start
  FROM p c WHERE event_type = 'signup') c JOIN p i ON i.flow_id = c.flow_id AND i.vseq BETWEEN start AND until""")
def s13(spark, d):
    p = packets(spark, d).withColumn("pts", F.col("vseq") * 3600)
    clips = p.where("event_type = 'signup'").select(F.col("event_id").alias("clip_id"), "flow_id", F.col("pts").alias("from_pts"), (F.col("pts") + 108_000).alias("to_pts"))
    cued = joins.floor_lookup(clips, p.where("event_type = 'purchase'"), "flow_id", "pts", "from_pts", ["pts"]).withColumnRenamed("found_pts", "start_pts")
    return datagrams.replayed(p, cued, ["flow_id"], "pts", F.lit(0.5), 500 * 3600).select("clip_id", "event_id", "due_us")


@query("t8_step_frames", """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN vseq END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back_vseq,
  first_value(CASE WHEN kind = 'video' THEN vseq END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_vseq FROM p WINDOW w AS (PARTITION BY flow_id ORDER BY vseq)""")
def t8(spark, d):
    """One step from where each packet is: back to the key frame before it, or on to the next picture."""
    w = Window.partitionBy("flow_id").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda wanted, order: F.last(F.when(wanted, F.col("vseq")), True).over(w.orderBy(order))
    return packets(spark, d).select("event_id", last(F.col("event_type") == "purchase", F.col("vseq")).alias("back_vseq"), last(F.col("kind") == "video", F.desc("vseq")).alias("next_vseq"))
