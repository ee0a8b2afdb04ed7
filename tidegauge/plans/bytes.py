"""Queries that go through bytes: datagrams, cells, tables, and small rules."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bits, media, tables
from ..operators import timers
from ..sources import captures, datagrams
from ..sources.stored import shared_folder
from .binding import packets, table
from .registry import query


def _bytes(*parts: tuple[Column | int, int]) -> Column:
    """Big-endian numbers of so many bytes each, one after the other."""
    return F.unhex(F.concat(*[F.lpad(F.hex((F.lit(v) if isinstance(v, int) else v).cast("long")), 2 * n, "0") for v, n in parts]))


def capture(spark, d) -> DataFrame:
    """Every packet as an RTP datagram of one cell, which carries its clock reference and, if it has a payload,
    the head of a unit with its stamp."""
    p = packets(spark, d)
    pcr, pts = F.col("pcr27"), F.col("pts90")
    base = F.floor(pcr / 300)
    clock = [(F.floor(base / 2), 4), (base % 2 * 32768 + 0x7E00 + pcr % 300, 2)]
    stamp = [(0x21 + F.floor(pts / (1 << 30)) * 2, 1), (F.floor(pts / (1 << 15)) % (1 << 15) * 2 + 1, 2), (pts % (1 << 15) * 2 + 1, 2)]
    head = [(0x47, 1), (F.col("pid") + F.when(F.col("has_payload"), 0x4000).otherwise(0), 2), (F.when(F.col("has_payload"), 0x30).otherwise(0x20) + F.col("cc"), 1), (7, 1), (0x10, 1), *clock]
    cell = F.rpad(F.concat(_bytes(*head), F.when(F.col("has_payload"), _bytes((1, 3), (0xE0, 1), (0, 2), (0x80, 1), (0x80, 1), (5, 1), *stamp)).otherwise(F.lit(b""))), 188, F.lit(b"\xff"))
    rtp = _bytes((0x80, 1), (33, 1), (F.col("seq"), 2), (F.col("rtp_ts"), 4), (0x12345678, 4))
    # captures that are read have their bytes as they are; a column that isn't deterministic keeps Spark from
    # pasting all that makes them here into each filter on them
    as_read = F.col("recv_us") + 0 * F.monotonically_increasing_id()
    return p.select("flow_id", F.lit(0).alias("leg"), as_read.alias("recv_us"), F.concat(rtp, cell).alias("data"))


@query("s1_datagrams", """SELECT flow_id, recv_us, seq, rtp_ts, pid, cc, has_payload AS pusi, has_payload, pcr27, CASE WHEN has_payload THEN pts90 END AS pts90 FROM p""")
def s1(spark, d):
    cells = datagrams.transport_cells(datagrams.rtp_packets(capture(spark, d)))
    return cells.select("flow_id", "recv_us", "seq", "rtp_ts", "pid", "cc", "pusi", "has_payload", "pcr27", "pts90")


@query("s1_capture_files", """SELECT flow_id, recv_us, seq, pid, cc FROM p""")
def s1_files(spark, d):
    """Written as capture files, an address a flow, and read again in ranges of a few kilobytes."""
    captures.register(spark)
    path = f"{shared_folder(spark)}/tidegauge/captures-{uuid.uuid4().hex}"
    address = F.concat_ws(".", F.lit("239"), *[F.expr(f"flow_id div {1 << n} % 256").cast("string") for n in (16, 8, 0)])
    sent = capture(spark, d).select(address.alias("address"), F.lit(5000).alias("port"), "recv_us", "data")
    sent.write.format("pcap").option("path", path).mode("append").save()
    read = spark.read.format("pcap").option("splitBytes", 1 << 15).load(path)
    byte = lambda i: F.split("address", "\\.")[i].cast("long")
    named = read.select((byte(1) * 65536 + byte(2) * 256 + byte(3)).alias("flow_id"), F.lit(0).alias("leg"), "recv_us", "data")
    return datagrams.transport_cells(datagrams.rtp_packets(named)).select("flow_id", "recv_us", "seq", "pid", "cc")


@query("s2_raw_cells", "SELECT flow_id, pid, count(*) AS cells, count_if(has_payload) AS payloads FROM p GROUP BY ALL")
def s2(spark, d):
    raw = capture(spark, d).select("flow_id", "recv_us", F.expr("substring(data, 13)").alias("payload"))
    return datagrams.transport_cells(raw).groupBy("flow_id", "pid").agg(F.count(F.lit(1)).alias("cells"), F.count_if("has_payload").alias("payloads"))


def table_cells(spark, d) -> DataFrame:
    """(flow_id, cell): the association table of each flow (a program a pid), and a map for each program."""

    @F.pandas_udf("array<binary>")
    def built(pids: pd.Series) -> pd.Series:
        def cells(flow):
            flow = sorted(map(int, flow))
            maps = [tables.map_cell(p - 255, 0x1000 + p, p, [(0x1B if p % 3 else 0x0F, p, bytes([0x0A, 4]) + b"eng\0")], p % 32, 0) for p in flow]
            return [tables.association_cell([(p - 255, 0x1000 + p) for p in flow], 1, 0), *maps]

        return pd.Series([cells(flow) for flow in pids])

    flows = packets(spark, d).groupBy("flow_id").agg(F.collect_set(F.col("pid").cast("int")).alias("pids"))
    return flows.select("flow_id", F.explode(built("pids")).alias("cell"))


@query("p9_programs", "SELECT DISTINCT flow_id, pid - 255 AS program, 4096 + pid AS map_pid, true AS crc_ok FROM p")
def p9(spark, d):
    cells = table_cells(spark, d).where(bits.ts_pid(F.col("cell")) == 0)
    listed = cells.select("flow_id", tables.crc_ok("cell").alias("crc_ok"), F.explode(tables.pat_programs("cell")).alias("x"))
    return listed.select("flow_id", F.col("x.program").cast("long").alias("program"), F.col("x.pid").cast("long").alias("map_pid"), "crc_ok")


@query("j11_program_maps", "SELECT DISTINCT flow_id, pid - 255 AS program, pid % 32 AS version, pid AS clock_pid, CASE WHEN pid % 3 > 0 THEN 27 ELSE 15 END AS stream_type, 'eng' AS language, true AS crc_ok FROM p")
def j11(spark, d):
    cells = table_cells(spark, d).where(bits.ts_pid(F.col("cell")) != 0)
    maps = cells.select("flow_id", tables.crc_ok("cell").alias("crc_ok"), tables.pmt("cell").alias("m")).select("flow_id", "crc_ok", "m.*")
    each = maps.select("flow_id", "crc_ok", "program", "version", "clock_pid", F.explode("streams").alias("s"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return each.select("flow_id", long("program"), long("version"), long("clock_pid"), F.col("s.stream_type").alias("stream_type"), tables.language("s.descriptors").alias("language"), "crc_ok")


_KINDS = list(timers.TIMERS)
_W10 = ", ".join(f"({i}, '{k}', {us}, '{mode}')" for i, (k, (us, mode)) in enumerate(timers.TIMERS.items()))


@query("w10_timers", """SELECT flow_id, kind, sum(n)::BIGINT AS errors, (CASE WHEN kind = 'sdt' THEN sum(n) ELSE 0 END)::BIGINT AS si_repetition FROM (
  SELECT flow_id, kind, CASE mode WHEN 'latch' THEN least(stale, 1) WHEN 'anchor' THEN (stale + 1) // 2 ELSE stale END AS n
  FROM (SELECT flow_id, kind, mode, (SELECT count(*) FROM range(0, 100000) g(i) WHERE f + i * 500000 >= a AND f + i * 500000 > t + most AND f + i * 500000 < n) AS stale
    FROM (SELECT *, coalesce(lead(t) OVER (PARTITION BY flow_id, kind, one ORDER BY t), e + 1) AS n FROM s JOIN x USING (flow_id)))
  UNION ALL SELECT flow_id, kind, (SELECT count(*) > 0 FROM range(0, 100000) g(i) WHERE f + i * 500000 >= said AND f + i * 500000 > a + 1000000 AND f + i * 500000 < coalesce(first, e + 1))::BIGINT
    FROM (SELECT flow_id, v.kind, pid, min(recv_us) AS said FROM p, (VALUES ('pmt'), ('es')) v(kind) WHERE event_type = 'signup' GROUP BY ALL) JOIN x USING (flow_id)
    LEFT JOIN (SELECT flow_id, kind, one AS pid, min(t) AS first FROM s GROUP BY ALL) USING (flow_id, kind, pid)) GROUP BY flow_id, kind""",
    f"""k(i, kind, most, mode) AS (VALUES {_W10}), s AS (SELECT flow_id, k.kind, mode, most, recv_us AS t, CASE WHEN k.kind IN ('pmt', 'es', 'pcr', 'pts') THEN pid END AS one FROM p JOIN k ON k.i = cents % 11),
x AS (SELECT flow_id, min(t) AS f, max(t) AS e, min(t) FILTER (kind = 'pat') AS a FROM s GROUP BY flow_id)""")  # fmt: skip
def w10_timers(spark, d):
    p = packets(spark, d)
    seen = p.withColumn("kind", F.get(F.array(*map(F.lit, _KINDS)), (F.col("cents") % 11).cast("int")))
    named = p.where("event_type = 'signup'").select("flow_id", "pid", "recv_us", F.explode(F.array(F.lit("pmt"), F.lit("es"))).alias("kind"))
    return timers.timer_errors(seen, ["flow_id"], "kind", "recv_us", named=named)


@query("q9_drain_rate", "SELECT flow_id, event_id, rate FROM r", """m AS MATERIALIZED (SELECT flow_id, vseq, event_id, pcr27, bytes FROM p),
r AS (SELECT flow_id, vseq, event_id, pcr27, bytes, 0::BIGINT AS rate FROM m WHERE vseq = 0 UNION ALL
  SELECT flow_id, vseq, event_id, pcr27, CASE WHEN vseq = 1 THEN bytes + 0 ELSE bytes END, CASE WHEN step NOT BETWEEN 0 AND 13500000 OR ns < 1000000 THEN rate WHEN rate = 0 THEN held * 8000000000 // ns ELSE (3 * rate + held * 8000000000 // ns) // 4 END
  FROM (SELECT m.*, r.rate, r.bytes AS held, m.pcr27 - r.pcr27 AS step, (m.pcr27 - r.pcr27) * 1000 // 27 AS ns FROM r JOIN m ON m.flow_id = r.flow_id AND m.vseq = r.vseq + 1))""")
def q9(spark, d):
    return timers.drain_rates(packets(spark, d))


@query("q22_priority_hints", """SELECT flow_id, count(*) AS packets, count_if(cents % 32 IN (5, 7, 8) OR cents % 256 // 2 % 64 IN (19, 20, 21, 32, 33, 34)) AS critical FROM p GROUP BY flow_id""")
def q22(spark, d):
    p = packets(spark, d).withColumn("data", _bytes((0xFFFF, 2), (1, 3), (F.col("cents") % 256, 1), (0xFF, 1)))
    hinted = p.withColumn("critical", media.critical_with_carry(F.col("data"), F.lag("data").over(Window.partitionBy("flow_id").orderBy("vseq"))))
    return hinted.groupBy("flow_id").agg(F.count(F.lit(1)).alias("packets"), F.count_if("critical").alias("critical"))


@query("p19_aspect_ratios", """SELECT p_partkey, CASE WHEN abs(w / h::DOUBLE / (16 / 9.0::DOUBLE) - 1) < 0.005 THEN '16:9' WHEN abs(w / h::DOUBLE / (4 / 3.0::DOUBLE) - 1) < 0.005 THEN '4:3' WHEN abs(w / h::DOUBLE / (21 / 9.0::DOUBLE) - 1) < 0.005 THEN '21:9'
  WHEN abs(w / h::DOUBLE / (256 / 135.0::DOUBLE) - 1) < 0.005 THEN '17:9 (DCI)' WHEN abs(w / h::DOUBLE / 1.85 - 1) < 0.005 THEN '1.85:1' WHEN abs(w / h::DOUBLE / 2.39 - 1) < 0.005 THEN '2.39:1' ELSE (w // gcd(w, h)) || ':' || (h // gcd(w, h)) END AS aspect FROM w""",
    "w AS (SELECT p_partkey, (p_size * 16)::BIGINT AS w, (180 + p_partkey % 9 * 36)::BIGINT AS h FROM part)")
def p19(spark, d):
    sized = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 16).alias("w"), (180 + F.col("p_partkey") % 9 * 36).alias("h"), F.lit(1).alias("sw"), F.lit(1).alias("sh"))
    return sized.select("p_partkey", media.aspect_ratio("w", "h", "sw", "sh").alias("aspect"))


@query("p30_sampling", """SELECT event_id, secs AS interval, greatest(secs, 5) AS sample, greatest((30 + greatest(secs, 5) - 1) // greatest(secs, 5), 2) AS threshold, least(greatest(secs * 10, 8), 50) AS frames
  FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN 5 ELSE least(greatest(cents % 80, 1), 60) END AS secs FROM p)""")
def p30(spark, d):
    asked = F.when(F.col("event_type") != "view", F.col("cents") % 80)
    return packets(spark, d).select("event_id", media.sampling(asked).alias("s")).select("event_id", "s.*")


@query("p31_audio_frames", "SELECT event_id, CASE WHEN t IN (3, 4) THEN 2160 WHEN t IN (15, 17) THEN 1920 WHEN t IN (129, 131, 132, 133, 135) THEN 2880 END AS ticks FROM (SELECT event_id, cents % 140 AS t FROM p)")
def p31(spark, d):
    return packets(spark, d).select("event_id", media.audio_frame_ticks(F.col("cents") % 140).alias("ticks"))


@query("p32_error_codes", "SELECT CASE WHEN event_type = 'error' THEN 'E' || (event_id % 7) ELSE '(no_error_code)' END AS code, count(*) AS n FROM events GROUP BY ALL")
def p32(spark, d):
    e = table(spark, d, "events")
    details = F.when(F.col("event_type") == "error", F.to_json(F.struct(F.concat(F.lit("E"), F.col("event_id") % 7).alias("error_code")))).otherwise(F.col("props"))
    return e.groupBy(media.error_code(details).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("k14_segments", """SELECT flow_id, segment_id, count(*) AS cells, (count(*) * 188)::BIGINT AS bytes, coalesce(sum(count(*) * 188) OVER (PARTITION BY flow_id ORDER BY segment_id DESC) <= 40000 OR row_number() OVER (PARTITION BY flow_id ORDER BY segment_id DESC) = 1, false) AS keep
  FROM (SELECT flow_id, ((recv_us - min(recv_us) OVER (PARTITION BY flow_id)) // 5000000)::BIGINT AS segment_id FROM p) GROUP BY flow_id, segment_id""")
def k14(spark, d):
    cells = datagrams.segmented(packets(spark, d), ["flow_id"], "recv_us", 5_000_000)
    sizes = cells.groupBy("flow_id", "segment_id").agg(F.count(F.lit(1)).alias("cells"), (F.max("byte_offset") + 188).cast("long").alias("bytes"))
    return sizes.join(datagrams.retained(sizes, ["flow_id"], 40_000), ["flow_id", "segment_id"])
