"""Queries from captured datagrams through programme tables.

Besides the packets, each flow carries tables before every eighth packet (epoch g): an association table of
sixty programmes over two cells, in which programme 1 moves every fourth epoch and is missing in each
eleventh, and its map over three cells, whose streams change every second epoch and whose middle cell is
lost in each seventh."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bits, tables
from ..operators import programmes
from ..sources import datagrams
from ..sources.stored import stored
from .binding import packets
from .bytes import capture
from .registry import query

_FILLER = bytes([0x05, 30]) + b"FILL" + bytes(26)


def _stream(pid: int) -> tuple[int, int, bytes]:
    kind, tag = [(0x0F, b"\x0a\x04eng\0"), (0x1B, b"\x0a\x04eng\0"), (0x06, b"\x6a\x04\0\0\0\0")][pid % 3]
    return kind, pid, tag + _FILLER


def _map_body(g: int) -> bytes:
    h = g // 2
    streams = b"".join(bytes([k]) + (0xE000 | p).to_bytes(2, "big") + (0xF000 | len(d)).to_bytes(2, "big") + d for k, p, d in (_stream(p) for p in range(256, 272) if (p + h) % 3))
    head = (0xB000 | 13 + len(streams)).to_bytes(2, "big") + b"\0\1" + bytes([0xC1 | h % 32 << 1, 0, 0])
    return b"\2" + head + (0xE000 | 256 + h % 16).to_bytes(2, "big") + b"\xf0\0" + streams


@lru_cache(maxsize=1 << 12)
def _tables(g: int) -> bytes:
    own = [] if g % 11 == 10 else [(1, 4096 + g // 4 % 2)]
    listed = own + [(n, 4608 + n) for n in range(2, 61)]
    found = tables.cells_of(0, 2 * g, tables.association_body(listed, g, stream=7))
    maps = tables.cells_of(4096 + g // 4 % 2, 3 * g, _map_body(g))
    return b"".join(found + [c for i, c in enumerate(maps) if i != 1 or g % 7 != 3])


def captured(spark, d) -> DataFrame:
    """Cells of packets and tables, from datagrams: flow_id, nr (their order), pid, cc, pusi, pts90, cell."""

    @F.pandas_udf("binary")
    def built(epochs: pd.Series) -> pd.Series:
        return pd.Series([_tables(int(g)) for g in epochs])

    due = packets(spark, d).where("vseq % 8 = 0").select("flow_id", F.lit(0).alias("leg"), (F.col("vseq") * 40000 - 10 + 0 * F.monotonically_increasing_id()).alias("recv_us"), F.concat(F.unhex(F.lit("80210000000000000000ABCD")), built(F.expr("vseq div 8"))).alias("data"))
    cells = datagrams.transport_cells(datagrams.rtp_packets(capture(spark, d).unionByName(due)))
    return stored(cells.select("flow_id", (F.col("recv_us") * 16 + F.col("place")).alias("nr"), "pid", "cc", "pusi", "pts90", "cell"), "captured")


#: Epochs of each flow: g, the pid of programme 1's map (m), how often it has changed (c), and the half-epoch
#: (h) whose map holds at the end of the epoch's tables.
_EPOCHS = """g0 AS (SELECT DISTINCT flow_id, vseq // 8 AS g FROM p), g1 AS (SELECT *, CASE WHEN g % 11 <> 10 THEN 4096 + g // 4 % 2 END AS m FROM g0),
g2 AS (SELECT *, lag(m) OVER (PARTITION BY flow_id ORDER BY g) AS before FROM g1), g3 AS (SELECT *, sum((m IS DISTINCT FROM before)::INT) OVER (PARTITION BY flow_id ORDER BY g) AS c FROM g2),
g AS (SELECT *, max(CASE WHEN g % 7 <> 3 AND m IS NOT NULL THEN g // 2 END) OVER (PARTITION BY flow_id, c ORDER BY g) AS h FROM g3),
maps AS (SELECT flow_id, g, 4096 + g // 4 % 2 AS pid, i, (g * 320000 - 10) * 16 + i - (g % 7 = 3 AND i = 4)::INT AS nr, (3 * g + i - 2) % 16 AS cc FROM g0, range(2, 5) r(i) WHERE NOT (g % 7 = 3 AND i = 3))"""


@query("q19_sections", """SELECT flow_id, 0 AS pid, (g * 320000 - 10) * 16 + 1 AS nr, 0 AS table_id, (252 - CASE WHEN m IS NULL THEN 4 ELSE 0 END)::INTEGER AS size, (g % 32)::INTEGER AS version, true AS crc_ok FROM g
  UNION ALL SELECT flow_id, pid, nr, 2, 16 + 43 * len(list_filter(range(256, 272), lambda x: (x + g // 2) % 3 <> 0)), g // 2 % 32, true FROM maps WHERE i = 4 AND g % 7 <> 3""", _EPOCHS)
def q19(spark, d):
    found = programmes.sections(programmes.table_parts(captured(spark, d), "nr"), "nr")
    byte = lambda i: F.conv(F.hex(F.substring("section", i, 1)), 16, 10).cast("int")
    return found.select("flow_id", "pid", "nr", byte(1).alias("table_id"), F.length("section").alias("size"), F.floor(byte(6) / 2).cast("int").bitwiseAND(F.lit(31)).alias("version"), tables.checksum_ok("section").alias("crc_ok"))


@query("f7_captured_programme", """SELECT p.flow_id, recv_us * 16 AS nr, pid, cc FROM p JOIN g ON g.flow_id = p.flow_id AND g.g = vseq // 8 WHERE (pid + h) % 3 <> 0 OR pid = 256 + h % 16
  UNION ALL SELECT flow_id, nr, pid, cc FROM maps JOIN g USING (flow_id, g) WHERE m IS NOT NULL
  UNION ALL SELECT flow_id, (g * 320000 - 10) * 16 + i, 0, (row_number() OVER (PARTITION BY flow_id ORDER BY g, i) - 1) % 16 FROM g, range(2) r(i) WHERE CASE i WHEN 0 THEN before ELSE m END IS NOT NULL""", _EPOCHS)
def f7(spark, d):
    kept = programmes.filter_programme(captured(spark, d), 1, "nr")
    return kept.select("flow_id", "nr", bits.ts_pid(F.col("cell")).alias("pid"), bits.ts_cc(F.col("cell")).alias("cc"))


@query("l9_captured_roles", """SELECT p.flow_id, recv_us * 16 AS nr, pid, CASE WHEN pid = list_min(list_filter(range(256, 272), lambda x: (x + h) % 3 <> 0 AND x % 3 = 1)) THEN 'video'
  WHEN pid = coalesce(list_min(list_filter(range(256, 272), lambda x: (x + h) % 3 <> 0 AND x % 3 = 0)), list_min(list_filter(range(256, 272), lambda x: (x + h) % 3 <> 0 AND x % 3 = 2))) THEN 'audio' END AS role
  FROM p JOIN g ON g.flow_id = p.flow_id AND g.g = vseq // 8 WHERE has_payload""", _EPOCHS)
def l9(spark, d):
    cells = captured(spark, d)
    found = stored(programmes.sections(programmes.table_parts(cells, "nr"), "nr"), "sections")
    said = stored(programmes.associations(found, "nr", None), "associations")
    held = programmes.roles(programmes.stream_maps(found, said, "nr"), "nr")
    stamped = cells.where("pts90 IS NOT NULL").select("flow_id", "nr", "pid")
    return programmes.with_roles(stamped, held, "nr").select("flow_id", "nr", "pid", "role")


@query("j3_captured_remap", """SELECT flow_id, nr, CASE pid WHEN 4096 THEN 5000 ELSE pid END AS pid, CASE 256 + g // 2 % 16 WHEN 257 THEN 700 WHEN 260 THEN 701 ELSE 256 + g // 2 % 16 END AS clock_pid,
    array_to_string(list_transform(list_filter(range(256, 272), lambda x: (x + g // 2) % 3 <> 0), lambda x: CASE x WHEN 257 THEN 700 WHEN 260 THEN 701 ELSE x END), ',') AS pids, true AS crc_ok
  FROM maps JOIN g USING (flow_id, g) WHERE i = 4 AND g % 7 <> 3 AND m IS NOT NULL
  UNION ALL SELECT flow_id, recv_us * 16, CASE pid WHEN 257 THEN 700 WHEN 260 THEN 701 ELSE pid END, NULL, NULL, NULL FROM p""", _EPOCHS)
def j3(spark, d):
    moved = programmes.remap_tables(captured(spark, d), {4096: 5000, 257: 700, 260: 701}, "nr")
    moved = stored(moved.withColumn("pid", bits.ts_pid(F.col("cell"))), "remapped")
    found = stored(programmes.sections(programmes.table_parts(moved, "nr"), "nr"), "sections")
    said = programmes.associations(found, "nr", 1)
    maps = found.where("pid <> 0").withColumn("m", tables.stream_map("section")).withColumn("crc_ok", tables.checksum_ok("section"))
    until = F.lead("nr").over(Window.partitionBy("flow_id").orderBy("nr"))
    named = said.withColumn("until", until).where("map_pid IS NOT NULL").select("flow_id", F.col("map_pid").alias("pid"), F.col("nr").alias("since"), "until")
    maps = programmes.within_spans(maps, named, "nr")
    pids = F.array_join(F.transform("m.streams", lambda s: s["pid"].cast("string")), ",")
    read = maps.select("flow_id", "nr", "pid", F.col("m.clock_pid").cast("long").alias("clock_pid"), pids.alias("pids"), "crc_ok")
    others = moved.where("pid NOT IN (0, 4097, 5000)").select("flow_id", "nr", "pid")
    return read.unionByName(others, allowMissingColumns=True)
