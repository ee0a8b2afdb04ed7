"""Small cases whose outcome is known."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidegauge.functions import bits, clock, media, tables
from tidegauge.operators import aggregates, alarms, filters, joins, rewrite, sequence, timers, windows
from tidegauge.sources import datagrams
from tidegauge.operators.sequence import merge_legs
from tidegauge.plans.binding import PCR_WRAP


def merged(spark, script, window=1024):
    rows = [(0, i, leg, i, seq) for i, (seq, leg) in enumerate(script)]
    df = spark.createDataFrame(rows, "flow_id long, recv_leg_us long, leg int, event_id long, seq long").withColumn("vseq", F.col("seq"))
    kept = {r["event_id"] for r in merge_legs(df, window).collect()}
    return [i in kept for i in range(len(script))]


@pytest.mark.parametrize(
    "script,window,want",
    [
        ([(1000, 1), (1000, 2), (1002, 1), (1001, 2), (1002, 2)], 1024, [True, False, True, True, False]),
        ([(65534, 1), (0, 1), (65535, 2), (65535, 1), (1, 1)], 1024, [True, True, True, False, True]),
        ([(50000, 1), (48000, 1)], 1024, [True, False]),
        ([(1000, 1), (6000, 1), (1001, 1)], 16384, [True, True, True]),
        ([(1000, 1), (6000, 1), (1001, 1)], 1024, [True, True, False]),
    ],
)
def test_gap_fill_merge(spark, script, window, want):
    assert merged(spark, script, window) == want


def test_percentile_interpolates(spark):
    df = spark.createDataFrame([(0, x) for x in (0, 10, 20, 30, 40)], "k int, v long")
    got = aggregates.percentiles(df, ["k"], "v", [0.0, 0.5, 0.625, 1.0]).first()
    assert list(got)[1:] == [0, 20, 25, 40]


@pytest.mark.parametrize("want,found", [(450_000, 450_000), (495_000, 450_000), (1 << 40, 810_000), (-5, 0)])
def test_floor_lookup(spark, want, found):
    index = spark.createDataFrame([(0, i * 90_000) for i in range(10)], "k long, pts long")
    target = spark.createDataFrame([(0, want)], "k long, want long")
    assert joins.floor_lookup(target, index, "k", "pts", "want", ["pts"]).first()["found_pts"] == found


def test_delay_factor():
    steady, gap = windows.DelayFactor(500_000), windows.DelayFactor(500_000)
    out = [x for i in range(70) if (x := steady.add(i * 10_000, False))]
    assert out and all(x[2] < 5 for x in out)
    times = [i * 10_000 + (200_000 if i > 20 else 0) for i in range(70)]
    assert max(x[2] for t in times if (x := gap.add(t, False))) > 10


@pytest.mark.parametrize(
    "changes,want",
    [
        ({}, ("healthy", [])),
        ({"bps": 0}, ("critical", ["no_data"])),
        ({"bps": 0, "blocked": True}, ("error", ["bandwidth_blocked"])),
        ({"slots": 3, "stalled": 3}, ("error", ["assembly_all_stalled"])),
        ({"slots": 3, "stalled": 1}, ("warning", ["assembly_slot_stalled"])),
        ({"sync_losses": 1, "p1_ok": False, "lost": 7}, ("critical", ["tr101290_sync_loss", "packet_loss"])),
        ({"lost": 7, "p1_ok": False, "p2_ok": False}, ("error", ["tr101290_p1", "packet_loss", "tr101290_p2"])),
        ({"lost": None, "p1_ok": None, "exceeded": True, "lost_": 0}, ("warning", ["bandwidth_exceeded"])),
    ],
)
def test_health(spark, changes, want):
    good = {"bps": 1000, "lost": 0, "sync_losses": 0, "p1_ok": True, "p2_ok": True, "exceeded": False, "blocked": False, "slots": 0, "stalled": 0}
    schema = "bps long, lost long, sync_losses long, p1_ok boolean, p2_ok boolean, exceeded boolean, blocked boolean, slots long, stalled long"
    row = good | {k: v for k, v in changes.items() if k in good}
    got = alarms.health(spark.createDataFrame([Row(**row)], schema)).first()
    assert (got["health"], got["reasons"]) == want


def test_input_state(spark):
    df = spark.createDataFrame([(1000, 10, True), (0, 10, True), (0, 10, False), (0, 0, False)], "b long, p long, f boolean")
    got = [r[0] for r in df.select(alarms.input_state(F.col("b"), F.col("p"), F.col("f"))).collect()]
    assert got == ["receiving", "connect_failed", "idle", "waiting"]


def test_alarm_machines():
    e = alarms.Escalation(80, 95, 2)
    assert [e.add(x) for x in (81, 50, 81, 96, 96, 96, 85, 10)] == [0, 0, 0, 2, 2, 2, 1, 0]
    h = alarms.Hysteresis(100, 80, inclusive=True)
    assert [h.add(x) for x in (100, 101, 81, 80, 120, None, 90)] == [False, True, True, False, True, False, False]
    two = alarms.Hysteresis(40, 30, 2)
    assert [two.add(x) for x in (41, 41, 35, 30, 29)] == [False, True, True, True, False]


def test_clocks_wrap(spark):
    df = spark.createDataFrame([(5, PCR_WRAP - 5), (PCR_WRAP - 5, 5), (0, 0)], "a long, b long")
    assert [r[0] for r in df.select(clock.signed_pcr_delta(F.col("a"), F.col("b"))).collect()] == [10, -10, 0]
    stamps = spark.createDataFrame([(89, (1 << 33) - 90), ((1 << 33) - 90, 89)], "a long, b long")
    assert [r[0] for r in stamps.select(clock.pts_delta_ms(F.col("a"), F.col("b"))).collect()] == [1, -1]


def test_cell_fields(spark):
    cell = bytearray(188)
    cell[:4] = bytes([0x47, 0x40 | 0x01, 0x00, 0x30 | 7])
    base, ext = 123_456_789, 250
    value = base << 15 | 0x3F << 9 | ext
    cell[4:12] = bytes([7, 0x90]) + value.to_bytes(6, "big")
    df = spark.createDataFrame([(bytes(cell),)], "c binary")
    c = F.col("c")
    got = df.select(bits.ts_pid(c), bits.ts_pusi(c), bits.ts_cc(c), bits.ts_has_payload(c), bits.ts_discontinuity(c), bits.extract_pcr(c)).first()
    assert list(got) == [256, True, 7, True, True, base * 300 + ext]


def test_anchor_passes_seen_gaps_and_bridges_the_rest():
    ms = 27_000
    a = rewrite.PcrAnchor()
    assert [a.rewrite(p, t) for p, t in ((0, 0), (40 * ms, 40_000), (2040 * ms, 2_040_000), (9040 * ms, 2_060_000), (1000 * ms, 3_060_000))] == [
        (0, False), (40 * ms, False), (2040 * ms, True), (2060 * ms, True), (2100 * ms, True)]


def test_realign_holds_audio_for_video():
    r = rewrite.Realign()
    out = [r.add("v0", "video", 90_000, 45_000), r.add("a1", "audio", 90_000 + 151 * 90, None), r.add("d", "data", 0, None), r.add("v1", "video", 90_000 + 90, 45_000), r.add("a2", "audio", 90_000, None)]
    assert out == [["v0"], [], ["d"], ["v1", "a1"], ["a2"]]
    late = rewrite.Realign()
    assert late.add("v", "video", 0, 9_000) == ["v"] and late.add("a", "audio", 9_000 + 120 * 90, None) == ["a"] and late.add("b", "audio", 30_000_000, None) == []
    assert late.drain(True) == ["b"]
    full = rewrite.Realign()
    assert sum(len(full.add(i, "audio", 0, None)) for i in range(515)) == 3


def test_freshness(spark):
    df = spark.createDataFrame([(0, t, v) for t, v in ((0, 10), (50, 10), (100, 10), (150, 11), (160, 3), (249, 3), (250, 3), (260, 4))], "k long, t long, v long")
    assert [r["fresh"] for r in windows.freshness(df, ["k"], "t", "v", 100).orderBy("t").collect()] == [True, True, False, True, True, True, False, True]


def test_time_codes_and_holds(spark):
    day = 86_400 * 25
    df = spark.createDataFrame([(0, i, f) for i, f in enumerate((day - 5, 2, 50, 44, 46, 30, day - 20, 3))], "k long, i long, f long")
    assert [r["i"] for r in windows.timecode_breaks(df, ["k"], "i", "f", day).orderBy("i").collect()] == [3, 5, 7]
    holds = spark.range(1, 7).select(clock.vblank_hold(F.col("id"), F.lit(0.4)).alias("low"), clock.vblank_hold(F.col("id"), F.lit(2.5)).alias("high")).collect()
    assert [r["low"] for r in holds] == [1] * 6 and [r["high"] for r in holds] == [3, 2, 3, 2, 3, 2]


def test_standby_waits_from_the_start(spark):
    rows = [(0, t, leg, i) for i, (t, leg) in enumerate(((0, 1), (100, 1), (201, 1), (210, 0), (300, 1), (500, 1)))]
    df = spark.createDataFrame(rows, "flow_id long, recv_leg_us long, leg int, event_id long")
    assert sorted(r["event_id"] for r in sequence.primary_preference(df, 200).collect()) == [2, 3, 5]


def test_merge_forgets_the_last_lap(spark):
    script = [(i * 900 % 65536, 1) for i in range(150)] + [(150 * 900 % 65536, 1), ((149 * 900 + 100) % 65536, 2)]
    assert merged(spark, script)[-2:] == [True, True]


def test_continuous_types(spark):
    df = spark.createDataFrame([(0x1B, None), (0x1F, None), (0x86, None), (0x33, None), (0x06, None), (0x06, "ac3")], "t int, a string")
    assert [r[0] for r in df.select(filters.is_continuous_media(F.col("t"), F.col("a"))).collect()] == [True, True, False, False, False, True]


def test_leg_conflicts(spark):
    schema = "nic string, source_ip string, gateway string"
    legs = spark.createDataFrame([(1, "eth0", None, None), (2, "eth9", "1.1.1.1", None), (3, None, None, None), (4, "eth8", None, "g"), (5, "eth7", None, "h"), (6, None, None, "h")], f"leg_id long, {schema}")
    busy = spark.createDataFrame([("eth0", None, None), ("eth5", "1.1.1.1", "g")], schema)
    assert {r["leg_id"]: r["reason"] for r in joins.leg_conflicts(legs, busy).collect()} == {1: "nic", 2: "source_ip", 3: "unpinned", 4: "gateway", 6: "unpinned"}
    assert joins.leg_conflicts(legs, busy.limit(0)).count() == 0


def test_alarm_kept_through_missing_values():
    h = alarms.Hysteresis(100, 80, kept=True)
    assert [h.add(x) for x in (101, None, 90, 70)] == [True, True, True, False]


def test_clock_residuals(spark):
    rows = [(0, i, i * 40_000, i * 1_080_000 + (270 if i == 6 else 0) + (54_000_000 if i == 7 else 0)) for i in range(8)]
    got = windows.pcr_accuracy(spark.createDataFrame(rows, "k long, vseq long, recv_us long, pcr27 long"), ["k"]).orderBy("vseq").collect()
    assert [r["residual_ns"] for r in got] == [None] * 4 + [0, 0, 10_000, None]


def test_table_checksum_and_round_trips(spark):
    assert tables.crc32_mpeg(b"123456789") == 0x0376E6E7
    pat = tables.association_cell([(0, 16), (1, 0x1000), (2, 0x1FFE)], 3, 1)
    assert tables.programs(pat) == [(1, 0x1000), (2, 0x1FFE)] and len(pat) == 188
    streams = [(0x1B, 0x100, b""), (0x06, 0x101, bytes([0x6A, 0])), (0x0F, 0x102, bytes([0x0A, 4]) + b"DEU\0"), (0x06, 0x103, bytes([0x56, 0]) * 80)]
    cell = tables.map_cell(7, 0x1000, 0x100, streams, 33, 0)
    assert tables.program_map(cell) == (7, 1, 0x100, [*streams[:3], (0x06, 0x103, b"")])
    shifted = pat[:3] + bytes([0x30, 3, 0, 0xFF, 0xFF]) + pat[4:184]
    assert tables.programs(shifted) == tables.programs(pat)
    broken = pat[:9] + bytes([pat[9] ^ 1]) + pat[10:]
    df = spark.createDataFrame([(pat,), (shifted,), (cell,), (broken,), (pat[:4] + b"\0\2" + pat[6:],), (b"G" * 188,), (None,)], "c binary")
    assert [r[0] for r in df.select(tables.crc_ok("c")).collect()][:4] == [True, True, True, False]
    assert [r[0] for r in df.select(tables.pmt("c")).collect()][0]["program"] is None
    kinds = [bytes([0x05, 4]) + b"Opus", bytes([0x0A, 4]) + b"eng\0" + bytes([0x7A, 0]), bytes([0x7F, 1, 0x15]), bytes([0x6A, 9]), b"", bytes([0x59, 0]), None]
    d = spark.createDataFrame([(k,) for k in kinds], "d binary")
    got = [tuple(r) for r in d.select(tables.audio_kind("d"), tables.language("d"), tables.is_text_service("d")).collect()]
    assert got == [("opus", None, False), ("eac3", "eng", False), ("ac4", None, False), (None, None, False), (None, None, False), (None, None, True), (None, None, False)]


def test_pcm_and_channels(spark):
    df = spark.createDataFrame([(bytes.fromhex("7fff8000c0000000"),), (b"\0",), (b"",)], "d binary")
    got = [r[0] for r in df.select(media.decode_pcm(F.col("d"), 16, 2)).collect()]
    assert got == [[[32767 / 32768, -0.5], [-1.0, 0.0]], None, [[], []]]
    three = spark.createDataFrame([(bytes.fromhex("800000400000"),)], "d binary")
    assert three.select(media.decode_pcm(F.col("d"), 24, 1), media.decode_pcm(F.col("d"), 20, 1)).first()[:] == ([[-1.0, 0.5]], [[-1.0, 0.5]])
    planes = spark.createDataFrame([([[1.0, 0.5], [0.0, -0.5]],)], "p array<array<double>>")
    mono, wrong = planes.select(media.mix_channels(F.col("p"), "stereo_to_mono_6db"), media.mix_channels(F.col("p"), "5_1_to_stereo_bs775")).first()
    assert mono == [[0.5, 0.0]] and wrong is None


def test_names_tags_and_hex(spark):
    df = spark.createDataFrame([(["A", "B-1", "A"], "0aFF"), (["a"], "abc"), (["X" * 33], "zz"), ([], "")], "t array<string>, h string")
    got = [tuple(r) for r in df.select(media.clip_tags(F.col("t")), media.hex_decode(F.col("h")), media.hex_encode(F.unhex("h"))).collect()]
    assert [g[0] for g in got] == [["A", "B-1"], None, None, []] and [g[1] for g in got] == [b"\x0a\xff", None, None, b""]
    sizes = spark.createDataFrame([(1920, 1080, 1, 1), (720, 576, 16, 15), (480, 271, 0, 0), (100, 30, 1, 1), (0, 5, 1, 1)], "w int, h int, sw int, sh int")
    assert [r[0] for r in sizes.select(media.aspect_ratio("w", "h", "sw", "sh")).collect()] == ["16:9", "4:3", "16:9", "10:3", None]
    assert [r[0] for r in spark.createDataFrame([(9,), (3,)], "c int").select(media.primaries_name(F.col("c"))).collect()] == ["bt2020", "unspecified"]


def test_critical_units_straddle(spark):
    df = spark.createDataFrame([(b"\0\0\1\x65", None), (b"\0\0\0\1\x02", None), (b"\1\x67", b"x\0\0"), (b"\x67", b"\0\0\1"), (b"\0\0\1", None), (b"\0\0\1\x26", None)], "d binary, b binary")
    assert [r[0] for r in df.select(media.critical_with_carry(F.col("d"), F.col("b"))).collect()] == [True, False, True, False, False, True]


def test_drain_rate():
    r = timers.DrainRate(100, 50)
    assert [r.measure(p, 1000) for p in (0, 270_000, 540_000, None, 1_080_000, 100)] == [0, 800_000, 800_000, 800_000, 800_000, 800_000]
    assert r.due(1000, 10, 0) == 10_000 and r.due(1000, 20, 0) == 10_000 + 8_000_000_000 // 840_000


def test_recording_is_written_and_found(spark, tmp_path):
    cells = spark.createDataFrame([(i % 2, i * 10_000, i * 900 if i % 4 < 2 else None) for i in range(400)], "flow_id long, recv_us long, pts90 long")
    parts = datagrams.segmented(cells, ["flow_id"], "recv_us", 1_000_000)
    datagrams.write_recording(parts, str(tmp_path), ["flow_id"], "recv_us")
    back = spark.read.parquet(f"{tmp_path}/cells")
    assert back.count() == 400 and back.where("flow_id = 1 AND segment_id = 2").count() == 50
    index = spark.read.parquet(f"{tmp_path}/index")
    found = joins.floor_lookup(spark.createDataFrame([(0, 90_100)], "flow_id long, want long"), index, "flow_id", "pts90", "want", ["segment_id", "byte_offset"]).first()
    assert (found["found_segment_id"], found["found_byte_offset"]) == (1, 0)
    sizes = spark.createDataFrame([(0, s, 100) for s in range(5)], "flow_id long, segment_id long, bytes long")
    assert {r["segment_id"] for r in datagrams.retained(sizes, ["flow_id"], 250).where("keep").collect()} == {3, 4}
    assert {r["segment_id"] for r in datagrams.retained(sizes, ["flow_id"], 50).where("keep").collect()} == {4}


def test_capture_streams(spark, tmp_path):
    rows = [(0, 0, i, bytes([0x80, 33]) + i.to_bytes(2, "big") + bytes(8) + bytes([0x47, 1, i, 0x10 | i]) + bytes(184)) for i in range(5)] + [(0, 0, 9, b"no"), (0, 0, 9, bytes([0x8F, 33]) + bytes(20))]
    spark.createDataFrame(rows, datagrams.CAPTURE).write.parquet(str(tmp_path / "c"))
    want = sorted(tuple(r) for r in datagrams.transport_cells(datagrams.rtp_packets(datagrams.read_capture(spark, str(tmp_path / "c")))).select("seq", "pid", "cc").collect())
    assert want == [(i, 256 + i, i) for i in range(5)]
    stream = datagrams.transport_cells(datagrams.rtp_packets(datagrams.read_capture_stream(spark, str(tmp_path / "c")))).select("seq", "pid", "cc")
    q = stream.writeStream.format("memory").queryName("captured").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("captured").collect()) == want
