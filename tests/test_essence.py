"""Headers, ancillary data, cues and manifests: small cases whose outcome is known."""

from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import ancillary, essence, tables
from tidegauge.sources import datagrams, export


def one(spark, data, column):
    return spark.createDataFrame([(data,)], "d binary").select(column(F.col("d")).alias("x")).first()["x"]


@pytest.mark.parametrize("data,want", [(b"\x80", 0), (b"\x40", 1), (b"\x10\x00", 7)])
def test_unsigned_codes(data, want):
    assert essence.Bits(data).unsigned() == want


def test_signed_codes_and_the_end():
    b = essence.Bits(0b1_010_011_00100_00101.to_bytes(3, "big"))
    b.read(7)
    assert [b.signed() for _ in range(5)] == [0, 1, -1, 2, -2]
    with pytest.raises(EOFError):
        b.read(1)


def test_h264_parameters(spark):
    # High profile, level 3.1, 1280x720 at 25 pictures a second, with escapes
    unit = bytes.fromhex("6764001facd9405005bb011000000300100000030320f1831960")
    got = essence.parameters_of(b"\0\0\0\1\x09\xf0\0\0\0\1" + unit + b"\0\0\1\x68\xee")
    assert got == (1280, 720, 25.0, "High", "3.1") and essence.parameters_of(unit) == got
    assert essence.parameters_of(unit[:6]) is None and essence.parameters_of(b"") is None and essence.parameters_of(None) is None
    assert tuple(one(spark, unit, essence.picture_parameters)) == got


def code(value):
    digits = f"{value + 1:b}"
    return "0" * (len(digits) - 1) + digits


def h265_unit(below=0, told=(), chroma=1, window=None, scaling="0", tools="000", sets=None, long_term="0", vui="0"):
    """A parameter set as its bits, written field by field."""
    bits = "0000" + f"{below:03b}" + "1" + "00" + "1" + "00010" + "0" * 80 + f"{123:08b}"
    if below:
        bits += "".join(told) + "00" * (8 - below) + "".join("1" * (88 * int(t[0]) + 8 * int(t[1])) for t in told)
    bits += code(0) + code(chroma) + ("0" if chroma == 3 else "") + code(1920) + code(1088)
    bits += "1" + "".join(map(code, window)) if window else "0"
    bits += code(2) * 2 + code(4) + "1" + code(3) * 3 * (below + 1) + code(0) * 6 + scaling + tools + (sets or code(0)) + long_term + "11" + vui
    data = int(bits + "1" + "0" * (-len(bits) - 1 & 7), 2).to_bytes((len(bits) + 8) // 8, "big")
    escaped, zeros = b"\x42\1", 0
    for byte in data:
        if zeros >= 2 and byte < 4:
            escaped, zeros = escaped + b"\3", 0
        escaped, zeros = escaped + bytes([byte]), zeros + 1 if byte == 0 else 0
    return escaped


RATE = "1" + "1" + "11111111" + "0" * 32 + "11" + "1" + "0" * 4 + "1" + "0" * 24 + "1" + "11" + "000" + "1" + "1" * 4 + "1" + f"{1001:032b}{60000:032b}"
SETS = code(4) + code(1) + code(2) + code(0) + "1" + code(1) + "1" + code(0) + "0" + "1" + "1" + code(0) + "1" + "01" + "00" + "1" + "0" + code(0) * 2 + "1" + "0" + code(4) + "1"
LISTS = "11" + ("0" + code(0)) * 5 + "1" + code(3) * 16 + ("0" + code(1)) * 5 + "1" + code(2) * 64 + ("0" + code(0)) * 5 + "1" + code(1) * 65 + "0" + code(0) + "1" + code(0) * 65


@pytest.mark.parametrize("fields,want", [
    ({}, (1920, 1088, None)), ({"window": (0, 0, 0, 4)}, (1920, 1080, None)), ({"chroma": 2, "window": (1, 2, 3, 4)}, (1914, 1081, None)),
    ({"chroma": 3, "window": (1, 2, 3, 4), "vui": RATE}, (1917, 1081, 60000 / 1001)), ({"vui": RATE, "below": 2, "told": ("10", "11")}, (1920, 1088, 60000 / 1001)),
    ({"vui": RATE, "scaling": LISTS}, (1920, 1088, 60000 / 1001)), ({"vui": RATE, "tools": "111" + "0" * 8 + code(1) * 2 + "1"}, (1920, 1088, 60000 / 1001)),
    ({"vui": RATE, "sets": SETS, "long_term": "1" + code(2) + "010101011" * 2}, (1920, 1088, 60000 / 1001)), ({"vui": RATE[:-40]}, (1920, 1088, None)),
])
def test_h265_parameters(fields, want):
    stream = b"\0\0\0\1\x40\1\x0c\0\0\1" + h265_unit(**fields) + b"\0\0\1\x44\1"
    assert essence.h265_parameters_of(stream) == (*want, "Main 10", "4.1")


def test_h265_sets_that_end_early():
    unit = h265_unit()
    assert all(essence.h265_parameters_of(unit[:n]) is None for n in range(18)) and essence.h265_parameters_of(None) is None
    assert essence.h265_parameters_of(b"\0\0\1\x67\x64\0\x1f\xac") is None


def test_mpeg2_extension():
    head = b"\0\0\1\xb3" + ((3840 - 4096 * 0) << 20 | 64 << 8 | 0x13).to_bytes(4, "big") + b"\xff\xff\xe0\0"
    extension = b"\0\0\1\xb5" + (1 << 20 | 0x44 << 12 | 1 << 11 | 1 << 9 | 0 << 7 | 1 << 5).to_bytes(3, "big") + bytes(4)
    assert essence.parameters_of(head) == (3840, 64, 25.0, "Main", "Main")
    assert essence.parameters_of(head + extension) == (3840, 64 + 4096, 25.0, "Main", "High")


def test_audio_headers_of_other_bytes(spark):
    for data in (None, b"", b"\xff", b"\xff\xf1\x50\x80\0\0", b"\0" * 9):
        assert one(spark, data, essence.adts) is None and one(spark, data, essence.loas) is None
    assert tuple(one(spark, b"\xff\xf1\x50\x80\0\0\0", essence.adts)) == (44100, 2, "AAC-LC")
    assert tuple(one(spark, b"\xff\xfd\x84\xc0", essence.mpeg_audio)) == (48000, 1, "MPEG-1 Layer II")


def test_cues(spark):
    signal = b"\xfc\0\x13\0" + bytes(6) + b"\0\0\5\x06" + b"\x80\0\0\0\1" + bytes(6)
    assert tuple(one(spark, signal, ancillary.cue)) == ("time_signal", 1)
    assert tuple(one(spark, signal[:16], ancillary.cue)) == ("time_signal", None)
    assert tuple(one(spark, signal[:13] + b"\xfe", ancillary.cue)) == ("unknown", None)
    assert tuple(one(spark, b"", ancillary.cue)) == ("unknown", None) and tuple(one(spark, None, ancillary.cue)) == ("unknown", None)


def test_damaged_section_gives_no_message(spark):
    args = [F.lit("start"), F.lit(7), F.lit(1500), F.lit(30_000), F.lit(True)]
    whole = spark.range(1).select(ancillary.splice_section(*args, F.lit(90_000)).alias("s")).first()["s"]
    assert tables.crc32_mpeg(bytes(whole)) == 0
    told = lambda data: one(spark, bytes(data), lambda c: ancillary.splice_message(c, F.lit(90_000)))
    assert tuple(told(whole)) == ("start", 7, 1500, 30_000, True)
    assert told(whole[:-1]) is None and told(whole[:20] + b"\x55" + whole[21:]) is None


def test_messages_of_several_operations():
    request = b"\1\0\0\0\x2a\0\0\x03\xe8\0\x32\0\0\1"
    skipped, asked = b"\1\4\0\1\xaa", b"\1\1\0\x0e" + request
    head = b"\xff\xff\0\0\0\0\0\0\0\0"
    want = ("start", 42, 1000, 5000, True)
    assert ancillary.message_of(head + b"\0\2" + skipped + asked) == want
    assert ancillary.message_of(head + b"\2\0\0\0\0\2" + skipped + asked) == want
    assert ancillary.message_of(b"\1\1" + bytes(11) + request) == want
    assert ancillary.message_of(head + b"\0\1" + skipped)[0] == "other:260"
    assert ancillary.message_of(head + b"\0\1" + asked[:-1]) is None and ancillary.message_of(head + b"\7\1" + asked) is None and ancillary.message_of(b"\1") is None


def test_ancillary_packets():
    packet = dict(color_difference=True, line_number=9, horizontal_offset=100, stream_flag=False, stream_num=3, did=0x61, sdid=1, user_data=bytes(range(20)))
    data = ancillary.packed([packet, packet | {"user_data": b""}], 5, 2)
    assert ancillary.unpacked(data) == [packet, packet | {"user_data": b""}]
    assert data[:8] == b"\0\5" + (len(data) - 8).to_bytes(2, "big") + b"\2\x80\0\0" and len(data) % 4 == 0
    assert ancillary.unpacked(data[:-4]) is None and ancillary.unpacked(data[:4] + b"\3" + data[5:]) is None and ancillary.unpacked(b"") is None
    assert [ancillary.with_parity(b) for b in (0, 1, 3)] == [0x200, 0x101, 0x203] and ancillary.checksum([0x1FF, 1]) == 0x200


def test_short_captions(spark):
    rows = [(97, 1, b"\x72" * 7), (97, 2, b"ab"), (97, 3, b"\0" * 9), (97, 1, b"\0" * 7 + b"\x72"), (97, 2, b"abcdef"), (97, 1, b"")]
    df = spark.createDataFrame(rows, "did int, sdid int, user_data binary").select(ancillary.captions(F.struct("did", "sdid", "user_data")).alias("c"))
    assert [r["c"] and tuple(r["c"]) for r in df.collect()] == [None, None, None, ("cea708", 0, 8), ("cea608", 2, 6), None]


def test_manifest_without_audio(spark):
    row = spark.sql("""SELECT 0L AS start_s, 0.5D AS target_s, 0L AS latest, 3L AS available, 0.0D AS offset_s, named_struct('codecs', 'avc1.640020', 'width', 1920, 'height', 1080, 'frame_rate', '30000/1001', 'timescale', 90000, 'bandwidth', 5000000L) AS video,
      cast(null as struct<codecs:string,channels:int,sample_rate:int,bandwidth:long>) AS audio""")
    text = row.select(export.dash_manifest().alias("m")).first()["m"]
    assert 'availabilityStartTime="1970-01-01T00:00:00Z"' in text and 'minimumUpdatePeriod="PT1.0S"' in text and 'minBufferTime="PT2.0S"' in text and 'timeShiftBufferDepth="PT30S"' in text
    assert "audio" not in text and "availabilityTimeOffset" not in text
    shown = ElementTree.fromstring(text).find(".//{*}Representation")
    assert shown.get("frameRate") == "30000/1001" and {k: shown.find("{*}SegmentTemplate").get(k) for k in ("duration", "startNumber", "timescale")} == {"duration": "45000", "startNumber": "1", "timescale": "90000"}


def test_replay_of_a_clip(spark):
    cells = spark.createDataFrame([(1, n * 3600) for n in range(10)], "flow_id long, pts long")
    clips = spark.createDataFrame([(5, 1, 7200, 14400), (6, 1, 9, 3), (7, 2, 0, 100)], "clip_id long, flow_id long, start_pts long, to_pts long")
    got = datagrams.replayed(cells, clips, ["flow_id"], "pts", F.lit(0.5), 5000).orderBy("pts").collect()
    assert [(r["clip_id"], r["pts"], r["due_us"]) for r in got] == [(5, 7200, 0), (5, 10800, 80_000), (5, 14400, 160_000)]
