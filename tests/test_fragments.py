"""Media segments read back by a plain parser of boxes."""

import os
import struct
import tempfile

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import fragments

HOLDERS = {"moov", "trak", "mdia", "minf", "stbl", "dinf", "mvex", "moof", "traf"}


def boxes(data, at=0, end=None):
    """(name, start of body, end) of every box, holders before what they hold."""
    end = len(data) if end is None else end
    while at < end:
        size, name = struct.unpack(">I4s", data[at : at + 8])
        assert 8 <= size <= end - at
        yield name.decode(), at + 8, at + size
        if name.decode() in HOLDERS:
            yield from boxes(data, at + 8, at + size)
        at += size


def samples_of(data):
    """(decode time, composition time, duration, sync, bytes) of a fragment, and its number."""
    found = {n: (a, b) for n, a, b in boxes(data)}
    start = next(a - 8 for n, a, _ in boxes(data) if n == "moof")
    number = struct.unpack(">I", data[found["mfhd"][0] + 4 :][:4])[0]
    time = struct.unpack(">Q", data[found["tfdt"][0] + 4 :][:8])[0]
    head, count, offset = struct.unpack(">IIi", data[found["trun"][0] :][:12])
    assert head == 0x01000F01 and found["tfhd"][1] - found["tfhd"][0] == 8 and found["trun"][1] - found["trun"][0] == 12 + 16 * count
    at, out = start + offset, []
    assert at == found["mdat"][0]
    for i in range(count):
        duration, size, flags, shift = struct.unpack(">IIIi", data[found["trun"][0] + 12 + 16 * i :][:16])
        out.append((time, time + shift, duration, flags == 0x02000000, data[at : at + size]))
        time, at = time + duration, at + size
    assert at == found["mdat"][1]
    return number, out


def table(spark):
    rows = [(1, s, 1 << 40 | s * 9000 + n * 3000, 3000, [6000, -3000, None][n], n == 0, bytes([s, n]) * (n + s)) for s in range(3) for n in range(3)]
    return rows, spark.createDataFrame(rows, "flow_id long, segment_id long, dts long, duration long, offset long, key boolean, data binary")


def test_samples_read_back(spark):
    rows, df = table(spark)
    got = fragments.media_segments(df.repartition(5), ["flow_id"]).orderBy("segment_id").collect()
    for s, r in enumerate(got):
        number, samples = samples_of(bytes(r["data"]))
        assert (number, r["first_dts"], r["duration"], r["samples"]) == (s + 1, rows[s * 3][2], 9000, 3)
        assert samples == [(t, t + (o or 0), d, k, x) for _, g, t, d, o, k, x in rows if g == s]
        assert [n for n, _, _ in boxes(bytes(r["data"]))] == ["styp", "moof", "mfhd", "traf", "tfhd", "tfdt", "trun", "mdat"]
    assert fragments.media_segments(df.limit(0), ["flow_id"]).count() == 0


@pytest.mark.parametrize("video", [True, False])
def test_what_comes_before(video):
    entry = fragments.video_entry(1280, 720, b"\x01\x64\0\x1f") if video else fragments.audio_entry(2, 48_000, b"\x11\x90")
    data = fragments.init_segment(entry, 90_000, video, 1280, 720)
    found = {n: (a, b) for n, a, b in boxes(data)}
    assert {"ftyp", "mvhd", "tkhd", "mdhd", "hdlr", "stsd", "stts", "stsc", "stsz", "stco", "trex"} <= set(found)
    sizes = {n: b - a for n, (a, b) in found.items()}
    assert (sizes["mvhd"], sizes["tkhd"], sizes["mdhd"], sizes["trex"]) == (100, 84, 24, 24)
    assert struct.unpack(">I", data[found["mdhd"][0] + 12 :][:4])[0] == 90_000
    body = data[found["stsd"][0] + 8 : found["stsd"][1]]
    assert body == entry and len(list(boxes(entry))) == 1
    if video:
        assert struct.unpack(">HH", entry[32:36]) == (1280, 720) and entry[86:].startswith(struct.pack(">I4s", 12, b"avcC"))
        assert struct.unpack(">II", data[found["tkhd"][1] - 8 :][:8]) == (1280 << 16, 720 << 16)
    else:
        assert struct.unpack(">HH", entry[24:28]) == (2, 16) and struct.unpack(">H", entry[32:34])[0] == 48_000 and entry[36:44] == struct.pack(">I4s", len(entry) - 36, b"esds")


def test_files_appear_whole(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    _, df = table(spark)
    fragments.write_segments(fragments.media_segments(df, ["flow_id"]), folder, "seg", "flow_id")
    assert sorted(os.listdir(f"{folder}/1")) == ["seg-00001.m4s", "seg-00002.m4s", "seg-00003.m4s"]
    with open(f"{folder}/1/seg-00002.m4s", "rb") as f:
        assert samples_of(f.read())[0] == 2


def test_a_failed_job_leaves_nothing(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    fragments.register(spark)
    rows = spark.createDataFrame([("a.m4s", b"x"), ("b.m4s", b"y")], "name string, data binary").repartition(1)
    with pytest.raises(Exception, match="outside"):
        rows.unionByName(rows.withColumn("name", F.lit("../../c"))).coalesce(1).write.format("named_files").option("path", folder).mode("append").save()
    assert not [f for f in os.listdir(folder) if f.endswith(".m4s")]
