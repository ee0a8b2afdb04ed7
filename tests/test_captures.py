"""Capture files and transport streams: every way to split a file gives the same rows."""

import os
import random
import struct
import tempfile

import pytest

from tidegauge.sources import captures


@pytest.fixture(scope="module")
def sources(spark):
    captures.register(spark)
    return spark


def cells(n, seed=0):
    rng = random.Random(seed)
    return [b"\x47" + bytes([i >> 8, i & 255]) + bytes(rng.choices([0x47, 0, 1, 0xFF], k=185)) for i in range(n)]


def cells_read(spark, folder, split):
    return sorted((os.path.basename(r["file"]), r["place"], bytes(r["cell"])) for r in spark.read.format("transport_stream").option("splitBytes", split).load(folder).collect())


def test_cells_of_files(sources):
    folder = tempfile.mkdtemp(prefix="spark-")
    a, b = cells(50, 1), cells(30, 2)
    for name, data in (("a.ts", b"".join(a)), ("b.ts", b"junk" * 5 + b"".join(b[:20]) + b"\x00" * 77 + b"".join(b[20:]) + b"\x47cut"), ("empty.ts", b""), ("other.txt", b"\x47" * 1000)):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    want = [("a.ts", i * 188, c) for i, c in enumerate(a)] + [("b.ts", 20 + i * 188 + 77 * (i >= 20), c) for i, c in enumerate(b)]
    whole = cells_read(sources, folder, 1 << 30)
    # the last cell before a break isn't followed by another, so it isn't in step
    assert set(whole) <= set(want) and set(want) - set(whole) <= {want[50 + 19], want[-1]}
    for split in (100, 188, 1000, 5555):
        assert cells_read(sources, folder, split) == whole


def frame(payload, port=5000, address=b"\xef\x01\x02\x03", vlan=b"", proto=17, fragment=0):
    udp = struct.pack(">HHHH", 1, port, 8 + len(payload), 0) + payload
    return bytes(12) + vlan + b"\x08\0" + struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(udp), 0, fragment, 64, proto, 0, bytes(4), address) + udp


def pcap(records, order="<", link=1):
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65_535, link)
    return out + b"".join(struct.pack(order + "IIII", t // 10**6, t % 10**6, len(f), len(f)) + f for t, f in records)


@pytest.mark.parametrize("order", ["<", ">"])
def test_datagrams_of_captures(sources, order):
    rng = random.Random(7)
    sent = [(1_700_000_000_000_000 + i * 1777, bytes(rng.choices([0, 1, 255, 0x47], k=rng.randint(0, 400)))) for i in range(200)]
    records = [(t, frame(d, vlan=b"\x81\0\0\5" if i % 3 == 0 else b"")) for i, (t, d) in enumerate(sent)]
    noise = [(sent[0][0], frame(b"tcp", proto=6)), (sent[0][0], frame(b"part", fragment=0x2000)), (sent[0][0], b"short"), (sent[0][0], bytes(12) + b"\x08\x06" + bytes(40))]
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/x.pcap", "wb") as f:
        f.write(pcap([*records[:100], *noise, *records[100:]], order))
    want = sorted(("239.1.2.3", 5000, t, d) for t, d in sent)
    for split in (1 << 30, 97, 1000, 20_000):
        got = sources.read.format("pcap").option("splitBytes", split).load(folder).collect()
        assert sorted((r["address"], r["port"], r["recv_us"], bytes(r["data"])) for r in got) == want, split


def test_what_is_written_reads_back(sources):
    folder = tempfile.mkdtemp(prefix="spark-") + "/new"
    rows = [(f"239.0.0.{i % 7}", 5000 + i % 3, 10**15 + i, bytes([i % 256]) * (i % 50)) for i in range(500)]
    df = sources.createDataFrame(rows, "address string, port int, recv_us long, data binary")
    df.repartition(4).write.format("pcap").option("path", folder).mode("append").save()
    assert len([f for f in os.listdir(folder) if f.endswith(".pcap")]) == 4 and not [f for f in os.listdir(folder) if f.endswith(".tmp")]
    got = sources.read.format("pcap").option("splitBytes", 2048).load(folder).collect()
    assert sorted((r["address"], r["port"], r["recv_us"], bytes(r["data"])) for r in got) == sorted(rows)


def test_what_is_no_capture(sources):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/x.pcap", "wb") as f:
        f.write(b"not a capture file at all")
    with pytest.raises(Exception, match="isn't a capture file"):
        sources.read.format("pcap").load(folder).collect()
    with pytest.raises(ValueError, match="mounted"):
        captures.local_path("s3://bucket/x")
    assert captures.local_path("file:///a/b") == captures.local_path("file:/a/b") == "/a/b"


def test_ranges_of_a_large_file_are_bounded(sources):
    """Many times the ranges: they get longer, cover each byte once, and give the same rows."""
    folder = tempfile.mkdtemp(prefix="spark-")
    sent = [(1000 * i, frame(bytes([i & 255]) * (20 + i % 50))) for i in range(2000)]
    with open(f"{folder}/a.pcap", "wb") as f:
        f.write(pcap(sent))
    size = os.path.getsize(f"{folder}/a.pcap")
    cut = captures.ranges(folder, ".pcap", 16)
    assert size > 16 * 4 * captures.MOST_RANGES and len(cut) <= captures.MOST_RANGES + 1
    assert [r.start for r in cut] == [0, *[r.end for r in cut[:-1]]] and cut[-1].end == size
    read = lambda split: sorted((r["recv_us"], bytes(r["data"])) for r in sources.read.format("pcap").option("splitBytes", split).load(folder).collect())
    assert read(1 << 12) == sorted((t, f[42:]) for t, f in sent)


def test_windows_go_back(tmp_path):
    data = random.Random(3).randbytes(100_000)
    (tmp_path / "a").write_bytes(data)
    with open(tmp_path / "a", "rb") as file:
        window = captures._Window(file, 10, 4096)
        assert all(window.get(at, 100) == data[at : at + 100] for at in (10, 50_000, 11, 99_990, 20_000))
