"""Programme tables over cells: sections, filters, roles and pids, with bytes made elsewhere where there are any."""

import pytest

from tidegauge.functions import tables
from tidegauge.operators import programmes

#: Association table and map that a common muxer writes: programme 1 on pid 4096, video on 256, audio on 257.
PAT = bytes.fromhex("00b00d0001c100000001f0002ab104b2")
PMT = bytes.fromhex("02b0170001c10000e100f0001be100f0000fe101f0002f44b99b")


def cell(pid, cc, payload, begins=True, room=184):
    """``payload`` in a cell, with an adaptation field that leaves ``room`` bytes."""
    head = bytes([0x47, (0x40 if begins else 0) | pid >> 8, pid & 255, (0x10 if room == 184 else 0x30) | cc & 15])
    if room < 184:
        head += bytes([183 - room]) + (b"\0" + b"\xff" * (182 - room) if room < 183 else b"")
    return (head + payload).ljust(188, b"\xff")


def frame(spark, cells):
    rows = [(1, n, (c[1] & 0x1F) << 8 | c[2], c[3] & 15, bool(c[1] & 0x40), c) for n, c in enumerate(cells)]
    return spark.createDataFrame(rows, "flow_id long, nr long, pid int, cc int, pusi boolean, cell binary")


def found(spark, cells, checked=True):
    df = frame(spark, cells)
    return [(r["pid"], r["nr"], r["section"]) for r in programmes.sections(programmes.section_parts(df, "nr", checked), "nr").orderBy("nr").collect()]


def long_section(size, table_id=2):
    body = bytes([table_id]) + (0xB000 | size - 3).to_bytes(2, "big") + bytes(range(256)) * 5
    body = body[: size - 4]
    return body + tables.crc32_mpeg(body).to_bytes(4, "big")


def split(section, pid=32, cc=0, pointer=0):
    whole = bytes([pointer]) + b"\xaa" * pointer + section
    return [cell(pid, cc + i // 184, whole[i : i + 184], i == 0) for i in range(0, len(whole), 184)]


def test_foreign_bytes():
    assert tables.crc32_mpeg(PAT) == 0 and tables.crc32_mpeg(PMT) == 0
    assert tables.listed_programs(PAT) == [(1, 4096)]
    assert tables.mapped_streams(PMT) == (1, 0, 256, [(0x1B, 256, b""), (0x0F, 257, b"")])
    moved = tables.with_mapped_pids(PMT, {256: 700, 257: 4096})
    assert tables.crc32_mpeg(moved) == 0 and tables.mapped_streams(moved) == (1, 0, 700, [(0x1B, 700, b""), (0x0F, 4096, b"")])
    assert tables.listed_programs(tables.with_mapped_pids(PAT, {4096: 33})) == [(1, 33)]
    assert tables.with_mapped_pids(PAT, {}) == PAT and tables.with_mapped_pids(b"\x42" + PAT[1:], {4096: 33}) == b"\x42" + PAT[1:]
    body = PAT[:-4]
    assert tables.cells_of(0, 3, body) == [cell(0, 3, b"\0" + PAT)] == [tables.association_cell([(1, 4096)], 0, 3)]


@pytest.mark.parametrize("size,pointer", [(16, 0), (183, 0), (184, 0), (400, 0), (400, 20), (180, 100)])
def test_sections_across_cells(spark, size, pointer):
    section = long_section(size)
    cells = split(section, pointer=pointer)
    assert found(spark, cells) == [(32, len(cells) - 1, section)]


def test_a_header_across_cells(spark):
    section = long_section(20)
    cells = [cell(32, 0, b"\0" + section[:1], room=2), cell(32, 1, section[1:2], False, room=1), cell(32, 2, section[2:], False)]
    assert found(spark, cells) == [(32, 2, section)]


def test_what_is_given_up(spark):
    section = long_section(400)
    a, b, c = split(section)
    assert found(spark, [a, c]) == [] and found(spark, [b, c]) == []
    assert found(spark, [a, a, b, b, c]) == [(32, 4, section)]
    assert len(found(spark, [a, c], checked=False)) == 0 and len(found(spark, [a, c, c], checked=False)) == 1
    assert found(spark, [a, *split(section, cc=1)]) == [(32, 3, section)]
    assert found(spark, [cell(32, 0, bytes([200]) + section)]) == []
    six = 6 * 184 - 1
    assert found(spark, split(long_section(900))) and not found(spark, split(long_section(six - 100)))  # the sixth cell goes beyond the cap
    assert found(spark, []) == []


def programme(n, pid, version, streams, cc, clock=256):
    return tables.map_cell(n, pid, clock, [(0x1B if p % 2 == 0 else 0x0F, p, b"") for p in streams], version, cc)


def test_a_programme_that_moves(spark):
    es = lambda pid: cell(pid, 0, b"\0\0\1", begins=False)
    cells = [
        es(256), tables.association_cell([(1, 32), (2, 48)], 0, 0, stream=9), es(256), programme(1, 32, 0, [256, 257], 0), programme(2, 48, 0, [300], 0), es(256), es(257), es(300),
        programme(1, 32, 0, [259], 1), es(259), es(257), programme(1, 32, 1, [258], 2), es(257), es(258), es(256),
        tables.association_cell([(1, 33), (2, 48)], 1, 1, stream=9), es(258), programme(1, 32, 5, [257], 3), programme(1, 33, 1, [257], 0), es(257), es(258),
        tables.association_cell([(2, 48)], 2, 2), es(257), programme(1, 33, 2, [257], 1), tables.association_cell([(1, 33)], 3, 3, stream=9), programme(1, 33, 2, [257], 2), es(257),
    ]
    got = programmes.filter_programme(frame(spark, cells), 1, "nr").orderBy("nr").collect()
    assert [r["nr"] for r in got] == [1, 3, 5, 6, 8, 10, 11, 13, 14, 15, 18, 19, 24, 25, 26]
    assert all(bytes(r["cell"]) == cells[r["nr"]] for r in got if r["pid"])
    assert [bytes(r["cell"]) for r in got if r["pid"] == 0] == [tables.association_cell([(1, p)], 0, n, stream=9) for n, p in enumerate([32, 33, 33])]
    assert programmes.filter_programme(frame(spark, cells).limit(0), 1, "nr").count() == 0


def test_roles_by_type_and_descriptor(spark):
    streams = [(0x06, 40, b"\x56\x01\0"), (0x06, 41, b""), (0x06, 42, b"\x6a\x01\0"), (0x1B, 43, b""), (0x24, 44, b"")]
    cells = [tables.association_cell([(7, 32)], 0, 0), tables.map_cell(7, 32, 43, streams, 0, 0), tables.map_cell(7, 32, 43, [(0x81, 50, b""), *streams[:2]], 1, 1), tables.map_cell(7, 32, 43, streams[:2], 2, 2)]
    df = frame(spark, cells)
    sections = programmes.sections(programmes.table_parts(df, "nr"), "nr")
    held = programmes.roles(programmes.stream_maps(sections, programmes.associations(sections, "nr", None), "nr"), "nr")
    assert [(r["nr"], r["until"], r["video"], r["audio"]) for r in held.orderBy("nr").collect()] == [(1, 2, 43, 42), (2, 3, None, 50), (3, None, None, 41)]
    rows = spark.createDataFrame([(1, 42, 0), (1, 42, 1), (1, 43, 1), (1, 43, 2), (1, 50, 2), (1, 50, 3), (1, 41, 9)], "flow_id long, pid long, nr long")
    assert [r["role"] for r in programmes.with_roles(rows, held, "nr").orderBy("nr", "pid").collect()] == [None, "audio", "video", None, "audio", None, "audio"]


def test_pids_in_tables_and_headers(spark):
    section = tables.map_cell(1, 32, 256, [(0x1B, 256, b"\x05\x1e" + bytes(30)), (0x0F, 257, b"\x05\x1e" + bytes(30))] * 2, 0, 0)[5:]
    section = section[: 3 + ((section[1] & 15) << 8 | section[2])]
    parts = [cell(32, 0, b"\0" + section[:60], room=61), cell(32, 1, section[60:], False)]
    cells = [tables.association_cell([(0, 16), (1, 32)], 0, 0), *parts, cell(256, 5, b"\0\0\1\xe0"), cell(400, 1, b"x")]
    got = [bytes(r["cell"]) for r in programmes.remap_tables(frame(spark, cells), {32: 99, 256: 8000, 16: 17}, "nr").orderBy("nr").collect()]
    assert got[0][:21] == cells[0][:19] + (0xE000 | 99).to_bytes(2, "big") and tables.crc32_mpeg(tables.section(got[0])) == 0
    assert [(c[1] & 0x1F) << 8 | c[2] for c in got] == [0, 99, 99, 8000, 400] and got[3][3:] == cells[3][3:] and got[4] == cells[4]
    joined = got[1][-60:] + got[2][4 : 4 + len(section) - 60]
    assert tables.crc32_mpeg(joined) == 0 and [s[1] for s in tables.mapped_streams(joined)[3]] == [8000, 257, 8000, 257]
    assert got[2][4 + len(section) - 60 :] == cells[2][4 + len(section) - 60 :]


#: A splice message of the standard's own examples: time signal with a segmentation descriptor.
CUE = bytes.fromhex("fc3034000000000000fffff00506fe72bd0050001e021c435545494800008e7fcf0001a599b00808000000002ca0a18a3402009ac9d17e")


def test_cues_are_moved(spark):
    assert tables.crc32_mpeg(CUE) == 0
    long = CUE[:1] + (0x3000 | 300 - 3).to_bytes(2, "big") + CUE[3:4] + (1 << 39 | (1 << 33) - 5).to_bytes(5, "big") + bytes(287)
    long += tables.crc32_mpeg(long).to_bytes(4, "big")
    cells = [*split(CUE, 500), *split(long, 500, cc=1), *split(CUE, 501), cell(256, 0, CUE)]
    df = frame(spark, cells)
    pids = spark.createDataFrame([(1, 500)], "flow_id long, pid int")
    got = [bytes(r["cell"]) for r in programmes.shift_cues(df, pids, 90_000, "nr").orderBy("nr").collect()]
    assert got[3:] == cells[3:] and [len(c) for c in got] == [188] * 5
    first, second = (s for _, _, s in found(spark, got[:3]))
    assert tables.crc32_mpeg(first) == tables.crc32_mpeg(second) == 0
    assert int.from_bytes(first[4:9], "big") == 90_000 and first[9:-4] == CUE[9:-4] and first[:4] == CUE[:4]
    assert int.from_bytes(second[4:9], "big") == 1 << 39 | 89_995
