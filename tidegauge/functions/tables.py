"""Programme tables in transport cells (P8-P10, P18, J11): parsing, checksums and synthesis.

Tables come a few times a second, so these run as pandas functions over the cells of table pids only."""

from __future__ import annotations

import zlib
from functools import wraps

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import bits, uint

CELL = 188

#: Descriptor tags and registration names that say what kind of audio private data is. Fixed values.
AUDIO_TAGS = {0x6A: "ac3", 0x7A: "eac3", 0x7B: "dts", 0x7C: "aac_latm", 0xAC: "ac4"}
AUDIO_NAMES = {b"AC-3": "ac3", b"EAC3": "eac3", b"DTS1": "dts", b"DTS2": "dts", b"DTS3": "dts", b"Opus": "opus", b"BSSD": "smpte302m", b"AC-4": "ac4"}

#: Descriptor tags of subtitles and teletext. Fixed values.
TEXT_TAGS = (0x45, 0x46, 0x56, 0x59)

#: Longest programme map section that leaves room for the rest of a cell. Fixed value.
LONGEST_MAP = 180


#: Each byte with its bits in reverse.
_REVERSED = bytes(int(f"{n:08b}"[::-1], 2) for n in range(256))


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 from the top bit down, begun with ones, not inverted; 0 over a section with its own. That is the
    common one with all bits in reverse and its inversion taken back."""
    turned = (zlib.crc32(bytes(data).translate(_REVERSED)) ^ 0xFFFFFFFF).to_bytes(4, "little")
    return int.from_bytes(turned.translate(_REVERSED), "big")


def section(cell: bytes | None) -> bytes | None:
    """The section that begins in a cell, cut at the cell's end; null if none does."""
    if cell is None or len(cell) < CELL or not cell[1] & 0x40:
        return None
    at = 5 + cell[4] if cell[3] & 0x20 else 4
    if at >= CELL:
        return None
    at += 1 + cell[at]
    if at + 3 > CELL:
        return None
    return cell[at : at + 3 + ((cell[at + 1] & 0x0F) << 8 | cell[at + 2])][: CELL - at]


def _whole(part: bytes) -> bool:
    return len(part) == 3 + ((part[1] & 0x0F) << 8 | part[2])


def programs(cell: bytes | None) -> list[tuple[int, int]]:
    """(program, pid of its map) of an association table; program 0, which names the network
    table, is left out. None for other cells."""
    return listed_programs(section(cell))


def listed_programs(part: bytes | None) -> list[tuple[int, int]]:
    """``programs`` of a section."""
    if part is None or len(part) < 8 or part[0] != 0:
        return []
    body = part[8 : len(part) - 4]
    entries = [body[i : i + 4] for i in range(0, len(body) - 3, 4)]
    return [(int.from_bytes(e[:2], "big"), int.from_bytes(e[2:], "big") & 0x1FFF) for e in entries if e[:2] != b"\0\0"]


def program_map(cell: bytes | None):
    """(program, version, clock pid, streams (type, pid, descriptors)) of a programme map, else null."""
    return mapped_streams(section(cell))


def mapped_streams(part: bytes | None):
    """``program_map`` of a section."""
    if part is None or len(part) < 16 or part[0] != 2:
        return None
    at, end, streams = 12 + (int.from_bytes(part[10:12], "big") & 0x0FFF), len(part) - 4, []
    while at + 5 <= end:
        size = int.from_bytes(part[at + 3 : at + 5], "big") & 0x0FFF
        streams.append((part[at], int.from_bytes(part[at + 1 : at + 3], "big") & 0x1FFF, part[at + 5 : min(at + 5 + size, end)]))
        at += 5 + size
    return int.from_bytes(part[3:5], "big"), part[5] >> 1 & 0x1F, int.from_bytes(part[8:10], "big") & 0x1FFF, streams


def _descriptors(data: bytes | None):
    """(tag, body) of each descriptor up to one that is cut off."""
    at, data = 0, data or b""
    while at + 2 <= len(data) and at + 2 + data[at + 1] <= len(data):
        yield data[at], data[at + 2 : at + 2 + data[at + 1]]
        at += 2 + data[at + 1]


def audio_kind_of(descriptors: bytes | None) -> str | None:
    """P10: the audio that private data carries, null if it is none."""
    for tag, body in _descriptors(descriptors):
        if tag in AUDIO_TAGS:
            return AUDIO_TAGS[tag]
        if tag == 0x05 and body[:4] in AUDIO_NAMES:
            return AUDIO_NAMES[body[:4]]
        if tag == 0x7F and body[:1] == b"\x15":
            return "ac4"
    return None


def language_of(descriptors: bytes | None) -> str | None:
    """The three-letter language, lower-cased."""
    for tag, body in _descriptors(descriptors):
        if tag == 0x0A and len(body) >= 3 and body[:3].isalpha() and body[:3].isascii():
            return body[:3].decode().lower()
    return None


def _cell_of(pid: int, cc: int, body: bytes) -> bytes:
    head = bytes([0x47, 0x40 | pid >> 8 & 0x1F, pid & 0xFF, 0x10 | cc & 0x0F, 0])
    return (head + body + crc32_mpeg(body).to_bytes(4, "big")).ljust(CELL, b"\xff")


def association_body(entries: list[tuple[int, int]], version: int, stream: int = 1) -> bytes:
    body = b"".join(p.to_bytes(2, "big") + (0xE000 | pid & 0x1FFF).to_bytes(2, "big") for p, pid in entries)
    return bytes([0]) + (0xB000 | 9 + len(body)).to_bytes(2, "big") + stream.to_bytes(2, "big") + bytes([0xC1 | (version & 0x1F) << 1, 0, 0]) + body


def association_cell(entries: list[tuple[int, int]], version: int, cc: int, stream: int = 1) -> bytes:
    """An association table of (program, pid) in one cell."""
    return _cell_of(0, cc, association_body(entries, version, stream))


def with_mapped_pids(part: bytes, pids: dict[int, int]) -> bytes:
    """A table's section with every pid that it names looked up in ``pids``, and its checksum made anew;
    the network table's pid stays, and so do sections of other tables."""
    out = bytearray(part)

    def move(at: int) -> None:
        word = int.from_bytes(out[at : at + 2], "big")
        out[at : at + 2] = (word & 0xE000 | pids.get(word & 0x1FFF, word & 0x1FFF)).to_bytes(2, "big")

    end = len(out) - 4
    if len(out) >= 12 and out[0] == 0:
        for at in range(8, end - 3, 4):
            if out[at : at + 2] != b"\0\0":
                move(at + 2)
    elif len(out) >= 16 and out[0] == 2:
        move(8)
        at = 12 + (int.from_bytes(out[10:12], "big") & 0x0FFF)
        while at + 5 <= end:
            move(at + 1)
            at += 5 + (int.from_bytes(out[at + 3 : at + 5], "big") & 0x0FFF)
    else:
        return part
    out[end:] = crc32_mpeg(bytes(out[:end])).to_bytes(4, "big")
    return bytes(out)


def with_later_splice(part: bytes, by_90k: int) -> bytes:
    """A cue's section with its 33-bit adjustment raised by ``by_90k``; other sections as they are."""
    if len(part) < 15 or part[0] != 0xFC:
        return part
    word = int.from_bytes(part[4:9], "big")
    word = word >> 33 << 33 | (word + by_90k) % (1 << 33)
    out = part[:4] + word.to_bytes(5, "big") + part[9:-4]
    return out + crc32_mpeg(out).to_bytes(4, "big")


def cells_of(pid: int, first_cc: int, body: bytes) -> list[bytes]:
    """A section with its checksum over as many cells as it takes."""
    whole, out = b"\0" + body + crc32_mpeg(body).to_bytes(4, "big"), []
    for i in range(0, len(whole), CELL - 4):
        head = bytes([0x47, (0x40 if i == 0 else 0) | pid >> 8 & 0x1F, pid & 0xFF, 0x10 | first_cc + len(out) & 0x0F])
        out.append((head + whole[i : i + CELL - 4]).ljust(CELL, b"\xff"))
    return out


def map_cell(program: int, pid: int, clock_pid: int, streams: list[tuple[int, int, bytes]], version: int, cc: int) -> bytes:
    """A programme map in one cell. Descriptors are kept in order as long as the section stays within
    LONGEST_MAP; a stream whose own don't fit goes without."""
    size, body = 13 + 5 * len(streams), b""
    for kind, at, descriptors in streams:
        fits = descriptors if descriptors and len(descriptors) <= 0x3FF and size + len(descriptors) <= LONGEST_MAP else b""
        size += len(fits)
        body += bytes([kind]) + (0xE000 | at & 0x1FFF).to_bytes(2, "big") + (0xF000 | len(fits)).to_bytes(2, "big") + fits
    head = bytes([2]) + (0xB000 | size).to_bytes(2, "big") + program.to_bytes(2, "big") + bytes([0xC1 | (version & 0x1F) << 1, 0, 0])
    return _cell_of(pid, cc, head + (0xE000 | clock_pid & 0x1FFF).to_bytes(2, "big") + b"\xf0\0" + body)


def on_call(returns: str):
    """A pandas function as a function of columns; the type is parsed when it is called, in a session."""
    return lambda f: wraps(f)(lambda *columns: F.pandas_udf(f, returns)(*columns))


@on_call("array<struct<program:int,pid:int>>")
def pat_programs(cells: pd.Series) -> pd.Series:
    return pd.Series([[{"program": p, "pid": pid} for p, pid in programs(c)] for c in cells])


@on_call("struct<program:int,version:int,clock_pid:int,streams:array<struct<stream_type:int,pid:int,descriptors:binary>>>")
def pmt(cells: pd.Series) -> pd.DataFrame:
    rows = [program_map(c) or (None, None, None, None) for c in cells]
    named = [(p, v, c, None if s is None else [{"stream_type": t, "pid": pid, "descriptors": d} for t, pid, d in s]) for p, v, c, s in rows]
    return pd.DataFrame(named, columns=["program", "version", "clock_pid", "streams"]).astype({"program": "Int32", "version": "Int32", "clock_pid": "Int32"})


def association(section: Column) -> Column:
    """P9 of assembled sections: (table_stream, version, programs); null for sections of other tables. A table lists up to
    some 250 programmes, of which a batch in Python would be millions of objects, so it is read by Spark's functions."""
    count = F.floor((F.length(section) - 12) / 4).cast("int")
    entry = lambda i: F.struct(uint(section, 8 + 4 * i, 2).cast("int").alias("program"), bits(uint(section, 10 + 4 * i, 2), 0, 0x1FFF).cast("int").alias("pid"))
    listed = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), entry)).otherwise(F.array().cast("array<struct<program:int,pid:int>>"))
    good = (F.length(section) >= 8) & (uint(section, 0, 1) == 0)
    return F.when(good, F.struct(uint(section, 3, 2).cast("int").alias("table_stream"), bits(uint(section, 5, 1), 1, 0x1F).cast("int").alias("version"), F.filter(listed, lambda x: x["program"] != 0).alias("programs")))


@on_call("struct<program:int,version:int,clock_pid:int,streams:array<struct<stream_type:int,pid:int,descriptors:binary>>>")
def stream_map(sections: pd.Series) -> pd.DataFrame:
    """``pmt`` of assembled sections."""
    rows = [mapped_streams(s) or (None, None, None, None) for s in sections]
    named = [(p, v, c, None if s is None else [{"stream_type": t, "pid": pid, "descriptors": d} for t, pid, d in s]) for p, v, c, s in rows]
    return pd.DataFrame(named, columns=["program", "version", "clock_pid", "streams"]).astype({"program": "Int32", "version": "Int32", "clock_pid": "Int32"})


@on_call("boolean")
def checksum_ok(sections: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else crc32_mpeg(s) == 0 for s in sections], dtype="boolean")


@on_call("boolean")
def crc_ok(cells: pd.Series) -> pd.Series:
    """Whether the section that begins in the cell ends in it and has the right checksum; null if none begins."""
    parts = [section(c) for c in cells]
    return pd.Series([None if p is None else _whole(p) and crc32_mpeg(p) == 0 for p in parts], dtype="boolean")


@on_call("string")
def audio_kind(descriptors: pd.Series) -> pd.Series:
    return pd.Series([audio_kind_of(d) for d in descriptors], dtype=object)


@on_call("boolean")
def is_text_service(descriptors: pd.Series) -> pd.Series:
    return pd.Series([any(tag in TEXT_TAGS for tag, _ in _descriptors(d)) for d in descriptors], dtype=bool)


@on_call("string")
def language(descriptors: pd.Series) -> pd.Series:
    return pd.Series([language_of(d) for d in descriptors], dtype=object)
