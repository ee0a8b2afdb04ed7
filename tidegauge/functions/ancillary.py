"""Ancillary data, captions, splice cues and pixel groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import big_endian, bits, uint
from .essence import Bits
from .tables import crc32_mpeg, on_call

#: Names of splice commands. Fixed values.
COMMANDS = {0x00: "splice_null", 0x04: "splice_schedule", 0x05: "splice_insert", 0x06: "time_signal", 0x07: "bandwidth_reservation", 0xFF: "private_command"}

#: Operations of splice messages: a request, and the one that does nothing; the types of a request. Fixed values.
REQUEST, NOTHING = 0x0101, 0x0102
TYPES = {1: "start", 2: "start", 3: "end", 4: "end", 5: "cancel"}

#: Bytes of a message's time by its kind. Fixed values.
TIME_BYTES = (0, 6, 4, 2)

PTS = 1 << 33
MESSAGE = "opcode:string,event_id:long,pre_roll_ms:long,break_ms:long,auto_return:boolean"
PACKET = "color_difference:boolean,line_number:int,horizontal_offset:int,stream_flag:boolean,stream_num:int,did:int,sdid:int,user_data:binary"

# -- splice sections (P20, J18) --


def _splice_time(data: Column, at: int) -> Column:
    return F.when(bits(uint(data, at, 1), 7, 1) == 1, uint(data, at, 5) % PTS)


def cue(section: Column) -> Column:
    """P20: (command, pts) of a splice section: its command's name, and the time that it gives, which of a
    splice_insert is that of a departure that isn't immediate. Sections that are cut off are unknown."""
    kind, size = uint(section, 13, 1), bits(uint(section, 11, 2), 0, 0xFFF)
    command = F.substring(section, F.lit(15), size.cast("int"))
    flags = uint(command, 5, 1)
    insert = F.when((bits(uint(command, 4, 1), 7, 1) == 0) & (bits(flags, 7, 1) == 1) & (bits(flags, 4, 1) == 0), _splice_time(command, 6))
    pts = F.when(kind == 5, insert).when(kind == 6, _splice_time(command, 0))
    names = F.create_map(*[F.lit(x) for pair in COMMANDS.items() for x in pair])
    whole = F.length(section) >= 14
    return F.struct(F.when(whole, F.coalesce(names[kind.cast("int")], F.lit("unknown"))).otherwise("unknown").alias("command"), F.when(whole & (F.length(command) == size), pts).alias("pts"))


@on_call("binary")
def with_crc(body: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else b + crc32_mpeg(b).to_bytes(4, "big") for b in body], dtype=object)


@on_call("boolean")
def crc_fits(section: pd.Series) -> pd.Series:
    return pd.Series([s is not None and len(s) > 4 and crc32_mpeg(s) == 0 for s in section], dtype=bool)


def splice_section(opcode: Column, event_id: Column, pre_roll_ms: Column, break_ms: Column, auto_return: Column, now: Column) -> Column:
    """A whole splice_insert section of a message (start, end or cancel) at stamp ``now``."""
    nothing, cancel, wait = F.lit(b""), opcode == "cancel", F.coalesce(pre_roll_ms, F.lit(0))
    lasts = F.when(~cancel, break_ms)
    flags = 0x4F + F.when(opcode == "start", 0x80).otherwise(0) + F.when(lasts.isNotNull(), 0x20).otherwise(0) + F.when(wait == 0, 0x10).otherwise(0)
    at = F.when(wait > 0, big_endian((now + wait * 90) % PTS + (0xFE << 32), 5)).otherwise(nothing)
    length = F.when(lasts.isNotNull(), big_endian(lasts * 90 % PTS + F.when(F.coalesce(auto_return, F.lit(False)), 0xFE << 32).otherwise(0x7E << 32), 5)).otherwise(nothing)
    rest = F.when(cancel, F.lit(b"\xff")).otherwise(F.concat(F.lit(b"\x7f"), big_endian(flags, 1), at, length, F.lit(b"\0\1\0\0")))
    command = F.concat(big_endian(F.coalesce(event_id, F.lit(0)), 4), rest)
    size = F.length(command)
    head = F.concat(F.lit(b"\xfc"), big_endian(0x3000 + 17 + size, 2), F.lit(bytes(7)), F.lit(b"\xff"), big_endian(0xF000 + size, 2), F.lit(b"\5"))
    return with_crc(F.concat(head, command, F.lit(b"\0\0")))


def splice_message(section: Column, now: Column) -> Column:
    """The message (opcode, event_id, pre_roll_ms, break_ms, auto_return) of a clear, whole splice_insert
    of a program at stamp ``now``; null for anything else."""
    size = bits(uint(section, 11, 2), 0, 0xFFF)
    command = F.substring(section, F.lit(15), size.cast("int"))
    whole = (F.length(section) >= 18) & (uint(section, 0, 1) == 0xFC) & (bits(uint(section, 1, 2), 0, 0xFFF) + 3 == F.length(section)) & (bits(uint(section, 4, 1), 7, 1) == 0)
    insert = whole & (uint(section, 13, 1) == 5) & (size >= 5) & (size + 20 <= F.length(section)) & crc_fits(section)
    flags, cancel = uint(command, 5, 1), bits(uint(command, 4, 1), 7, 1) == 1
    immediate, lasts = bits(flags, 4, 1) == 1, bits(flags, 5, 1) == 1
    moved = F.pmod(_splice_time(command, 6) + uint(section, 4, 5) % PTS - now, F.lit(PTS))
    wait = F.when(immediate, F.lit(0).cast("long")).otherwise(F.least(F.floor(moved / 90), F.lit(65535)))
    length = F.when(immediate, uint(command, 6, 5)).otherwise(uint(command, 11, 5))
    good = F.when(cancel, True).otherwise((bits(flags, 6, 1) == 1) & wait.isNotNull() & (~lasts | length.isNotNull()))
    fields = {
        "opcode": F.when(cancel, "cancel").when(bits(flags, 7, 1) == 1, "start").otherwise("end"), "event_id": uint(command, 0, 4), "pre_roll_ms": F.when(cancel, F.lit(0).cast("long")).otherwise(wait),
        "break_ms": F.when(~cancel & lasts, F.floor(length % PTS / 90)), "auto_return": F.when(~cancel & lasts, bits(length, 39, 1) == 1),
    }
    return F.when(insert & good, F.struct(*[c.alias(n) for n, c in fields.items()]))


# -- splice messages (P20) --


def build_message(opcode: Column, event_id: Column, pre_roll_ms: Column, break_ms: Column, auto_return: Column) -> Column:
    """P20: a message of one operation (start, end, cancel, else the one that does nothing)."""
    wait = F.coalesce(pre_roll_ms, F.lit(0))
    kind = F.when(opcode == "start", F.when(wait == 0, 2).otherwise(1)).when(opcode == "end", F.when(wait == 0, 4).otherwise(3)).when(opcode == "cancel", 5)
    tenths = F.least(F.ceil(F.coalesce(break_ms, F.lit(0)) / 100), F.lit(65535))
    request = F.concat(big_endian(kind, 1), big_endian(F.coalesce(event_id, F.lit(0)), 4), F.lit(b"\0\0"), big_endian(wait, 2), big_endian(tenths, 2), F.lit(b"\0\0"), big_endian(F.coalesce(auto_return, F.lit(False)).cast("int"), 1))
    data = F.coalesce(request, F.lit(b""))
    operation = F.when(kind.isNull(), NOTHING).otherwise(REQUEST)
    return F.concat(F.lit(b"\xff\xff"), big_endian(F.length(data) + 16, 2), F.lit(bytes(7)), F.lit(b"\1"), big_endian(operation, 2), big_endian(F.length(data), 2), data)


def _number(data: bytes, at: int, size: int) -> int | None:
    return int.from_bytes(data[at : at + size], "big") if at + size <= len(data) else None


def _operation(code: int, data: bytes):
    if code == NOTHING:
        return ("null", None, None, None, None)
    if code != REQUEST or not data:
        return (f"other:{code}", None, None, None, None)
    tenths = _number(data, 9, 2)
    lasts = tenths * 100 if tenths else None
    return (TYPES.get(data[0], f"other:{code}"), _number(data, 1, 4), _number(data, 7, 2), lasts, bool(data[13]) if lasts and len(data) >= 14 else None)


def message_of(data: bytes | None):
    """P20: (opcode, event_id, pre_roll_ms, break_ms, auto_return) of a message: its one operation, or of
    several the first that asks for or skips a splice. Null if it is cut off or of another version."""
    if data is None or len(data) < 2:
        return None
    if data[:2] != b"\xff\xff":
        return _operation(_number(data, 0, 2), data[13:]) if len(data) >= 13 and not data[8] else None
    if len(data) < 11 or data[4] or data[10] >= len(TIME_BYTES):
        return None
    at = 11 + TIME_BYTES[data[10]]
    if at >= len(data):
        return None
    codes, rest = [], data[at + 1 :]
    for _ in range(data[at]):
        code, size = _number(rest, 0, 2), _number(rest, 2, 2)
        if size is None or len(rest) < 4 + size:
            return None
        if code in (REQUEST, NOTHING):
            return _operation(code, rest[4 : 4 + size])
        codes.append(code)
        rest = rest[4 + size :]
    return (f"other:{codes[0] if codes else 0xFFFF}", None, None, None, None)


@on_call(f"struct<{MESSAGE}>")
def parse_message(data: pd.Series) -> pd.DataFrame:
    rows = pd.DataFrame([message_of(d) or (None,) * 5 for d in data], columns=["opcode", "event_id", "pre_roll_ms", "break_ms", "auto_return"])
    return rows.astype({"event_id": "Int64", "pre_roll_ms": "Int64", "break_ms": "Int64", "auto_return": "boolean"})


# -- ancillary packets (P22, P23) --


def with_parity(byte: int) -> int:
    """Ten bits of a byte: even parity as bit 8 and its inverse as bit 9."""
    odd = byte.bit_count() & 1
    return byte | (0x100 if odd else 0x200)


def checksum(words: list[int]) -> int:
    """Nine bits of the words' sum, and the inverse of the last of them."""
    total = sum(words) & 0x1FF
    return total | (0 if total & 0x100 else 0x200)


def packed(packets, number: int, field: int) -> bytes:
    """Packets behind a header of eight bytes, each filled up to 32 bits."""
    body = b""
    for p in packets:
        data = bytes(p["user_data"])
        words = [with_parity(b) for b in (p["did"], p["sdid"], len(data) & 0xFF, *data)]
        value = int(p["color_difference"]) << 31 | int(p["line_number"]) << 20 | int(p["horizontal_offset"]) << 8 | int(p["stream_flag"]) << 7 | int(p["stream_num"])
        for word in [*words, checksum(words)]:
            value = value << 10 | word
        size = 32 + 10 * (len(words) + 1)
        fill = -size % 32
        body += (value << fill).to_bytes((size + fill) // 8, "big")
    return number.to_bytes(2, "big") + len(body).to_bytes(2, "big") + bytes([len(packets), field << 6, 0, 0]) + body


def unpacked(data: bytes | None):
    """The packets; null if there are fewer than the header says or one is cut off."""
    if data is None or len(data) < 8 or 8 + _number(data, 2, 2) > len(data):
        return None
    b = Bits(data[8 : 8 + _number(data, 2, 2)] if _number(data, 2, 2) else data[8:])
    out = []
    while len(out) < data[4] and b.left >= 62:
        begin = b.left
        fields = [b.read(n) for n in (1, 11, 12, 1, 7)]
        did, sdid, size = (b.read(10) & 0xFF for _ in range(3))
        if b.left < 10 * (size + 1):
            return None
        user = bytes(b.read(10) & 0xFF for _ in range(size))
        b.read(10)
        b.left -= min(-(begin - b.left) % 32, b.left)
        out.append(dict(zip(("color_difference", "line_number", "horizontal_offset", "stream_flag", "stream_num"), (bool(fields[0]), fields[1], fields[2], bool(fields[3]), fields[4])), did=did, sdid=sdid, user_data=user))
    return out if len(out) == data[4] else None


@on_call("binary")
def pack_packets(packets: pd.Series, number: pd.Series, field: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else packed(p, int(n), int(f)) for p, n, f in zip(packets, number, field)], dtype=object)


@on_call(f"array<struct<{PACKET}>>")
def unpack_packets(data: pd.Series) -> pd.Series:
    return pd.Series([unpacked(d) for d in data], dtype=object)


def captions(packet: Column) -> Column:
    """(kind, count, payload_bytes) of a packet (did, sdid, user_data) that carries captions; null for
    others and for those that are too short."""
    data = packet["user_data"]
    size, newer = F.length(data), packet["sdid"] == 1
    each = F.transform(F.sequence(F.lit(0), size - 1), lambda i: uint(data, i, 1))
    marker = F.array_position(each, F.lit(0x72).cast("long"))
    after = F.when(marker > 0, F.coalesce(bits(F.get(each, marker.cast("int")), 0, 0x1F), F.lit(0))).otherwise(0)
    good = (packet["did"] == 0x61) & ((newer & (size >= 8)) | ((packet["sdid"] == 2) & (size >= 3)))
    return F.when(good, F.struct(F.when(newer, "cea708").otherwise("cea608").alias("kind"), F.when(newer, after).otherwise(F.floor(size / 3) % 256).cast("int").alias("count"), size.alias("payload_bytes")))


# -- pixel groups (P24) --


def pack_422(luma: Column, blue: Column, red: Column, depth: int) -> Column:
    """Rows of samples (one of each colour for two of luma) as pixel groups of 8 or 10 bits, big-endian."""
    digits, top = depth, (1 << depth) - 1
    low = lambda c: c.cast("long").bitwiseAND(F.lit(top))
    group = lambda i: low(F.get(blue, i)) * (1 << 3 * depth) + low(F.get(luma, 2 * i)) * (1 << 2 * depth) + low(F.get(red, i)) * (1 << depth) + low(F.get(luma, 2 * i + 1))
    each = F.transform(F.sequence(F.lit(0), F.size(blue) - 1), lambda i: F.lpad(F.hex(group(i)), digits, "0"))
    return F.when(F.size(blue) > 0, F.unhex(F.array_join(each, ""))).otherwise(F.lit(b""))


def unpack_422(pixels: Column, depth: int) -> Column:
    """(y, cb, cr) of pixel groups; a part of a group at the end is left out."""
    size = depth // 2
    count = F.floor(F.length(pixels) / size).cast("int")
    groups = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: uint(pixels, i * size, size))).otherwise(F.array().cast("array<bigint>"))
    part = lambda place: F.transform(groups, lambda g: bits(g, place * depth, (1 << depth) - 1))
    luma = F.flatten(F.transform(groups, lambda g: F.array(bits(g, 2 * depth, (1 << depth) - 1), bits(g, 0, (1 << depth) - 1))))
    return F.struct(luma.alias("y"), part(3).alias("cb"), part(1).alias("cr"))
