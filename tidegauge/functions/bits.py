"""Bytes of transport packets as column expressions (offsets count from 0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = 188

#: Stream types that carry data only. Fixed values.
DATA_ONLY = [0x05, 0x0B, 0x0C, 0x0D, 0x14]


def uint(data: Column, at, size: int) -> Column:
    """Unsigned big-endian integer of up to seven bytes; null beyond the end."""
    part = F.substring(data, (at if isinstance(at, Column) else F.lit(at)) + 1, F.lit(size))
    value = F.conv(F.hex(part), 16, 10).cast("long")
    return value if size == 1 else F.when(F.length(part) == size, value)


def uint_le(data: Column, at: int, size: int) -> Column:
    parts = [uint(data, at + i, 1) * (1 << 8 * i) for i in range(size)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def bits(value: Column, shift: int, mask: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND(F.lit(mask))


def big_endian(value: Column, size: int) -> Column:
    """``value`` as ``size`` bytes."""
    return F.unhex(F.lpad(F.hex(value), 2 * size, "0"))


# -- RTP (F2-F4, J1, P7) --


def is_fec(data: Column, magic: bytes, header: int = 10) -> Column:
    """a parity datagram, told by its prefix before anything else is looked at."""
    return (F.length(data) >= len(magic) + header) & (F.substring(data, 1, len(magic)) == F.lit(magic))


def is_likely_rtp(data: Column) -> Column:
    """twelve bytes at least, and version 2."""
    return F.coalesce((F.length(data) >= 12) & (bits(uint(data, 0, 1), 6, 3) == 2), F.lit(False))


def payload_type(data: Column) -> Column:
    return bits(uint(data, 1, 1), 0, 0x7F)


def rtp_sequence(data: Column) -> Column:
    return uint(data, 2, 2)


def rtp_timestamp(data: Column) -> Column:
    return uint(data, 4, 4)


def strip_rtp_header(data: Column) -> Column:
    """The payload behind the fixed header, contributing sources and header extension; null if
    they reach beyond the datagram."""
    first = uint(data, 0, 1)
    base = 12 + 4 * bits(first, 0, 0x0F)
    extended = bits(first, 4, 1) == 1
    start = F.when(extended, base + 4 + 4 * uint(data, base + 2, 2)).otherwise(base)
    return F.when(start <= F.length(data), F.substring(data, start.cast("int") + 1, F.length(data)))


# -- transport stream cells (J2, P1-P6) --


def cells(payload: Column) -> Column:
    """The whole cells of a datagram; a partial one at the end is left out."""
    n = F.floor(F.length(payload) / CELL).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(payload, i * CELL + 1, F.lit(CELL)))).otherwise(F.array().cast("array<binary>"))


def ts_pid(cell: Column) -> Column:
    return bits(uint(cell, 1, 2), 0, 0x1FFF)


def ts_tei(cell: Column) -> Column:
    return bits(uint(cell, 1, 1), 7, 1) == 1


def ts_pusi(cell: Column) -> Column:
    return bits(uint(cell, 1, 1), 6, 1) == 1


def ts_cc(cell: Column) -> Column:
    return bits(uint(cell, 3, 1), 0, 0x0F)


def ts_adaptation_control(cell: Column) -> Column:
    return bits(uint(cell, 3, 1), 4, 3)


def ts_has_payload(cell: Column) -> Column:
    return bits(uint(cell, 3, 1), 4, 1) == 1


def ts_has_adaptation(cell: Column) -> Column:
    return bits(uint(cell, 3, 1), 5, 1) == 1


def _adaptation_flags(cell: Column) -> Column:
    return F.when(ts_has_adaptation(cell) & (uint(cell, 4, 1) > 0), uint(cell, 5, 1))


def ts_discontinuity(cell: Column) -> Column:
    return F.coalesce(bits(_adaptation_flags(cell), 7, 1) == 1, F.lit(False))


def set_discontinuity(cell: Column) -> Column:
    """The cell with its discontinuity bit set, if it has adaptation flags."""
    flags = _adaptation_flags(cell)
    changed = F.concat(F.substring(cell, 1, 5), big_endian(flags.bitwiseOR(F.lit(0x80)), 1), F.substring(cell, 7, CELL))
    return F.when(flags.isNotNull(), changed).otherwise(cell)


def extract_pcr(cell: Column) -> Column:
    """P5: base * 300 + extension; null without one."""
    has = (bits(_adaptation_flags(cell), 4, 1) == 1) & (uint(cell, 4, 1) >= 7)
    base = uint(cell, 6, 4) * 2 + bits(uint(cell, 10, 1), 7, 1)
    return F.when(has, base * 300 + bits(uint(cell, 10, 2), 0, 0x1FF))


def payload_offset(cell: Column) -> Column:
    return F.when(ts_has_adaptation(cell), uint(cell, 4, 1) + 5).otherwise(F.lit(4).cast("long")).cast("int")


def _stamp(data: Column, at: Column) -> Column:
    """33 bits over five bytes with marker bits between."""
    return bits(uint(data, at, 1), 1, 7) * (1 << 30) + F.floor(uint(data, at + 1, 2) / 2).cast("long") * (1 << 15) + F.floor(uint(data, at + 3, 2) / 2).cast("long")


def extract_pts(cell: Column) -> Column:
    """Of a PES header that begins in this cell."""
    at = payload_offset(cell)
    begins = ts_pusi(cell) & ts_has_payload(cell) & (uint(cell, at, 3) == 1)
    return F.when(begins & (bits(uint(cell, at + 7, 1), 7, 1) == 1), _stamp(cell, at + 9))


def extract_dts(cell: Column) -> Column:
    at = payload_offset(cell)
    begins = ts_pusi(cell) & ts_has_payload(cell) & (uint(cell, at, 3) == 1)
    return F.when(begins & (bits(uint(cell, at + 7, 1), 6, 3) == 3), _stamp(cell, at + 14))


# -- recording index (P25) --


def index_entry(pts: Column, timecode: Column, segment: Column, offset: Column, flags: Column) -> Column:
    """24 bytes, little endian: pts u64, timecode, segment, offset, flags u32."""
    le = lambda v, n: F.concat(*[F.substring(big_endian(v, n), n - i, 1) for i in range(n)])
    return F.concat(le(pts, 8), *[le(v, 4) for v in (timecode, segment, offset, flags)])


def parse_index_entry(entry: Column) -> Column:
    names = ["smpte_tc", "segment_id", "byte_offset", "flags"]
    low, high = uint_le(entry, 0, 4), uint_le(entry, 4, 4)
    return F.struct((high * (1 << 32) + low).alias("pts"), *[uint_le(entry, 8 + 4 * i, 4).alias(n) for i, n in enumerate(names)])


# -- time codes (P21) --


def pack_timecode(hh: Column, mm: Column, ss: Column, ff: Column) -> Column:
    out = hh.cast("long")
    for part in (mm, ss, ff):
        out = out * 256 + part
    return out


def format_timecode(packed: Column) -> Column:
    return F.concat_ws(":", *[F.lpad(bits(packed, s, 0xFF).cast("string"), 2, "0") for s in (24, 16, 8, 0)])


def parse_timecode(text: Column, fps: int) -> Column:
    """Packed time code of HH:MM:SS:FF or HH:MM:SS;FF; null if a field is out of range."""
    part = F.split(text, "[:;]")
    field = lambda i: F.expr("1") * F.get(part, i).try_cast("int")
    good = text.rlike(r"^\d{2}:\d{2}:\d{2}[:;]\d{2}$")
    hh, mm, ss, ff = (field(i) for i in range(4))
    return F.when(good & (hh < 24) & (mm < 60) & (ss < 60) & (ff < fps), pack_timecode(hh, mm, ss, ff))


def timecode_frames(packed: Column, fps: int) -> Column:
    """Frames since midnight."""
    return ((bits(packed, 24, 0xFF) * 60 + bits(packed, 16, 0xFF)) * 60 + bits(packed, 8, 0xFF)) * fps + bits(packed, 0, 0xFF)


# -- geometry (P29, L13) --


def fit_width(sw: Column, sh: Column, dw: Column, dh: Column) -> Column:
    """Letterbox: the even width that keeps the aspect inside dw x dh."""
    w = F.least(dw, F.floor(dh * sw / sh)).cast("long")
    return F.greatest(w - w % 2, F.lit(2))


def fit_height(sw: Column, sh: Column, dw: Column, dh: Column) -> Column:
    h = F.least(dh, F.floor(dw * sh / sw)).cast("long")
    return F.greatest(h - h % 2, F.lit(2))


def overlaps(a: str, b: str) -> Column:
    """Whether rectangles x, y, width, height of aliases ``a`` and ``b`` share a pixel."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "x") < c(b, "x") + c(b, "width")) & (c(b, "x") < c(a, "x") + c(a, "width")) & (c(a, "y") < c(b, "y") + c(b, "height")) & (c(b, "y") < c(a, "y") + c(a, "height"))
