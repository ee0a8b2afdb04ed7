"""Headers of audio and video essence.

Audio headers have fixed places and are column functions. Parameter sets of pictures are codes of varying
length that come once a group of pictures, so they run as a pandas function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import bits, uint
from .tables import on_call

#: Sample rates by index, and profiles by object type, of AAC. Fixed values.
AAC_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]
AAC_PROFILES = {1: "AAC-Main", 2: "AAC-LC", 3: "AAC-SSR", 4: "AAC-LTP", 5: "HE-AAC", 29: "HE-AAC v2"}

#: Sample rates of MPEG-1 audio by index; MPEG-2 has half of them and MPEG-2.5 a quarter. Fixed values.
MPEG_RATES = [44100, 48000, 32000]

#: Picture rates of MPEG-2 by code, from 1. Fixed values.
MPEG2_PICTURE_RATES = [24000 / 1001, 24.0, 25.0, 30000 / 1001, 30.0, 50.0, 60000 / 1001, 60.0]
MPEG2_PROFILES = {1: "High", 2: "Spatially Scalable", 3: "SNR Scalable", 4: "Main", 5: "Simple"}
MPEG2_LEVELS = {4: "High", 6: "High-1440", 8: "Main", 10: "Low"}

#: Names of H.264 profiles, and those that tell their chroma format. Fixed values.
H264_PROFILES = {66: "Baseline", 77: "Main", 88: "Extended", 100: "High", 110: "High 10", 122: "High 4:2:2", 244: "High 4:4:4 Predictive"}
H264_WITH_CHROMA = (100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135)

#: Names of H.265 profiles. Fixed values.
H265_PROFILES = {1: "Main", 2: "Main 10", 3: "Main Still Picture", 4: "Range Extensions", 5: "High Throughput"}


def _one_of(values: list, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _named(names: dict[int, str], value: Column, other: str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(known[value.cast("int")], F.lit(other))


def _audio(rate: Column, channels: Column, name: Column, good: Column) -> Column:
    return F.when(good & rate.isNotNull(), F.struct(rate.alias("sample_rate"), channels.cast("int").alias("channels"), name.alias("profile")))


def adts(data: Column) -> Column:
    """(sample_rate, channels, profile) of an ADTS header; null for anything else."""
    third = uint(data, 2, 1)
    synced = (F.length(data) >= 7) & (bits(uint(data, 0, 2), 4, 0xFFF) == 0xFFF)
    return _audio(_one_of(AAC_RATES, bits(third, 2, 0x0F)), bits(uint(data, 2, 2), 6, 7), _named(AAC_PROFILES, bits(third, 6, 3) + 1, "AAC"), synced)


def mpeg_audio(data: Column) -> Column:
    """The same of an MPEG audio header of layers I to III, with version and layer as profile."""
    head = uint(data, 0, 2)
    version, layer = bits(head, 3, 3), bits(head, 1, 3)
    rate = F.floor(_one_of(MPEG_RATES, bits(uint(data, 2, 1), 2, 3)) / F.when(version == 3, 1).when(version == 2, 2).otherwise(4)).cast("int")
    name = F.concat(_one_of(["MPEG-2.5", "", "MPEG-2", "MPEG-1"], version), F.lit(" Layer "), _one_of(["", "III", "II", "I"], layer))
    good = (F.length(data) >= 4) & (bits(head, 5, 0x7FF) == 0x7FF) & (version != 1) & (layer != 0)
    return _audio(rate, F.when(bits(uint(data, 3, 1), 6, 3) == 3, 1).otherwise(2), name, good)


def loas(data: Column) -> Column:
    """(reused, audio) of a LOAS frame: whether it points to the last configuration, else the one that
    it carries, of a single program and layer of version 0. Null for anything else."""
    head, size = uint(data, 3, 2), F.length(data) * 8 - 40
    config = uint(F.rpad(data, 12, F.lit(b"\0")), 5, 7)
    longer = F.when(bits(config, 51, 31) == 31, 6).otherwise(0)
    at = lambda width, skipped: F.floor(config / F.pow(F.lit(2), F.lit(56) - skipped - width)).cast("long").bitwiseAND(F.lit((1 << width) - 1))
    kind = F.when(longer > 0, 32 + at(6, F.lit(5))).otherwise(at(5, F.lit(0)))
    index = at(4, longer + 5)
    own = F.when(index == 15, 24).otherwise(0)
    rate = F.when(index == 15, at(24, longer + 9)).otherwise(_one_of(AAC_RATES, index).cast("long"))
    told = at(4, longer + own + 9)
    channels = F.when(told == 7, 8).when((told == 0) | (told > 7), 2).otherwise(told)
    audio = _audio(rate, channels, _named(AAC_PROFILES, kind, "AAC-LATM"), (size >= longer + own + 13) & (bits(head, 14, 1) == 0) & (bits(head, 0, 0x7F) == 0))
    synced = (F.length(data) >= 4) & (bits(uint(data, 0, 2), 5, 0x7FF) == 0x2B7)
    reused = bits(uint(data, 3, 1), 7, 1) == 1
    return F.when(synced & reused, F.struct(F.lit(True).alias("reused"), F.when(~reused, audio).alias("audio"))).when(synced & audio.isNotNull(), F.struct(F.lit(False).alias("reused"), audio.alias("audio")))


class Bits:
    """Bits of a unit from the first on, with codes of varying length. Reading beyond the end is an
    EOFError."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def read(self, n: int = 1) -> int:
        if n > self.left:
            raise EOFError
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)

    def unsigned(self) -> int:
        rest = self.value & ((1 << self.left) - 1)
        zeros = self.left - rest.bit_length()
        if zeros > 31 or not rest:
            raise EOFError
        self.left -= zeros
        return self.read(zeros + 1) - 1

    def signed(self) -> int:
        code = self.unsigned()
        return (code + 1) // 2 if code & 1 else -(code // 2)


def unescaped(unit: bytes) -> bytes:
    """A unit without the bytes that keep start codes out of it."""
    return unit.replace(b"\0\0\3", b"\0\0")


def _picture_rate(b: Bits) -> float | None:
    try:
        if b.read() and b.read(8) == 255:
            b.read(32)
        if b.read():
            b.read()
        if b.read():
            b.read(4)
            if b.read():
                b.read(24)
        if b.read():
            b.unsigned(), b.unsigned()
        if b.read():
            tick, scale = b.read(32), b.read(32)
            return scale / (2 * tick) if tick else None
    except EOFError:
        pass
    return None


def h264_parameters(unit: bytes):
    """(width, height, frame_rate, profile, level) of a sequence parameter set, its first byte
    included; null if it ends too early."""
    b = Bits(unescaped(unit)[1:])
    try:
        profile, _, level, _ = b.read(8), b.read(8), b.read(8), b.unsigned()
        chroma = 1
        if profile in H264_WITH_CHROMA:
            chroma = b.unsigned()
            b.read(chroma == 3), b.unsigned(), b.unsigned(), b.read()
            for i in range((12 if chroma == 3 else 8) if b.read() else 0):
                last = following = 8
                for _ in range((16 if i < 6 else 64) if b.read() else 0):
                    if following:
                        following = (last + b.signed()) % 256
                    last = following or last
        b.unsigned()
        order = b.unsigned()
        if order == 0:
            b.unsigned()
        elif order == 1:
            b.read(), b.signed(), b.signed()
            for _ in range(b.unsigned()):
                b.signed()
        b.unsigned(), b.read()
        columns, rows = b.unsigned() + 1, b.unsigned() + 1
        fields = 1 if b.read() else 2
        b.read(fields - 1), b.read()
        left, right, top, bottom = [b.unsigned() for _ in range(4)] if b.read() else [0] * 4
    except EOFError:
        return None
    x, y = (1 if chroma in (0, 3) else 2), fields * (2 if chroma == 1 else 1)
    rate = _picture_rate(b) if b.left and b.read() else None
    return columns * 16 - x * (left + right), fields * rows * 16 - y * (top + bottom), rate, H264_PROFILES.get(profile, "Unknown"), f"{level // 10}.{level % 10}"


def _h265_layers(b: Bits, below: int) -> tuple[int, int]:
    """Profile and level that hold for all layers; what each of the ``below`` lower ones says is passed over."""
    profile = b.read(8) & 31
    b.read(80)
    level = b.read(8)
    if below:
        told = [b.read(2) for _ in range(8)]
        b.read(sum(88 * (t >> 1) + 8 * (t & 1) for t in told[:below]))
    return profile, level


def _h265_scaling(b: Bits) -> None:
    for step in range(4):
        for _ in range(6 if step < 3 else 2):
            if b.read():
                for _ in range(min(64, 16 << 2 * step) + (step > 1)):
                    b.signed()
            else:
                b.unsigned()


def _h265_reference_sets(b: Bits) -> None:
    """Short-term sets of pictures that are referred to, each by its distances (before, then after, nearest first);
    a set may be told by what it takes over from the one before it."""
    last: list[int] = []
    for n in range(b.unsigned()):
        if n and b.read():
            shift = (-1) ** b.read() * (b.unsigned() + 1)
            moved = [d + shift for d in [*last, 0] if b.read() or b.read()]
            last = sorted((d for d in moved if d < 0), reverse=True) + sorted(d for d in moved if d > 0)
        else:
            counts, last = (b.unsigned(), b.unsigned()), []
            for count, sign in zip(counts, (-1, 1), strict=True):
                at = 0
                for _ in range(count):
                    at += sign * (b.unsigned() + 1)
                    b.read()
                    last.append(at)


def _h265_rate(b: Bits, below: int) -> float | None:
    """Pictures a second, from all that comes after the size; null where it isn't told or the set ends too early."""
    try:
        b.unsigned(), b.unsigned()
        order_bits = b.unsigned() + 4
        for _ in range(3 * (below + 1 if b.read() else 1) + 6):
            b.unsigned()
        if b.read() and b.read():
            _h265_scaling(b)
        b.read(2)
        if b.read():
            b.read(8), b.unsigned(), b.unsigned(), b.read()
        _h265_reference_sets(b)
        if b.read():
            b.read(b.unsigned() * (order_bits + 1))
        b.read(2)
        if not b.read():
            return None
        if b.read() and b.read(8) == 255:
            b.read(32)
        if b.read():
            b.read()
        if b.read():
            b.read(4)
            b.read(24 * b.read())
        if b.read():
            b.unsigned(), b.unsigned()
        b.read(3)
        for _ in range(4 * b.read()):
            b.unsigned()
        if b.read():
            tick, scale = b.read(32), b.read(32)
            return scale / tick if tick and scale else None
    except EOFError:
        pass
    return None


def h265_parameters(unit: bytes):
    """(width, height, frame_rate, profile, level) of an H.265 sequence parameter set, its two first bytes
    included; null if it ends before the size is told."""
    b = Bits(unescaped(unit)[2:])
    try:
        below = b.read(8) >> 1 & 7
        profile, level = _h265_layers(b, below)
        b.unsigned()
        chroma = b.unsigned()
        b.read(chroma == 3)
        width, height = b.unsigned(), b.unsigned()
        left, right, top, bottom = [b.unsigned() for _ in range(4)] if b.read() else [0] * 4
    except EOFError:
        return None
    width -= (2 if chroma in (1, 2) else 1) * (left + right)
    height -= (2 if chroma == 1 else 1) * (top + bottom)
    return (width, height, _h265_rate(b, below), H265_PROFILES.get(profile, "Unknown"), f"{level // 30}.{level % 30 // 3}") if width > 0 and height > 0 else None


def h265_parameters_of(data: bytes | None):
    """Of the first H.265 sequence parameter set (type 33) in a stream."""
    for unit in re.split(b"\0\0\1", data or b""):
        if len(unit) >= 4 and unit[0] >> 1 & 0x3F == 33:
            return h265_parameters(unit)
    return None


def mpeg2_parameters(data: bytes):
    """The same of the first sequence header, with its extension if that comes next."""
    at = data.find(b"\0\0\1\xb3")
    body = data[at + 4 :]
    if at < 0 or len(body) < 8:
        return None
    head, profile, level = int.from_bytes(body[:4], "big"), "Main", "Main"
    width, height, code = head >> 20, head >> 8 & 0xFFF, head & 0x0F
    after = body[body.find(b"\0\0\1", 8) :] if body.find(b"\0\0\1", 8) >= 0 else b""
    if after[3:4] == b"\xb5" and len(after) >= 10 and after[4] >> 4 == 1:
        more = int.from_bytes(after[4:7], "big")
        p, v = more >> 16 & 7, more >> 12 & 0x0F
        profile, level = MPEG2_PROFILES.get(p, f"Profile {p}"), MPEG2_LEVELS.get(v, f"Level {v}")
        width, height = width | (more >> 7 & 3) << 12, height | (more >> 5 & 3) << 12
    rate = MPEG2_PICTURE_RATES[code - 1] if 1 <= code <= len(MPEG2_PICTURE_RATES) else None
    return (width, height, rate, profile, level) if width and height else None


def parameters_of(data: bytes | None):
    """Of the first H.264 parameter set or, without one, MPEG-2 sequence header in a stream."""
    if data is None:
        return None
    first, *units = re.split(b"\0\0\1", data)
    for unit in [*units, first]:
        if len(unit) >= 4 and unit[0] & 0x1F == 7:
            return h264_parameters(unit)
    return mpeg2_parameters(data)


def _pictures(found) -> pd.DataFrame:
    return pd.DataFrame([f or (None,) * 5 for f in found], columns=["width", "height", "frame_rate", "profile", "level"]).astype({"width": "Int32", "height": "Int32", "frame_rate": "float64"})


@on_call("struct<width:int,height:int,frame_rate:double,profile:string,level:string>")
def picture_parameters(data: pd.Series) -> pd.DataFrame:
    return _pictures(map(parameters_of, data))


@on_call("struct<width:int,height:int,frame_rate:double,profile:string,level:string>")
def picture_parameters_h265(data: pd.Series) -> pd.DataFrame:
    return _pictures(map(h265_parameters_of, data))
