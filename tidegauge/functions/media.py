"""Small rules of audio, video and clips as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gain of a channel that is mixed in at -3 dB.
_3DB = 0.70710677

#: Outputs of the channel presets, each a list of (input channel, gain), by the inputs they need. Fixed values.
PRESETS = {
    "mono_to_stereo": (1, [[(0, 1.0)], [(0, 1.0)]]),
    "stereo_to_mono_3db": (2, [[(0, _3DB), (1, _3DB)]]),
    "stereo_to_mono_6db": (2, [[(0, 0.5), (1, 0.5)]]),
    "5_1_to_stereo_bs775": (6, [[(0, 1.0), (2, _3DB), (4, _3DB)], [(1, 1.0), (2, _3DB), (5, _3DB)]]),
    "7_1_to_stereo_bs775": (8, [[(0, 1.0), (2, _3DB), (4, _3DB), (6, _3DB)], [(1, 1.0), (2, _3DB), (5, _3DB), (7, _3DB)]]),
    "4ch_to_stereo_lt_rt": (4, [[(0, 1.0), (2, _3DB)], [(1, 1.0), (3, _3DB)]]),
}

#: Names of colour primaries. Fixed values.
PRIMARIES = {1: "bt709", 4: "bt470m", 5: "bt470bg", 6: "smpte170m", 7: "smpte240m", 8: "film", 9: "bt2020", 10: "smpte428", 11: "smpte431", 12: "smpte432", 22: "ebu3213"}

#: Aspect ratios that pictures within half a percent are called by. Fixed values.
ASPECTS = [(16 / 9, "16:9"), (4 / 3, "4:3"), (21 / 9, "21:9"), (256 / 135, "17:9 (DCI)"), (1.85, "1.85:1"), (2.39, "2.39:1")]

#: 90 kHz ticks of one audio frame, by stream types. Fixed values.
FRAME_TICKS = [([0x03, 0x04], 2160), ([0x0F, 0x11], 1920), ([0x81, 0x83, 0x84, 0x85, 0x87], 2880)]

#: Unit types that a picture can't be built without. Fixed values.
CRITICAL_H264, CRITICAL_HEVC = (5, 7, 8), (19, 20, 21, 32, 33, 34)


def hex_encode(data: Column) -> Column:
    """P11."""
    return F.lower(F.hex(data))


def hex_decode(text: Column) -> Column:
    """P11; null for odd lengths and other characters."""
    return F.when(text.rlike("^(?:[0-9a-fA-F]{2})*$"), F.unhex(text))


def decode_pcm(data: Column, depth: int, channels: int) -> Column:
    """Big-endian PCM of 16, 20 or 24 bits (20 in the upper bits of three bytes) to one array a
    channel of numbers from -1 to 1; null if the bytes are no whole frames."""
    size = 2 if depth == 16 else 3
    frames = F.length(data) / (size * channels)
    raw = lambda at: F.conv(F.hex(F.substring(data, at + 1, F.lit(size))), 16, 10).cast("long")
    signed = lambda v: F.when(v >= 1 << 8 * size - 1, v - (1 << 8 * size)).otherwise(v)
    level = (lambda v: F.floor(v / 16) / float(1 << 19)) if depth == 20 else (lambda v: v / float(1 << 8 * size - 1))
    one = lambda c: F.transform(F.sequence(F.lit(0), frames.cast("int") - 1), lambda i: level(signed(raw((i * channels + c) * size))))
    some = F.array(*[one(c) for c in range(channels)])
    return F.when(data.isNull() | (F.length(data) % (size * channels) != 0), None).when(F.length(data) > 0, some).otherwise(F.array(*[F.array().cast("array<double>")] * channels))


def mix_channels(planes: Column, preset: str) -> Column:
    """Arrays of channels through a preset; null if their number isn't the preset's."""
    need, outputs = PRESETS[preset]
    plane = lambda c, gain: F.transform(F.get(planes, c), lambda x: x * gain)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    return F.when(F.size(planes) == need, F.array(*[reduce(add, [plane(*part) for part in row]) for row in outputs]))


def aspect_ratio(width: str, height: str, sar_width: str, sar_height: str) -> Column:
    """Display aspect, by a usual name if within half a percent of it; null for empty pictures."""
    w, h = F.col(width) * F.greatest(F.col(sar_width), F.lit(1)), F.col(height) * F.greatest(F.col(sar_height), F.lit(1))
    name = F.lit(None).cast("string")
    for ratio, label in reversed(ASPECTS):
        name = F.when(F.abs(w / h - ratio) / ratio < 0.005, label).otherwise(name)
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(64)), F.struct(w.cast("long").alias("a"), h.cast("long").alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1))).alias("b"))), lambda s: s["a"])
    whole = F.concat_ws(":", (w / steps).cast("long"), (h / steps).cast("long"))
    return F.when((F.col(width) > 0) & (F.col(height) > 0), F.coalesce(name, whole))


def primaries_name(code: Column) -> Column:
    """P19."""
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in PRIMARIES.items() for x in (k, v)])[code], F.lit("unspecified"))


def clip_tags(tags: Column) -> Column:
    """The tags without repeats, in order; null if there are over 16 or one isn't 1 to 32 of A-Z, 0-9, _
    and -."""
    good = (F.size(tags) <= 16) & F.forall(tags, lambda t: t.rlike(r"^[A-Z0-9_-]{1,32}\z"))
    return F.when(good, F.array_distinct(tags))


def clip_is_valid(name: Column, description: Column) -> Column:
    """Names of up to 256 bytes, descriptions of up to 4096."""
    return (F.octet_length(name) <= 256) & (F.coalesce(F.octet_length(description), F.lit(0)) <= 4096)


def _critical_bytes() -> str:
    return "".join(f"\\x{b:02x}" for b in range(256) if b & 0x1F in CRITICAL_H264 or b >> 1 & 0x3F in CRITICAL_HEVC)


def holds_critical_unit(data: Column) -> Column:
    """Whether a start code is followed by a unit of a critical type of either codec."""
    return F.decode(data, "ISO-8859-1").rlike(f"(?s)\\x00\\x00\\x01[{_critical_bytes()}]")


def critical_with_carry(data: Column, before: Column) -> Column:
    """Q22: ``holds_critical_unit`` with the last two bytes of the datagram before in front, as a start code
    may straddle two; the first one has none before."""
    tail = F.coalesce(F.substring(before, -2, 2), F.lit(b""))
    return holds_critical_unit(F.concat(tail, data))


def sampling(interval: Column) -> Column:
    """(interval, sample, threshold, frames) of a preview every ``interval`` seconds (1 to 60, unset 5):
    a picture is sampled every five seconds at most often, has frozen after thirty seconds, two samples
    at least, and 8 to 50 frames may be decoded."""
    secs = F.when(interval.isNull(), F.lit(5)).otherwise(F.least(F.greatest(interval.cast("long"), F.lit(1)), F.lit(60)))
    sample = F.greatest(secs, F.lit(5))
    return F.struct(secs.alias("interval"), sample.alias("sample"), F.greatest(F.ceil(30 / sample), F.lit(2)).alias("threshold"), F.least(F.greatest(secs * 10, F.lit(8)), F.lit(50)).alias("frames"))


def audio_frame_ticks(stream_type: Column) -> Column:
    """Null for other types."""
    out = F.lit(None).cast("int")
    for types, ticks in FRAME_TICKS:
        out = F.when(stream_type.isin(types), ticks).otherwise(out)
    return out


def error_code(details: Column) -> Column:
    """The error_code of an event's JSON details."""
    return F.coalesce(F.get_json_object(details, "$.error_code"), F.lit("(no_error_code)"))
