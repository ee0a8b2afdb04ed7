"""Media segments as fragmented MP4 (K6, K7): boxes, segments from sample tables, and their files.

A segment is a few seconds of one track, so a group of samples is small; segments are made and written
wherever their samples are. Box names, versions and flags are the format's own, fixed values."""

from __future__ import annotations

import os
import struct
import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .captures import local_path

UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
#: Sample flags: one that others depend on and that depends on none, and any other.
SYNC_SAMPLE, OTHER_SAMPLE = 0x02000000, 0x01010000


def box(name: str, *inside: bytes) -> bytes:
    body = b"".join(inside)
    return struct.pack(">I4s", 8 + len(body), name.encode()) + body


def full_box(name: str, version: int, flags: int, *inside: bytes) -> bytes:
    return box(name, struct.pack(">I", version << 24 | flags), *inside)


def video_entry(width: int, height: int, config: bytes) -> bytes:
    """An AVC sample entry with its decoder configuration."""
    head = bytes(6) + struct.pack(">H16xHHIII H32sHh", 1, width, height, 0x480000, 0x480000, 0, 1, bytes(32), 24, -1)
    return box("avc1", head, box("avcC", config))


def audio_entry(channels: int, rate: int, config: bytes) -> bytes:
    """An AAC sample entry; ``config`` is the decoder's own part of its stream descriptor."""
    own = b"\x05" + bytes([len(config)]) + config
    decoder = b"\x04" + bytes([13 + len(own)]) + b"\x40\x15" + bytes(11) + own
    stream = b"\x03" + bytes([3 + len(decoder) + 3]) + b"\0\0\0" + decoder + b"\x06\x01\x02"
    return box("mp4a", bytes(6), struct.pack(">H8xHHIHH", 1, channels, 16, 0, rate & 0xFFFF, 0), full_box("esds", 0, 0, stream))


def init_segment(entry: bytes, timescale: int, video: bool, width: int = 0, height: int = 0, track: int = 1) -> bytes:
    """What comes before all segments of a track: brands, its description, and no samples."""
    times = struct.pack(">4I", 0, 0, timescale, 0)
    movie = full_box("mvhd", 0, 0, times, struct.pack(">IH10x", 0x10000, 0x100), UNITY, bytes(24), struct.pack(">I", track + 1))
    header = full_box("tkhd", 0, 3, struct.pack(">5I8xHHH2x", 0, 0, track, 0, 0, 0, 0, 0 if video else 0x100), UNITY, struct.pack(">II", width << 16, height << 16))
    handler = full_box("hdlr", 0, 0, struct.pack(">I4s12x", 0, b"vide" if video else b"soun"), b"\0")
    place = box("dinf", full_box("dref", 0, 0, struct.pack(">I", 1), full_box("url ", 0, 1)))
    nothing = [full_box(n, 0, 0, bytes(4)) for n in ("stts", "stsc")] + [full_box("stsz", 0, 0, bytes(8)), full_box("stco", 0, 0, bytes(4))]
    sound = full_box("vmhd", 0, 1, bytes(8)) if video else full_box("smhd", 0, 0, bytes(4))
    table = box("stbl", full_box("stsd", 0, 0, struct.pack(">I", 1), entry), *nothing)
    media = box("mdia", full_box("mdhd", 0, 0, times, struct.pack(">HH", 0x55C4, 0)), handler, box("minf", sound, place, table))
    extends = box("mvex", full_box("trex", 0, 0, struct.pack(">5I", track, 1, 0, 0, 0)))
    return box("ftyp", b"iso6", bytes(4), b"iso6cmfcmp41") + box("moov", movie, box("trak", header, media), extends)


def media_segment(number: int, first: int, durations: list[int], offsets: list[int], keys: list[bool], data: list[bytes], track: int = 1) -> bytes:
    """A fragment with all its samples: their durations, composition offsets (may be negative) and bytes, from
    decode time ``first``."""
    each = b"".join(struct.pack(">IIIi", d, len(x), SYNC_SAMPLE if k else OTHER_SAMPLE, o) for d, o, k, x in zip(durations, offsets, keys, data, strict=True))

    def movie(at: int) -> bytes:
        run = full_box("trun", 1, 0x000F01, struct.pack(">Ii", len(data), at), each)
        return box("moof", full_box("mfhd", 0, 0, struct.pack(">I", number)), box("traf", full_box("tfhd", 0, 0x020000, struct.pack(">I", track)), full_box("tfdt", 1, 0, struct.pack(">Q", first)), run))

    return box("styp", b"msdh", bytes(4), b"msdhmsix") + movie(len(movie(0)) + 8) + box("mdat", *data)


def media_segments(samples: DataFrame, keys: list[str], track: int = 1) -> DataFrame:
    """(keys, segment_id, first_dts, duration, samples, data) of ``samples`` (keys, segment_id, dts, duration,
    offset, key, data; keys and times are longs), one row a segment. Samples are taken by dts; null bytes are
    empty, a null offset is 0. A segment's number is its segment_id + 1, as numbers begin with 1."""
    schema = ", ".join(f"{k} long" for k in keys) + ", segment_id long, first_dts long, duration long, samples long, data binary"

    def made(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("dts", kind="stable")
        head = frame.iloc[0]
        durations = frame["duration"].astype(int).tolist()
        data = media_segment(int(head["segment_id"]) + 1, int(head["dts"]), durations, frame["offset"].fillna(0).astype(int).tolist(), frame["key"].fillna(False).astype(bool).tolist(), [b"" if x is None else x for x in frame["data"]], track)
        return pd.DataFrame([(*(head[k] for k in keys), head["segment_id"], head["dts"], sum(durations), len(frame), data)], columns=[c.split()[0] for c in schema.split(", ")])

    return samples.select(*keys, "segment_id", "dts", "duration", "offset", "key", "data").groupBy(*keys, "segment_id").applyInPandas(made, schema)


@dataclass
class Renames(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class _FileWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = local_path(options["path"])

    def write(self, rows) -> Renames:
        told = Renames()
        for name, data in rows:
            final = os.path.join(self.path, name)
            if not os.path.abspath(final).startswith(os.path.abspath(self.path) + os.sep):
                raise ValueError(f"{name} lies outside the folder")
            os.makedirs(os.path.dirname(final), exist_ok=True)
            part = f"{final}.{uuid.uuid4().hex}.tmp"
            with open(part, "wb") as file:
                file.write(data)
            told.files.append((part, final))
        return told

    def commit(self, messages) -> None:
        for part, final in (f for m in messages for f in m.files):
            os.replace(part, final)

    def abort(self, messages) -> None:
        for part, _ in (f for m in messages if m is not None for f in m.files):
            if os.path.exists(part):
                os.remove(part)


class NamedFiles(DataSource):
    """Rows (name, data) written as files under a folder: each under another name until all tasks have written
    theirs, so that a player never sees part of a file and a failed job leaves none. Option: path, on a file
    system that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)


def write_segments(segments: DataFrame, path: str, prefix: str = "seg", *folders: str) -> None:
    """The files that ``export.dash_manifest`` and ``export.live_playlist`` name, in a folder for each of the
    columns ``folders``."""
    register(segments.sparkSession)
    number = F.format_string(f"{prefix}-%05d.m4s", F.col("segment_id") + 1)
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in folders], number)
    segments.select(name.alias("name"), "data").write.format("named_files").option("path", path).mode("append").save()
