"""Capture files and transport streams on a mounted file system, as Spark data sources.

Files are read in byte ranges, so that a large one spreads over tasks. A range that doesn't begin at a file's
start finds the first record, or cell, in it by what follows; it gives those that begin in it and reads the
last one to its end in the range after it. Readers open files themselves, so all executors must mount them."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed values of the formats: first number of a capture file in microseconds, its two headers, and cells.
MAGIC, FILE_HEADER, RECORD_HEADER, CELL, SYNC = 0xA1B2C3D4, 24, 16, 188, 0x47
#: Records or cells in a row that must fit for a place to be taken as a beginning.
RUN = 5
#: Cells that are read before a range to get in step.
LEAD = 64
#: Ranges that what is read is cut into, but for one a file more: beyond, ranges get longer, as each is a task.
MOST_RANGES = 1024
#: Bytes read at a time, and the fewest.
PIECE, LEAST_PIECE = 1 << 20, 1 << 12
#: Largest record, when a file's own limit is 0 or larger.
SNAP = 262_144


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int

    def piece(self) -> int:
        """Bytes to read at a time, so that a short range doesn't read far into the next ones."""
        return min(PIECE, max(LEAST_PIECE, self.end - self.start))


def local_path(path: str) -> str:
    """A path that Python can open."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path} isn't on a mounted file system")
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def ranges(path: str, ending: str, split: int) -> list[Range]:
    path = local_path(path)
    files = sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(ending)) if os.path.isdir(path) else [path]
    sized = [(f, os.path.getsize(f)) for f in files]
    split = max(split, -(-sum(size for _, size in sized) // MOST_RANGES))
    return [Range(f, at, min(at + split, size), size) for f, size in sized for at in range(0, size, split)]


class _Window:
    """A file's bytes from some place on, read in pieces; what lies behind the place asked for last is let go."""

    def __init__(self, file, at: int, piece: int):
        self.file, self.base, self.held, self.piece = file, at, b"", piece
        file.seek(at)

    def get(self, at: int, n: int) -> bytes:
        if at < self.base:
            self.base, self.held = at, b""
            self.file.seek(at)
        if at > self.base + self.piece:
            drop = min(at - self.base, len(self.held))
            self.held, self.base = self.held[drop:], self.base + drop
        while at + n > self.base + len(self.held) and (more := self.file.read(self.piece)):
            self.held += more
        return self.held[at - self.base : at - self.base + n]


class _RangeReader(DataSourceReader):
    ending = ""

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", 64 << 20))

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.ending, self.split)

    def rows(self, file, part: Range) -> Iterator[tuple]:
        raise NotImplementedError

    schema: pa.Schema

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        with open(part.path, "rb") as file:
            for row in self.rows(file, part):
                held.append(row)
                size += len(row[-1])
                if size >= 4 << 20:
                    yield self._batch(held)
                    held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)


class _CellReader(_RangeReader):
    ending, schema = ".ts", pa.schema([("file", pa.string()), ("place", pa.int64()), ("cell", pa.binary())])

    def rows(self, file, part: Range) -> Iterator[tuple]:
        """A cell begins with the sync byte, and so do the RUN cells from it on, or all to the file's end; once
        in step the next one alone has to. Reading begins some cells before the range, so that a place that
        only looks in step has been left when the range begins."""
        at, locked = max(part.start - LEAD * CELL, 0), False
        window = _Window(file, at, part.piece())
        while at < part.end and at + CELL <= part.size:
            ahead = range(at, min(at + (1 if locked else RUN) * CELL + 1, part.size), CELL)
            if all(window.get(x, 1)[0] == SYNC for x in ahead):
                if at >= part.start:
                    yield part.path, at, window.get(at, CELL)
                at, locked = at + CELL, True
            else:
                at, locked = at + 1, False


class _PacketReader(_RangeReader):
    ending = ".pcap"
    schema = pa.schema([("address", pa.string()), ("port", pa.int32()), ("recv_us", pa.int64()), ("data", pa.binary())])

    def rows(self, file, part: Range) -> Iterator[tuple]:
        head = file.read(FILE_HEADER)
        order = next((o for o in "<>" if len(head) == FILE_HEADER and struct.unpack(o + "I", head[:4])[0] == MAGIC), None)
        if order is None:
            raise ValueError(f"{part.path} isn't a capture file in microseconds")
        snap, link = struct.unpack(order + "II", head[16:])
        snap = min(snap or SNAP, SNAP)
        window, at = _Window(file, max(part.start, FILE_HEADER), part.piece()), max(part.start, FILE_HEADER)

        def record(at: int) -> tuple[int, int, int, int] | None:
            raw = window.get(at, RECORD_HEADER)
            if len(raw) < RECORD_HEADER:
                return None
            seconds, micros, kept, whole = struct.unpack(order + "IIII", raw)
            good = micros < 1_000_000 and 0 < kept <= snap and kept <= whole and at + RECORD_HEADER + kept <= part.size
            return (seconds, micros, kept, whole) if good else None

        def begins(at: int) -> bool:
            """Whether RUN records follow one another from here on, or as many as there are, within a day of one another."""
            first = None
            for _ in range(RUN):
                if at >= part.size and first is not None:
                    return True
                found = record(at)
                if found is None or abs(found[0] - (first if first is not None else found[0])) > 86_400:
                    return False
                first, at = found[0], at + RECORD_HEADER + found[2]
            return True

        if part.start:
            while at < part.end and not begins(at):
                at += 1
        while at < part.end and (found := record(at)):
            seconds, micros, kept, _ = found
            if sent := _datagram(window.get(at + RECORD_HEADER, kept), link):
                yield *sent[:2], seconds * 1_000_000 + micros, sent[2]
            at += RECORD_HEADER + kept


def _datagram(frame: bytes, link: int) -> tuple[str, int, bytes] | None:
    """(address, port, payload) of a UDP datagram over IPv4 in an Ethernet frame (link 1, with any VLAN tags) or
    raw (101); None for all else, and for what is cut off or in fragments."""
    at = 0
    if link == 1:
        at = 12
        while frame[at : at + 2] in (b"\x81\x00", b"\x88\xa8"):
            at += 4
        if frame[at : at + 2] != b"\x08\x00":
            return None
        at += 2
    if len(frame) < at + 28 or frame[at] >> 4 != 4 or frame[at + 9] != 17 or int.from_bytes(frame[at + 6 : at + 8], "big") & 0x3FFF:
        return None
    udp = at + 4 * (frame[at] & 0x0F)
    size = int.from_bytes(frame[udp + 4 : udp + 6], "big")
    if size < 8 or len(frame) < udp + size:
        return None
    return ".".join(map(str, frame[at + 16 : at + 20])), int.from_bytes(frame[udp + 2 : udp + 4], "big"), frame[udp + 8 : udp + size]


@dataclass
class Written(WriterCommitMessage):
    path: str
    final: str


class _PacketWriter(DataSourceWriter):
    """A file a task, under another name until the job commits, so that a lost executor leaves none behind."""

    def __init__(self, options: dict):
        self.path = local_path(options["path"])

    def write(self, rows) -> Written:
        os.makedirs(self.path, exist_ok=True)
        name = uuid.uuid4().hex
        part = Written(f"{self.path}/.{name}.tmp", f"{self.path}/{name}.pcap")
        with open(part.path, "wb") as file:
            file.write(struct.pack("<IHHiIII", MAGIC, 2, 4, 0, 0, SNAP, 1))
            for address, port, recv_us, data in rows:
                udp = struct.pack(">HHHH", 5004, port, 8 + len(data), 0) + bytes(data)
                ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(udp), 0, 0, 64, 17, 0, b"\0\0\0\0", bytes(map(int, address.split("."))))
                total = sum(struct.unpack(">10H", ip))
                total = (total & 0xFFFF) + (total >> 16)
                frame = bytes(12) + b"\x08\0" + ip[:10] + (~(total + (total >> 16)) & 0xFFFF).to_bytes(2, "big") + ip[12:] + udp
                file.write(struct.pack("<IIII", recv_us // 1_000_000, recv_us % 1_000_000, len(frame), len(frame)) + frame)
        return part

    def commit(self, messages) -> None:
        for m in messages:
            os.rename(m.path, m.final)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class PcapSource(DataSource):
    """UDP datagrams of capture files: address, port, recv_us, data. Options: path (a file, or a folder of .pcap
    files) and splitBytes, which grows beyond MOST_RANGES ranges. Written as files of Ethernet frames."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return "address string, port int, recv_us long, data binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PacketReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _PacketWriter(self.options)


class TransportStreamSource(DataSource):
    """Cells of transport stream files: file, place (its first byte), cell. Options: path (a file, or a folder of
    .ts files) and splitBytes, which grows beyond MOST_RANGES ranges. Bytes between which no cells are in step are left out."""

    @classmethod
    def name(cls) -> str:
        return "transport_stream"

    def schema(self) -> str:
        return "file string, place long, cell binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _CellReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to ``spark.read.format`` and pcap to ``write.format``."""
    spark.dataSource.register(PcapSource)
    spark.dataSource.register(TransportStreamSource)
