"""Token ids in files of byte-aligned variable-length codes (operator 12).

Ids are replaced by their rank in the corpus, the most frequent first, so that most take one byte. Four
ranks share a control byte, two bits each, which say how many bytes a rank has (1 to 4); control bytes and
data bytes are kept apart, so a reader finds all lengths by a table with a row for each control byte.

The format is a folder with two Parquet tables, which Spark writes and commits on any file system. ``ranks``
has one row, the ids by rank. ``blocks`` has a row for each run of whole documents: part and block (their
order is that of the documents), first (ids before it in its part), doc_ids, lengths, control and data."""

from __future__ import annotations

import json
import os
import re
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, shared_dir

#: Distinct words whose ids a worker keeps (and a third as many other pre-tokens), twice: those seen since it
#: was last full, and those before. When the new ones are full they become the old ones.
CACHE = 3 << 17
#: A block is closed by the first document that ends at so many ids or more.
BLOCK = 1 << 13

#: The split of byte-level BPE that ``pieces`` is proved for; a fixed value of the vocabulary's library.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space before a character that isn't space always begins a pre-token of SPLIT: a run of spaces gives up
#: its last one there, and nothing else that it could belong to reaches over it. So texts can be cut there.
CUT = re.compile(r" (?=\S)").split


class Remembered:
    """Values for strings, of which the often used ones stay."""

    def __init__(self, make, most: int):
        self.make, self.most, self.new, self.old = make, most, {}, {}

    def find(self, key: str) -> bytes:
        """For a key that isn't in ``new``."""
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = found
        return found

    def __call__(self, key: str) -> bytes:
        return self.new.get(key) or self.find(key)


class TokenEncoder:
    """The ids of a text as the tokenizers library gives them, without special tokens added, as bytes of
    ``dtype``. Texts are cut at spaces; the library's merges run once for each distinct word, and pre-token of
    other pieces, that is remembered. Vocabularies of another kind are encoded text by text."""

    def __init__(self, vocabulary: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.code = Tokenizer.from_str(vocabulary), "H" if np.dtype(dtype).itemsize == 2 else "I"
        kind = json.loads(vocabulary)
        split = kind.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        added = kind.get("added_tokens", [])
        self.cuts = plain and kind["model"]["type"] == "BPE" and not kind.get("normalizer") and not kind["model"].get("dropout") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.split, self.merge = regex.compile(SPLIT).findall, self.tokenizer.model.tokenize
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.special_ids = {t["content"]: self._bytes([t["id"]]) for t in added}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # one character for each byte, from characters that between them have all bytes of UTF-8
        some = [*map(chr, range(0x800)), *(chr(c) for c in range(0x800, 0x110000, 0x400) if not 0xD800 <= c < 0xE000)]
        self.letters = {b: c for x in some for b, c in zip(x.encode(), level.pre_tokenize_str(x)[0][0], strict=True)}
        self.words, self.tokens = Remembered(lambda word: self._merged(f" {word}"), CACHE), Remembered(self._merged, CACHE // 3)
        self.marks = {c: self._merged(c) for c in string.punctuation + "\n"} if self.cuts else {}

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _merged(self, token: str) -> bytes:
        return self._bytes([t.id for t in self.merge(token.encode().decode("latin-1").translate(self.letters))])

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.tokens, self.split(piece)))

    def _after_space(self, part: str) -> bytes:
        """The ids of a space and ``part``, which begins with no space and isn't among the new words. Letters
        are one pre-token with the space before them, and a mark after them is one more."""
        if part.isalpha():
            return self.words.find(part)
        if part[-1] in self.marks and part[:-1].isalpha():
            return self.words(part[:-1]) + self.marks[part[-1]]
        first, line, second = part.partition("\n")  # a line end between letters and marks is a pre-token
        if line and first[:-1].isalpha() and first[-1] in self.marks and second.isalpha():
            return self.words(first[:-1]) + self.marks[first[-1]] + self.marks[line] + self.tokens(second)
        return self._piece(f" {part}")

    def _joined(self, parts: list[str]) -> bytes | None:
        """None if some part but the first begins with space, where a text may not be cut."""
        out = [self._piece(parts[0]), *map(self.words.new.get, parts[1:])]
        at = 0
        try:
            while True:
                at = out.index(None, at)
                if not parts[at] or parts[at][0].isspace():
                    return None
                out[at] = self._after_space(parts[at])
        except ValueError:
            return b"".join(out)

    def _plain(self, text: str) -> bytes:
        return self._joined(text.split(" ")) or self._joined(CUT(text))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cuts:
            return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return b"".join(self.special_ids[p] if i % 2 else self._plain(p) if p else b"" for i, p in enumerate(parts))
        return self._plain(text)


@lru_cache(maxsize=2)
def _worker_encoder(shared, dtype: str) -> TokenEncoder:
    """One a worker, which keeps what it remembers from task to task."""
    return TokenEncoder(shared.value, dtype)


def id_type(vocabulary: str, end: int) -> str:
    """Two bytes an id where all fit, else four."""
    kind = json.loads(vocabulary)
    most = max([end, *(t["id"] for t in kind.get("added_tokens", [])), *(v if isinstance(v, int) else i for i, v in enumerate((kind["model"]["vocab"]).values()))])
    return "<u2" if most < 1 << 16 else "<u4"


_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)])
_SIZE = _LENGTHS.sum(axis=1)
_BEFORE = _LENGTHS.cumsum(axis=1) - _LENGTHS
#: For each control byte, where the 16 bytes of four ranks are, from the group's start, and which of them are there.
_PLACE = (_BEFORE[:, :, None] + np.arange(4)).reshape(256, 16)
_THERE = np.where(np.arange(4) < _LENGTHS[:, :, None], 255, 0).astype(np.uint8).reshape(256, 16)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes; the last control byte counts absent ranks as zeros of one byte,
    which aren't in the data."""
    n, width = len(ranks), 2 if int(ranks.max(initial=0)) <= 0xFFFF else 4
    whole = np.zeros(-(-n // 4) * 4, f"<u{width}")
    whole[:n] = ranks
    more = (whole > 0xFF).astype(np.uint8)
    if width == 4:
        more += (whole > 0xFFFF).astype(np.uint8) + (whole > 0xFFFFFF)
    quads = more.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    there = np.arange(width, dtype=np.uint8) <= more[:n, None]
    return control.tobytes(), whole[:n].view(np.uint8).reshape(-1, width)[there].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks: a row of places and one of masks for each control byte, from tables."""
    groups = np.frombuffer(control, np.uint8)
    sizes = _SIZE[groups]
    padded = np.zeros(len(data) + 32, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    quads = padded[(sizes.cumsum() - sizes)[:, None] + _PLACE[groups]] & _THERE[groups]
    return quads.reshape(-1).view("<u4")[:n]


def _batches(found: Iterator[tuple], names: list[str], types: list[pa.DataType], rows: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in found:
        held.append(row)
        if len(held) >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def write_tokens(docs: DataFrame, vocabulary_path: str, path: str, end: int | None = None) -> None:
    """Encodes every text of ``docs`` (doc_id, a long; text) and writes the ids as a new folder ``path``.

    Documents are in ascending order of doc_id (null first; of one doc_id, by checksum of the ids), each
    with the id ``end`` after it if one is given. Null texts count as empty, repeated rows each have their
    place, other columns are left out, no rows give a folder without blocks. A text is never cut, so a block has
    as many ids as its last document makes it have.

    Texts are encoded once; the ids are written, and what each task has counted, which gives the ranks (a row for
    each id of the vocabulary comes to the driver); then ids are ranged by document and packed."""
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    dtype = id_type(vocabulary, end or 0)
    tail, shared, width = (np.array([end], dtype).tobytes() if end is not None else b""), spark.sparkContext.broadcast(vocabulary), np.dtype(dtype).itemsize
    keys = ["doc_id", "crc", "uid"]

    names = ["doc_id", "crc", "ids", "counts"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = _worker_encoder(shared, dtype), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids = [encoder.encode(t.as_py()) + tail for t in some.column("text")]
                new = np.bincount(np.frombuffer(b"".join(ids), dtype), minlength=len(seen))
                new[: len(seen)] += seen
                seen = new
                crcs = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), crcs, pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.tobytes()], pa.binary())], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column("counts"):
                n = np.frombuffer(counts.as_py(), np.int64)
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["id", "n"])

    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, crc long, ids binary, counts binary")
    encoded = materialise(encoded.withColumn("uid", F.monotonically_increasing_id()), "ids", compression="zstd")
    counts = encoded.where("counts IS NOT NULL").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    spark.createDataFrame([(order,)], "ids array<long>").write.parquet(f"{path}/ranks")
    ranks = spark.sparkContext.broadcast(rank)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, block, first, doc_ids, held, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def packed() -> tuple:
            return part, block, first, doc_ids, [len(x) // width for x in held], *pack(ranks.value[np.frombuffer(b"".join(held), dtype)])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                doc_ids.append(doc_id)
                held.append(ids.as_py())
                size += len(held[-1]) // width
                if size >= BLOCK:
                    yield packed()
                    block, first, doc_ids, held, size = block + 1, first + size, [], [], 0
        if held:
            yield packed()

    names = ["part", "block", "first", "doc_ids", "lengths", "control", "data"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    ranged = encoded.where("ids IS NOT NULL").drop("counts").repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    written = ranged.mapInArrow(lambda b: _batches(blocks(b), names, types, 64), "part int, block long, first long, doc_ids array<long>, lengths array<long>, control binary, data binary")
    written.write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """What ``write_tokens`` wrote: doc_id, start (ids of all documents before it), n_tokens and ids, or,
    with ``digest``, ids_crc32 of the ids as unsigned little-endian 32-bit integers instead of them."""
    stored = spark.read.parquet(f"{path}/blocks")
    sizes = stored.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("size"))
    before = sizes.select(F.col("part").alias("of"), (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    ids_of = np.array(spark.read.parquet(f"{path}/ranks").first()["ids"] or [0], np.uint32)
    shared = spark.sparkContext.broadcast(ids_of)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, doc_ids, lengths, control, data = (batch.column(c)[row].as_py() for c in ("part", "first", "doc_ids", "lengths", "control", "data"))
                ids, at = shared.value[unpack(control, data, sum(lengths))].astype("<u4"), 0
                for doc_id, n in zip(doc_ids, lengths, strict=True):
                    own = ids[at : at + n]
                    yield part, doc_id, first + at, n, zlib.crc32(own) if digest else own
                    at += n

    last, kind, arrow = ("ids_crc32", "long", pa.int64()) if digest else ("ids", "array<long>", pa.list_(pa.int64()))
    names, types = ["part", "doc_id", "start", "n_tokens", last], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), arrow]
    found = stored.mapInArrow(lambda b: _batches(documents(b), names, types, 1024), f"part int, doc_id long, start long, n_tokens long, {last} {kind}")
    # a row a written part, so no more than the partitions of one shuffle
    return found.join(F.broadcast(before), F.col("part") == F.col("of")).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", last)


def fresh_path(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark)}/tidegauge/tokens-{uuid.uuid4().hex}"
