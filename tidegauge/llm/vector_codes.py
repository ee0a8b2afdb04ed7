"""Product codes of vectors, trained on distinct parts (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Integer components lie within this, so that squared distances of up to 1,024 components fit a long.
REACH = 1 << 25
#: A key with more than this share of the rows is joined by broadcast; there are fewer than its inverse of them.
HOT = 1000


def integer_vectors(vectors: DataFrame, scale: int, parts: int) -> DataFrame:
    """Written rows uid, vec_id, label, v, with v = floor(scale * x). Rows with a null vector, or with null or
    non-finite components, are left out; so are vectors whose integers would exceed REACH (their errors
    needn't fit a long), and those whose length isn't that of the smallest vec_id's or no multiple of ``parts``."""
    x = F.col("embedding")
    usable = F.size(x).between(1, 1024) & (F.size(x) % parts == 0) & F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < REACH / scale, F.lit(False)))
    rows = vectors.where(x.isNotNull() & usable).select("vec_id", "label", F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v"))
    rows = materialise(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    return rows.where(F.size("v") == (first[0] if first else 0))


def assign(positions: np.ndarray, parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each part's codebook, ties to the lower index."""
    code, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for p in np.unique(positions):
        own = np.flatnonzero(positions == p)
        for some in np.array_split(own, -(-len(own) // 4096)):
            away = ((parts[some][:, None, :] - books[p][None]) ** 2).sum(axis=2)
            code[some], error[some] = away.argmin(axis=1), away.min(axis=1)
    return code, error


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("part").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, -1)


def _moved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries move to the floor of the weighted mean of their parts; unused ones stay. What
    comes to the driver is one row of sums an entry."""
    n_books, n_entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((n_books * n_entries, width), np.int64), np.zeros(n_books * n_entries, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            position, weight, parts = batch.column("position").to_numpy(), batch.column("weight").to_numpy(), _matrix(batch)
            at = position * n_entries + assign(position, parts, books)[0]
            np.add.at(total, at, parts * weight[:, None])
            np.add.at(seen, at, weight)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used]), *(pa.array(total[used, i]) for i in range(width))], names=["at", "seen", *(f"s{i}" for i in range(width))])

    columns = [f"s{i}" for i in range(width)]
    partial = distinct.mapInArrow(sums, ", ".join(f"{c} long" for c in ["at", "seen", *columns]))
    books = books.copy()
    for row in partial.groupBy("at").agg(F.sum("seen").alias("seen"), *[F.sum(c).alias(c) for c in columns]).collect():
        books[divmod(row["at"], n_entries)] = [row[c] // row["seen"] for c in columns]
    return books


def _joined(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key and its number of rows: keys with
    more than one in HOT of all rows, of which there are fewer than HOT in each group that sums up to
    ``total``, are broadcast; the others, none of which is large, are shuffled."""
    hot = F.broadcast(table.where(F.col(weight) * HOT > total).drop(weight))
    cold = table.where(F.col(weight) * HOT <= total).drop(weight)
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def encode(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """Codes of ``vectors`` (vec_id, embedding, label), and the codebooks (part, entry, component).

    Integer vectors are cut into ``parts`` equal parts. Equal parts of a position become one row with a
    weight, and codebooks are trained and parts assigned on these rows only; codes and errors are then joined
    back to the vectors. Codebooks start as the parts of the smallest vec_ids (null ones last, then by
    components). The result has vec_id, label, code (two hex digits a part), error and label_error, the sum over
    equal labels, nulls together. Repeated vec_ids each get their row; with fewer vectors than entries the
    codebooks are shorter; other columns are left out; no rows give no rows.

    ``integer_vectors`` says which vectors take part. The driver holds codebooks and sums, which don't grow."""
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold up to 256 entries")
    kept = integer_vectors(vectors, scale, parts)
    first = [r["v"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    width = len(first[0]) // parts if first else 1
    books = np.array(first, np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    cut = F.array(*[F.slice("v", k * width + 1, width) for k in range(parts)])
    pieces = kept.select("uid", "vec_id", "label", F.posexplode(cut).alias("position", "part")).withColumn("position", F.col("position").cast("long"))
    distinct = materialise(pieces.groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")), "parts")
    if first:
        for _ in range(rounds):
            books = _moved(distinct, books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, error = assign(batch.column("position").to_numpy(), _matrix(batch), books)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], names=[*batch.schema.names, "c", "e"])

    assigned = materialise(distinct.mapInArrow(coded, "position long, part array<int>, weight long, c long, e long"), "codes")
    total = distinct.where("position = 0").agg(F.sum("weight")).first()[0] or 0
    back = _joined(pieces, assigned, ["position", "part"], "weight", total)
    # a part's two hex digits never meet another's, so the pieces of a vector can come in any order
    digits = [F.max(F.when(F.col("position") == k, F.lpad(F.lower(F.hex("c")), 2, "0"))) for k in range(parts)]
    codes = back.groupBy("uid").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.concat(*digits).alias("code"), F.sum("e").alias("error"))
    codes = materialise(codes.withColumn("_label", F.struct("label")).drop("uid"), "coded")
    by_label = materialise(codes.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    return _joined(codes, by_label, ["_label"], "n", total).select("vec_id", "label", "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position within the part."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
