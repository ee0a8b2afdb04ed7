"""Shards along a Hilbert curve (operator 6)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, materialise, row_hash, without


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``cells`` (a column a dimension, values
    below 2**bits). Neighbours on the curve differ by one in one dimension.

    From the top bit down, the cell's quadrant is looked at in the frame of the sub-curve that
    enters it; the frame (a reflection and an exchange of axes) is undone on the lower bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(dims):
            high = x[d] >> level & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(high, low, swap)
            x[d] ^= swap if d else 0
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = index << 1 | x[d] >> level & 1
    return index


def category(column: str, bits: int) -> Column:
    """A label's cell: equal labels share it, so a file's range of cells can rule a label out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(1 << bits)), F.lit(0)).cast("int")


def magnitude(value: Column, bits: int, per_octave: int = 3) -> Column:
    """A count's cell on a logarithmic scale; null and below one: 0, beyond the scale: the last."""
    level = F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double")) * per_octave)
    return F.coalesce(F.least(level, F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


#: A function that adds columns to rows of source and doc_id, and the names of those that order them.
Schedule = tuple[Callable[[DataFrame], DataFrame], list[str]] | None


def _counted(ranged: DataFrame, at: str) -> tuple[DataFrame, Column]:
    """``ranged``, a written table numbered in its partitions by ``at``, with three columns more; and a
    row's place in the whole order with the count of all rows."""
    own, prior, whole = (free_name(ranged, name) for name in ("part", "before", "all"))
    part, total = F.shiftright(at, 33), Window.orderBy("part")
    counts = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = counts.select(F.col("part").alias(own), (F.sum("rows").over(total) - F.col("rows")).alias(prior), F.sum("rows").over(total.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(whole))
    place = F.struct((F.col(prior) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).alias("p"), F.col(whole).alias("n"))
    return ranged.join(F.broadcast(before), part == F.col(own)), place


def shard_by_curve(docs: DataFrame, cells: list[Column], bits: int, shards: int, order: list[str], slots_by: Schedule = None) -> DataFrame:
    """``docs`` with curve (Hilbert index of its cells), shard and slot.

    Rows are ranged by curve, then by ``order``, then by row hash, and that order is cut into runs
    whose row counts differ by one at most; slot counts from 0 in a shard. Rows that are equal in
    all columns may change places. No rows give no rows; with fewer rows than shards some shards
    stay empty. The ranged rows are written once; only a row a partition of them is counted up.

    With ``slots_by``, a function that adds columns to rows of source and doc_id and the names of
    those that order them, slot counts in that order instead; shards stay as they are."""

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    docs = docs.withColumn("curve", curve(*cells))
    docs = without(docs, ["shard", "slot"])
    at, tie, luck = free_name(docs, "at"), free_name(docs, "tie"), free_name(docs, "luck")
    keys = ["curve", *order, tie, luck]
    ranged = docs.withColumn(tie, row_hash(docs)).withColumn(luck, F.rand(7))
    ranged = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie, luck)
    ranged = materialise(ranged.withColumn(at, F.monotonically_increasing_id()), "ranged")
    joined, place = _counted(ranged, at)
    joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], place.alias(at))
    run = F.expr(f"{at}.p * {shards} div {at}.n").cast("int")
    slot = F.expr(f"{at}.p - (shard * {at}.n + {shards} - 1) div {shards}")
    if slots_by is None:
        return joined.withColumn("shard", run).withColumn("slot", slot).drop(at)
    schedule, turns = slots_by
    sharded = joined.withColumn("shard", run)
    due = schedule(sharded.select("source", "doc_id", "shard", F.col(f"{at}.p").alias("row"))).select("shard", "row", *turns)
    due = due.repartitionByRange("shard", *turns, "row").sortWithinPartitions("shard", *turns, "row").select("shard", "row", F.monotonically_increasing_id().alias(at))
    due, place = _counted(materialise(due, "due"), at)
    due = due.select("shard", "row", place.alias(at)).select(F.col("row").alias(tie), slot.alias("slot"))
    return sharded.join(due, F.col(f"{at}.p") == F.col(tie)).drop(at, tie)


def write_shards(sharded: DataFrame, path: str, shards: int) -> None:
    """One folder a shard, rows in slot order, so that files hold short stretches of the curve."""
    sharded.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def size_of(text: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8 for the row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def curve_shards(docs: DataFrame, shards: int = 24, bits: int = 6, slots_by: Schedule = None) -> DataFrame:
    """``docs`` with curve, shard and slot: sharded by source, language and size (a column of
    ``docs``; see ``size_of``)."""
    return shard_by_curve(docs, [category("source", bits), category("lang", bits), magnitude(F.col("size"), bits)], bits, shards, ["doc_id"], slots_by)
