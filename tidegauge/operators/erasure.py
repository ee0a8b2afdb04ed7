"""Parity matrices over bytes (Q12 to Q14): cells of L columns and D rows, numbered from the base that their parity
packets name. Spark lays cells into their matrices and shuffles a matrix's cells together; numpy works on all
matrices of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of cells that are laid out in numpy at a time.
AT_ONCE = 1 << 24

CELL, COLUMN, ROW = 0, 1, 2


def _slices(batches: Iterator[pa.RecordBatch], columns: int, depth: int) -> Iterator[tuple]:
    """(rows, have, data) of some matrices at a time. ``data`` has L * D cells, then L column parities, then D row
    parities a matrix; a cell is its length (two bytes; a parity has the lengths' parity there) and its payload,
    filled up with zeros. What isn't there is zero and false in ``have``. Parts are laid out from Arrow's buffers:
    as Python objects those of one batch would take hundreds of megabytes."""
    size, offset = columns * depth, np.array([0, columns * depth, columns * depth + columns])
    for batch in batches:
        keys = pd.DataFrame({k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("flow_id", "base")})
        parts, per_row = batch.column("parts").flatten(), pc.list_value_length(batch.column("parts")).to_numpy(zero_copy_only=False)
        what, at, held = parts.flatten()
        place, length = offset[what.to_numpy(zero_copy_only=False)] + at.to_numpy(zero_copy_only=False), pc.binary_length(held).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(per_row)])
        step = max(1, AT_ONCE // (int(length.max(initial=1)) * (size + columns + depth)))
        for first in range(0, len(keys), step):
            rows = keys.iloc[first : first + step].reset_index(drop=True)
            own = slice(ends[first], ends[first + len(rows)])
            widths, matrix = length[own], np.repeat(np.arange(len(rows)), per_row[first : first + len(rows)])
            data = np.zeros((len(rows), size + columns + depth, int(widths.max(initial=1))), np.uint8)
            have = np.zeros(data.shape[:2], bool)
            have[matrix, place[own]] = True
            inside = np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths)
            joined = np.frombuffer(b"".join(held[own.start : own.stop].to_pylist()), np.uint8)
            data[np.repeat(matrix, widths), np.repeat(place[own], widths), inside] = joined
            yield rows, have, data


#: What is given back.
PARITIES = pa.schema([("flow_id", pa.int64()), ("base", pa.int64()), ("is_column", pa.bool_()), ("index", pa.int64()), ("payload", pa.binary())])
RECOVERED = pa.schema([("flow_id", pa.int64()), ("vseq", pa.int64()), ("payload", pa.binary())])


def _arrow(rows: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(pd.DataFrame(rows), schema, preserve_index=False)


def _solved(have: np.ndarray, data: np.ndarray, columns: int, depth: int) -> np.ndarray:
    """Fills cells of ``data`` in place: a line (column or row) with its parity and but one cell missing gives that
    cell, until no line does. Returns which cells were filled."""
    size, n = columns * depth, len(data)
    grid, there = data[:, :size].reshape(n, depth, columns, -1), have[:, :size].reshape(n, depth, columns).copy()
    began = there.copy()
    lines = [(1, have[:, size : size + columns], data[:, size : size + columns]), (2, have[:, size + columns :], data[:, size + columns :])]
    filled = True
    while filled:
        filled = False
        for axis, known, parity in lines:
            matrix, line = np.nonzero(known & ((~there).sum(axis) == 1))
            if not len(matrix):
                continue
            filled = True
            cells = grid[matrix, :, line] if axis == 1 else grid[matrix, line]
            missing = (~(there[matrix, :, line] if axis == 1 else there[matrix, line])).argmax(1)
            at = (matrix, missing, line) if axis == 1 else (matrix, line, missing)
            grid[at] = np.bitwise_xor.reduce(cells, 1) ^ parity[matrix, line]
            there[at] = True
    data[:, :size] = grid.reshape(n, size, -1)
    return (there & ~began).reshape(n, size)


def _framed(payload: str):
    return F.concat(F.unhex(F.lpad(F.hex(F.length(payload)), 4, "0")), payload)


def _matrices(bases: DataFrame, media: DataFrame, parities: DataFrame | None, size: int) -> DataFrame:
    """(flow_id, base, parts) of the matrices that begin at ``bases``: their cells by number, an equality join."""
    places = bases.select("flow_id", "base", F.posexplode(F.sequence(F.col("base"), F.col("base") + size - 1)).alias("at", "vseq"))
    parts = places.join(media.select("flow_id", "vseq", _framed("payload").alias("data")), ["flow_id", "vseq"]).select("flow_id", "base", F.lit(CELL).alias("what"), "at", "data")
    if parities is not None:
        parts = parts.unionByName(parities.select("flow_id", "base", F.when(F.col("is_column"), COLUMN).otherwise(ROW).alias("what"), F.col("index").cast("int").alias("at"), F.col("payload").alias("data")))
    return parts.groupBy("flow_id", "base").agg(F.collect_list(F.struct("what", "at", "data")).alias("parts"))


def byte_parity(media: DataFrame, bases: DataFrame, columns: int, depth: int) -> DataFrame:
    """Q12 in bytes: (flow_id, base, is_column, index, payload), the parity packets of each matrix of ``bases``
    (flow_id, base; distinct) all of whose cells are in ``media`` (flow_id, vseq, payload). Numbers are unwrapped,
    a number is there once at most, payloads are not null and under 64 KiB. No rows give no rows."""

    def encode(batches):
        for rows, have, data in _slices(batches, columns, depth):
            whole = have[:, : columns * depth].all(1)
            rows, grid = rows[whole], data[whole, : columns * depth].reshape(int(whole.sum()), depth, columns, -1)
            for name, axis in ((True, 1), (False, 2)):
                sums = np.bitwise_xor.reduce(grid, axis)
                k = sums.shape[1]
                yield _arrow({"flow_id": np.repeat(rows["flow_id"].to_numpy(), k), "base": np.repeat(rows["base"].to_numpy(), k), "is_column": name, "index": np.tile(np.arange(k), len(rows)), "payload": pd.Series([s.tobytes() for s in sums.reshape(-1, sums.shape[-1])], dtype=object)}, PARITIES)

    return _matrices(bases, media, None, columns * depth).mapInArrow(encode, "flow_id long, base long, is_column boolean, index long, payload binary")


def recover_bytes(media: DataFrame, parities: DataFrame, columns: int, depth: int) -> DataFrame:
    """Q13 with Q14: (flow_id, vseq, payload) of the lost packets that parities of their column and row restore, by
    single erasures until none is left. ``media`` is as in ``byte_parity``; ``parities`` are its rows, as many as
    arrived. A matrix begins at the base in its parities' headers, so cells have their right places even where its
    first packets are lost; packets of no matrix restore nothing. A matrix of which no packet came has but
    parities and restores nothing unless L or D is 1. Rows come back in no order."""

    def solve(batches):
        size = columns * depth
        for rows, have, data in _slices(batches, columns, depth):
            matrix, cell = np.nonzero(_solved(have, data, columns, depth))
            found = data[matrix, cell]
            length = found[:, 0].astype(int) * 256 + found[:, 1]
            payload = [row[2 : 2 + n].tobytes() for row, n in zip(found, length, strict=True)]
            yield _arrow({"flow_id": rows["flow_id"].to_numpy()[matrix], "vseq": rows["base"].to_numpy()[matrix] + cell, "payload": pd.Series(payload, dtype=object)}, RECOVERED)

    bases = parities.select("flow_id", "base").distinct()
    return _matrices(bases, media, parities, columns * depth).mapInArrow(solve, "flow_id long, vseq long, payload binary")
