"""Repair of conversation structure by a min-plus matrix scan (operator 13).

A repaired conversation's role initials fit ``(s?(ua)+)?``, read by four states: nothing yet, after the
system row, after a user row, after an assistant row. A turn is a 4x4 matrix over (cost, audit) elements:
which edits lead from a state to a state, inserts before the turn included. Matrices multiply by adding
costs and joining audits, and by taking the least cost and then the least audit, which is associative, so
a conversation's rows are reduced in a tree: within a partition by halves, and across partitions by runs.

Of equal cost and between the same two states no audit is the beginning of another (what follows would be
inserts, which cost), so the least audit of the parts gives the least audit of the whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

Element = tuple[int, str] | None
Matrix = tuple[Element, ...]

#: What edits cost. A blank or duplicate row must go; a truncated one that stays costs MEND more.
REROLE, DELETE, INSERT, MEND = 3, 4, 3, 3
#: For each role initial the steps between states; states 0 and 3 may end a conversation.
STEPS = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
ENDS = (0, 3)
#: Segments of a conversation that one task joins in a round.
FAN = 16
#: Space and the five control characters that count as blank.
BLANK = " \t\n\x0b\x0c\r"


def _matrix(found: Iterable[tuple[int, int, int, str]]) -> Matrix:
    cells: list[list[tuple[int, str]]] = [[] for _ in range(16)]
    for i, j, cost, audit in found:
        cells[4 * i + j].append((cost, audit))
    return tuple(min(c, default=None) for c in cells)


def times(a: Matrix, b: Matrix) -> Matrix:
    """First a, then b."""
    ways = ((i, j, x[0] + y[0], x[1] + y[1]) for i in range(4) for k in range(4) if (x := a[4 * i + k]) for j in range(4) if (y := b[4 * k + j]))
    return _matrix(ways)


NOTHING = _matrix((i, i, 0, "") for i in range(4))
_ONE = _matrix([(i, i, 0, "") for i in range(4)] + [(i, j, INSERT, "I") for c in "ua" for i, j in STEPS[c]])
#: Any inserts; more than two in a row lead nowhere that fewer don't.
INSERTS = times(_ONE, _ONE)


@lru_cache(maxsize=1 << 14)
def _short(kinds: str) -> Matrix:
    if len(kinds) > 1:
        half = len(kinds) // 2
        return times(_short(kinds[:half]), _short(kinds[half:]))
    step = [(i, i, DELETE, "D") for i in range(4)]
    if kinds != "d":
        more, initial = MEND * kinds.isupper(), kinds.lower()
        step += [(i, j, more, "K") for i, j in STEPS.get(initial, [])]
        step += [(i, j, REROLE + more, "R") for c in "ua" for i, j in STEPS[c]]
    return times(INSERTS, _matrix(step))


def product(kinds: str) -> Matrix:
    """The matrix of turns, a letter each: d for a row that must go, else s, u, a or x for its role's
    initial (x: any other), upper case if it is truncated. Parts of eight turns and less are remembered."""
    if len(kinds) <= 8:
        return _short(kinds) if kinds else NOTHING
    half = 1 << ((len(kinds) - 1).bit_length() - 1)
    return times(product(kinds[:half]), product(kinds[half:]))


def cheapest(turns: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    whole = times(turns, INSERTS)
    return min(whole[j] for j in ENDS if whole[j])


class Segment(NamedTuple):
    """Consecutive rows of one conversation: what can be joined to the segment after it."""

    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str
    last: str
    low: int | None
    high: int | None
    turns: int
    matrix: Matrix

    def then(self, other: Segment) -> Segment:
        broken = self.illegal + other.illegal + (self.last + other.first not in ("su", "ua", "au"))
        turns = self.turns + other.turns - (self.high is not None and self.high == other.low)
        low, high = self.low if self.low is not None else other.low, other.high if other.high is not None else self.high
        counts = (self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated)
        return Segment(*counts, broken, self.first, other.last, low, high, turns, times(self.matrix, other.matrix))

    def row(self) -> tuple:
        cost, audit = cheapest(self.matrix)
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _segment(turns: list[int | None], faults: list[str], initials: list[str]) -> Segment:
    known = [t for t in turns if t is not None]
    kinds = "".join("d" if f in ("blank", "duplicate") else (c if c in STEPS else "x").upper() if f else (c if c in STEPS else "x") for f, c in zip(faults, initials, strict=True))
    broken = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    ends = (known[0], known[-1]) if known else (None, None)
    return Segment(*(faults.count(f) for f in ("blank", "duplicate", "truncated")), broken, initials[0], initials[-1], *ends, len(set(known)), product(kinds))


def _with_faults(rows: DataFrame, order: list[str]) -> DataFrame:
    """Each row's first fault and role initial, without texts. A duplicate is a row that isn't the first of
    its conversation, role and text; firsts are found by partial minima, and looked up by the row's own
    number, so no conversation and no repeated text is gathered anywhere."""
    content = rows.withColumn("r", F.md5(F.col("role").cast("binary")))
    firsts = content.groupBy("conv", "r", "t").agg(F.min(F.struct("turn", "uid")).alias("f")).select(F.col("f.uid").alias("uid"), F.lit(True).alias("is_first"))
    trimmed = F.rtrim("text", F.lit(BLANK))
    fault = F.when(trimmed == "", "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return rows.join(firsts, "uid", "left").select(*order, fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))


def plans(rows: DataFrame) -> DataFrame:
    """For each conversation of ``rows`` (see ``as_rows``): gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows are ranged by conversation and turn, so that a long conversation spreads over tasks. A task reduces
    each conversation to a segment; those that may go on in another task (the first and the last of each)
    are then joined in rounds, FAN neighbours at a time."""
    order = ["conv", "turn", "role", "t", "uid"]
    kind = dict(rows.dtypes)["conv"]
    done = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    open_ = "place long, counts array<long>, ends array<string>, span array<long>, costs array<long>, audits array<string>"

    def packed(place: int, s: Segment) -> tuple:
        costs, audits = [x and x[0] for x in s.matrix], [x and x[1] for x in s.matrix]
        return place, [s.blank, s.duplicate, s.truncated, s.illegal], [s.first, s.last], [s.low, s.high, s.turns], costs, audits

    def unpacked(counts: list, ends: list, span: list, costs: list, audits: list) -> Segment:
        return Segment(*counts, *ends, *span, tuple(None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, current, parts, started, left = TaskContext.get().partitionId(), None, ([], [], []), False, []
        first = True

        def close(last: bool) -> None:
            nonlocal first
            found = _segment(*parts)
            left.append((current, *((None,) * 7 if first or last else found.row()), *(packed(place, found) if first or last else (None,) * 6)))
            first = False

        for batch in batches:
            for conv, turn, fault, initial in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "fault", "initial")), strict=True):
                if started and conv != current:
                    close(False)
                    parts = ([], [], [])
                started, current = True, conv
                for held, value in zip(parts, (turn, fault, initial), strict=True):
                    held.append(value)
            if left:
                yield _batch(left)
                left.clear()
        if started:
            close(True)
            yield _batch(left)

    def names(schema: str) -> list[str]:
        return [x.split()[0] for x in schema.split(", ")]

    columns = ["conv", *names(done), *names(open_)]
    types = [_arrow(kind), *[pa.int64()] * 6, pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]

    def _batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names=columns)

    def join(final: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = segment = None
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    own, place = unpacked(*(row[c] for c in names(open_)[1:])), row["place"] // FAN
                    if segment is not None and key == (row["conv"], place):
                        segment = segment.then(own)
                        continue
                    if segment is not None:
                        out.append(joined(key, segment))
                    key, segment = (row["conv"], place), own
                if out:
                    yield _batch(out)
            if segment is not None:
                yield _batch([joined(key, segment)])

        def joined(key: tuple, s: Segment) -> tuple:
            return (key[0], *(s.row() if final else (None,) * 7), *((None,) * 6 if final else packed(key[1], s)))

        return run

    schema = f"conv {kind}, {done}, {open_}"
    ranged = _with_faults(rows, order).repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialise(ranged.mapInArrow(reduce, schema), "segments")
    edges = found.where("place IS NOT NULL")
    rounds, most = 1, edges.agg(F.max("place")).first()[0] or 0
    while most >= FAN:
        rounds, most = rounds + 1, most // FAN
    for i in range(rounds):
        run = F.expr(f"place div {FAN}")
        edges = edges.repartition("conv", run).sortWithinPartitions("conv", "place").mapInArrow(join(i == rounds - 1), schema)
    keep = ["conv", *names(done)]
    return materialise(found.where("place IS NULL").select(*keep).unionByName(edges.select(*keep)), "repair-plans")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The repaired conversations: conv, place (from 0), edit (K, R or I), role, text; rows of a
    conversation come in order and in one partition.

    A conversation's plan and its rows, sorted, stream through a task, which holds the plan and one batch."""
    kind = dict(rows.dtypes)["conv"]
    sorted_by = ["conv", "audit IS NULL", "turn", "role", "t", "uid"]
    both = planned.select("conv", "audit").unionByName(rows.select("conv", "turn", "role", "t", "uid", "text"), allowMissingColumns=True)
    both = both.repartition("conv").sortWithinPartitions(*map(F.expr, sorted_by))
    types = [_arrow(kind), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place, out = None, "", 0, 0, 0, []

        def emit(edit: str, role: str, text: str) -> None:
            nonlocal place, state
            out.append((conv, place, edit, role, text))
            place, state = place + 1, {"s": 1, "u": 2}.get(role[:1], 3)

        def inserts() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                at += 1
                emit("I", "assistant" if state == 2 else "user", "")

        for batch in batches:
            for own, plan, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "role", "text")), strict=True):
                if plan is not None:
                    inserts()
                    conv, audit, at, state, place = own, plan, 0, 0, 0
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit != "D":
                    emit(edit, role if edit == "K" else "assistant" if state == 2 else "user", text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv", "place", "edit", "role", "text"])
                out.clear()
        inserts()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv", "place", "edit", "role", "text"])

    return both.mapInArrow(run, f"conv {kind}, place long, edit string, role string, text string")


def hashes(fixed: DataFrame) -> DataFrame:
    """conv and repaired_sha256 over ``role:text``, newline-joined; SHA-256 reads its bytes one after
    another, so a conversation is hashed by one task, as its rows stream through."""
    kind = dict(fixed.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = state = None

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), [_arrow(kind), pa.string()], strict=True)], names=["conv", "repaired_sha256"])

        for batch in batches:
            out = []
            for own, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "place", "role", "text")), strict=True):
                if place == 0:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = own, hashlib.sha256()
                state.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode())
            if out:
                yield batch_of(out)
        if state is not None:
            yield batch_of([(conv, state.hexdigest())])

    return fixed.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def as_rows(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    """Written rows for ``plans`` and ``repaired``, from conv_id (a long, an int or a string), turn, role and
    text: conv, turn, role, text, t (a hash of the text) and uid. Null roles and texts become one space.
    ``copies`` (1 if not given) says how often a row comes.

    Rows are taken by turn (null first), then role, then hash of the text; rows that are equal in all of
    these can't be told apart. A role that begins with none of s, u, a, or is empty, fits nowhere and must
    be changed or deleted; a null conversation is one as any other. Other columns are left out; no rows
    give no rows."""
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"))
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")
    return materialise(many.withColumn("t", F.md5(F.col("text").cast("binary"))).withColumn("uid", F.monotonically_increasing_id()), "turns")


def damage(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows damaged by the checksum of their conversation and turn, and how often each comes: a twentieth
    each is dropped, loses its text, loses its sentence ends, comes twice, or is given the role user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("mark"))
    text = F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("mark <> 0").withColumns({"text": text, "role": F.when(F.col("mark") == 4, "user").otherwise(F.col("role"))})
    return rows, F.when(F.col("mark") == 3, 2).otherwise(1)
