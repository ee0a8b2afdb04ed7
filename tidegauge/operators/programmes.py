"""Programme tables put together from cells, and what depends on them: which cells are a programme's, which
pid has which role at a time, and pids rewritten in headers and tables (Q19, F7, L9, J3).

Cells are rows (flow_id, pid, cc, pusi, cell) with a place in their flow, ``order``, a long that no two cells
of a flow share. What a table says holds from the cell that completes its section on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bits, tables
from ..functions.bits import CELL
from ..sources.stored import stored

#: Longest payload that is gathered for a section. Fixed value.
CAP = 1024

#: Stream types that are video, and those that are audio whatever their descriptors say. Fixed values.
VIDEO = [0x01, 0x02, 0x1B, 0x24]
AUDIO = [0x03, 0x04, 0x0F, 0x11, 0x81, 0x82, 0x87, 0x88]


def section_parts(cells: DataFrame, order: str, checked: bool = True) -> DataFrame:
    """Q19: (flow_id, pid, unit, order, start, before, part) of the cells of each section: ``part`` begins at
    byte ``start`` of the cell and ``before`` bytes of the section come earlier. A section begins where a cell
    says so, behind its pointer; what ends the one before it there is left out. Cells are listed until CAP bytes
    have come, so a unit is bounded.

    With ``checked``, a repeated cell counts once, and a section with a cell missing is given up; without,
    cells are taken as they come."""
    c = F.col("cell")
    by_pid = Window.partitionBy("flow_id", "pid").orderBy(order)
    begun = cells.where(bits.ts_has_payload(c)).withColumn("start", bits.payload_offset(c)).where(F.col("start") < CELL)
    bodies = begun.select("flow_id", "pid", order, "pusi", "cc", "start", F.substring(c, F.col("start") + 1, F.lit(CELL)).alias("part"))
    begins = F.col("pusi")
    if checked:
        step = F.pmod(F.col("cc") - F.lag("cc").over(by_pid), F.lit(16))
        bodies = bodies.withColumn("step", step).where("step IS NULL OR step <> 0")
        begins = begins | F.coalesce(F.col("step") != 1, F.lit(True))
    skipped = F.when(F.col("pusi"), 1 + bits.uint(F.col("part"), 0, 1)).otherwise(0).cast("int")
    bodies = bodies.withColumn("unit", F.sum(begins.cast("long")).over(by_pid)).withColumn("skipped", skipped)
    bodies = bodies.withColumns({"start": F.col("start") + F.col("skipped"), "part": F.substring("part", F.col("skipped") + 1, F.lit(CELL))})
    in_unit = Window.partitionBy("flow_id", "pid", "unit").orderBy(order)
    opened = F.first(F.col("pusi") & (F.length("part") > 0)).over(in_unit)
    before = F.coalesce(F.sum(F.length("part")).over(in_unit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = bodies.withColumns({"opened": opened, "before": before}).where(F.col("opened") & (F.col("before") <= CAP))
    return listed.select("flow_id", "pid", "unit", order, "start", "before", "part")


def sections(parts: DataFrame, order: str) -> DataFrame:
    """Q19: (flow_id, pid, unit, order, section) of ``section_parts``, with ``order`` of the cell that completes
    it; sections that aren't completed within CAP bytes are left out, and what follows one in its cell too."""
    units = parts.groupBy("flow_id", "pid", "unit").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), (F.col("before") + F.length("part")).alias("end"), "part"))).alias("parts"))
    joined = units.withColumn("data", F.aggregate("parts", F.lit(b""), lambda data, x: F.concat(data, x["part"])))
    sized = joined.withColumn("size", F.when(F.length("data") >= 3, 3 + bits.bits(bits.uint(F.col("data"), 1, 2), 0, 0x0FFF)).cast("int"))
    done = sized.withColumn("last", F.get(F.filter("parts", lambda x: x["end"] >= F.col("size")), F.lit(0))).where(F.col("last.end") <= CAP)
    return done.select("flow_id", "pid", "unit", F.col("last.at").alias(order), F.substring("data", F.lit(1), F.col("size")).alias("section"))


def table_parts(cells: DataFrame, order: str, checked: bool = True) -> DataFrame:
    """``section_parts`` of the association tables, and of the pids that any of them names in the flow: all
    other cells, nearly all there are, are only looked up by their pid."""
    first = stored(section_parts(cells.where("pid = 0"), order, checked), "association-parts")
    listed = sections(first, order).select("flow_id", F.explode(tables.association("section")["programs"]).alias("p"))
    pids = listed.select("flow_id", F.col("p.pid").cast(dict(cells.dtypes)["pid"]).alias("pid")).where("pid <> 0").distinct()
    return first.unionByName(section_parts(cells.join(pids, ["flow_id", "pid"], "left_semi"), order, checked))


def _with_last(rows: DataFrame, changes: DataFrame, keys: list[str], order: str, names: list[str]) -> DataFrame:
    """``rows`` with the columns ``names`` of the last change at or before them, all null before the first."""
    held = changes.select(*keys, order, F.struct(*names).alias("_held"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("_row"))
    own = rows.select(*keys, order, F.lit(None).cast(held.schema["_held"].dataType).alias("_held"), F.struct("*").alias("_row"))
    until = Window.partitionBy(*keys).orderBy(order, F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = held.unionByName(own).withColumn("_held", F.last("_held", True).over(until)).where("_row IS NOT NULL")
    return met.select("_row.*", *[F.col(f"_held.{n}").alias(n) for n in names])


def associations(found: DataFrame, order: str, program: int | None) -> DataFrame:
    """What the association tables say of ``program`` (None: the first one listed): (flow_id, order,
    table_stream, map_pid, target), a row whenever the version or the map's pid changes; map_pid is null where
    the programme is missing, and ``target`` counts the changes of the map's pid."""
    parsed = found.where("pid = 0").withColumn("a", tables.association("section")).where("a.version IS NOT NULL")
    listed = F.col("a.programs") if program is None else F.filter("a.programs", lambda x: x["program"] == program)
    named = parsed.select("flow_id", order, F.col("a.table_stream").alias("table_stream"), F.col("a.version").alias("version"), F.get(listed, 0)["pid"].cast("long").alias("map_pid"))
    by_flow = Window.partitionBy("flow_id").orderBy(order)
    moved = ~F.col("map_pid").eqNullSafe(F.lag("map_pid").over(by_flow))
    changed = named.withColumns({"moved": moved, "new": moved | ~F.col("version").eqNullSafe(F.lag("version").over(by_flow))})
    return changed.withColumn("target", F.sum(F.col("moved").cast("long")).over(by_flow)).where("new").select("flow_id", order, "table_stream", "map_pid", "target")


def stream_maps(found: DataFrame, said: DataFrame, order: str) -> DataFrame:
    """The maps of the programme that ``associations`` follow: (flow_id, order, until, map_pid, clock_pid,
    streams). A map counts if its pid is the one named then and its version isn't that of the map before it;
    it holds until the next one that counts or until the programme moves or goes."""
    parsed = found.where("pid <> 0").withColumn("m", tables.stream_map("section")).where("m.version IS NOT NULL").select("flow_id", order, "pid", "m.*")
    now = _with_last(parsed, said, ["flow_id"], order, ["map_pid", "target"]).where("pid = map_pid")
    again = F.col("version") == F.lag("version").over(Window.partitionBy("flow_id", "target").orderBy(order))
    counted = now.withColumn("again", F.coalesce(again, F.lit(False))).where("NOT again").select("flow_id", order, "target", "map_pid", "clock_pid", "streams")
    moves = said.groupBy("flow_id", "target").agg(F.min(order).alias(order))
    by_flow = Window.partitionBy("flow_id").orderBy(order)
    both = counted.unionByName(moves, allowMissingColumns=True).withColumn("until", F.lead(order).over(by_flow))
    return both.where("streams IS NOT NULL").drop("target")


def spans(maps: DataFrame, said: DataFrame, order: str) -> DataFrame:
    """(flow_id, pid, since, until): when which pids are the programme's: the map's own while it is named, its
    streams and its clock while the map holds. Spans of one pid may overlap."""
    pids = F.array_distinct(F.concat(F.transform("streams", lambda s: s["pid"].cast("long")), F.filter(F.array(F.col("clock_pid").cast("long")), lambda p: p != 0x1FFF)))
    streams = maps.select("flow_id", F.explode(pids).alias("pid"), F.col(order).alias("since"), "until")
    by_flow = Window.partitionBy("flow_id").orderBy(order)
    named = said.withColumn("until", F.lead(order).over(by_flow)).where("map_pid IS NOT NULL")
    return streams.unionByName(named.select("flow_id", F.col("map_pid").alias("pid"), F.col(order).alias("since"), "until"))


def within_spans(cells: DataFrame, when: DataFrame, order: str) -> DataFrame:
    """The cells whose pid has a span open at their place. Beginnings and ends are put between the cells and
    summed up, so no cell meets a span in a join."""
    ends = when.select("flow_id", "pid", F.explode(F.array(F.struct(F.col("since").alias("o"), F.lit(1).alias("d")), F.struct(F.col("until").alias("o"), F.lit(-1).alias("d")))).alias("e")).where("e.o IS NOT NULL")
    marks = ends.select("flow_id", "pid", F.col("e.o").alias(order), F.col("e.d").alias("_d"))
    until = Window.partitionBy("flow_id", "pid").orderBy(order, F.col("_d") == 0).rowsBetween(Window.unboundedPreceding, 0)
    both = cells.withColumn("_d", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    return both.withColumn("_open", F.sum("_d").over(until)).where("_d = 0 AND _open > 0").drop("_d", "_open")


@tables.on_call("binary")
def _lone_association(program: pd.Series, map_pid: pd.Series, stream: pd.Series, cc: pd.Series) -> pd.Series:
    rows = zip(program, map_pid, stream, cc, strict=True)
    return pd.Series([tables.association_cell([(int(p), int(m))], 0, int(n), int(s)) for p, m, s, n in rows])


def filter_programme(cells: DataFrame, program: int, order: str, checked: bool = True) -> DataFrame:
    """the cells of one programme of several, by the tables in the stream as they change. Cells with tables
    of maps, streams and the clock pass as they are; each cell of the association table is replaced by one that
    lists this programme alone and counts on, and is left out while the programme isn't listed."""
    found = stored(sections(table_parts(cells, order, checked), order), "sections")
    said = stored(associations(found, order, program), "associations")
    kept = within_spans(cells.where("pid <> 0"), spans(stream_maps(found, said, order), said, order), order)
    listed = _with_last(cells.where("pid = 0"), said, ["flow_id"], order, ["map_pid", "table_stream"]).where("map_pid IS NOT NULL")
    count = (F.row_number().over(Window.partitionBy("flow_id").orderBy(order)) - 1) % 16
    alone = listed.withColumn("cc", count.cast(dict(cells.dtypes)["cc"])).withColumn("cell", _lone_association(F.lit(program), "map_pid", "table_stream", "cc"))
    return kept.unionByName(alone.select(*kept.columns))


def roles(maps: DataFrame, order: str) -> DataFrame:
    """(flow_id, order, until, video, audio): the first video stream of each map, and the first stream
    that is audio by its type; without one, private data that its descriptors say is audio, then private data
    that they don't say is text."""
    each = maps.select("flow_id", order, "until", F.posexplode_outer("streams").alias("n", "s"))
    kind, tags = F.col("s.stream_type"), F.col("s.descriptors")
    private = kind == 0x06
    rank = F.when(kind.isin(AUDIO), 0).when(private & tables.audio_kind(tags).isNotNull(), 1).when(private & ~tables.is_text_service(tags), 2)
    first = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "n", F.col("s.pid").alias("pid"))))
    video = F.min(F.when(kind.isin(VIDEO), F.struct("n", F.col("s.pid").alias("pid"))))
    return each.groupBy("flow_id", order, "until").agg(video["pid"].cast("long").alias("video"), first["pid"].cast("long").alias("audio"))


def with_roles(rows: DataFrame, held: DataFrame, order: str) -> DataFrame:
    """``rows`` (flow_id, pid, order) with role, video or audio, that their pid has then, else null."""
    ends = held.where("until IS NOT NULL").select("flow_id", F.col("until").alias(order), F.lit(None).cast("long").alias("video"), F.lit(None).cast("long").alias("audio"), F.lit(0).alias("_begins"))
    starts = held.select("flow_id", order, "video", "audio", F.lit(1).alias("_begins"))
    # where one ends as the next begins, the beginning counts
    last = F.max_by(F.struct("video", "audio"), "_begins")
    changes = starts.unionByName(ends).groupBy("flow_id", order).agg(last.alias("h")).select("flow_id", order, "h.*")
    met = _with_last(rows, changes, ["flow_id"], order, ["video", "audio"])
    return met.withColumn("role", F.when(F.col("pid") == F.col("video"), "video").when(F.col("pid") == F.col("audio"), "audio")).drop("video", "audio")


def put_back(cells: DataFrame, parts: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """``cells`` with the bytes of rewritten sections (``new``: flow_id, pid, unit, section) in the places that
    ``parts`` says they came from. A section must have kept its length."""
    slices = parts.join(new, ["flow_id", "pid", "unit"]).select("flow_id", order, "start", F.substring("section", F.col("before").cast("int") + 1, F.length("part")).alias("_slice")).where(F.length("_slice") > 0)
    met = cells.join(slices.withColumnRenamed("start", "_start"), ["flow_id", order], "left")
    written = F.when(F.col("_slice").isNull(), F.col("cell")).otherwise(F.overlay("cell", "_slice", F.col("_start") + 1))
    return met.withColumn("cell", written).select(*cells.columns)


def shift_cues(cells: DataFrame, pids: DataFrame, by_90k: int, order: str, checked: bool = True) -> DataFrame:
    """``cells`` in which the splice time adjustment of every cue on ``pids`` (flow_id, pid) is ``by_90k``
    ticks later, modulo 2**33, with its checksum made anew; also of cues that take several cells."""
    parts = stored(section_parts(cells.join(pids.distinct(), ["flow_id", "pid"], "left_semi"), order, checked), "cue-parts")

    @F.pandas_udf("binary")
    def shifted(part: pd.Series) -> pd.Series:
        return pd.Series([tables.with_later_splice(p, by_90k) for p in part])

    new = sections(parts, order).select("flow_id", "pid", "unit", shifted("section").alias("section"))
    return put_back(cells, parts, new, order)


def remap_tables(cells: DataFrame, pids: dict[int, int], order: str, checked: bool = True) -> DataFrame:
    """Every cell with its pid looked up in ``pids``, in its header and in the association and map tables,
    whose checksums are made anew. A table keeps its length, so its bytes go back into the cells that they came
    from. Tables on pids that no association table names then are left as they are."""
    parts = stored(table_parts(cells, order, checked), "table-parts")
    found = stored(sections(parts, order), "sections")
    listed = found.where("pid = 0").withColumn("a", tables.association("section")).select("flow_id", F.col(order).alias("since"), F.transform("a.programs", lambda p: p["pid"].cast("long")).alias("pids"))
    until = F.lead("since").over(Window.partitionBy("flow_id").orderBy("since"))
    named = listed.withColumn("until", until).select("flow_id", F.explode("pids").alias("pid"), "since", "until")
    maps = within_spans(found.where("pid <> 0"), named, order)

    @F.pandas_udf("binary")
    def moved(part: pd.Series) -> pd.Series:
        return pd.Series([tables.with_mapped_pids(p, pids) for p in part])

    new = found.where("pid = 0").unionByName(maps).select("flow_id", "pid", "unit", moved("section").alias("section"))
    met = put_back(cells, parts, new, order)
    target = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in pids.items() for x in kv]), F.col("pid").cast("int")), F.col("pid").cast("int")) if pids else F.col("pid").cast("int")
    head = bits.big_endian(bits.bits(bits.uint(F.col("_c"), 1, 2), 0, 0xE000) + target, 2)
    written = F.concat(F.substring("_c", 1, 1), head, F.substring("_c", 4, CELL - 3))
    return met.withColumn("_c", F.col("cell")).withColumn("cell", written).withColumn("pid", target.cast(dict(cells.dtypes)["pid"])).select(*cells.columns)
