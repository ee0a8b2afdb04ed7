"""Captured datagrams as tables and streams (S1, S2), and recordings on disk and played again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import bits

#: A captured datagram: when and on which leg it came, and its bytes.
CAPTURE = T.StructType([T.StructField("flow_id", T.LongType()), T.StructField("leg", T.IntegerType()), T.StructField("recv_us", T.LongType()), T.StructField("data", T.BinaryType())])


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """A folder of captures in Parquet."""
    return spark.read.schema(CAPTURE).parquet(path)


def read_capture_stream(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """The same folder as a stream, as files arrive."""
    return spark.readStream.schema(CAPTURE).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def rtp_packets(datagrams: DataFrame) -> DataFrame:
    """What is RTP, with payload_type, seq, rtp_ts and payload; all else, and what is cut off in its
    header, goes."""
    d = F.col("data")
    parsed = datagrams.where(bits.is_likely_rtp(d)).withColumns({"payload_type": bits.payload_type(d), "seq": bits.rtp_sequence(d), "rtp_ts": bits.rtp_timestamp(d), "payload": bits.strip_rtp_header(d)})
    return parsed.where("payload is not null").drop("data")


def transport_cells(packets: DataFrame, payload: str = "payload") -> DataFrame:
    """S1, S2 (a raw datagram is its own payload): one row a whole cell that begins with the sync byte, with
    its place in the datagram and its header fields."""
    cells = packets.select(*[F.col(f"`{c}`") for c in packets.columns if c != payload], F.posexplode(bits.cells(F.col(payload))).alias("place", "cell"))
    c = F.col("cell")
    fields = {"pid": bits.ts_pid(c), "pusi": bits.ts_pusi(c), "cc": bits.ts_cc(c), "has_payload": bits.ts_has_payload(c), "discontinuity": bits.ts_discontinuity(c), "pcr27": bits.extract_pcr(c), "pts90": bits.extract_pts(c)}
    return cells.where(F.substring(c, 1, 1) == F.lit(b"\x47")).withColumns(fields)


def segmented(cells: DataFrame, keys: list[str], time: str, length_us: int) -> DataFrame:
    """Cells with the number of their segment, which rolls every ``length_us`` from a key's first cell,
    and their byte offset in it."""
    first = F.min(time).over(Window.partitionBy(*keys))
    numbered = cells.withColumn("segment_id", F.floor((F.col(time) - first) / length_us))
    return numbered.withColumn("byte_offset", (F.row_number().over(Window.partitionBy(*keys, "segment_id").orderBy(time)) - 1) * bits.CELL)


def write_recording(segments: DataFrame, path: str, keys: list[str], time: str) -> None:
    """The cells by recording and segment, and beside them an index of the cells that carry a stamp."""
    rows = segments.repartition(*keys, "segment_id").sortWithinPartitions(*keys, "segment_id", time)
    rows.write.partitionBy(*keys, "segment_id").mode("append").parquet(f"{path}/cells")
    index = segments.where("pts90 is not null").select(*keys, "segment_id", "pts90", "byte_offset", F.col(time).alias("at_us"))
    index.repartition(*keys).sortWithinPartitions(*keys, "pts90").write.partitionBy(*keys).mode("append").parquet(f"{path}/index")


def retained(segments: DataFrame, keys: list[str], most_bytes: int) -> DataFrame:
    """(keys, segment_id, keep) of a table (keys, segment_id, bytes): the newest segments of each
    recording that are within ``most_bytes`` together, the newest one always; the others' partitions can
    be deleted."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("segment_id"))
    total = F.sum("bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return segments.select(*keys, "segment_id", ((total <= most_bytes) | (F.row_number().over(newest) == 1)).alias("keep"))


def replayed(cells: DataFrame, clips: DataFrame, keys: list[str], pts: str, speed: Column, span: int) -> DataFrame:
    """The cells of each clip (clip_id, keys, start_pts, to_pts), both ends included, with due_us, when
    each is played from the clip's start on at ``speed`` (over 0, to 1). Clips meet cells by the spans of
    ``span`` ticks they reach over, so none is held against a whole recording."""
    first, last = F.floor(F.col("start_pts") / span), F.floor(F.col("to_pts") / span)
    asked = clips.where("start_pts <= to_pts").select("clip_id", *keys, "start_pts", "to_pts", F.explode(F.sequence(first, last)).alias("_span"))
    met = cells.withColumn("_span", F.floor(F.col(pts) / span)).join(asked, [*keys, "_span"]).where(F.col(pts).between(F.col("start_pts"), F.col("to_pts")))
    return met.withColumn("due_us", F.round((F.col(pts) - F.col("start_pts")) * 100 / (9 * speed)).cast("long")).drop("_span", "start_pts", "to_pts")
