"""What the operators of this package share: reading tables, cutting lineage, word patterns."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset
    and all runs on one machine (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or os.path.join(tempfile.gettempdir(), "checkpoints")


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage and survives lost executors. The folder has a fresh name each time;
    whoever owns the shared folder clears it when the job's output has been written."""
    path = f"{shared_dir(df.sparkSession)}/tidegauge/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast if it has ``rows`` rows at most;
    beyond that Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def row_hash(df: DataFrame):
    """128-bit hash over all columns of a row, as a struct; map columns, which can't be hashed, as JSON."""
    cols = [F.to_json(F.col(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    return F.struct(F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit("second"), *cols).alias("h2"))


def numbered(df: DataFrame, order: list[str], name: str, total: str | None = None) -> DataFrame:
    """``df``, written in the order of ``order``, with each row's place in it (from 0) as ``name`` and
    the count of all rows as ``total``. Rows are ranged, and only a count a partition is summed up."""
    at = free_name(df, "at")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    ranged = materialise(ranged, "ranged")
    part, all_ = F.shiftright(at, 33), Window.orderBy("_part")
    before = ranged.groupBy(part.alias("_part")).count().select("_part", (F.sum("count").over(all_) - F.col("count")).alias("_before"), F.sum("count").over(all_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    place = F.col("_before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    more = [F.col("_all").alias(total)] if total else []
    return ranged.join(F.broadcast(before), part == F.col("_part")).select(*[F.col(f"`{c}`") for c in df.columns], place.alias(name), *more)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add, however they are cased."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
