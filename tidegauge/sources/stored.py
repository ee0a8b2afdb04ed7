"""Tables written between steps, so that what is used more than once is worked out once."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet under the folder in spark.checkpoint.dir, which all executors share, and read
    again: rows survive lost executors, and readers take only the columns they need. Where the setting is
    missing a local session uses a temporary folder, and a cluster is an error. Whoever owns the folder clears it."""
    path = f"{shared_folder(df.sparkSession)}/tidegauge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), "checkpoints")
    return folder
