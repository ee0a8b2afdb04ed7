"""Media folders and configuration files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is read of a configuration; all else in it is passed over.
CONFIG = """flows array<struct<id string, name string, enabled boolean, input_ids array<string>, output_ids array<string>>>,
inputs array<struct<id string, name string, type string>>, outputs array<struct<id string, name string, type string>>"""


def media_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, size_bytes, modified_unix) of all files below ``folder``. Contents aren't read
    unless a query selects ``content`` itself. Spark leaves out names that begin with a dot or underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    return files.select("path", name.alias("name"), F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("modified_unix"))


def library_use(files: DataFrame) -> DataFrame:
    """Files and bytes by the ending of their names; null without one."""
    ending = F.lower(F.nullif(F.regexp_extract("name", r"\.([^.]+)$", 1), F.lit("")))
    return files.groupBy(ending.alias("ending")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """A row (node, config) for each JSON file that ``path`` names; node is the file's path. A file that
    isn't JSON has a null config."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("node"), parse_config(F.col("value")).alias("config"))


def parse_config(text: Column) -> Column:
    return F.from_json(text, CONFIG)


def with_secrets(config: DataFrame, secrets: DataFrame) -> DataFrame:
    """Entries (node, id, ...) with the secret settings (node, id, settings) kept in a file of their own;
    null where there are none."""
    return config.join(secrets.select("node", "id", "settings"), ["node", "id"], "left")


def dimension(configs: DataFrame, kind: str, id: str | None = None) -> DataFrame:  # noqa: A002  named as in the configuration
    """All flows, inputs or outputs (``kind``) of all nodes, or the one with an id; a scan that
    reads the node and this part of the configuration only."""
    rows = configs.select("node", F.inline(f"config.{kind}"))
    return rows if id is None else rows.where(F.col("id") == id)
