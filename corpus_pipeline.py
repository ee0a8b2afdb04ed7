"""From raw documents to sharded training data, one stage after another.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents (the last:
also size, shard and slot). Between stages the rows are written as Parquet and read again. No rows give no rows in
every stage; texts are read whole, however long; columns that documents don't have stay, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import decontaminate, language, mixing, near_dedup, sharding
from tidegauge.llm.common import materialise, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a learned language is found; those without letters, and those with
    no n-gram that any language has beyond its filter's false positives, go. The model is learned
    from the labels of the stage's own input; where there are none, nothing can be rejected. Null and empty
    texts have no letters and go; repeated rows are judged alike; of languages that are equally likely the one
    with more labelled rows is taken."""
    model = language.fit(docs)
    if not model.languages:
        return docs
    judged = language.identify(docs.withColumn("row", F.struct("*")), model)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") > 0)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each near-duplicate group, by doc_id (null last) and then by the row's hash.
    Documents without words are copies of one another, so one of them stays; of rows that are equal in all
    columns one stays."""
    return near_dedup.near_dedup(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item. Null and empty texts hold none and stay; repeated rows
    stay or go together."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, in the order in which their blocks are due; the last stage, which gets
    rows in any order, works the same schedule out again. A null source is a source of its own; repeated rows
    each have their place."""
    return mixing.mix(docs).sort("mix_slot", "mix_place").drop(*mixing.NEW)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all documents into shards along the curve; slots in a shard follow the mixing schedule. Null sources
    and languages are in the first cell, a null text has size 8; rows that are equal in all columns may
    change places."""
    sized = docs.withColumn("size", sharding.size_of("text"))
    return sharding.curve_shards(sized, 24, slots_by=(mixing.mix, ["mix_slot", "mix_place"])).drop("curve")


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix_sources),
    ("shard", shard),
]

#: Fingerprints and n-gram models can't be expressed in SQL; tests/llm compares each stage with a
#: plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
