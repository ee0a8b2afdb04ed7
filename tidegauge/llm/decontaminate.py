"""Benchmark decontamination by windows (operator 1).

DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, row_hash
from .native_simhash import distance, near_block_keys, nearby_block_keys, simhash

SHINGLE = 5

#: Windows and items within RADIUS bits are compared: cut into BLOCKS blocks, their SimHashes have one
#: block at least with RADIUS div BLOCKS differing bits at most.
RADIUS, BLOCKS = 17, 6


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of the runs of ``size`` words, repeats included; none for fewer words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def find_leaks(docs: DataFrame, items: DataFrame, key: str, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """(key, item_id, start, n_words, similarity) for every document and item that a window of the
    document, as long as the item, matches: the best window of the pair, counted in words from 0.

    A window and an item of its length are compared if the SimHashes of their words are within RADIUS
    bits; multi-index blocks miss no such pair. They match if the weighted Jaccard similarity of their
    five-word shingles is at least ``similarity``. Windows that share no shingle with any item have
    similarity 0, so windows are only laid where a shared shingle puts an item's start (moved inside
    the document, cut to it if it is shorter). Items of fewer words than a shingle match documents of
    just those words; items and documents without words match nothing. Repeated items each match, and
    rows of equal key and text give one result; no rows give no rows.

    Rows exploded by shingle carry hashes and numbers only; texts are read again where windows are
    laid. Equal windows are judged once. Sides of joins are left to Spark to broadcast by their size."""
    item = items.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    item = item.withColumn("shingles", shingles_of(F.col("words"))).withColumn("fp", simhash(_hashes("words"))).withColumn("w", F.size("words"))
    item = materialise(item.withColumn("number", F.monotonically_increasing_id()), "items")
    doc = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(key, text).alias("d1"), F.xxhash64(F.lit("second"), key, text).alias("d2"))
    anchors = item.select("w", F.posexplode("shingles").alias("offset", "shingle")).distinct()
    worded = doc.select("d1", "d2", words_of(F.col("text")).alias("words"))
    at = worded.select("d1", "d2", F.size("words").alias("n"), F.posexplode(shingles_of(F.col("words"))).alias("p", "shingle")).join(anchors, "shingle")
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("offset"), F.col("n") - F.col("w")))
    places = materialise(at.groupBy("d1", "d2").agg(F.collect_set(F.struct("w", start.alias("start"))).alias("places")), "places")
    laid = doc.join(places, ["d1", "d2"]).select("key", words_of(F.col("text")).alias("words"), "places").select("key", "words", F.explode("places").alias("at"))
    cut = laid.select("key", "at.*", F.slice("words", F.col("at.start") + 1, F.col("at.w")).alias("words"))
    placed = materialise(cut.withColumn("h1", F.xxhash64("words")).withColumn("h2", F.xxhash64(F.lit("second"), "words")), "windows")
    window = placed.groupBy("w", "h1", "h2").agg(F.first("words").alias("words"))
    window = window.select("w", "h1", "h2", shingles_of(F.col("words")).alias("shingles"), simhash(_hashes("words")).alias("fp"), F.monotonically_increasing_id().alias("window"))
    window = materialise(window, "distinct")
    asked = item.where(F.size("shingles") > 0).select("number", "w", F.col("fp").alias("fi"), F.explode(nearby_block_keys(F.col("fp"), BLOCKS, RADIUS // BLOCKS)).alias("block"))
    offered = window.select("window", "w", "fp", F.explode(near_block_keys(F.col("fp"), BLOCKS)).alias("block"))
    pairs = offered.join(asked, ["w", "block"]).where(distance(F.col("fp"), F.col("fi")) <= RADIUS).select("window", "number").distinct()
    counted = lambda rows, of, n, k: rows.select(of, F.size("shingles").alias(n), F.explode("shingles").alias("shingle")).groupBy(of, n, "shingle").agg(F.count(F.lit(1)).alias(k))
    both = pairs.join(counted(window, "window", "n", "k"), "window").join(counted(item, "number", "n_item", "k_item"), ["number", "shingle"])
    shared = both.groupBy("window", "number", "n", "n_item").agg(F.sum(F.least("k", "k_item")).alias("both"))
    alike = shared.withColumn("similarity", F.col("both") / (F.col("n") + F.col("n_item") - F.col("both"))).where(F.col("similarity") >= similarity)
    found = alike.join(window.select("window", "w", "h1", "h2"), "window").join(item.select("number", "item_id"), "number").select("w", "h1", "h2", "item_id", "similarity")
    long = placed.select("key", "start", F.size("words").alias("n_words"), "w", "h1", "h2").join(found, ["w", "h1", "h2"])
    short = item.where(F.size("words") < SHINGLE).select("item_id", "words")
    whole = doc.select("key", words_of(F.col("text")).alias("words")).where(F.size("words").between(1, SHINGLE - 1))
    same = whole.join(short, "words").select("key", "item_id", F.lit(0).alias("start"), F.size("words").alias("n_words"), F.lit(1.0).alias("similarity"))
    every = long.select("key", "item_id", "start", "n_words", "similarity").unionByName(same)
    best = F.max_by(F.struct("start", "n_words", "similarity"), F.struct("similarity", -F.col("start")))
    return every.groupBy("key", "item_id").agg(best.alias("best")).select(F.col("key").alias(key), "item_id", "best.*")


def _hashes(words: str) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """``docs`` without the documents in which ``find_leaks`` finds an item; columns stay."""
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, row_hash(docs))
    leaks = find_leaks(keyed, items, key, text, item_id, item_text, similarity)
    return keyed.join(leaks.select(key).distinct(), key, "left_anti").drop(key)
