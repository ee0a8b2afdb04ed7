"""Language identification by bit-sliced Bloom filters of n-grams (operator 10)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, without

CHUNK = 1 << 18

#: Labels come to the driver and go to every task; a column with more isn't one of languages.
MOST = 4096


class Model(NamedTuple):
    """rows: for each position of the filter the languages' bits, 64 to a word; load: for each
    language the share of positions that are set."""

    languages: list[str]
    n: int
    hashes: int
    rows: np.ndarray
    load: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None, n: int) -> Iterator[np.ndarray]:
    """64-bit keys of the text's character n-grams, in pieces of bounded size. Letters count in
    lower case; a run of other characters is one blank, and blanks frame the text. A gram lies
    within a word with its blanks. No letters give nothing."""
    text, carry = text or "", np.zeros(1, "<u8")
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "replace"), "<u4")
        ends = [np.zeros(1, "<u8")] if at + CHUNK >= len(text) else []
        codes = np.concatenate([carry, np.where(_letters()[codes], codes, np.uint32(0)).astype("<u8"), *ends])
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        carry = codes[1 - n :] if n > 1 else codes[:0]
        if len(codes) < n:
            continue
        keys, inner = np.zeros(len(codes) - n + 1, "<u8"), np.ones(len(codes) - n + 1, bool)
        for k in range(n):
            part = codes[k : len(codes) - n + 1 + k]
            keys = keys * np.uint64(0x110001) + part
            if 0 < k < n - 1:
                inner &= part != 0
        yield keys[inner]


def _positions(keys: np.ndarray, size: int, hashes: int) -> np.ndarray:
    """For each key its places in a filter of ``size`` (a power of two) by double hashing."""
    h = keys.copy()
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(33)
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((one[None] + np.arange(hashes, dtype="<u8")[:, None] * two[None]) & np.uint64(size - 1)).astype(np.int64)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", n: int = 4, bound: int = 2000, share: float = 0.01, size: int = 1 << 18, hashes: int = 3, folds: int = 8) -> Model:
    """Builds the filters from labelled rows (null text or lang: left out).

    ``bound`` is how many rows of a language are expected to be read: a language with more is
    sampled by row hash. An n-gram goes into a language's filter if at least ``share`` of that
    language's read rows hold it. The driver receives, per position of the filter that is set, one
    mask: at most ``size`` rows, whatever the corpus. Over MOST labels are an error. Repeated rows count
    each, ties in row counts order languages by name, no rows give a model without languages."""
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MOST + 1).collect()}
    if len(sizes) > MOST:
        raise ValueError(f"over {MOST} different labels")
    languages = sorted(sizes, key=lambda l: (-sizes[l], l))
    if not languages:
        return Model([], n, hashes, np.zeros((size, 1), "<u8"), np.zeros(0))
    rate = F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, bound / sizes[l]))])
    number = F.create_map(*[F.lit(x) for i, l in enumerate(languages) for x in (l, i)])
    read = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000).withColumn("l", number[F.col("lang")])

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for l, t in zip(batch["l"], batch["text"], strict=True):
                own = np.unique(np.concatenate([np.zeros(0, "<u8"), *ngrams(t, n)])).view("<i8")
                yield pd.DataFrame({"l": np.full(len(own) + 1, l), "g": np.append(own, 0), "gram": np.arange(len(own) + 1) < len(own)})

    counts = read.select("l", "text").repartition(folds * 4).mapInPandas(grams, "l int, g long, gram boolean").groupBy("l", "g", "gram").count()
    rows_of = counts.where("not gram").select("l", F.col("count").alias("n"))
    common = counts.where("gram").join(F.broadcast(rows_of), "l").where(F.col("count") >= F.greatest(F.lit(2), F.col("n") * share))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = _positions(batch["g"].to_numpy("int64").view("<u8"), size, hashes)
            yield pd.DataFrame({"at": at.ravel(), "l": np.tile(batch["l"].to_numpy(), hashes)})

    words = -(-len(languages) // 64)
    at_word = [F.coalesce(F.bit_or(F.when(F.floor(F.col("l") / 64) == w, F.expr("shiftleft(1L, l % 64)"))), F.lit(0)).alias(f"w{w}") for w in range(words)]
    rows = np.zeros((size, words), "<u8")
    for r in common.select("l", "g").mapInPandas(places, "at long, l int").groupBy("at").agg(*at_word).toLocalIterator():
        rows[r["at"]] = [x & (1 << 64) - 1 for x in r[1:]]
    load = np.array([float((rows[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()) for i in range(len(languages))])
    return Model(languages, n, hashes, rows, load)


def predict_one(text: str | None, model: Model) -> tuple[str, float]:
    """(language, score): each filter says which n-grams of the whole text it holds; from that
    count come off the false positives to be expected, and the language with most left wins, ties
    going to the one with more labelled rows. Score: the winner's share of the n-grams. Null texts and texts
    without letters are ("und", 0)."""
    k, total, hits = len(model.languages), 0, np.zeros(len(model.languages))
    for keys in ngrams(text, model.n):
        total += len(keys)
        at = _positions(keys, len(model.rows), model.hashes)
        masks = np.bitwise_and.reduce(model.rows[at], axis=0)
        for i in range(k):
            hits[i] += np.count_nonzero(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1))
    if not k or not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    if not total:
        return model.languages[0], 0.0
    wrong = model.load**model.hashes
    right = np.clip((hits - total * wrong) / np.maximum(1 - wrong, 1e-9), 0, None)
    best = int(right.argmax())
    return model.languages[best], min(1.0, float(right[best]) / total)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score. The model's size is fixed when it is built (2 MB for up
    to 64 languages), so it is broadcast. Repeated rows get equal results, no rows none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([predict_one(t, shared.value) for t in texts], columns=["lang_pred", "score"])

    of = free_name(docs, "predicted")
    return without(docs, ["lang_pred", "score"]).withColumn(of, predicted(F.col(text))).select("*", f"{of}.lang_pred", f"{of}.score").drop(of)
