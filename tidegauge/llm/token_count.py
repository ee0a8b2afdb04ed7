"""Token counts with a whole-token shortcut (operator 7)."""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens whose merged counts a worker keeps.
CACHE = 1 << 17


def _library(vocabulary: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_str(vocabulary)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def whole_tokens(vocabulary: str, pattern: str) -> frozenset[str]:
    """The vocabulary strings that alone are one pre-token and encode as just their own token.

    Being in the vocabulary isn't enough, as merges may not lead there; each string is tried."""
    tokenizer, split = _library(vocabulary), regex.compile(pattern)
    ids = sorted(tokenizer.get_vocab(with_added_tokens=False).values())
    texts = [tokenizer.decode([i], skip_special_tokens=False) for i in ids]
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for i, t, e in zip(ids, texts, found, strict=True) if e.ids == [i] and split.findall(t) == [t])


class TokenCounter:
    """Counts the tokens of a text as a byte-level BPE library would, without special tokens added."""

    def __init__(self, vocabulary: str, pattern: str, whole: frozenset[str]):
        self.tokenizer, self.find, self.whole, self.known = _library(vocabulary), regex.compile(pattern).findall, whole, {}
        special = [t["content"] for t in json.loads(vocabulary).get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def _merged(self, counts: Counter) -> int:
        new = [p for p in counts if p not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(counts)
        self.known.update(zip(new, (len(e.ids) for e in self.tokenizer.encode_batch(new, add_special_tokens=False)), strict=True))
        total = sum(n * self.known[p] for p, n in counts.items())
        if len(self.known) > CACHE:
            self.known.clear()
        return total

    def count(self, text: str | None) -> int:
        """Tokens of the whole text; 0 for null and empty. A special string in it is one token."""
        if not text:
            return 0
        parts, special = [text], 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            special = len(parts) - 1
        counts: Counter = Counter()
        for part in parts:
            counts.update(self.find(part))
        rest = Counter({p: n for p, n in counts.items() if p not in self.whole})
        return special + counts.total() - rest.total() + (self._merged(rest) if rest else 0)


@lru_cache(maxsize=2)
def _worker_counter(shared) -> TokenCounter:
    return TokenCounter(*shared.value)


def count_tokens(docs: DataFrame, vocabulary_path: str, text: str = "text", pattern: str | None = None, limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    The proof of whole tokens runs once, in the driver; what goes to the executors is the
    vocabulary and that list, bounded by the vocabulary file. No text is truncated; nulls count
    as empty, repeated rows each get their row, no rows give no rows."""
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    pattern = pattern or _pattern()
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, pattern, whole_tokens(vocabulary, pattern)))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _worker_counter(shared)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    counted = docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("n_tokens", n_tokens(F.col(text)))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
