"""URL rules indexed by their rarest literal token (operator 8)."""

from __future__ import annotations

import re
from re import _parser
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, without

#: Only A-Z are lower-cased: other letters part tokens, whatever their case.
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Rule(NamedTuple):
    """``rule`` is host/path-prefix if ``regex`` is None (host and its subdomains, path from the
    slash on), else a name, and ``regex`` is searched in host + path."""

    verdict: str
    rule: str
    regex: str | None = None


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z]+", text.translate(_LOWER)) if w]


def _sure(parsed, outer: bool = True) -> list[str]:
    """What must occur in sequence where the parsed pattern matches: letters and digits; "/" for an end of
    the URL or one other character (or the place between it and a letter); "?" for anything else."""
    out = []
    for kind, value in parsed:
        if kind is _parser.LITERAL:
            c = chr(value).translate(_LOWER)
            out.append(c if c.isascii() and c.isalnum() else "/")
        elif kind is _parser.AT and value in (_parser.AT_BEGINNING, _parser.AT_BEGINNING_STRING, _parser.AT_END, _parser.AT_END_STRING, _parser.AT_BOUNDARY):
            out.append("/")
        elif kind is _parser.IN and all(k is _parser.LITERAL and not (chr(v).isascii() and chr(v).isalnum()) for k, v in value):
            out.append("/")
        elif kind is _parser.SUBPATTERN and not value[1] and not value[2]:
            out += _sure(value[3], False)
        else:
            out.append("?")
    return out


def literal_tokens(rule: Rule) -> set[str]:
    """Tokens that every URL that the rule fits must hold whole. Empty: the rule is always tried.

    Of a pattern's parse only runs of literal letters and digits count that have something on both sides
    that ends a token for sure; choices, repetitions, classes and wildcards don't."""
    if rule.regex is None:
        host, _, path = rule.rule.partition("/")
        whole = path if re.search(r"[^0-9A-Za-z]$", path) else re.sub(r"[0-9A-Za-z]+$", "", path)
        return set(_words(host) + _words(whole))
    return set(re.findall(r"(?<=/)[0-9a-z]+(?=/)", "".join(_sure(_parser.parse(rule.regex, re.ASCII)))))


class RuleIndex:
    """Fetches by a URL's tokens the rules worth trying, and tries only those."""

    def __init__(self, rules: Iterable[Rule], frequency: dict[str, int]):
        self.by_token, self.always = defaultdict(list), []
        for rule in rules:
            test = re.compile(rule.regex, re.ASCII) if rule.regex else None
            tokens = literal_tokens(rule)
            (self.by_token[min(tokens, key=lambda t: (frequency.get(t, 0), -len(t), t))] if tokens else self.always).append((rule, test))

    @staticmethod
    def _fits(rule: Rule, test, host: str, path: str) -> bool:
        if test:
            return bool(test.search(host + path))
        name, _, rest = rule.rule.partition("/")
        return (host == name or host.endswith("." + name)) and path.startswith("/" + rest)

    def judge(self, host: str, path: str, default: str) -> tuple[str | None, str, int]:
        """(longest fitting prefix rule or null, verdict, rules tried). Equally long rules: the
        smaller string wins. Without one, the first fitting pattern by name decides, else ``default``."""
        tried = [*self.always, *(x for t in dict.fromkeys(_words(host + path)) for x in self.by_token.get(t, ()))]
        fit = [r for r, test in tried if self._fits(r, test, host, path)]
        prefix = min((r for r in fit if r.regex is None), key=lambda r: (-len(r.rule), r.rule), default=None)
        if prefix:
            return prefix.rule, prefix.verdict, len(tried)
        pattern = min((r for r in fit if r.regex), key=lambda r: r.rule, default=None)
        return None, pattern.verdict if pattern else default, len(tried)


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or
    the end. Both are empty for a null url or one without ://."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format(f"coalesce(`{url}`, '')"))).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower)).withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule, verdict and n_tried (rules tried for the url).

    A rule is filed under the token that fewest URLs of the whole table hold; that count covers
    all rows, and as only tokens of rules are counted it is no longer than the rule list. Null or
    malformed urls get the rules for an empty host, so usually ``default``; repeated rows get equal results; no rows give no rows. Rules are a list in the
    driver, and go to the executors as they are."""
    at = without(with_host_and_path(pages, url), ["rule", "verdict", "n_tried"])
    tokens = sorted(set().union(*map(literal_tokens, rules)))
    spark = pages.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in tokens], "token string"))
    held = at.select(F.explode(F.array_distinct(F.split(F.lower(F.concat("host", "path")), "[^0-9a-z]+"))).alias("token"))
    frequency = {r["token"]: r["count"] for r in held.join(wanted, "token").groupBy("token").count().collect()}
    shared = spark.sparkContext.broadcast((list(rules), frequency))
    kept: list[RuleIndex] = []

    @F.pandas_udf("rule string, verdict string, n_tried int")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = kept[0] if kept else RuleIndex(*shared.value)
        kept[:] = [index]
        for hosts, paths in batches:
            yield pd.DataFrame([index.judge(h, p, default) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict", "n_tried"])

    of = free_name(at, "judged")
    return at.withColumn(of, judged("host", "path")).select("*", f"{of}.rule", f"{of}.verdict", f"{of}.n_tried").drop(of)
