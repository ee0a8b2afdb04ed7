"""Secrets by pattern and by sliding-window entropy (operator 2).

DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

#: Kind, pattern, the group that is measured, and its least length. Patterns find matches from
#: left to right without overlap; those too short are dropped afterwards, so they still use up
#: what they cover. Keys and hex runs reach as far as their characters do, so there the least length can
#: be asked for at once: a shorter one holds no other.
KINDS = [
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]

#: What must occur for a kind to be looked for at all.
_HINTS = [r"(?i)password|passwd|secret|token|api_?key", r"AKIA[A-Z0-9]", r"[0-9a-f]{24}"]

#: Candidate strings for the entropy scan.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

#: The characters of candidates.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Character classes: name, what a window must consist of, least entropy in bits a character. Each
#: class slides its own windows, over the candidate's runs of its characters.
CLASSES = [
    ("hex_digits", r"[0-9a-fA-F]", 3.0),
    ("alphanumeric", r"[A-Za-z0-9]", 3.6),
    ("base64", r"[A-Za-z0-9+/=_-]", 3.8),
]

#: Candidates that are no secrets: words of one case, sorted or repeated fillers, identifiers
#: joined from words, UUIDs, digits only, paths of plain words.
ALLOWED = [
    r"[A-Z]?[a-z]+|[A-Z]+",
    r"(?:[A-Za-z]+[_=/+-]+)+[A-Za-z]*",
    r"[0-9_=/+-]+",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(?i).*(?:example|placeholder|your_?key|changeme|abcdefgh|12345678).*",
    r"(.)\1+",
]


def _gaps_and_matches(text: Column, pattern: str) -> Column:
    """Array of (gap, match, found): what lies before each match, and the match; the last gap
    reaches to the end. Java's groups: 1 gap, 2 match."""
    whole = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    return F.arrays_zip(F.regexp_extract_all(text, whole, F.lit(1)).alias("gap"), F.regexp_extract_all(text, whole, F.lit(2)).alias("hit"))


def _placed(text: Column, pattern: str, good=lambda hit: F.char_length(hit) > 0) -> Column:
    """Array of (at, hit): the matches that are ``good`` with their first code point's place, in order. Only
    these are appended, so the work follows the text's length."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,hit:string>>").alias("out"))

    def step(state, x):
        at = state["at"] + F.char_length(x["gap"])
        found = F.when(good(x["hit"]), F.array_append(state["out"], F.struct(at.cast("int").alias("at"), x["hit"].alias("hit")))).otherwise(state["out"])
        return F.struct((at + F.char_length(x["hit"])).cast("int").alias("at"), found.alias("out"))

    return F.aggregate(_gaps_and_matches(text, pattern), zero, step, lambda s: s["out"])


def _spans(text: Column, kind: int) -> Column:
    name, pattern, group, least = KINDS[kind]
    measured = (lambda hit: F.regexp_extract(hit, f"^{pattern}", group)) if group else (lambda hit: hit)
    good = _placed(text, pattern, lambda hit: F.char_length(measured(hit)) >= least)
    spans = F.transform(good, lambda x: F.struct(x["at"].alias("start"), F.lit(kind).alias("kind"), (x["at"] + F.char_length(x["hit"])).cast("int").alias("end")))
    return F.when(text.rlike(_HINTS[kind]), spans).otherwise(F.array().cast(_SPANS))


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def window_entropy(value: Column, window: int) -> Column:
    """The largest Shannon entropy, in bits a character, of any ``window`` characters of ``value``
    in a row (of all of it, if shorter). Characters beyond ALPHABET don't count.

    The state holds a count for each character; one is raised as a character comes in and one lowered
    as the oldest goes. S = sum of c log2 c over the counts changes by those two alone, so it is carried
    along, and H = log2 w - S / w."""
    f = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    codes = F.filter(F.transform(F.split(value, ""), lambda c: F.when(c != "", F.instr(F.lit(ALPHABET), c)).otherwise(0)), lambda i: i > 0)
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def scan(code):
        def step(state, i):
            new, old = F.get(code, i), F.coalesce(F.get(code, i - window), F.lit(0))
            n, m = F.get(state["counts"], old), F.get(state["counts"], new)
            kept = F.when((old > 0) & (old == new), m - 1).otherwise(m)
            s = state["s"] + F.when(old > 0, f(n - 1) - f(n)).otherwise(0.0) + f(kept + 1) - f(kept)
            counts = F.transform(state["counts"], lambda c, j: c + (j == new).cast("int") - ((j == old) & (old > 0)).cast("int"))
            entropy = F.when(i >= window - 1, F.log2(F.lit(float(window))) - s / window).otherwise(F.lit(0.0))
            return F.struct(counts.alias("counts"), s.alias("s"), F.greatest(state["best"], entropy).alias("best"))

        size = F.size(code).cast("double")
        end = lambda state: F.when(size >= window, state["best"]).otherwise(F.log2(size) - state["s"] / size)
        return F.when(size > 0, F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), zero, step, end)).otherwise(F.lit(0.0))

    return F.element_at(F.transform(F.array(codes), scan), 1)


def _entropy_spans(text: Column, window: int, allowed: list[str]) -> Column:
    """Spans of kind ``len(KINDS)``: candidates that no allowed form covers, with letters and digits
    in them, and for some class a run of its characters with a window of high entropy."""
    def wanted(x):
        hit = x["hit"]
        over = F.lit(False)
        for _, of, least in CLASSES:
            runs = F.regexp_extract_all(hit, F.lit(f"({of}{{{min(window, 20)},}})"), F.lit(1))
            over = over | F.coalesce(F.array_max(F.transform(runs, lambda run: window_entropy(run, window))) >= least, F.lit(False))
        suspect = hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
        for pattern in allowed:
            suspect = suspect & ~hit.rlike(f"^(?:{pattern})$")
        return F.when(suspect, over).otherwise(F.lit(False))

    found = F.filter(_placed(text, CANDIDATE), wanted)
    spans = F.transform(found, lambda x: F.struct(x["at"].alias("start"), F.lit(len(KINDS)).alias("kind"), (x["at"] + F.char_length(x["hit"])).cast("int").alias("end")))
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.array().cast(_SPANS))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("entropy"))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def scan_secrets(docs: DataFrame, text: str = "text", window: int = 20, allowed: list[str] = ALLOWED) -> DataFrame:
    """``docs`` with secrets: an array of (start, kind, end) by start, then kind; code points, end
    exclusive. Kinds 0 to 2 are KINDS, 3 is a candidate of high entropy that overlaps none of them.
    A null text has none, like an empty one. Each row is judged alone: no shuffle, repeated rows
    get equal results, no rows give no rows."""
    docs = without(docs, ["secrets", "_base", "_more"])
    value = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(*[_spans(value, k) for k in range(len(KINDS))]))
    found = docs.withColumn("_base", base).withColumn("_more", _entropy_spans(value, window, allowed))
    new = F.filter("_more", lambda m: ~F.exists("_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return found.withColumn("secrets", F.array_sort(F.concat("_base", new))).drop("_base", "_more")


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``scan_secrets``' rows with their spans in ``text`` replaced by ``mask``; overlapping spans
    become one. A null text stays null."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, x):
        fresh = x["start"] >= state["at"]
        gap = F.substring(F.col(text), state["at"] + 1, x["start"] - state["at"])
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(fresh, F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"]).alias("out"))

    done = F.aggregate("secrets", zero, step, lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(text))))
    return docs.withColumn(text, F.when(F.size("secrets") > 0, done).otherwise(F.col(text)))


def digest(scanned: DataFrame) -> DataFrame:
    """``scan_secrets``' rows with counts a kind, the SHA-256 of the base spans, and all spans as text."""
    base = F.filter("secrets", lambda x: x["kind"] < len(KINDS))
    of_kind = lambda i: F.size(F.filter("secrets", lambda x: x["kind"] == i)).cast("long")
    counts = {f"n_{k[0]}": of_kind(i) for i, k in enumerate(KINDS)}
    return scanned.withColumns(counts | {"base_sha256": F.sha2(_written(base), 256), "spans": _written(F.col("secrets"))})
