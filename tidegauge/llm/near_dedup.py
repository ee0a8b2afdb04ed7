"""SimHash near-duplicates by tiled exact comparison (operator 4)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, row_hash
from .components import connected_components

SEED = 42
CHUNK = 1 << 15


def _shingle_ends(text: str | None, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The text's words (A-Z lower-cased, parted by ASCII white space) joined by blanks, and where its
    shingles start and end in that; fewer words than a shingle are one, no words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return b"", [], []
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    return b" ".join(words), [0, *(ends[: len(last) - 1] + 1).tolist()], last


def _majority(joined: bytes, starts: list[int], ends: list[int], hashed, width: int) -> np.ndarray:
    counts = np.zeros(width, np.int64)
    for at in range(0, len(ends), CHUNK):
        digests = b"".join([hashed(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, width // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits((2 * counts > len(ends)).astype(np.uint8))


def simhash(text: str | None, shingle: int = 4) -> int:
    """Signed 64-bit SimHash of the whole text.

    A-Z are lower-cased, words are runs without ASCII white space, features are ``shingle``-word
    shingles with repeats (fewer words: the whole sequence) hashed by XXH64. A bit is set if over
    half of the hashes have it. Null and wordless texts give 0."""
    return int(_majority(*_shingle_ends(text, shingle), xxhash.xxh64_digest, 64).view(">i8")[0])


def wide_simhash(text: str | None, shingle: int) -> tuple[int, int]:
    """The same with 128 bits, as two signed halves."""
    high, low = _majority(*_shingle_ends(text, shingle), xxhash.xxh3_128_digest, 128).view(">i8")
    return int(high), int(low)


def similarity_of(a: str | None, b: str | None, shingle: int) -> float:
    """Weighted Jaccard similarity of the texts' shingles (their multisets); 1 if both have none."""
    one, other = (Counter(j[s:e] for s, e in zip(starts, ends, strict=True)) for j, starts, ends in (_shingle_ends(a, shingle), _shingle_ends(b, shingle)))
    both = (one & other).total()
    return both / every if (every := one.total() + other.total() - both) else 1.0


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 4) -> DataFrame:
    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(out, fingerprint(F.col(text)))


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after linking i[k] and j[k] for each k; a label is the smallest index linked."""
    while True:
        a, b = label[i], label[j]
        if not (differ := a != b).any():
            return label
        np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while not np.array_equal(up := label[label], label):
            label = up


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int, rows: int = 64, cols: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Compares every value of ``a`` with every value of ``b`` (None: of ``a`` itself) and returns
    links that connect all that lie within ``radius`` bits: a spanning forest, at most one link a
    value, however many pairs there are. Values are unsigned, as bits of negative ones count otherwise."""
    every = a if b is None else np.concatenate([a, b])
    shift, right = (0, a) if b is None else (len(a), b)
    label = np.arange(len(every))
    for i0 in range(0, len(a), rows):
        left = a[i0 : i0 + rows, None]
        for j0 in range(i0 if b is None else 0, len(right), cols):
            near = np.bitwise_count(left ^ right[None, j0 : j0 + cols]) <= radius
            if near.any():
                i, j = np.nonzero(near)
                label = _join_labels(label, i + i0, j + j0 + shift)
    tail = np.flatnonzero(label != np.arange(len(every)))
    return every[tail], every[label[tail]]


def hamming_links(prints: DataFrame, column: str, radius: int = 4, tile: int = 8192) -> DataFrame:
    """Links (a, b) between the distinct values of ``column`` that connect all values within
    ``radius`` bits of each other.

    Values are dealt into tiles of about ``tile`` values with one population count each. As
    counts of values within the radius differ by the radius at most, only tile pairs with such
    counts meet; each pair is compared exactly. The driver sees 65 population counts."""
    prints = prints.select(F.col(column).alias("fp")).withColumn("pc", F.bit_count("fp").cast("int"))
    sizes = {r["pc"]: r["count"] for r in prints.groupBy("pc").count().collect()}
    tiles = [-(-sizes.get(p, 0) // tile) for p in range(65)]
    of_pc = F.array(*map(F.lit, tiles))
    packed = prints.withColumn("s", F.pmod(F.xxhash64("fp"), F.element_at(of_pc, F.col("pc") + 1)).cast("int")).groupBy("pc", "s").agg(F.collect_list("fp").alias("fps"))

    def met(lo, hi):
        """The tiles with counts from lo to hi."""
        return F.flatten(F.transform(F.sequence(lo, hi), lambda p: F.transform(F.when(F.element_at(of_pc, p + 1) > 0, F.sequence(F.lit(0), F.element_at(of_pc, p + 1) - 1)).otherwise(F.array().cast("array<int>")), lambda q: F.struct(p.alias("pc"), q.alias("s")))))

    own = F.struct("pc", "s")
    up = packed.select(own.alias("x"), F.explode(met(F.col("pc"), F.least(F.col("pc") + radius, F.lit(64)))).alias("y"), F.col("fps").alias("a")).where("y >= x")
    down = packed.select(F.explode(met(F.greatest(F.col("pc") - radius, F.lit(0)), F.col("pc"))).alias("x"), own.alias("y"), F.col("fps").alias("b")).where("y >= x")
    pairs = up.join(down.hint("shuffle_merge"), ["x", "y"]).select((F.col("x") == F.col("y")).alias("same"), "a", "b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for same, a, b in zip(batch["same"], batch["a"], batch["b"], strict=True):
                u, v = tile_links(np.asarray(a, "int64").view("<u8"), None if same else np.asarray(b, "int64").view("<u8"), radius)
                yield pd.DataFrame({"a": u.view("<i8"), "b": v.view("<i8")})

    return pairs.mapInPandas(compare, "a long, b long")


def near_groups(prints: DataFrame, doc_id: str = "doc_id", fingerprint: str = "fingerprint", radius: int = 4) -> DataFrame:
    """``prints`` with a column component_id: the smallest doc_id that links reach from the row.

    Exact copies share a fingerprint and are compared once. Null doc_ids link, but name no
    component unless the whole component has none (then it is null). ``prints`` is read more
    than once: pass a written table."""
    distinct = materialise(prints.groupBy(F.col(fingerprint).alias("fp")).agg(F.min(doc_id).alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    labels = connected_components(hamming_links(distinct, "fp", radius))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    linked = materialise(named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select(F.col("fp").alias(name := free_name(prints, "fp")), "component_id", "n"), "named")
    # fingerprints of a thousandth of all rows and more, which a thousand can be at most, don't shuffle their rows
    hot = F.col("n") * 1000 >= linked.agg(F.sum("n")).first()[0] if not linked.isEmpty() else F.lit(False)
    often, rest = F.broadcast(linked.where(hot).drop("n")), linked.where(~hot).drop("n")
    on = prints[fingerprint] == F.col(name)
    few = prints.join(often, on, "left_anti").join(rest, on, "left")
    return prints.join(often, on).unionByName(few).drop(name)


def closest_links(distance: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links (i[k], j[k]) make a forest that joins all that the links join, closest first."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    kept = []
    for k in np.argsort(distance, kind="stable").tolist():
        a, b = root(int(i[k])), root(int(j[k]))
        if a != b:
            up[a] = b
            kept.append(k)
    return np.array(kept, dtype=np.int64)


def _near(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances and places of all pairs of 128-bit values within ``radius`` bits, over both halves."""
    d = np.bitwise_count(left[:, None, 0] ^ right[None, :, 0])
    d += np.bitwise_count(left[:, None, 1] ^ right[None, :, 1])
    i, j = np.divmod(np.flatnonzero(d <= radius), len(right))
    return d[i, j].astype(np.int64), i, j


def tile_pairs(a: np.ndarray, ga: np.ndarray, b: np.ndarray | None, gb: np.ndarray | None, radius: int, rows: int = 64, cols: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``tile_candidates``, but gives all pairs within ``radius`` bits whose groups (``ga``, ``gb``) differ, a
    block at a time; groups may be changed between blocks."""
    right, shift, groups = (a, 0, ga) if b is None else (b, len(a), gb)
    for i0 in range(0, len(a), rows):
        for j0 in range(i0 if b is None else 0, len(right), cols):
            _, i, j = _near(a[i0 : i0 + rows], right[j0 : j0 + cols], radius)
            i, j = i + i0, j + j0
            apart = (ga[i] != groups[j]) & ((i < j) | (b is not None))
            if apart.any():
                yield i[apart], j[apart] + shift


def tile_candidates(a: np.ndarray, b: np.ndarray | None, radius: int, rows: int = 64, cols: int = 2048, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Compares all of ``a`` with all of ``b`` (None: of ``a`` itself), two halves of 64 bits a row, and
    returns the places of pairs within ``radius`` bits: of each group that such pairs join a tree of the
    closest ones."""
    right, shift = (a, 0) if b is None else (b, len(a))
    found = np.zeros((3, 0), np.int64)
    for i0 in range(0, len(a), rows):
        left = a[i0 : i0 + rows]
        for j0 in range(i0 if b is None else 0, len(right), cols):
            d, i, j = _near(left, right[j0 : j0 + cols], radius)
            near = (i + i0 < j + j0) | (b is not None)
            if near.any():
                found = np.concatenate([found, [d[near], i[near] + i0, j[near] + j0 + shift]], axis=1)
                if found.shape[1] > most:
                    found = found[:, closest_links(*found)]
    found = found[:, closest_links(*found)]
    return found[1], found[2]


def wide_links(nodes: DataFrame, radius: int, tile: int = 8192) -> DataFrame:
    """Links (a, b) between rows (node, high, low) with 128-bit fingerprints within ``radius`` bits:
    trees of the closest, so that a group of many copies isn't spelled out in pairs.

    Rows are dealt into tiles with one population count of both halves each; as counts within the
    radius differ by it at most, only tile pairs with such counts meet. The driver sees 129 counts."""
    nodes = nodes.withColumn("pc", (F.bit_count("high") + F.bit_count("low")).cast("int"))
    sizes = {r["pc"]: r["count"] for r in nodes.groupBy("pc").count().collect()}
    tiles = F.array(*[F.lit(-(-sizes.get(p, 0) // tile)) for p in range(129)])
    dealt = nodes.withColumn("s", F.pmod(F.xxhash64("node"), F.element_at(tiles, F.col("pc") + 1)).cast("int"))
    held = ["node", "high", "low"]
    packed = dealt.groupBy("pc", "s").agg(F.collect_list(F.struct(*held)).alias("rows"))

    def met(lo, hi):
        return F.flatten(F.transform(F.sequence(lo, hi), lambda p: F.transform(F.when(F.element_at(tiles, p + 1) > 0, F.sequence(F.lit(0), F.element_at(tiles, p + 1) - 1)).otherwise(F.array().cast("array<int>")), lambda q: F.struct(p.alias("pc"), q.alias("s")))))

    own = F.struct("pc", "s")
    up = packed.select(own.alias("x"), F.explode(met(F.col("pc"), F.least(F.col("pc") + radius, F.lit(128)))).alias("y"), F.col("rows").alias("a")).where("y >= x")
    down = packed.select(F.explode(met(F.greatest(F.col("pc") - radius, F.lit(0)), F.col("pc"))).alias("x"), own.alias("y"), F.col("rows").alias("b")).where("y >= x")
    unpacked = lambda of, side: [F.col(f"{of}.{n}").alias(f"{side}_{n}") for n in held]
    pairs = up.join(down.hint("shuffle_merge"), ["x", "y"]).select((F.col("x") == F.col("y")).alias("same"), *unpacked("a", "a"), *unpacked("b", "b"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                left, right = np.stack([r.a_high, r.a_low], axis=1).view("<u8"), np.stack([r.b_high, r.b_low], axis=1).view("<u8")
                node = np.asarray(r.a_node if r.same else np.concatenate([r.a_node, r.b_node]), np.int64)
                i, j = tile_candidates(left, None if r.same else right, radius)
                yield pd.DataFrame({"a": node[i], "b": node[j]})

    return pairs.mapInPandas(compare, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def shingle_numbers(text: str | None, shingle: int) -> np.ndarray:
    """The text's shingles as 64-bit hashes, of which a repeat is a number of its own: what two texts' multisets
    have in common are the numbers that both have."""
    joined, starts, ends = _shingle_ends(text, shingle)
    hashes = np.sort(np.fromiter((xxhash.xxh3_64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)), np.uint64, len(ends)))
    repeats = (np.arange(len(hashes)) - np.searchsorted(hashes, hashes)).astype(np.uint64)
    return (hashes + repeats * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def tile_alike(prints: np.ndarray, numbers: list[np.ndarray], split: int, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (places i, j) that connect all pairs within ``radius`` bits whose ``shingle_numbers`` have a Jaccard
    similarity of ``similarity`` at least: a forest, however many pairs there are. Pairs are one of the first
    ``split`` rows with one of the others, or all pairs if there are no others. Pairs that earlier ones have put
    into one group aren't judged; all others are, a row against its whole block at once."""
    sizes, label = np.array([len(x) for x in numbers]), np.arange(len(prints))
    starts = np.cumsum(sizes) - sizes
    values, known = np.unique(np.concatenate(numbers), return_inverse=True)
    marked, found = np.zeros(len(values), bool), [np.zeros((2, 0), np.int64)]
    others = (prints[split:], label[split:]) if split < len(prints) else (None, None)
    for i, j in tile_pairs(prints[:split], label[:split], *others, radius):
        for k, many in zip(*(x.tolist() for x in np.unique(i, return_counts=True)), strict=True):
            met, j = j[:many], j[many:]
            met = met[(label[met] != label[k]) & (np.minimum(sizes[met], sizes[k]) >= similarity * np.maximum(sizes[met], sizes[k]) - 1e-6) & (sizes[met] > 0)]
            if not len(met):
                continue
            own, n = known[starts[k] : starts[k] + sizes[k]], sizes[met]
            marked[own] = True
            ends = np.cumsum(n)
            both = np.add.reduceat(marked[known[np.repeat(starts[met] - ends + n, n) + np.arange(ends[-1])]], ends - n, dtype=np.int64)
            marked[own] = False
            alike = met[both / (n + sizes[k] - both) >= similarity]
            _, one = np.unique(label[alike], return_index=True)
            if len(one):
                found.append(np.stack([np.full(len(one), k), alike[one]]))
                label[:] = _join_labels(label, *found[-1])
    i, j = np.concatenate(found, axis=1)
    return i, j


def alike_links(texts: DataFrame, shingle: int, similarity: float, radius: int, rows: int = 1024, size: int = 1 << 23) -> DataFrame:
    """Links (a, b) that connect all texts (group, node, high, low, t) within ``radius`` bits in one group whose
    weighted Jaccard similarity is ``similarity`` at least.

    A large group is dealt into tiles of about ``rows`` texts and ``size`` characters, of which every two meet in
    one task. Pairs are judged there and never are rows, so of a group of n texts there are n times its tiles."""
    @F.pandas_udf("array<long>")
    def numbers(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_numbers(t, shingle) for t in texts], dtype=object)

    tiles = texts.groupBy("group").agg(F.ceil(F.greatest(F.count(F.lit(1)) / rows, F.sum(F.coalesce(F.char_length("t"), F.lit(0))) / size, F.lit(1))).cast("int").alias("tiles"))
    dealt = texts.select("group", "node", "high", "low", numbers("t").alias("numbers")).join(tiles, "group").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("group", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("second"), "node", "high", "low", "numbers")

    def judged(held: list) -> tuple[np.ndarray, np.ndarray]:
        node = np.array([r.node for r in held])
        i, j = tile_alike(np.array([(r.high, r.low) for r in held], np.int64).view(np.uint64), [r.numbers for r in held], sum(not r.second for r in held), radius, similarity)
        return node[i], node[j]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for batch in batches:
            found = []
            for r in batch.itertuples():
                if (r.group, r.x, r.y) != key:
                    if len(held) > 1:
                        found.append(judged(held))
                    key, held = (r.group, r.x, r.y), []
                held.append(r)
            yield pd.DataFrame({"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])} if found else {"a": [], "b": []}, dtype="int64")
        if len(held) > 1:
            yield pd.DataFrame(dict(zip("ab", judged(held), strict=True)), dtype="int64")

    return met.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "second").mapInPandas(judge, "a long, b long")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8, radius: int = 32) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest by doc_id (null last), then by
    row hash; of fully equal rows one stays. Columns stay as they are. No rows give no rows.

    Texts are linked if the weighted Jaccard similarity of their ``shingle``-word shingles is at least
    ``similarity``. Pairs to judge are those within ``radius`` of 128 bits of SimHash. Tiled exact comparison joins
    them by trees, so that a dense group isn't spelled out; then all such pairs in what a tree joins are judged, but
    for those that others have joined already (``alike_links``). At the similarity of 0.8 about 20 bits differ, with
    a deviation of 4. Equal fingerprints are one text (those of texts without words, too)."""
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, row_hash(docs))

    @F.pandas_udf("high long, low long")
    def fingerprint(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([wide_simhash(t, shingle) for t in texts], columns=["high", "low"], dtype="int64")

    rows = keyed.select(F.col(doc_id).alias("id"), F.col(key).alias("k"), F.col(text).alias("t"))
    prints = rows.withColumn("fp", fingerprint("t")).select("id", "k", "fp.*")
    nodes = prints.groupBy("high", "low").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "k")).alias("first"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "prints")
    links = materialise(wide_links(nodes.select("node", "high", "low"), radius).distinct(), "candidates")
    joined = connected_components(links).withColumnRenamed("component", "group")
    linked = nodes.join(joined, "node").select("group", "node", "high", "low", "first.k")
    texts = materialise(rows.join(linked, "k").groupBy("group", "node", "high", "low").agg(F.first("t").alias("t")), "texts")
    judged = connected_components(alike_links(texts, shingle, similarity, radius)).withColumnRenamed("component", "of")
    groups = nodes.join(judged, "node", "left").groupBy(F.coalesce("of", "node").alias("group"))
    kept = groups.agg(F.min("first").alias("first")).select(F.col("first.k").alias(key))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
