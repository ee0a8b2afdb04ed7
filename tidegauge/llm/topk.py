"""Exact top-k inner products by no-random-access aggregation (operator 9)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Sums of products below this are exact in a double.
EXACT = 1 << 53


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def sorted_lists(rows: np.ndarray) -> np.ndarray:
    """A column a dimension: the rows' places, best value first."""
    return np.argsort(-rows, axis=0, kind="stable").astype(np.int32)


def nra(rows: np.ndarray, order: np.ndarray, ids: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``nra_many`` for one query."""
    return nra_many(rows, order, ids, np.array([own]), query[None], k)[0]


def nra_many(rows: np.ndarray, order: np.ndarray, ids: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the indices and scores of its k best rows, best first, ties to smaller ids;
    ``own`` has the row that each query is itself, or -1.

    Each dimension's list (``order``, see ``sorted_lists``) is read in sequence, all to the same depth,
    which doubles from a sixteenth of the list on: from its top for positive components of queries and
    from its end for negative ones. What is newly read is added to the lower bounds of the queries that
    are still open, all at once; what isn't read lies between the last value read of its list and the
    list's end, which gives the upper bound. A query is closed when the rows whose upper bound reaches
    its k-th lower bound are 4 k at most, so that no other row can qualify; their scores are then resolved."""
    n, width = rows.shape
    if 4.0 * float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(width, 1) >= EXACT:
        found = []
        for mine, query in zip(own, queries, strict=True):
            score = np.clip(rows.astype(object) @ query.astype(object), -(1 << 63), (1 << 63) - 1).astype("int64")
            left = np.flatnonzero(np.arange(n) != mine)
            best = _best(ids[left], score[left], k)
            found.append((left[best], score[left[best]]))
        return found
    values, lists = rows.astype(float), np.arange(width)
    up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
    top, end = (values[order[0], lists], values[order[-1], lists]) if n else (np.zeros(width), np.zeros(width))
    low = np.repeat((up @ end + down @ top)[:, None], n, axis=1)
    mine = np.flatnonzero(own >= 0)
    low[mine, own[mine]] = -np.inf
    read_up, read_down = np.zeros((n, width)), np.zeros((n, width))
    found, open_, depth = [None] * len(queries), np.arange(len(queries)), 0
    while len(open_):
        to = min(n, 2 * depth or max(1, n // 16))
        first, last = order[depth:to], order[n - to : n - depth]
        new_up, new_down = np.zeros((n, width)), np.zeros((n, width))
        new_up[first, lists], new_down[last, lists] = values[first, lists] - end, values[last, lists] - top
        read_up[first, lists], read_down[last, lists] = 1, 1
        low += up @ new_up.T
        low += down @ new_down.T
        depth = to
        if depth < n:
            gap_up, gap_down = up * (values[order[depth - 1], lists] - end), down * (values[order[n - depth], lists] - top)
            high = low + (gap_up.sum(1) + gap_down.sum(1))[:, None]
            high -= gap_up @ read_up.T
            high -= gap_down @ read_down.T
        else:
            high = low
        kth = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(open_), -np.inf)
        left = (high >= kth[:, None]) & (high > -np.inf)
        done = (left.sum(1) <= 4 * k) | (depth == n)
        for i in np.flatnonzero(done):
            at = np.flatnonzero(left[i])
            score = rows[at] @ queries[open_[i]]
            best = _best(ids[at], score, k)
            found[open_[i]] = (at[best], score[best])
        open_, low, up, down = open_[~done], low[~done], up[~done], down[~done]
    return found


def exact_top_k(vectors: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 100, scale: int = 1024, block: int = 4096, query_block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id ``every`` divides.

    Components become floor(scale * x) as integers; the score is their inner product, clipped to
    a long. All rows are candidates for all queries but the row itself (a repeated row is a
    candidate like any other, and each repeated query row gets its own result); vectors meet only
    vectors of their length. Vectors that are null or hold null or non-finite components take no
    part; a null id is never a query and loses ties. No rows give no rows.

    Candidates are dealt evenly into blocks, whose lists are sorted once and written, and queries into
    query blocks; each pair of blocks is one group, searched alone, and yields k rows a query at most."""
    usable = vectors.where(F.col(embedding).isNotNull() & F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    ints = usable.select(F.col(vec_id).cast("long").alias("id"), F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    ints = materialise(ints.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    asked = F.coalesce(F.col("id") % every == 0, F.lit(False))
    n, queries = ints.agg(F.count(F.lit(1)), F.count_if(asked)).first()
    blocks, rounds = max(1, -(-n // block)), max(1, -(-queries // query_block))
    dealt, stack = F.xxhash64("uid"), lambda c: np.array(c.tolist(), "int64").reshape(len(c), -1)

    def sort_block(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid")
        rows = stack(group["v"])
        return pd.DataFrame({"c": group["c"].iloc[:1], "width": rows.shape[1], "uids": [group["uid"].to_numpy()], "ids": [group["id"].tolist()], "rows": [rows.ravel()], "order": [sorted_lists(rows).ravel()]})

    block_of = ints.select(F.pmod(dealt, F.lit(blocks)).alias("c"), "uid", F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "v")
    lists = materialise(block_of.groupBy("c", F.size("v").alias("width")).applyInPandas(sort_block, "c long, width int, uids array<long>, ids array<long>, rows array<long>, order array<int>"), "lists")
    lists = lists.select("*", F.expr(f"explode(sequence(0L, {rounds - 1}L))").alias("q"))
    sought = ints.where(asked).select(F.expr(f"explode(sequence(0L, {blocks - 1}L))").alias("c"), F.pmod(dealt, F.lit(rounds)).alias("q"), F.size("v").alias("width"), "uid", "id", "v")

    def search(block_: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_uid": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")]
        if not block_.empty and not wanted.empty:
            of = block_.iloc[0]
            uids, ids = np.asarray(of["uids"]), np.asarray(of["ids"])
            rows, order = np.asarray(of["rows"]).reshape(len(ids), -1), np.asarray(of["order"]).reshape(len(ids), -1)
            at = np.searchsorted(uids, wanted["uid"])
            own = np.where(uids[np.minimum(at, len(uids) - 1)] == wanted["uid"], at, -1)
            for uid, id_, (found, score) in zip(wanted["uid"], wanted["id"], nra_many(rows, order, ids, own, stack(wanted["v"]), k), strict=True):
                out.append(pd.DataFrame({"query_uid": uid, "query_id": id_, "vec_id": ids[found], "score": score}))
        return pd.concat(out)

    met = lists.groupBy("c", "q", "width").cogroup(sought.groupBy("c", "q", "width")).applyInPandas(search, "query_uid long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id"))
    ranked = met.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif(F.col("vec_id"), F.lit((1 << 63) - 1)).alias("vec_id"), "score")
