"""Operator 9: exact top-k inner products by the threshold algorithm.

Candidates and queries are dealt over a grid of bounded cells: every query block
meets every candidate block once, in one task. A cell keeps a sorted list per dimension. For a
query, sorted access walks each list from its better end (by the sign of the
query's component), in steps that double; random access scores what a step meets for the first time,
and the scores at the lists' current depth bound everything unseen. The search stops where that bound
is under the k-th result, or where the lists have shown every candidate. A list whose entries
change the bound most for an access goes deeper than one that changes it little. The cells' results merge into each query's
k best.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate block and of a query block; both bound a task's memory.
CANDIDATES, QUERIES = 8192, 4096
#: Entries that a first step reads of each list, on average.
FIRST_STEP = 8
#: Scores that a signed 64-bit integer can't hold become the nearest one that it can.
_LARGEST = 2**63 - 1


class SortedLists:
    """Integer vectors with one sorted list per dimension, ready for searches."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")  # positions then order ties by id
        self.ids, self.x = ids[order], vectors[order]
        self.rank = np.argsort(self.x, axis=0, kind="stable").T.copy()  # dimension, depth
        self.value = np.take_along_axis(self.x, self.rank.T, axis=0).T.copy()

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k best by (-score, id), and the entries that were read."""
        n = len(self.ids)
        used = np.flatnonzero(q)
        weight, up = q[used], q[used] > 0
        seen = self.ids == own  # never a result
        unseen = n - int(seen.sum())
        ids, scores = self.ids[:0], np.zeros(0, self.x.dtype)
        depth = np.zeros(len(used), np.int64)
        step = FIRST_STEP
        while unseen:
            if not len(used):  # all scores are zero: any order of access is sorted
                at = np.flatnonzero(~seen)
            else:
                now = np.minimum(depth + self._shares(weight, up, used, depth, step), n)
                found = np.zeros(n, bool)
                for d, upward, a, b in zip(used.tolist(), up.tolist(), depth.tolist(), now.tolist()):
                    found[self.rank[d, n - b : n - a] if upward else self.rank[d, a:b]] = True
                depth, step = now, 2 * step
                at = np.flatnonzero(found & ~seen)
            seen[at] = True
            unseen -= len(at)
            new = self.ids[at]
            ids, scores = best(np.concatenate([ids, new]), np.concatenate([scores, self.x[at] @ q]), k)
            if len(scores) == k and len(used) and depth.max() < n and self.bound(weight, up, used, depth) < scores[-1]:
                break
        return ids, scores, int(depth.sum())

    def _frontier(self, up: np.ndarray, used: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The value that each list shows next; its last one where it is read up."""
        at = np.minimum(depth, len(self.ids) - 1)
        return self.value[used, np.where(up, len(self.ids) - 1 - at, at)]

    def bound(self, weight: np.ndarray, up: np.ndarray, used: np.ndarray, depth: np.ndarray):
        """No vector outside the first ``depth`` entries of the lists in use scores more."""
        return (weight * self._frontier(up, used, depth)).sum()

    def _shares(self, weight: np.ndarray, up: np.ndarray, used: np.ndarray, depth: np.ndarray, step: int) -> np.ndarray:
        """Entries to read of each list: 1 at least, the rest by what ``step`` more entries would take off the bound."""
        fall = np.abs(weight * (self._frontier(up, used, depth) - self._frontier(up, used, depth + step))).astype(np.float64)
        total = fall.sum()
        return 1 + ((step - 1) * len(used) * fall / total if total else np.full(len(used), step - 1)).astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by (-score, id)."""
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _exact(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Rows padded with zeros to one width, as integers: in doubles where these hold
    all sums of products and bounds exactly, Python's own where 64 bits might not hold one."""
    large = max((float(np.abs(v).max()) for v in vectors if len(v)), default=0.0)
    most = large * large * max(width, 1)
    kind = np.float64 if most < 2**52 else np.int64 if most < 2**61 else object
    out = np.zeros((len(vectors), width), kind)
    for row, v in zip(out, vectors):
        row[: len(v)] = [int(c) for c in v] if kind is object else v.astype(kind)
    return out


def _rows(t: pa.Table, scale: float) -> tuple[np.ndarray, list[np.ndarray]]:
    ids = t["vec_id"].to_numpy()
    col = t["v"].combine_chunks()
    flat = np.floor(np.asarray(col.flatten(), np.float64) * scale)
    ends = np.cumsum(np.asarray(col.value_lengths(), np.int64))
    return ids, np.split(flat, ends[:-1]) if len(ids) else []


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """Each query's ``k`` best rows by exact integer inner product.

    Components become ``floor(scale * x)`` in double. ``is_query`` is a Column
    that marks the query rows. Returns ``query_id``, ``rank`` (from 1),
    ``vec_id``, ``score``; equal scores rank by smaller id; fewer rows than
    ``k`` are all returned. Vectors that are null or hold null or non-finite
    components, and rows with a null id, take no part. Shorter vectors count as
    padded with zeros. Rows of the query's id are never its results; repeated
    candidate rows are each a result; an id that occurs several times among the
    queries asks once, with its least vector. A score beyond a signed 64-bit integer is returned as the nearest one, and
    such scores are ties. An empty table gives no row.
    """
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks")).where(finite)
    asked = rows.where("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    n_rows, n_asked = rows.select("vec_id").count(), asked.select("vec_id").count()
    n_c, n_q = max(1, math.ceil(n_rows / candidates)), max(1, math.ceil(n_asked / queries))
    block = lambda n, *salt: F.pmod(F.xxhash64("vec_id", *salt), F.lit(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.select("vec_id", "v", block(n_c, F.col("v")).alias("c"), spread(n_q).alias("q"))
    right = asked.select("vec_id", "v", block(n_q).alias("q"), spread(n_c).alias("c"))

    def cell(have: pa.Table, ask: pa.Table) -> pa.Table:
        ids, xs = _rows(have, scale)
        names, qs = _rows(ask, scale)
        out: list[list] = [[], [], []]
        if len(ids) and len(names):
            width = max(map(len, xs + qs))
            both = _exact(xs + qs, width)
            lists = SortedLists(ids, both[: len(xs)])
            for name, q in zip(names, both[len(xs) :]):
                found, scores, _ = lists.search(q, name, k)
                out[0] += [int(name)] * len(found)
                out[1] += found.tolist()
                out[2] += [max(-_LARGEST - 1, min(_LARGEST, int(x))) for x in scores]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

