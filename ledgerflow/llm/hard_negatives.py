"""Operator 13: hard negatives inside a window of scores, by vantage-point trees.

Inner products become distances: a block's vectors get one more component, the root of what their squared norm lacks of
the block's largest one, and a query gets a zero there. A higher score then is a smaller distance, and a window of scores is an
annulus around the query. A tree splits a block's rows again and again at the median distance from a vantage point, and
keeps the distances that each half spans; by the triangle inequality a half whose distances from the query miss the
annulus is never entered. The rest is visited nearest first, so the first rows that come out are the best ones and the walk ends there.
Trees only rule out and order; every score that decides is an exact integer.

Rows and anchors are dealt over a grid of bounded cells, twice: for the positives, then for the windows that these give.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .topk import _LARGEST, _exact

#: Rows of a candidate block and anchors of an anchor block; both bound a task's memory.
CANDIDATES, ANCHORS = 8192, 4096
#: Rows of a leaf.
LEAF = 256
#: What a distance may be off by, generously, as a share of the largest distance there can be.
_SLACK = 1e-6


class VantageTree:
    """The rows of a block (integers), their labels and ids, in leaves under vantage points."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.unit = float(max(1, np.abs(x).max(initial=0)))
        flat = (x / self.unit).astype(np.float64)
        norms = (flat * flat).sum(axis=1)
        self.top = norms.max(initial=0.0)
        self._build(np.column_stack([flat, np.sqrt(np.maximum(self.top - norms, 0.0))]))
        self.vantages = flat[[v for v, _ in self.inner.values()]]

    def _build(self, points: np.ndarray) -> None:
        """By node: a vantage row and two halves (child, least, largest distance from it), or a leaf's rows."""
        self.inner: dict[int, tuple[int, list[tuple[int, float, float]]]] = {}
        self.leaves: dict[int, np.ndarray] = {}
        todo, made = [(0, np.arange(len(points)))], 1
        while todo:
            node, rows = todo.pop()
            if len(rows) <= LEAF:
                self.leaves[node] = rows
                continue
            own = points[rows]
            far = own - own.mean(axis=0)
            vantage = int(rows[np.argmax((far * far).sum(axis=1))])
            apart = np.sqrt(((own - points[vantage]) ** 2).sum(axis=1))
            order = np.argsort(apart, kind="stable")
            halves = order[: len(order) // 2], order[len(order) // 2 :]
            self.inner[node] = vantage, [(made + i, float(apart[h[0]]), float(apart[h[-1]])) for i, h in enumerate(halves)]
            todo += [(made + i, rows[h]) for i, h in enumerate(halves)]
            made += 2


class Query:
    """One query's walks through a tree; what a walk has scored and sorted serves the next ones."""

    def __init__(self, tree: VantageTree, q: np.ndarray, own: int):
        self.tree, self.q, self.own = tree, q, own
        flat = (q / tree.unit).astype(np.float64)
        self.sum = float((flat * flat).sum()) + tree.top
        self.slack = _SLACK * (1 + math.sqrt(self.sum))
        self.apart = dict(zip(tree.inner, np.sqrt(np.maximum(0.0, self.sum - 2 * (tree.vantages @ flat))).tolist()))
        self.sorted: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def _distance(self, score: float) -> float:
        """Of a row with that score, in the tree's unit."""
        return math.sqrt(max(0.0, self.sum - 2 * score))

    def nearest(self, label: int, same: bool, k: int, least=None, most=None) -> Iterator[tuple[int, int]]:
        """(id, score) of at most ``k`` rows with (or without) that label and with scores from ``least`` to ``most``, best first, ties by smaller id."""
        tree, square = self.tree, self.tree.unit * self.tree.unit
        inner = 0.0 if most is None else max(0.0, self._distance(most / square) - self.slack)
        outer = math.inf if least is None else self._distance(least / square) + self.slack
        heap: list[tuple] = [(-math.inf, 0, 0, 0, inner, math.inf)]  # less what it can't exceed, row or node, id, node, its annulus
        while heap and k:
            score, is_row, row, node, near, far = heapq.heappop(heap)
            if is_row:
                yield row, -score
                k -= 1
            elif node in tree.leaves:
                for row, s in self._leaf(node, label, same, k, least, most):
                    heapq.heappush(heap, (s, 1, row, 0, 0, 0))
            else:
                d = self.apart[node]
                for child, low, high in tree.inner[node][1]:
                    n, f = max(near, d - high - self.slack, low - d - self.slack), min(far, d + high + self.slack)
                    if n <= outer and f >= inner:
                        # The bound on scores, with the slack of its own arithmetic.
                        at_most = (self.sum - n * n + self.sum * _SLACK) / 2 * square
                        heapq.heappush(heap, (-at_most, 0, 0, child, n, f))

    def _leaf(self, node: int, label: int, same: bool, k: int, least, most) -> Iterator[tuple[int, int]]:
        """The leaf's ``k`` best rows in the window: (id, score with its sign turned)."""
        if (key := (node, label, same)) not in self.sorted:
            rows = self.tree.leaves[node]
            rows = rows[((self.tree.labels[rows] == label) == same) & (self.tree.ids[rows] != self.own)]
            ids, turned = self.tree.ids[rows], -(self.tree.x[rows] @ self.q)
            order = sorted(range(len(ids)), key=lambda i: (turned[i], ids[i])) if turned.dtype == object else np.lexsort((ids, turned))
            self.sorted[key] = ids[order], turned[order]
        ids, turned = self.sorted[key]
        begin = 0 if most is None else int(np.searchsorted(turned, -most))
        for i, s in zip(ids[begin : begin + k].tolist(), turned[begin : begin + k].tolist()):
            if least is not None and s > -least:
                break
            yield i, s


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the largest integer s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _vectors(t: pa.Table, scale: float) -> list[np.ndarray]:
    col = t["v"].combine_chunks()
    flat = np.floor(np.asarray(col.flatten(), np.float64) * scale)
    ends = np.cumsum(np.asarray(col.value_lengths(), np.int64))
    return np.split(flat, ends[:-1]) if len(t) else []


def _searches(have: pa.Table, ask: pa.Table, scale: float) -> Iterator[tuple[dict, Query]]:
    """Every anchor of ``ask`` with its walks through one tree of ``have``."""
    if not len(have) or not len(ask):
        return
    xs, qs = _vectors(have, scale), _vectors(ask, scale)
    both = _exact(xs + qs, max(map(len, xs + qs)))
    tree = VantageTree(have["vec_id"].to_numpy(), have["label"].to_numpy(), both[: len(xs)])
    for anchor, q in zip(ask.drop_columns("v").to_pylist(), both[len(xs) :]):
        yield anchor, Query(tree, q, anchor["vec_id"])


def _long(score) -> int:
    return max(-_LARGEST - 1, min(_LARGEST, int(score)))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, k: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, id_col: str = "vec_id",
    vector_col: str = "embedding", candidates: int = CANDIDATES, anchors: int = ANCHORS,
) -> DataFrame:
    """Each anchor's positives with the ``k`` best rows of other labels in their windows.

    Components become ``floor(scale * x)`` in double; a score is the exact integer inner product with the anchor; higher
    scores come first, ties by smaller id. An anchor's positives are its best other rows of its label. A negative of a positive has
    another label and a score of ``low`` to ``high`` per cent of the positive's (of a negative score no row has that; of 0 it is 0).
    Returns ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    Rows with a null id, label or vector, or with a component that is null, not finite or too large to be scaled, take no part. Shorter
    vectors, empty ones too, count as padded with zeros. Rows of an anchor's id are never its results; other rows that repeat are each a
    result; an id that occurs several times among the anchors asks once, with its least label and vector. A positive without a negative gives no row. A score
    beyond a signed 64-bit integer is returned as the nearest one, and such scores are ties. Other columns don't matter. An empty table gives no row.
    """
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x * scale) & (F.abs(x * scale) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), is_anchor.alias("asks"))
    # A number for each row, fixed by writing it: equal rows then go to different blocks.
    rows = materialise(rows.where("vec_id is not null and label is not null and v is not null").where(finite).withColumn("n", F.monotonically_increasing_id()), "negatives-rows")
    asked = materialise(rows.where("asks").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.*"), "negatives-anchors")
    n_c, n_q = max(1, math.ceil(rows.count() / candidates)), max(1, math.ceil(asked.count() / anchors))
    block = lambda n, key: F.pmod(F.xxhash64(F.col(key)), F.lit(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cells = rows.select("vec_id", "label", "v", block(n_c, "n").alias("c"), spread(n_q).alias("q"))
    dealt = lambda a: a.select("*", block(n_q, "vec_id").alias("q"), spread(n_c).alias("c"))

    def alike(have: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for anchor, query in _searches(have, ask, scale):
            out += [(anchor["vec_id"], row, _long(s)) for row, s in query.nearest(anchor["label"], True, positives)]
        return _table(out, ("anchor_id", "positive_id", "positive_score"))

    def unlike(have: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for anchor, query in _searches(have, ask, scale):
            for p in anchor["found"]:
                least, most = window(p["positive_score"], low, high)
                if least <= most:
                    out += [(anchor["vec_id"], p["p"], p["positive_id"], p["positive_score"], row, _long(s)) for row, s in query.nearest(anchor["label"], False, k, least, most)]
        return _table(out, ("anchor_id", "p", "positive_id", "positive_score", "negative_id", "negative_score"))

    met = cells.groupBy("c", "q").cogroup(dealt(asked).groupBy("c", "q")).applyInArrow(alike, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = met.withColumn("p", F.row_number().over(order).cast("long")).where(F.col("p") <= positives)
    # At most ``positives`` entries for each anchor.
    found = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("p", "positive_id", "positive_score")).alias("found"))
    windows = materialise(asked.join(found, "vec_id"), "negatives-windows")
    met = cells.groupBy("c", "q").cogroup(dealt(windows).groupBy("c", "q")).applyInArrow(unlike, "anchor_id long, p long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "p").orderBy(F.desc("negative_score"), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = materialise(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard(rows, asked, windows)
    return out


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})
