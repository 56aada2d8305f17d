"""Operator 11: centroid clustering by delta Lloyd rounds, in exact integers.

Assignments and distances are written each round, and the clusters' sums stay on the driver. A round compares a vector whose
centroid stood still with the centroids that moved, and only a vector whose own centroid moved with all of them. A vector that changes its
cluster is a signed transfer: taken off one sum and put onto another. Each task adds up its transfers in
one row that it writes beside its assignments, so a task that runs again counts once and no vector is read for the sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches

#: A sum travels as signed digits of this many bits, which Spark adds up in longs without an overflow over millions of tasks.
_DIGIT = 40
#: Distances that a signed 64-bit integer can't hold become the largest one that it can.
_LARGEST = 2**63 - 1
_STATE = "vec_id long, v array<double>, cluster int, distance long, transfers array<struct<cluster: int, dim: int, digit: int, value: long>>"


def _integers(v: np.ndarray, c: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids in doubles where these hold every distance exactly, else in Python's integers."""
    most = max(float(np.abs(v).max(initial=0.0)), float(max((abs(x) for row in c for x in row), default=0)))
    if v.shape[1] * (2 * most) ** 2 < 2**52:
        return v, np.array(c, np.float64).reshape(len(c), v.shape[1])
    exact = np.array([[int(x) for x in row] for row in v.tolist()], object).reshape(v.shape)
    return exact, np.array(c, object).reshape(len(c), v.shape[1])


def _distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]


def assign(v: np.ndarray, cluster: np.ndarray, distance: np.ndarray, centroids: list[list[int]], moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Clusters and distances after the ``moved`` centroids took their new places; a cluster of -1 is a vector without one yet."""
    cluster, distance = cluster.copy(), distance.copy()
    anew = (cluster < 0) | (distance == _LARGEST)
    anew[~anew] = moved[cluster[~anew]]
    for rows, against in ((np.flatnonzero(anew), np.arange(len(centroids))), (np.flatnonzero(~anew), np.flatnonzero(moved))):
        if len(rows) and len(against):
            found = _distances(*_integers(v[rows], [centroids[j] for j in against]))
            at = found.argmin(axis=1)  # the first of equals has the smaller number
            least = np.array([min(int(x), _LARGEST) for x in found[np.arange(len(rows)), at]], np.int64)
            to = against[at].astype(cluster.dtype)
            nearer = anew[rows] | (least < distance[rows]) | (least == distance[rows]) & (to < cluster[rows])
            cluster[rows[nearer]], distance[rows[nearer]] = to[nearer], least[nearer]
    return cluster, distance


class Transfers:
    """Signed sums of vectors, and of their number, by cluster."""

    def __init__(self, k: int, width: int):
        self.sums = np.full((k, width + 1), 0, object)

    def add(self, v: np.ndarray, cluster: np.ndarray, sign: int) -> None:
        exact = v if len(v) * float(np.abs(v).max(initial=0.0)) < 2**53 else np.array([[int(x) for x in row] for row in v.tolist()], object).reshape(v.shape)
        for j in np.unique(cluster):
            own = cluster == j
            self.sums[j] += np.array([sign * int(x) for x in exact[own].sum(axis=0)] + [sign * int(own.sum())], object)

    def rows(self) -> list[dict]:
        """The sums that aren't zero, digit by digit."""
        out = []
        for j, d in zip(*np.nonzero(self.sums)):
            value, digit = abs(self.sums[j, d]), 0
            while value:
                low = value % 2**_DIGIT
                out.append({"cluster": int(j), "dim": int(d), "digit": digit, "value": int(low if self.sums[j, d] > 0 else -low)})
                value, digit = value >> _DIGIT, digit + 1
        return out


def _round(centroids: list[list[int]], moved: np.ndarray, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.struct([("cluster", pa.int32()), ("dim", pa.int32()), ("digit", pa.int32()), ("value", pa.int64())])
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("cluster", pa.int32()), ("distance", pa.int64()), ("transfers", pa.list_(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Transfers(len(centroids), width)
        for batch in batches:
            v = np.floor(np.asarray(batch["v"].flatten(), np.float64)).reshape(len(batch), width)
            was = batch["cluster"].to_numpy()
            cluster, distance = assign(v, was, batch["distance"].to_numpy(), centroids, moved)
            sums.add(v[left := (cluster != was) & (was >= 0)], was[left], -1)
            sums.add(v[came := cluster != was], cluster[came], 1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"].cast(pa.list_(pa.float64())), pa.array(cluster, pa.int32()), pa.array(distance), pa.nulls(len(batch), pa.list_(kind))], schema=schema)
        if rows := sums.rows():
            yield pa.RecordBatch.from_pylist([{"transfers": rows}], schema=schema)

    return run


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: float = 256.0, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each vector's cluster after ``rounds`` Lloyd rounds from ``k`` starts, and the clusters' sums of squared distances.

    Components become ``floor(scale * x)`` in double. The starts are the vectors whose ids have the smallest SHA-256 of ``salt`` and the
    decimal id, in that order (equal ids by vector; null ids last). A vector belongs to the nearest centroid, the smaller number of equals. A centroid becomes the
    floor of its vectors' mean; one without vectors stays. Returns ``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``,
    ``inertia``, ``centroid_sha256``.

    Vectors without exactly ``width`` components, and those with a component that is null, not finite or too large to be scaled, are left out. Fewer vectors than ``k`` give
    as many centroids. Rows that repeat count each; null ids are vectors like others. Equal starts leave all but the first
    without vectors. Distances and sums over the largest signed 64-bit integer are returned as that. Other columns don't matter. An empty table gives no row.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    scaled = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * scale)
    # The comparison keeps whole vectors only: it is null where a component is.
    whole = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.size(vector_col) == width).where(whole).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"))
    first = rows.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last(), "v").limit(k).collect()
    centroids = [[int(x) for x in np.floor(r["v"])] for r in first]
    moved = np.ones(len(centroids), bool)
    sums = np.full((len(centroids), width + 1), 0, object)
    state = rows.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    written: list[DataFrame] = []
    for n in range(rounds + 1):
        state = materialise(state.mapInArrow(_round(centroids, moved, width), _STATE), "lloyd")
        discard(*written)
        written = [state]
        moved = np.zeros(len(centroids), bool)
        if n < rounds:
            for t in _digits(state):
                sums[t["cluster"], t["dim"]] += t["value"] << (_DIGIT * t["digit"])
            for j, (*total, count) in enumerate(sums.tolist()):
                if count and (at := [x // count for x in total]) != centroids[j]:
                    centroids[j], moved[j] = at, True
        state = state.where("cluster is not null").drop("transfers")
        if not moved.any():
            break
    return _told(state, centroids)


def _digits(state: DataFrame) -> list:
    """The tasks' transfers, added up by cluster, dimension and digit: a table that is bounded by the centroids."""
    one = state.where("transfers is not null").select(F.explode("transfers").alias("t")).select("t.*")
    return one.groupBy("cluster", "dim", "digit").agg(F.sum("value").alias("value")).collect()


def _told(state: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The assignments with what holds for their clusters: a row for each centroid, so small enough to be sent everywhere."""
    inertia = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(inertia.values()), _LARGEST)
    told = [(j, min(s, _LARGEST), total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, s in inertia.items()]
    by_cluster = state.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
