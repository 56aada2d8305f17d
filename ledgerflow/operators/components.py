"""Connected components of a large edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, written


def connected(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``node``, ``root``: the smallest node of each edge's component.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; nodes without an
    edge to another are not listed, repeats do no harm. Each round hangs every node's
    larger neighbours onto its smallest one, then every node's smaller ones, which
    shrinks the depth by a constant factor; it stops when no row changes. Rounds
    are aggregations and joins by key, never a collected component, and each
    writes its edges to the shared folder. Their number grows with the logarithm of the depth; where
    ``rounds`` of them don't do, it's an error.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        last = now
        now = written(large.join(small, "a").select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).where("a <> b").distinct(), "edges")
        discard(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
