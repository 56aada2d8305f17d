"""Cutting lineage: tables that later stages read several times are written to a shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share.

    Where it is unset, a local master gets a temporary folder; elsewhere that is an error.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set(CHECKPOINT_DIR, root)
    return root.rstrip("/")


_scratch: list[list[DataFrame]] = []


def written(df: DataFrame, what: str) -> DataFrame:
    """The table, written to the shared folder and read again: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    if _scratch:
        _scratch[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more; one that is gone does no harm."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.shared_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are ``written`` within go at its end, so what comes of them must be written elsewhere by then."""
    _scratch.append([])
    try:
        yield
    finally:
        discard(*_scratch.pop())
