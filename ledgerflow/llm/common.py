"""Helpers that several operators share: inputs, shared folders, bounded caches."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_folder

#: Rows and bytes of an Arrow batch between the JVM and Python, for texts can be long.
ARROW_ROWS, ARROW_BYTES = 1000, "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark from whatever store holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; texts can be long. The session keeps the setting, for plans run after they are made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all executors share."""
    root = shared_folder(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage ends
    there, and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    # Shuffle files of what was just written go as soon as the driver's JVM sees
    # that nothing refers to them; without this they would wait for its next full collection.
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once what was made of them is written itself."""
    for t in tables:
        drop_path(t.sparkSession, t.shared_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path that ``shared_dir`` made."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def repeats(rows: DataFrame, id_col: str) -> bool:
    """Whether an id occurs twice; reads the ids alone."""
    return not rows.groupBy(id_col).count().where("count > 1").isEmpty()


class GenerationCache(dict):
    """A bounded memo: ``self[key]`` computes on a miss through ``make(key)``.

    Two generations bound the memory. Once ``limit`` young entries exist, they
    become the old generation and the former old one goes; an old entry that is
    used again moves back. Keys over ``longest`` characters are never stored.
    """

    def __init__(self, make, limit: int = 200_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's vocabulary file lies; see ``public_tokenizers``."""
    import public_tokenizers

    return public_tokenizers.path(name) if not os.path.isabs(name) else name
