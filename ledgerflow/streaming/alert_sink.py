"""A sink of alert documents for streams: JSON lines in files that count once their batch is committed.

Tasks write files of their own, trying again with a wait that grows by the same step each time. When all tasks of a batch are done the
driver writes the batch's manifest, last and under the batch's number, and readers take the files that manifests name. So files of tasks that
ran twice, of batches that were given up and of batches that ran again are never read, and an alert is found once.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Lines of a file, so that a task holds a bounded part of what it writes.
LINES = 10_000


@dataclass
class Written(WriterCommitMessage):
    """The files of one task, and their lines."""

    files: list[str]
    lines: int


def tried(do: Callable[[], None], attempts: int, wait: float, sleep: Callable[[float], None] = time.sleep) -> None:
    """Up to ``attempts`` times; after the k-th failure it waits k times ``wait`` seconds. The last failure is raised."""
    for k in range(1, attempts + 1):
        try:
            return do()
        except OSError:
            if k == attempts:
                raise
            sleep(k * wait)


class AlertWriter(DataSourceStreamWriter):
    """Options: ``path`` (a URI that driver and executors share), ``attempts`` (3), ``wait`` (seconds, 0.5)."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.attempts, self.wait = int(options.get("attempts", 3)), float(options.get("wait", 0.5))

    def _write(self, name: str, text: str) -> None:
        def once() -> None:
            store, root = fs.FileSystem.from_uri(self.path)
            store.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
            with store.open_output_stream(f"{root}/{name}.part") as f:
                f.write(text.encode())
            store.move(f"{root}/{name}.part", f"{root}/{name}")

        tried(once, self.attempts, self.wait)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, lines, total = [], [], 0

        def flush() -> None:
            if lines:
                files.append(f"files/{uuid.uuid4().hex}.jsonl")
                self._write(files[-1], "".join(f"{x}\n" for x in lines))
                lines.clear()

        for row in iterator:
            lines.append(row[0])
            total += 1
            if len(lines) >= LINES:
                flush()
        flush()
        return Written(files, total)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        done = [m for m in messages if m is not None]
        self._write(f"manifests/{batchId}.json", json.dumps({"files": [f for m in done for f in m.files], "lines": sum(m.lines for m in done)}))

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            if store.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                store.delete_file(f"{root}/{name}")


class AlertLines(DataSource):
    """The format ``alert_lines``: streams of one string column, a JSON document a row."""

    @classmethod
    def name(cls) -> str:
        return "alert_lines"

    def schema(self) -> str:
        return "value string"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return AlertWriter(self.options)


def read_alert_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the documents of all committed batches under ``path``, which Spark reads."""
    named = spark.read.schema("files array<string>").json(f"{path}/manifests").selectExpr("explode(files) AS name")
    files = [f"{path}/{r.name}" for r in named.collect()]
    return spark.read.text(files) if files else spark.createDataFrame([], "value string")
