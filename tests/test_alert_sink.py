"""The sink of alert documents, with failures where a batch can be lost."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceStreamWriter

from ledgerflow.streaming import alert_sink


class FailsBeforeCommit(alert_sink.AlertWriter):
    def commit(self, messages, batchId):
        if batchId == 1 and not os.path.exists(self.path.removeprefix("file://") + "-failed"):
            open(self.path.removeprefix("file://") + "-failed", "w").close()
            raise RuntimeError("lost between the tasks and the commit")
        super().commit(messages, batchId)

    def abort(self, messages, batchId):
        """A driver that is lost removes nothing."""


class Failing(alert_sink.AlertLines):
    @classmethod
    def name(cls):
        return "failing_alert_lines"

    def streamWriter(self, schema, overwrite) -> DataSourceStreamWriter:
        return FailsBeforeCommit(self.options)


def test_each_alert_once_after_a_failure_before_the_commit(spark, tmp_path):
    spark.dataSource.register(Failing)
    path = f"file://{tmp_path}/alerts"

    def run():
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in" / "*"))
        lines = stream.select(F.to_json(F.struct(F.concat(F.lit("txn-"), "id").alias("alertId"))).alias("value"))
        q = lines.writeStream.format("failing_alert_lines").option("path", path).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()

    for k in range(3):
        spark.range(10 * k, 10 * k + 10, 1, 2).write.parquet(str(tmp_path / "in" / str(k)))
        if k == 1:
            with pytest.raises(Exception, match="between the tasks and the commit"):
                run()
            found = [json.loads(r.value)["alertId"] for r in alert_sink.read_alert_lines(spark, path).collect()]
            assert sorted(found) == sorted(f"txn-{i}" for i in range(10))
        run()
    found = [json.loads(r.value)["alertId"] for r in alert_sink.read_alert_lines(spark, path).collect()]
    assert sorted(found) == sorted(f"txn-{i}" for i in range(30))
    named = [f for m in (tmp_path / "alerts" / "manifests").glob("*.json") for f in json.loads(m.read_text())["files"]]
    assert len(list((tmp_path / "alerts" / "files").glob("*.jsonl"))) > len(named) > 2


def test_waits_grow_by_the_same_step():
    waits, left = [], [OSError("a"), OSError("b"), OSError("c")]

    def do():
        if left:
            raise left.pop()

    alert_sink.tried(do, 4, 0.5, waits.append)
    assert waits == [0.5, 1.0, 1.5]
    left[:] = [OSError("a"), OSError("b")]
    with pytest.raises(OSError):
        alert_sink.tried(do, 2, 1.0, waits.append)
    assert waits[3:] == [1.0]


def test_abort_removes_files_and_no_manifest_reads_as_nothing(spark, tmp_path):
    (tmp_path / "manifests").mkdir()
    writer = alert_sink.AlertWriter({"path": f"file://{tmp_path}"})
    message = writer.write(iter([("{}",)] * (alert_sink.LINES + 1)))
    assert message.lines == alert_sink.LINES + 1 and len(message.files) == 2
    writer.abort([message, None], 0)
    assert not list((tmp_path / "files").glob("*.jsonl"))
    writer.commit([writer.write(iter([])), None], 0)
    assert alert_sink.read_alert_lines(spark, f"file://{tmp_path}").count() == 0
