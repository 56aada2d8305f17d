"""Streaming: the batch plans over keyed state, one micro-batch at a time.

Two queries follow each other. The first stamps late transfers with the clock and writes them once, batch by batch. The second keeps
account histories as keyed state (``keyed``) and runs the batch engine's plans over what that state hands on for the accounts that
a batch touches. Its work grows with the batch and those accounts' histories; of the window as a whole it reads only the narrow rows that
it has written (for cycles, and the first-stage scores of neighbours) and the edges that link rings. Nothing of the window is written again.

Results are written per batch, and a batch that Spark repeats after a failure starts from the state before it and overwrites
what it wrote, so results count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import features, rings
from ..operators.adjacency import TOTALS
from ..plans import alerts as alert_plan
from ..plans.models import Model
from ..schema import FEATURES, Config
from ..sources.transfers import clamp_event_time
from ..storage import scratch, written
from . import keyed

_EDGE = ("seq", "m", "src", "dst")
_ENTRY = ("acct", "dir", "peer", "seq", "m", "amount", "ach")
#: Keyed state of this kind is held on local disk, not in memory, and uploaded by its changes.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Replay:
    """Scores a stream of canonical transfers (with ``m_raw``).

    Writes features to ``out/<batch>`` and, with a ``model`` and the ``stage1`` models that its neighbour features need, scores to
    ``scores/<batch>`` and alert documents to ``alerts/<batch>``. Late transfers are stamped with the clock, never dropped.
    """

    def __init__(self, spark: SparkSession, path: str, cfg: Config = Config(), model: Model | None = None, stage1: tuple[Model, ...] = ()):
        self.spark, self.path, self.cfg, self.model, self.stage1 = spark, path.rstrip("/"), cfg, model, stage1
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read(self, what: str, batch_id: int) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/state/{batch_id}/{what}") if batch_id >= 0 else None

    def _write(self, df: DataFrame, what: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{what.format(batch_id)}")

    def stamp(self, batch: DataFrame, batch_id: int) -> None:
        """Write the batch with its minutes ``m`` to ``stamped/<batch>``, whole and once: a repeated batch finds it there."""
        fs, done = self._fs(f"{self.path}/stamped/{batch_id}")
        if fs.exists(done):
            return
        fs.mkdirs(done.getParent())
        at = self.spark.read.parquet(f"{self.path}/clock/{batch_id - 1}").first() if batch_id else None
        clock = at.clock if at else None
        late = batch.drop("m").withColumn("_raw", F.col("m_raw")).withColumn("m_raw", F.greatest("m_raw", F.lit(clock).cast("long")))  # greatest skips nulls
        staged = f"{self.path}/stamping/{batch_id}"
        clamp_event_time(late).withColumn("m_raw", F.col("_raw")).drop("_raw").write.mode("overwrite").parquet(staged)
        now = self.spark.read.parquet(staged).agg(F.max("m")).first()[0]
        self._write(self.spark.createDataFrame([(clock if now is None else now,)], "clock long"), "clock/{}", batch_id)
        fs.rename(self._fs(staged)[1], done)

    def process(self, rows: DataFrame, batch_id: int) -> None:
        """The results of one batch of ``keyed.histories``."""
        with scratch():
            self._process(written(rows, "keyed"), batch_id)

    def _process(self, rows: DataFrame, batch_id: int) -> None:
        cfg, ago = self.cfg, batch_id - 1
        at = self._read("clock", ago)
        at = at.first() if at is not None else None
        clock, epoch, held = (at.clock, at.epoch, at.held) if at else (None, None, [])
        batch = rows.where(F.col("kind") == keyed.NEW).where("dir <> 'I'").select("transfer.*").withColumn("s1", F.lit(None).cast("double"))
        begin, now = batch.agg(F.min("m"), F.max("m")).first()
        if now is None:  # no transfer: what fell out of state leaves no result
            self._keep_on(ago, batch_id)
            return
        entries = rows.where(F.col("kind").isin(keyed.KEPT, keyed.NEW)).select(*_ENTRY)
        before, sent = rows.where(F.col("kind") == keyed.TOTAL).select("acct", *TOTALS), rows.where(F.col("kind") == keyed.SENT)
        window = [h for h in held if h.upto >= begin - cfg.window]
        older = self.spark.read.schema(batch.schema).parquet(*(f"{self.path}/rows/{h.batch}" for h in window)) if window else batch.where("false")
        with_state = lambda what, new: new if ago < 0 else self._read(what, ago).unionByName(new)
        asked = batch.select("seq")
        values = features.graph_values(older.unionByName(batch), cfg, self.model is not None, asked, before, entries, sent)
        spans = rings.epochs(batch, cfg, epoch)
        linked = with_state("linked", batch.join(rings.linking(features.hit_flags(values, cfg), cfg), "seq", "left_semi").select(*_EDGE))
        found = written(features.base_features(batch, cfg, values, rings.running_rings(batch, linked, spans, cfg)), "found")
        self._write(found, "out/{}", batch_id)
        alerted = with_state("alerted", batch.where("false").select(*_EDGE))
        if self.model is not None:
            staged = batch.drop("s1").join(found, "seq")
            first = sum((m.score() for m in self.stage1), F.lit(0.0)) / max(1, len(self.stage1))
            batch = written(staged.withColumn("s1", first).select(*batch.columns), "batch")
            known = older.select("seq", "s1").unionByName(batch.select("seq", "s1"))
            near = features.neighbour_features(None, cfg, entries.join(known, "seq")).join(asked, "seq", "left_semi")
            full = staged.join(near, "seq", "left").fillna(0.0, subset=list(FEATURES[30:]))
            scored = written(full.withColumn("score", self.model.score()), "scored")
            self._write(scored.select("seq", "score"), "scores/{}", batch_id)
            alerted = with_state("alerted", scored.where(F.col("score") >= self.model.threshold).where("src <> dst").select(*_EDGE))
            circle = rings.running_rings(batch, alerted, spans, cfg, members=True)
            self._write(alert_plan.alerts(older.unionByName(batch), scored, self.model, cfg, values, circle), "alerts/{}", batch_id)
        self._write(batch, "rows/{}", batch_id)
        epoch = spans[-1][0] if spans else epoch
        recent = F.coalesce(F.col("m") >= F.lit(epoch).cast("long") - cfg.window, F.lit(True))
        self._write(linked.where(recent), f"state/{batch_id}/linked", batch_id)
        self._write(alerted.where(recent), f"state/{batch_id}/alerted", batch_id)
        self._tell(batch_id, now, epoch, [*((h.batch, h.upto) for h in window), (batch_id, now)])
        # A repeat of this batch still reads what the one before it named.
        named = {h.batch for h in window} | {batch_id}
        self._forget(*(f"rows/{h.batch}" for h in (self._read("clock", ago - 1).first().held if ago > 0 else []) if h.batch not in named | {h.batch for h in held}), f"state/{batch_id - 2}")

    def _tell(self, batch_id: int, clock: int | None, epoch: int | None, held: list[tuple[int, int]]) -> None:
        """The clock, written last: the batches whose rows the next one may read, with their last minutes."""
        self._write(self.spark.createDataFrame([(clock, epoch, held)], "clock long, epoch long, held array<struct<batch: long, upto: long>>"), f"state/{batch_id}/clock", batch_id)

    def _keep_on(self, ago: int, batch_id: int) -> None:
        """A batch without a transfer hands the state before it on."""
        for what in ("linked", "alerted"):
            if ago >= 0:
                self._write(self._read(what, ago), f"state/{batch_id}/{what}", batch_id)
        at = self._read("clock", ago).first() if ago >= 0 else None
        self._tell(batch_id, *((at.clock, at.epoch, [tuple(h) for h in at.held]) if at else (None, None, [])))

    def _forget(self, *paths: str) -> None:
        """Delete what no batch can read any more."""
        for path in paths:
            fs, p = self._fs(f"{self.path}/{path}")
            fs.delete(p, True)

    def start(self, stream: DataFrame, **options):
        """Stamp the stream, then score it: with a trigger that ends, one after the other, else both at once. The running query of
        scores; checkpoints lie beside the results."""
        trigger = options or {"availableNow": True}
        run = lambda df, each, name: df.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.path}/checkpoint/{name}").trigger(**trigger).start()
        fs, stamped = self._fs(f"{self.path}/stamped")
        fs.mkdirs(stamped)
        first = run(stream, self.stamp, "stamp")
        if "availableNow" in trigger or "once" in trigger:
            first.awaitTermination()
        schema = T.StructType([f for f in stream.schema.fields if f.name != "m"]).add("m", T.LongType())
        return run(keyed.histories(self.spark.readStream.schema(schema).parquet(f"{self.path}/stamped/*"), self.cfg), self.process, "keyed")
