"""Operator 5: language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over them, the maximum of
each filter over a window goes through a softmax layer. It is trained in numpy
on a bounded, documented sample of labelled rows; prediction runs over every
fixed-length window of every whole text, in batches, and averages the windows'
log-probabilities by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

UNDETERMINED = "und"


@dataclass(frozen=True)
class Shape:
    """The network's size and its training; all of it is fixed before data is seen."""

    window: int = 256  # bytes of a window
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8  # of each width
    embedding: int = 6
    epochs: int = 12
    batch: int = 64
    rate: float = 0.01
    seed: int = 7
    sample_docs: int = 4000  # labelled documents that training reads, all languages together
    least_docs: int = 20  # of each language, however many there are
    sample_windows: int = 4  # of each document, spread over the whole text


class ByteConvNet:
    """Embedding, convolutions, max pooling and softmax over byte windows."""

    def __init__(self, labels: list[str], shape: Shape):
        rng = np.random.default_rng(shape.seed)
        self.labels, self.shape = labels, shape
        self.wide = max(shape.widths)
        self.n = shape.filters * len(shape.widths)
        self.emb = rng.normal(0, 0.5, (shape.embedding, 256)).astype(np.float32)
        self.conv = rng.normal(0, 0.3, (self.n, self.wide, shape.embedding)).astype(np.float32)
        self.mask = np.zeros_like(self.conv)
        for k, w in enumerate(shape.widths):
            self.mask[k * shape.filters : (k + 1) * shape.filters, :w] = 1
        self.conv *= self.mask
        self.bias = np.zeros(self.n, np.float32)
        self.out = rng.normal(0, 0.1, (len(labels), self.n)).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def windows(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """All windows of a text, zero-padded, and the bytes each starts anew."""
        step = self.shape.window - self.wide + 1
        n = max(1, -(-(len(data) - self.wide + 1) // step))
        padded = np.zeros((n - 1) * step + self.shape.window, np.uint8)
        padded[: len(data)] = np.frombuffer(data, np.uint8)
        starts = np.arange(n) * step
        weight = np.minimum(len(data) - starts, step).astype(np.float64)
        return np.lib.stride_tricks.sliding_window_view(padded, self.shape.window)[starts], weight

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """Embedded bytes of each position's receptive field, one row per weight."""
        steps = x.shape[1] - self.wide + 1
        e = self.emb[:, x]  # embedding, window, byte
        cols = np.empty((self.wide, self.shape.embedding, x.shape[0], steps), np.float32)
        for k in range(self.wide):
            cols[k] = e[:, :, k : k + steps]
        return cols.reshape(self.wide * self.shape.embedding, -1)

    def _pooled(self, x: np.ndarray, where: bool = False):
        steps = x.shape[1] - self.wide + 1
        cols = self._columns(x)
        z = (self.conv.reshape(self.n, -1) @ cols).reshape(self.n, x.shape[0], steps)
        if not where:
            return np.maximum(z.max(axis=2) + self.bias[:, None], 0)
        at = z.argmax(axis=2)
        return np.maximum(np.take_along_axis(z, at[:, :, None], 2)[:, :, 0] + self.bias[:, None], 0), at, cols

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(window, label) of float32."""
        z = (self.out @ self._pooled(x) + self.out_bias[:, None]).T
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on the cross-entropy, in a fixed order of rows."""
        rng = np.random.default_rng(self.shape.seed + 1)
        names = ["emb", "conv", "bias", "out", "out_bias"]
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        d, t = self.shape.embedding, 0
        for _ in range(self.shape.epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), self.shape.batch):
                rows = order[a : a + self.shape.batch]
                xb, yb = x[rows], y[rows]
                b, steps = len(rows), xb.shape[1] - self.wide + 1
                h, at, cols = self._pooled(xb, where=True)
                z = (self.out @ h + self.out_bias[:, None]).T
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(b), yb] -= 1
                p /= b
                g = {"out": p.T @ h.T, "out_bias": p.sum(axis=0)}
                dh = (self.out.T @ p.T) * (h > 0)
                g["bias"] = dh.sum(axis=1)
                picked = cols.reshape(self.wide * d, b, steps)[:, np.arange(b)[None, :], at]  # weight, filter, window
                g["conv"] = (np.einsum("wfb,fb->fw", picked, dh).reshape(self.conv.shape)) * self.mask
                back = np.einsum("fkd,fb->kdfb", self.conv, dh)
                g["emb"] = np.zeros_like(self.emb)
                for k in range(self.wide):
                    seen = xb[np.arange(b)[None, :], at + k]  # filter, window
                    for j in range(d):
                        g["emb"][j] += np.bincount(seen.ravel(), back[k, j].ravel(), 256).astype(np.float32)
                t += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    move = self.shape.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - move).astype(np.float32))

    def predict(self, texts: list[str | None], block: int = 512) -> tuple[list[str], list[float]]:
        """Label and probability of each whole text, whatever stands beside it."""
        labels, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        held: list[np.ndarray] = []
        owners: list[tuple[int, np.ndarray]] = []
        for i, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):
                x, weight = self.windows(text.encode())
                held.append(x)
                owners.append((i, weight))
        if not held:
            return labels, scores
        counts = [len(x) for x in held]
        logs = np.empty((sum(counts), len(self.labels)), np.float64)
        done, pending, size = 0, [], 0
        for x in held:
            for a in range(0, len(x), block):
                part = x[a : a + block]
                if size + len(part) > block and pending:
                    logs[done : done + size] = self.log_probabilities(np.concatenate(pending))
                    done, pending, size = done + size, [], 0
                pending.append(part)
                size += len(part)
        if pending:
            logs[done : done + size] = self.log_probabilities(np.concatenate(pending))
        done = 0
        for (i, weight), n in zip(owners, counts):
            mean = (logs[done : done + n] * weight[:, None]).sum(axis=0) / weight.sum()
            done += n
            p = np.exp(mean - mean.max())
            p /= p.sum()
            best = int(p.argmax())
            labels[i], scores[i] = self.labels[best], float(p[best])
        return labels, scores


def train(labelled: DataFrame, text_col: str, lang_col: str, key: Column, shape: Shape = Shape()) -> ByteConvNet | None:
    """Fit the network on at most about ``sample_docs`` labelled rows.

    The sample takes an equal share of each language, by the hash of ``key`` (a null one
    counts as such), and ``least_docs`` at least; of each text ``sample_windows`` windows from all over it. Rows with a null
    text or label never take part. Every label can be learned. None if there's no such row.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key).alias("h"))
    counts = dict(rows.groupBy("lang").count().collect())  # a row a label, as many as the network has outputs
    labels = sorted(counts)
    if not labels:
        return None
    share = max(float(shape.least_docs), shape.sample_docs / len(labels))
    rates = labelled.sparkSession.createDataFrame([(k, min(1.0, share / n)) for k, n in counts.items()], "lang string, rate double")
    picked = rows.join(F.broadcast(rates), "lang").where(F.pmod("h", F.lit(1_000_000)) < F.col("rate") * 1_000_000).select("lang", "text", "h")
    small_batches(labelled.sparkSession)
    net = ByteConvNet(labels, shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for lang, text, h in zip(*(c.to_pylist() for c in batch.columns)):
                if any(map(str.isalpha, text)):
                    x, weight = net.windows(text.encode())
                    x = x[(weight >= shape.window // 4) | (np.arange(len(x)) == 0)]
                    for k in sorted({(2 * k + 1) * len(x) // (2 * shape.sample_windows) for k in range(shape.sample_windows)}):
                        for column, value in zip(out, (lang, x[k].tobytes(), h)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.binary(), pa.int64()))], ["lang", "x", "h"])

    most = 2 * int(share * len(labels)) * shape.sample_windows  # far more than the sample has
    got = picked.mapInArrow(run, "lang string, x binary, h long").orderBy("h", "lang", "x").limit(most).collect()
    if got and len(labels) > 1:
        at = {lang: k for k, lang in enumerate(labels)}
        net.fit(np.stack([np.frombuffer(r.x, np.uint8) for r in got]), np.array([at[r.lang] for r in got]))
    return net


def predict_language(docs: DataFrame, net: ByteConvNet | None, text_col: str = "text", label_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """Append the predicted language and its score to every row.

    Reads ``text_col`` alone. ``und`` with score 0 for a text that is null or
    has no letter, and for all texts if nothing could be learned. Rows with the
    same text get the same result, wherever they lie; columns of ``docs`` with
    the names of the results are replaced. A map over rows without a shuffle;
    the broadcast network is of fixed size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(label_as, score_as)
    at = docs.columns.index(text_col)
    model = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            labels, scores = net.predict(texts) if net else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, label_as, score_as])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(label_as, StringType()), StructField(score_as, DoubleType())])
    return docs.mapInArrow(run, schema)
