"""Operator 12: texts scored by a log-bilinear neural language model, trained by noise-contrastive estimation.

The model predicts a token's class from the classes before it: their vectors, weighted by position and added up, meet
each class's output vector. The most frequent words are classes of their own; the other words share classes by their first bytes, and
within such a class a word has its smoothed share of the training counts. So every word that there can be has a
probability, and these add up to one.

Training passes over every training document. A round deals its part of them over tasks; each goes through its texts in mini-batches from the last round's
parameters, with noise words in place of a sum over all classes, and what the tasks come to is averaged by their
tokens. Scoring uses the full sum over classes, by batched matrix products: for every context that there can be where a
table of these sums is small (once, spread over tasks), else for the different contexts of a stretch of text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches

#: Tokens of a stretch that is trained on or scored at once, and contexts of a matrix product: both bound a task's memory.
STRETCH, CONTEXTS = 1 << 18, 2048
#: Contexts of which a table of sums is made: 16 MB.
TABLE = 1 << 22
#: Different words that a counting task holds before it hands them on.
COUNTED = 300_000
#: The key of the end token in tables of words: no word is empty.
END = b""


@dataclass(frozen=True)
class Shape:
    """Sizes of the model and of its training; none depends on the corpus."""

    words: int = 767  # that are classes of their own
    buckets: int = 256  # classes of all other words
    prefix: int = 3  # bytes that decide on them
    dim: int = 16
    context: int = 2
    noise: int = 64  # words that a mini-batch is contrasted with
    batch: int = 512
    rounds: int = 3  # parts of the corpus; parameters are averaged after each
    rate: float = 0.1
    seed: int = 12
    known: int = 200_000  # words whose counts every task holds, of
    longest: int = 64  # bytes at most


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased in A-Z, split at white space: ASCII's, as both methods do on bytes."""
    return text.lower().split() if text else []


def bucket(word: bytes, shape: Shape) -> int:
    return zlib.crc32(word[: shape.prefix]) % shape.buckets


class LogBilinear:
    """Parameters: context and output vectors of the classes, weights by position, biases."""

    def __init__(self, counts: np.ndarray, shape: Shape):
        rng = np.random.default_rng(shape.seed)
        k, d = len(counts), shape.dim
        self.shape = shape
        share = (counts + 1.0) / (counts + 1.0).sum()
        self.log_noise, self.upto = np.log(share).astype(np.float32), np.cumsum(share)
        self.seen = rng.normal(0, 0.1, (k, d)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (k, d)).astype(np.float32)
        self.at = np.full((shape.context, d), 1 / shape.context, np.float32)
        self.bias = self.log_noise.copy()
        #: The logarithms of all contexts' sums over classes, by ``code``.
        self.totals: np.ndarray | None = None

    def table(self) -> np.ndarray:
        """All parameters, one row of ``dim`` + 1 for each class and position."""
        k = len(self.bias)
        full = np.zeros((2 * k + len(self.at), self.shape.dim + 1), np.float64)
        full[:k, :-1], full[k : 2 * k, :-1], full[2 * k :, :-1] = self.seen, self.out, self.at
        full[k : 2 * k, -1] = self.bias
        return full

    def take(self, full: np.ndarray) -> None:
        k = len(self.bias)
        self.seen, self.out, self.at = (full[a:b, :-1].astype(np.float32) for a, b in ((0, k), (k, 2 * k), (2 * k, None)))
        self.bias = full[k : 2 * k, -1].astype(np.float32)

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return sum(self.at[i] * self.seen[before[:, i]] for i in range(self.shape.context))

    def code(self, before: np.ndarray) -> np.ndarray:
        """A number for each context (classes, nearest first)."""
        return before @ (len(self.bias) ** np.arange(self.shape.context))

    def log_totals(self, code: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over all classes after the contexts of these numbers."""
        before = code[:, None] // (len(self.bias) ** np.arange(self.shape.context)) % len(self.bias)
        total = np.empty(len(code), np.float32)
        for a in range(0, len(code), CONTEXTS):
            scores = self.predicted(before[a : a + CONTEXTS]) @ self.out.T
            scores += self.bias
            top = scores.max(axis=1, keepdims=True)
            scores -= top
            total[a : a + CONTEXTS] = np.log(np.exp(scores, out=scores).sum(axis=1)) + top[:, 0]
        return total

    def log_probabilities(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural logarithms of the classes' probabilities after the classes ``before`` (nearest first)."""
        code = self.code(before)
        if self.totals is not None:
            total = self.totals[code]
        else:
            codes, of = np.unique(code, return_inverse=True)
            total = self.log_totals(codes)[of]
        return np.einsum("nd,nd->n", self.predicted(before), self.out[token]) + self.bias[token] - total


class Trainer:
    """Noise-contrastive steps on one task's tokens, scaled by each parameter's past gradients."""

    def __init__(self, model: LogBilinear, seed: int):
        self.m, self.rng, self.tokens = model, np.random.default_rng([model.shape.seed, seed]), 0
        self.past = [np.ones_like(x) for x in (model.seen, model.out, model.at, model.bias)]

    def learn(self, before: np.ndarray, token: np.ndarray) -> None:
        size = self.m.shape.batch
        order = self.rng.permutation(len(token))
        for a in range(0, len(order), size):
            self._step(before[order[a : a + size]], token[order[a : a + size]])
        self.tokens += len(token)

    def _step(self, before: np.ndarray, token: np.ndarray) -> None:
        m, n = self.m, self.m.shape.noise
        noise = np.minimum(np.searchsorted(m.upto, self.rng.random(n)), len(m.bias) - 1)
        q = m.predicted(before)
        out, far = m.out[token], m.out[noise]
        lift = np.float32(np.log(n))
        true = _sigmoid(-(np.einsum("nd,nd->n", q, out) + m.bias[token] - m.log_noise[token] - lift))
        false = -_sigmoid(q @ far.T + (m.bias[noise] - m.log_noise[noise] - lift))
        back = true[:, None] * out + false @ far
        d_out, d_bias = _gathered(token, true[:, None] * q, m.out.shape), np.bincount(token, true, len(m.bias)).astype(np.float32)
        np.add.at(d_out, noise, false.T @ q)
        np.add.at(d_bias, noise, false.sum(axis=0))
        d_seen, d_at = np.zeros_like(m.seen), np.zeros_like(m.at)
        for i in range(m.shape.context):
            d_seen += _gathered(before[:, i], back * m.at[i], m.seen.shape)
            d_at[i] = (back * m.seen[before[:, i]]).sum(axis=0)
        for x, g, past in zip((m.seen, m.out, m.at, m.bias), (d_seen, d_out, d_at, d_bias), self.past):
            past += g * g
            x += m.shape.rate * g / np.sqrt(past)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gathered(at: np.ndarray, rows: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Rows added up by their place."""
    flat = (at[:, None] * shape[1] + np.arange(shape[1])).ravel()
    return np.bincount(flat, rows.ravel(), shape[0] * shape[1]).reshape(shape).astype(np.float32)


def stretches(texts: list[np.ndarray], context: int, most: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts' numbers, classes before, classes) of all tokens, a bounded number at a time; before a text there are ends."""
    parts: list[tuple[int, np.ndarray, np.ndarray]] = []
    held = 0
    for number, ids in enumerate(texts):
        padded = np.concatenate([np.zeros(context, ids.dtype), ids])
        for a in range(0, len(ids), most):
            part = padded[a : a + most + context]
            if parts and held + len(part) - context > most:
                yield _joined(parts, context)
                parts, held = [], 0
            parts.append((number, part[:context], part[context:]))
            held += len(part) - context
    if parts:
        yield _joined(parts, context)


def _joined(parts: list[tuple[int, np.ndarray, np.ndarray]], context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(ids) for _, _, ids in parts])
    stream = np.concatenate([x for _, lead, ids in parts for x in (lead, ids)]).astype(np.intp)
    place = np.arange(sizes.sum()) + context * np.repeat(np.arange(1, len(parts) + 1), sizes)
    return np.repeat([n for n, _, _ in parts], sizes), np.stack([stream[place - 1 - i] for i in range(context)], axis=1), stream[place]


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``word`` (binary), ``n``: the tokens of all texts, the end as an empty word. A task hands on sums of what it has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(words(text.as_py()))
                counts[END] += 1
                if len(counts) > COUNTED:
                    yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})
                    counts.clear()
        if counts:
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": list(counts.values())})

    some = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, shape: Shape) -> list[tuple[bytes, int]]:
    """(word, n), the most frequent first, equals by bytes: at most ``known``, ``words`` at least where there are as many.

    Bounded twice: by their number, for a table of few levels of frequency says where to cut, and by their length.
    """
    short = counts.where(F.length("word") <= shape.longest).withColumn("level", F.floor(16 * F.log2("n")))
    cut, held = None, 0
    for r in sorted(short.groupBy("level").count().collect(), reverse=True):
        if (held := held + r["count"]) > shape.known:
            break
        cut = r["level"]
    found = short.where(F.col("level") >= cut).collect() if cut is not None else []
    if (missing := min(shape.words, shape.known) - len(found)) > 0:
        rest = short if cut is None else short.where(F.col("level") < cut)
        found += rest.orderBy(F.desc("n"), "word").limit(missing).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in found), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """What every task holds of the corpus: the frequent words' counts, the classes' counts. Bounded by the shape."""

    def __init__(self, frequent: list[tuple[bytes, int]], ends: int, buckets: dict[int, tuple[int, int]], shape: Shape):
        own = frequent[: shape.words]
        tokens, kinds = np.zeros(shape.buckets, np.int64), np.zeros(shape.buckets, np.int64)
        for b, (n, v) in buckets.items():
            tokens[b], kinds[b] = n, v
        for w, n in own:
            tokens[bucket(w, shape)] -= n
            kinds[bucket(w, shape)] -= 1
        self.shape, self.first_bucket = shape, 1 + len(own)
        self.place = {w: i for i, (w, _) in enumerate(frequent)}
        self.log_count = np.log10(np.array([n for _, n in frequent], np.float64) + 1)
        self.cls = np.array([1 + i if i < len(own) else self.first_bucket + bucket(w, shape) for i, (w, _) in enumerate(frequent)], np.uint16)
        self.counts = np.concatenate([[ends], [n for _, n in own], tokens]).astype(np.int64)
        #: What a word's share of its class is divided by.
        self.log_size = np.concatenate([np.zeros(self.first_bucket), np.log10(tokens + kinds + 1.0)])


_ENCODED = "row long, doc_id long, held_out boolean, ids binary, known long, counted double, shared double, misses array<struct<word: binary, n: long>>"


def _encoder(shared, ends: int):
    """Texts as classes (unsigned 16-bit), with what frequent words say of their scores and the other words to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        log_ends = float(np.log10(ends + 1))
        for batch in batches:
            split = [words(t.as_py()) for t in batch["text"]]
            sizes = np.array([len(w) for w in split], np.int64)
            text = np.repeat(np.arange(len(split)), sizes)
            place = np.fromiter(map(v.place.get, chain.from_iterable(split), repeat(-1)), np.int32, int(sizes.sum()))
            cls, found = np.zeros(len(place), np.uint16), place >= 0
            cls[found] = v.cls[place[found]]
            missed: dict[int, Counter] = {}
            begin = np.cumsum(sizes) - sizes
            for k in np.flatnonzero(~found).tolist():
                d = int(text[k])
                w = split[d][k - begin[d]]
                cls[k] = v.first_bucket + bucket(w, v.shape)
                missed.setdefault(d, Counter())[w] += 1
            log_count = np.zeros(len(place))
            log_count[found] = v.log_count[place[found]]
            rare = cls >= v.first_bucket
            per_text = lambda x: np.bincount(text, x, len(split))
            ids = [np.append(x, np.uint16(0)).tobytes() for x in np.split(cls, np.cumsum(sizes)[:-1])] if split else []
            flat = [(w, n) for d in sorted(missed) for w, n in missed[d].items()]
            offsets = np.concatenate([[0], np.cumsum([len(missed.get(d, ())) for d in range(len(split))])]).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array([w for w, _ in flat], pa.binary()), pa.array([n for _, n in flat], pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["row"], batch["doc_id"], batch["held_out"], pa.array(ids, pa.binary()), pa.array((per_text(found) + (ends > 0)).astype(np.int64)),
                    pa.array(per_text(log_count) + log_ends), pa.array(per_text(np.where(rare, log_count - v.log_size[cls], 0.0))), pa.ListArray.from_arrays(offsets, entries),
                ],
                ["row", "doc_id", "held_out", "ids", "known", "counted", "shared", "misses"],
            )

    return run


def _classes(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint16) for x in batch["ids"]]


def train(encoded: DataFrame, counts: np.ndarray, shape: Shape = Shape()) -> LogBilinear:
    """The model after ``rounds`` parts of all training texts (``ids``), each text in one of them.

    A task starts from the parameters so far and gives its own back once, as sums weighted by its tokens: a table
    of as many rows as there are parameters' vectors for a task, whatever it reads.
    """
    model = LogBilinear(counts, shape)
    columns = [f"p{i}" for i in range(shape.dim + 1)]
    for n in range(shape.rounds):

        def run(batches: Iterator[pa.RecordBatch], model=model, n=n) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(model, n)
            for batch in batches:
                for _, before, token in stretches(_classes(batch), shape.context):
                    trainer.learn(before, token)
            if trainer.tokens:
                full = model.table() * trainer.tokens
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(full)), pa.int64()), pa.array(np.full(len(full), trainer.tokens), pa.int64()), *map(pa.array, full.T.copy())], ["at", "tokens", *columns])

        part = encoded.where(~F.col("held_out")).where(F.pmod(F.xxhash64("row"), F.lit(shape.rounds)) == n).select("ids")
        came = part.mapInArrow(run, "at long, tokens long, " + ", ".join(f"{c} double" for c in columns))
        mean = came.groupBy("at").agg(*((F.sum(c) / F.sum("tokens")).alias(c) for c in columns)).orderBy("at").collect()
        if mean:
            model.take(np.array([[r[c] for c in columns] for r in mean]))
    return model


def tabulate(spark: SparkSession, model: LogBilinear) -> None:
    """Gives the model its table of sums if that has at most ``TABLE`` entries; tasks make a part each."""
    n = len(model.bias) ** model.shape.context
    if n <= TABLE:
        step = max(1, n // 64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in batch["id"].to_pylist():
                    totals = model.log_totals(np.arange(begin, min(begin + step, n)))
                    yield pa.RecordBatch.from_pydict({"id": [begin], "totals": [totals.tobytes()]})

        parts = spark.range(0, n, step).mapInArrow(run, "id long, totals binary").collect()
        model.totals = np.concatenate([np.frombuffer(r["totals"], np.float32) for r in sorted(parts)])


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LogBilinear = shared.value
        for batch in batches:
            texts = _classes(batch)
            total = np.zeros(len(texts))
            for text, before, token in stretches(texts, model.shape.context):
                total += np.bincount(text, model.log_probabilities(before, token), len(texts))
            own = {"n_tokens": pa.array([len(t) for t in texts], pa.int64()), "modelled": pa.array(total / np.log(10))}
            keep = ["row", "doc_id", "held_out", "known", "counted", "shared"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *own.values()], [*keep, *own])

    return run


def score_texts(docs: DataFrame, is_held_out: Column, shape: Shape = Shape(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each text's log10 probability under the model, and under add-one smoothed counts of single tokens.

    Both learn from all texts that aren't held out (null: not held out). Tokens are a text's words, lower-cased in A-Z, and one end. Returns
    ``doc_id``, ``held_out``, ``n_tokens``, ``n_known`` (tokens that occur in training), ``train_tokens``, ``base_score``, ``score``.

    A null or empty text is its end alone. A text of any length is scored whole. Rows that repeat, in any column, count each; a null id stays one. A
    word of the held-out texts that training hasn't got has the share of one more word in its class. Words equally
    frequent are ordered by their bytes. Without a training text the base is 0 and the model one of random vectors. Other columns don't matter. An empty table gives no row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(is_held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    counts = materialise(word_counts(source.where(~F.col("held_out")), "text"), "lm-counts")
    sizes = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("kinds"), F.sum(F.when(F.length("word") == 0, F.col("n"))).alias("ends")).first()
    tokens, kinds, ends = sizes["tokens"] or 0, sizes["kinds"], sizes["ends"] or 0
    single = counts.where(F.length("word") > 0)
    by_bucket = single.groupBy(F.pmod(F.crc32(F.substring("word", 1, shape.prefix)), F.lit(shape.buckets)).cast("int").alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    vocabulary = Vocabulary(frequent_words(single, shape), ends, {r["b"]: (r["n"], r["v"]) for r in by_bucket}, shape)
    shared = spark.sparkContext.broadcast(vocabulary)
    encoded = materialise(source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_encoder(shared, ends), _ENCODED), "lm-texts")

    model = train(encoded, vocabulary.counts, shape)
    tabulate(spark, model)
    model = spark.sparkContext.broadcast(model)
    whole = encoded.select("row", "doc_id", "held_out", "known", "counted", "shared", "ids").mapInArrow(_scorer(model), "row long, doc_id long, held_out boolean, known long, counted double, shared double, n_tokens long, modelled double")
    # Words outside the tasks' table: what isn't in training adds nothing to a sum of counts.
    missed = encoded.select("row", F.explode("misses").alias("m")).select("row", "m.word", F.col("m.n").alias("times"))
    more = missed.join(counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"))
    both = whole.join(more, "row", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    scored = both.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("counted") + F.col("more") - F.col("n_tokens") * F.log10(F.lit(float(tokens + kinds + 1)))).alias("base_score"), (F.col("modelled") + F.col("shared") + F.col("more")).alias("score"),
    )
    out = materialise(scored, "lm-scores")
    discard(counts, encoded)
    return out
