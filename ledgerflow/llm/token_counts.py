"""Operator 7: token counts by a map-side two-tier lookup.

A bounded sample of rows (``sample_rows``, read by ``SAMPLE_TASKS`` tasks) gives the frequent
pre-tokens: each task counts in a bounded summary, the driver adds up and keeps ``table_size`` of them,
whose lengths it encodes and broadcasts as one compact table. All rows are then mapped: the length of a pre-token
comes from that table, another is encoded once by each worker and kept in its
bounded cache; a memo of space-led pieces before both saves splitting a piece again. Table and sample only save time; they
never change a count, and no pre-token of the corpus is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import GenerationCache, small_batches, vocabulary_path
from .pretokens import PieceEncoder

#: Pre-tokens over this length never enter the table: they bound its bytes.
LONGEST = 32
#: Tasks that count the sample; each gives ``per_task`` rows to the driver at most.
SAMPLE_TASKS = 8


class _Counter:
    """Counts by the tokenizers library's own merges, one match at a time."""

    def __init__(self, name: str, frequent: dict[str, int]):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self._model = self._tokenizer.model
        special = {t.content: 1 for t in self._tokenizer.get_added_tokens_decoder().values()}
        self._bytes = _byte_letters()
        self._pieces = PieceEncoder(lambda match: len(encode_match(self._model, self._bytes, match)), sum, special)
        self._pieces.matches = _TwoTier(self._pieces.matches, frequent)

    def length(self, match: str) -> int:
        return self._pieces.matches[match]

    def count(self, text: str | None) -> int:
        return self._pieces.encode(text)


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, each other
    byte for the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(rest)}


def encode_match(model, letters: dict[int, int], match: str):
    """Tokens of one match by the library's model."""
    return model.tokenize(match.encode().decode("latin-1").translate(letters))


def frequent_pretokens(texts: DataFrame, table_size: int, per_task: int, sample_rows: int) -> list[str]:
    """The heaviest pre-tokens of the sample, ``table_size`` at most.

    A task keeps a Misra-Gries summary of ``8 * per_task`` counters and gives
    the ``per_task`` heaviest, so its memory and its output are bounded.
    """
    rows = texts.count()
    sample = texts if rows <= sample_rows else texts.sample(sample_rows / rows, seed=11)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex

        find, held = regex.compile(public_tokenizers.PATTERN).findall, Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(find(text.as_py() or ""))
                if len(held) > 64 * per_task:
                    floor = sorted(held.values(), reverse=True)[8 * per_task]
                    held = Counter({k: v - floor for k, v in held.items() if v > floor})
        top = [(k, v) for k, v in held.most_common(per_task) if len(k) <= LONGEST and "\n" not in k]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([v for _, v in top], pa.int64())], ["piece", "n"])

    held: Counter = Counter()
    for r in sample.repartition(SAMPLE_TASKS).mapInArrow(summarise, "piece string, n long").collect():
        held[r.piece] += r.n
    return [k for k, _ in sorted(held.items(), key=lambda x: (-x[1], x[0]))[:table_size]]


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text", table_size: int = 16_384, per_task: int = 8192, sample_rows: int = 4000
) -> DataFrame:
    """Count the tokens of every whole text, one row per input row.

    Returns ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``
    (``n_tokens > limit``). Null text counts as empty: 0, 0 and false. Repeated
    rows give repeated results, an empty table none; no other column is read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col], docs[text_col])
    frequent = frequent_pretokens(docs.select(docs[text_col]), table_size, per_task, sample_rows)
    counter = _Counter(vocabulary, {})
    lengths = [counter.length(m) for m in frequent]
    compact = docs.sparkSession.sparkContext.broadcast(("\n".join(frequent), lengths))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers = compact.value
        counter = _Counter(vocabulary, dict(zip(names.split("\n"), numbers)) if numbers else {})
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


class _TwoTier(dict):
    """The broadcast table first; what it lacks goes to the worker's cache."""

    def __init__(self, cache: GenerationCache, frequent: dict[str, int]):
        super().__init__(frequent)
        self._cache = cache

    def __missing__(self, match: str) -> int:
        return self._cache[match]
