"""Operator 4: best-fit packing of tokenised documents into fixed sequences.

Each task packs its own rows by bounded-space online best-fit. A fixed number
of bins is open; a bitset has bit ``f`` set while some open bin has ``f`` free
tokens, so the tightest bin that fits is the lowest set bit from the piece's
length on. When a piece fits in none and all bins are open, the fullest (the
lowest set bit) closes first. State is bounded by the number of open bins.

Bins that are open when a task ends would stay part-empty, more of them the more tasks there are.
So the pieces of those bins, some hundreds a task, go through a second pass of the same best-fit over few tasks.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, vocabulary_path
from .pretokens import PieceEncoder
from .token_counts import _byte_letters, encode_match


#: White space at which the encoder by ranks may run out of its stack.
_LONG_RUN = re.compile(r"\s{1000}")
#: Pieces that a worker keeps of texts with such runs, and of files whose merges aren't ranked by ids.
PIECES = 200_000
#: Pieces that a task of the second pass takes at most.
REPACKED = 500_000


class BestFit:
    """Bounded-space online best-fit: ``place(length) -> (bin, offset)``.

    Bins are numbered in the order they open; a length must be 1 to ``capacity``.
    ``closed`` gathers the bins that take no more.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.free: dict[int, list[int]] = {}  # free space -> open bins
        self.bits = 0
        self.n_open = 0
        self.next = 0
        self.closed: list[int] = []

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            home = self._take(space)
        else:
            if self.n_open >= self.most:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))  # the fullest closes
                self.n_open -= 1
            home, space = self.next, self.capacity
            self.next += 1
            self.n_open += 1
        left = space - length
        if left:
            self.free.setdefault(left, []).append(home)
            self.bits |= 1 << left
        else:
            self.n_open -= 1
            self.closed.append(home)
        return home, self.capacity - space

    def _take(self, space: int) -> int:
        bins = self.free[space]
        home = bins.pop()
        if not bins:
            del self.free[space]
            self.bits ^= 1 << space
        return home


class _Ids:
    """Ids as the tokenizers library gives them, as packed 32-bit integers.

    Where the file's merges stand in the order of their ids, they are ranks, and an encoder by ranks gives the same ids several
    times as fast; special strings are cut out first, as the library does. Other files go through the library's own model.
    """

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        path = vocabulary_path(name)
        tokenizer, letters = Tokenizer.from_file(path), _byte_letters()
        word = lambda i: i.to_bytes(4, "little")
        special = {t.content: word(i) for i, t in tokenizer.get_added_tokens_decoder().items()}
        model = tokenizer.model
        self.encode = by_model = PieceEncoder(lambda m: b"".join(word(t.id) for t in encode_match(model, letters, m)), b"".join, special, limit=PIECES).encode
        ranks = _ranks(path, letters)
        if ranks is None:
            return
        import public_tokenizers
        import tiktoken

        encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        plain = lambda text: encoding.encode_to_numpy(text, disallowed_special=()).tobytes()
        cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

        def encode(text: str | None) -> bytes:
            if not text:
                return b""
            if _LONG_RUN.search(text):
                return by_model(text)
            if cut is None or not any(s in text for s in special):
                return plain(text)
            return b"".join(special[p] if p in special else plain(p) for p in cut.split(text) if p)

        self.encode = encode


def _ranks(path: str, letters: dict[int, int]) -> dict[bytes, int] | None:
    """Tokens' bytes with their ids, if these rank the merges; else none."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model = whole["model"]
    if whole.get("normalizer") or (whole.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or model.get("end_of_word_suffix"):
        return None
    vocabulary, back = model["vocab"], {chr(x): bytes([b]) for b, x in letters.items()}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [vocabulary[x] for x in merged]
    if any(a >= b for a, b in zip(ids, ids[1:])) or not back.keys() <= vocabulary.keys() or not all(set(x) <= back.keys() for x in merged):
        return None
    return {b"".join(back[c] for c in token): vocabulary[token] for token in [*back, *merged]}


@lru_cache(maxsize=1)
def _ids(name: str) -> _Ids:
    """One encoder a worker process: its caches serve all tasks that the worker runs."""
    return _Ids(name)


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of ``n`` tokens: one piece if it fits, else
    pieces of ``capacity`` tokens of which the first takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, open_bins: int = 512, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document is its ids, then ``end_id``; only one over ``capacity`` is cut.
    Returns per piece ``id_col``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset`` and, with ``keep_ids``, ``ids``.
    Null text counts as empty and packs its ``end_id`` alone. Repeated rows are
    packed each; an empty table gives no row. Sequence numbers hold the task in
    their upper bits, so tasks need no exchange. The first pass is written to the shared folder, for the second
    takes the pieces of bins left open, ``REPACKED`` of them a task at most; no text is shuffled, and a task
    that runs again gives the same rows for the same input.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")
    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"] + ["ids"] * keep_ids
    types = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = _ids(vocabulary).encode, BestFit(capacity, open_bins)
        held: dict[int, list[list]] = {}  # rows of open bins
        base = key_type = None

        def made(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(range(len(names)), [key_type, *types[1:]])], names)

        for batch in batches:
            if base is None and batch.num_rows:
                base, key_type = batch.column(2)[0].as_py() << 33, batch.schema.field(0).type
            done: list[list] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    home, offset = bins.place(length)
                    row = [key, k, start, length, crc32(part), base + home, offset, False]
                    held.setdefault(home, []).append(row + [array("I", part).tolist()] * keep_ids)
                for home in bins.closed:
                    done += held.pop(home)
                bins.closed.clear()
            if done:
                yield made(done)
        if held:
            yield made([r[:7] + [True] + r[8:] for rows in held.values() for r in rows])

    columns = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ids = ", ids array<int>" * keep_ids
    first = docs.select(docs[id_col], docs[text_col], F.spark_partition_id().cast("long").alias("_task")).mapInArrow(run, f"{columns}, open boolean{ids}")
    first = materialise(first, "packed")
    left = first.where("open").drop("open")
    tasks = max(1, -(-left.count() // REPACKED))
    return first.where("NOT open").drop("open").unionByName(_repacked(left.repartition(tasks), capacity, open_bins))


def _repacked(pieces: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    """The second pass: new sequences and offsets of ``pieces``, by their lengths."""
    at = pieces.columns.index("length"), pieces.columns.index("sequence_id"), pieces.columns.index("offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(capacity, open_bins), None
        for batch in batches:
            if base is None and batch.num_rows:
                base = (1 << 62) + (batch.column(batch.num_columns - 1)[0].as_py() << 33)
            places = [bins.place(n) for n in batch.column(at[0]).to_pylist()]
            bins.closed.clear()
            columns = dict(enumerate(batch.columns[:-1]))
            columns[at[1]] = pa.array([base + home for home, _ in places], pa.int64())
            columns[at[2]] = pa.array([offset for _, offset in places], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), batch.schema.names[:-1])

    return pieces.withColumn("_task", F.spark_partition_id().cast("long")).mapInArrow(run, pieces.schema)
