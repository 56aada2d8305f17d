"""Operator 1: byte-level BPE encoding and decoding.

A pre-token's byte positions are the leaves of a segment tree. Leaf ``i`` holds
the rank of the pair that starts at the live token at byte ``i``; an inner node
holds the least rank of its ``FAN`` children, and the first child that holds it leads down, so that the root
gives the leftmost pair of least rank. A merge changes three leaves at most
(the merged token, its left neighbour, the position that died), each a
logarithmic point update: n bytes take O(n log n), however long the pre-token. A node's least child is found
by ``min`` over a slice, so the usual pre-token, of ``FAN`` bytes or fewer, is a root over its leaves.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, vocabulary_path
from .pretokens import PieceEncoder

#: Stands for "no pair here"; above every rank.
_NONE = 1 << 60
#: Pieces that a worker keeps, of two generations each.
PIECES = 400_000
#: Children of an inner node.
FAN = 32


def load_ranks(name: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: each line is a base64 token and its rank."""
    with open(vocabulary_path(name), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class MergeTree:
    """Encodes single pre-tokens by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one pre-token; empty input has none."""
        ranks, n = self.ranks, len(word)
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        if n == 0:
            return []
        get = ranks.get
        leaves = [get(word[i : i + 2], _NONE) for i in range(n - 1)]
        leaves.append(_NONE)
        levels = [leaves]
        while len(levels[-1]) > FAN:
            low = levels[-1]
            levels.append([min(low[k : k + FAN]) for k in range(0, len(low), FAN)])
        top, inner = levels[-1], levels[-2::-1]
        after = list(range(1, n + 1))  # where the token that starts here ends
        before = list(range(-1, n - 1))  # where the token before this one starts
        while (least := min(top)) < _NONE:
            i = top.index(least)
            for level in inner:  # the leftmost leaf that holds the least rank
                i = level.index(least, FAN * i)
            dead = after[i]
            after[i] = end = after[dead]
            leaves[dead] = _NONE
            if end < n:
                before[end] = i
                leaves[i] = get(word[i : after[end]], _NONE)
            else:
                leaves[i] = _NONE
            p = before[i]
            if i:
                leaves[p] = get(word[p:end], _NONE)
            if inner:
                for leaf in (dead, i, p) if i else (dead, i):
                    for low, high in zip(levels, levels[1:]):
                        leaf //= FAN
                        now = min(low[FAN * leaf : FAN * leaf + FAN])
                        if high[leaf] == now:
                            break
                        high[leaf] = now
        ids, i = [], 0
        while i < n:
            ids.append(ranks[word[i : after[i]]])
            i = after[i]
        return ids


class ByteBpe:
    """Encoder and decoder of one vocabulary; ids come as little-endian
    unsigned 32-bit integers in bytes, which is what the caches hold."""

    def __init__(self, name: str):
        ranks = load_ranks(name)
        tree = MergeTree(ranks)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._pieces = PieceEncoder(lambda m: _pack(tree.encode(m.encode())), b"".join, limit=PIECES)

    def encode(self, text: str | None) -> bytes:
        return self._pieces.encode(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, _unpack(ids)))


def _pack(ids: list[int]) -> bytes:
    import sys

    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def _unpack(ids: bytes) -> array:
    import sys

    a = array("I")
    a.frombytes(ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a


@lru_cache(maxsize=1)
def _codec(name: str) -> ByteBpe:
    """One codec a worker process: its caches serve all tasks that the worker runs."""
    return ByteBpe(name)


def bpe_codec(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode every text and decode the ids again, one row per input row.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and,
    with ``keep_ids``, ``ids`` (array of int) and ``decoded`` (binary).
    A null text counts as empty: no ids, digests of no bytes. Repeated rows give
    repeated results, an empty table none; other columns aren't read, whatever
    their names. A map over the rows: no shuffle, memory bounded by the caches.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                decoded = codec.decode(ids)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                for column, value in zip(out, row + ((_unpack(ids).tolist(), decoded) if keep_ids else ())):
                    column.append(value)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, schema)
