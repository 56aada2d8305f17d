"""Operator 8: SimHash near-duplicates by a segment-popcount grid.

Fingerprints come from XXH64 of word shingles. Those within ``MOST`` differing
bits link, and the connected components of the links are the groups.

Each fingerprint is embedded as the bit counts of its 32 two-bit segments. The
Manhattan distance of two embeddings never exceeds the Hamming distance, so it
prunes. The segments lie in six blocks; three bits can touch three of them at most, so two fingerprints that link have the same
coordinates in three blocks. Each choice of three is a grid whose cells are single points, and the range join needs a point's own
cell alone. A cell also has the counts of a second pairing of the same bits, which makes it about as fine as the bits
themselves: a grid has 2^28 cells or more, so that candidates stay in proportion to the fingerprints until there are billions of them.
What meets in a cell is pruned by the Manhattan distance and verified exactly on the 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected
from .common import discard, materialise, repeats, small_batches

#: Differing bits up to which two fingerprints link. Three equal blocks of six are complete for this bound, not for more.
MOST = 3
#: Bits of each block; pairings don't leave a block, as all are multiples of four.
BLOCK_BITS = (12, 12, 12, 12, 8, 8)
_LANES = np.uint64(0x0101010101010101)


def _shingles(text: str | None, width: int) -> list[bytes] | map:
    words = text.encode().lower().split() if text else []  # ASCII only, for both
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return map(b" ".join, zip(*(words[k:] for k in range(width))))


def fingerprints(texts: list[str | None], width: int) -> np.ndarray:
    """SimHash of each whole text; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    sizes: list[int] = []

    def counted() -> Iterator[bytes]:
        for text in texts:
            n = 0
            for n, s in enumerate(_shingles(text, width), 1):
                yield s
            sizes.append(n)

    h = np.fromiter(map(xxh64_intdigest, counted(), repeat(42)), np.uint64)
    return majority(h, np.array(sizes, np.int64))


def majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For runs of ``n`` hashes each, the bits that over half of the run have; 0 for an empty run."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    ends = np.cumsum(n[full])
    begins = ends - n[full]
    # Eight byte-wide counters lie in a word, so at most 255 rows are added up at once.
    cuts = np.fromiter(chain.from_iterable(range(a, b, 255) for a, b in zip(begins.tolist(), ends.tolist())), np.int64)
    first = np.searchsorted(cuts, begins)
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & _LANES, cuts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (2 * counts[:, byte] > n[full]).astype(np.uint64) << np.uint64(8 * byte + j)
    return out


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``doc_id`` and its fingerprint ``fp`` as a signed long; one row per row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col]).mapInArrow(run, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _counts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, in two bits each."""
    odd = F.lit(0x5555555555555555)
    left, right = F.shiftrightunsigned(fp, 1).bitwiseAND(odd), fp.bitwiseAND(odd)
    return left.bitwiseXOR(right).bitwiseOR(F.shiftleft(left.bitwiseAND(right), 1))


def _crossed(fp: Column) -> Column:
    """The fingerprint with the middle bits of each four exchanged: its segments pair the bits anew."""
    keep, up, down = (F.lit(_signed(m)) for m in (0x9999999999999999, 0x2222222222222222, 0x4444444444444444))
    return fp.bitwiseAND(keep).bitwiseOR(F.shiftleft(fp.bitwiseAND(up), 1)).bitwiseOR(F.shiftrightunsigned(fp.bitwiseAND(down), 1))


_STARTS = [sum(BLOCK_BITS[:k]) for k in range(len(BLOCK_BITS))]
_MASKS = [((1 << n) - 1) << at for n, at in zip(BLOCK_BITS, _STARTS)]
_GRIDS = list(combinations(range(len(BLOCK_BITS)), 3))


def links(distinct: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of different fingerprints within ``MOST`` bits, each
    once. ``distinct`` has every fingerprint ``fp`` once."""
    once, again = _counts(F.col("fp")), _counts(_crossed(F.col("fp")))
    cell = lambda g: F.xxhash64(*(c.bitwiseAND(F.lit(_signed(sum(_MASKS[k] for k in g)))) for c in (once, again)))
    cells = F.array(*(F.struct(F.lit(n).alias("grid"), cell(g).alias("cell")) for n, g in enumerate(_GRIDS)))
    # few bytes before, twenty rows each after: spread first
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    points = spread.select("fp", once.alias("at"), F.inline(cells))
    x, y = (points.select(F.col("fp").alias(n), F.col("at").alias(f"at_{n}"), "grid", "cell") for n in "ab")
    # the Manhattan distance: segments' counts differ by the bits of |p - q|, which is 0, 1 or 2
    p, q = F.col("at_a"), F.col("at_b")
    low, high = F.lit(0x5555555555555555), F.lit(_signed(0xAAAAAAAAAAAAAAAA))
    one, two = p.bitwiseXOR(q).bitwiseAND(low), p.bitwiseXOR(q).bitwiseAND(high)
    # counts 0 and 1, 1 and 2 differ by 1 (in the low bit), 0 and 2 by 2 (in the high bit alone)
    far = F.bit_count(one) + 2 * F.bit_count(two.bitwiseAND(F.bitwise_not(F.shiftleft(one, 1))))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # a pair that shares several grids counts in the first one
    first = {sum(1 << k for k in range(6) if equal >> k & 1): min((n for n, g in enumerate(_GRIDS) if all(equal >> k & 1 for k in g)), default=-1) for equal in range(64)}
    same = sum((F.when(differ.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(1 << k)).otherwise(0) for k, m in enumerate(_MASKS)), F.lit(0))
    home = F.element_at(F.array(*(F.lit(first[e]) for e in range(64))), same + 1)
    near = (F.col("a") < F.col("b")) & (far <= MOST) & (F.bit_count(differ) <= MOST) & (home == F.col("x.grid"))
    return x.alias("x").join(y.alias("y"), (F.col("x.grid") == F.col("y.grid")) & (F.col("x.cell") == F.col("y.cell")) & near).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and group of every document.

    Returns ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (the
    smallest id that links reach, its own included) and ``n_links`` (different
    fingerprints linked with its own). Null texts and texts without words have
    fingerprint 0 and link like any other; repeated rows share all results and
    an empty table gives none. No other column is read. Copies collapse to one
    fingerprint before anything is joined, so a group of copies costs one row.
    """
    spark = docs.sparkSession
    rows = materialise(fingerprint_table(docs, id_col, text_col, width), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = materialise(links(distinct.select("fp")), "links")
    labels = connected(edges)
    degree = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").groupBy("a").agg(F.count("*").alias("n_links"))
    known = distinct.join(labels, distinct.fp == labels.node, "left").join(degree, distinct.fp == degree.a, "left")
    known = known.select("fp", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    roots = known.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = known.join(roots, "root").select("fp", "component_id", "n_links")
    return rows.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


# Near copies by a stated similarity: the same fingerprints, with segments of one bit.

#: Blocks of the distinct words' fingerprint, eight one-bit segments each; a block's cell is its own point.
BLOCKS = 8
#: Longs of the shingles' fingerprint, and the differing bits up to which it lets a pair through. At a similarity
#: of 0.8 the angle is 27 degrees, so 39 of 256 bits differ, with a deviation of 5.7.
LONGS, SHINGLE_BITS = 4, 56
#: Rounds of links to hubs.
ROUNDS = 3
#: A key with more than this part of all members is joined by broadcast; there are at most 1 / HOT such keys.
HOT = 1e-3


def sketches(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the fingerprint of its distinct words, those (``LONGS``) of its five-word
    shingles, its least shingles under ``BLOCKS`` hash functions, and a hash of the word sequence.
    A text of fewer words is one shingle."""
    from .passages import SHINGLE, WordHashes, _blocks, _constants, _mix, _shingled

    seeds, hashes, parts = _constants(LONGS + BLOCKS, 5), WordHashes(), []
    for _, block in _blocks(texts):
        ids, n = hashes.of(block)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((ids, owner))
        new = np.ones(len(ids), bool)
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        words = majority(ids[order][new], np.bincount(owner[order][new], minlength=len(n)))
        place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        placed = _mix(ids + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
        whole = np.zeros(len(n), np.uint64)
        np.add.at(whole, owner, placed)
        s = _shingled(ids, SHINGLE)
        s = s[owner[: len(s)] == owner[SHINGLE - 1 :]]
        m = np.maximum(n - SHINGLE + 1, 0)
        full = np.flatnonzero(m)
        begins = (np.cumsum(m) - m)[full]
        runs, least = np.zeros((len(n), LONGS), np.uint64), np.zeros((len(n), BLOCKS), np.uint64)
        for k, seed in enumerate(seeds):
            h = _mix(s ^ seed)
            few = _mix(whole ^ seed)
            if k < LONGS:
                runs[:, k] = np.where(m > 0, majority(h, m), few)
            else:
                least[:, k - LONGS] = few
                if len(full):
                    least[full, k - LONGS] = np.minimum.reduceat(h, begins)
        parts.append((words, runs, least, whole))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros((0, LONGS), np.uint64), np.zeros((0, BLOCKS), np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


_RUNS = [f"s{k}" for k in range(LONGS)]


def _sketch_table(texts: DataFrame) -> DataFrame:
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, runs, least, whole = sketches(batch.column(1).to_pylist())
            longs = [words, *runs.T, whole]
            cells = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(least).view(np.int64).ravel()), BLOCKS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in longs), cells], ["id", "words", *_RUNS, "whole", "least"])

    return texts.mapInArrow(run, f"id {kind}, words long, {', '.join(f'{r} long' for r in _RUNS)}, whole long, least array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets of five-word shingles are similar enough."""
    from .passages import SHINGLE, WordHashes, _aligned_blocks

    pairs = materialise(pairs, "pairs")
    used = materialise(texts.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi"), "texts")
    both = pairs.join(used.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(used.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            names = [batch.column(k).to_pylist() for k in (0, 1)]
            texts = tuple([t or "" for t in batch.column(k).to_pylist()] for k in (2, 3))
            for rows, held in _aligned_blocks(names, texts, hashes):
                sets = {k: np.unique(shingles) for k, (_, shingles) in held.items()}
                for row in rows:
                    a, b = names[0][row], names[1][row]
                    if min(len(held[a][0]), len(held[b][0])) < SHINGLE:
                        keep[row] = np.array_equal(held[a][0], held[b][0])
                        continue
                    c = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    keep[row] = c >= similarity * (len(sets[a]) + len(sets[b]) - c)
            yield batch.select([0, 1]).filter(pa.array(keep))

    kind = pairs.schema["a"].dataType.simpleString()
    out = materialise(both.mapInArrow(run, f"a {kind}, b {kind}"), "verified")
    discard(pairs, used)
    return out


def _keys(members: DataFrame, depth: int) -> DataFrame:
    """Members with the ``key`` of their block ``k``: the cell of the fingerprint's grid, split by the
    least shingle under the block's hash function and ``depth`` more functions."""
    splits = [F.element_at("least", (F.col("k") + d) % BLOCKS + 1) for d in range(depth + 1)]
    return members.withColumn("key", F.xxhash64("k", "cell", *splits))


def _hubs(members: DataFrame) -> DataFrame:
    """Members of keys that two of them share, one of which isn't ``tied`` to a hub yet, with ``hub``: of the
    key's members that which meets most others over all its keys (ties: the smallest id)."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("tied").isNull()).alias("open")).where("n > 1 AND open").select("key", "n")
    live = materialise(members.join(sizes, "key"), "members")
    degree = live.groupBy("id").agg(F.sum("n").alias("degree"))
    ranked = live.join(degree, "id")
    hubs = materialise(ranked.groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("d"), "id", *_RUNS, "tied")).alias("hub")), "hubs")
    total = live.count()
    hot = F.broadcast(live.groupBy("key").count().where(F.col("count") > max(64, HOT * total)).select("key"))
    common = live.join(hot, "key").join(F.broadcast(hubs.join(hot, "key")), "key")
    return live.join(hot, "key", "left_anti").join(hubs, "key").unionByName(common)


def near_copies(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose five-word shingles have a Jaccard similarity of
    ``similarity`` or more: ``doc_id``, ``component_id`` (least id of the group).

    The fingerprint of the distinct words moves little under small edits, so its blocks are the
    grid. A grid of fixed cells fills up as a corpus grows, so each cell is split by a least shingle.
    The members of such a key link to one hub, the member that meets most others, so a group of n copies costs
    n rows a key, however similar its members are. What the shingles' fingerprint lets through
    is verified on the whole shingle sets. Where some member isn't similar to its hub, the key's members other than
    the hub meet again, split by one more least shingle, over ``ROUNDS`` rounds in all. Two members
    tied to one hub are in one group already and not compared.

    Null texts count as empty; rows without an id have no group; rows
    repeated with one id are one document, by its least text; an empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    if repeats(texts, "id"):
        texts = materialise(texts.groupBy("id").agg(F.min("text").alias("text")), "texts")
    rows = materialise(_sketch_table(texts), "sketches")
    body = ["words", *_RUNS, "whole"]
    leaders = materialise(rows.groupBy(*body).agg(F.min("id").alias("id"), F.min("least").alias("least")), "leaders")
    cells = F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("words", 8 * k).bitwiseAND(F.lit(255)).alias("cell")) for k in range(BLOCKS)))
    members = leaders.select("id", *_RUNS, "least", F.inline(cells), F.lit(None).cast(leaders.schema["id"].dataType).alias("tied"))
    edges = None
    for depth in range(ROUNDS):
        met = materialise(_hubs(_keys(members, depth)), "met")
        far = sum(F.bit_count(F.col(r).bitwiseXOR(F.col(f"hub.{r}"))) for r in _RUNS)
        apart = F.col("tied").isNull() | F.col("hub.tied").isNull() | (F.col("tied") != F.col("hub.tied"))
        pairs = met.where((F.col("id") != F.col("hub.id")) & (far <= SHINGLE_BITS) & apart)
        pairs = pairs.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()
        found = _verified(pairs, texts, similarity)
        edges = found if edges is None else edges.unionByName(found)
        if depth + 1 < ROUNDS:
            ends = found.select(F.col("a").alias("id"), F.col("b").alias("with")).unionByName(found.select(F.col("b").alias("id"), F.col("a").alias("with")))
            left = met.where("id <> hub.id").join(ends, (met.id == ends.id) & (met.hub.id == ends["with"]), "left").select(met["*"], ends["with"].alias("now"))
            members = left.select("id", *_RUNS, "least", "k", "cell", F.coalesce("tied", "now").alias("tied"))
    labels = connected(edges)
    groups = leaders.join(labels, leaders.id == labels.node, "left").select(*body, F.coalesce("root", "id").alias("component_id"))
    return rows.join(groups, body).select(F.col("id").alias("doc_id"), "component_id")
