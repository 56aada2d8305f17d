"""Operators 1, 4 and 7 against the libraries whose results they give."""

import base64
import hashlib
import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerflow.llm import bpe, packing, token_counts

TEXTS = [None, "", " ", "a", "plain words, with  double   spaces\n\n and\ttabs ", "<|endoftext|> inside <|endoftext|>text", "naïve Straße ñandú 漢字 🙂 'll it's", "x" * 4000, "word " * 900, "\x1c\x85 odd \x1f blanks", " lead", "trail ", "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "x", 1) for k, t in enumerate(TEXTS)] + [(None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids_sha256 string, n_chars long")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_library_and_round_trips(docs):
    enc = reference()
    rows = bpe.bpe_codec(docs, "byte_bpe_multi_50k.tiktoken").collect()
    assert len(rows) == len(TEXTS) + 1
    texts = dict(enumerate(TEXTS)) | {None: "no id"}
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert bytes(r.decoded) == text.encode() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.bpe_codec(docs.where("false"), "byte_bpe_multi_50k.tiktoken").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_merge_tree_on_any_text(text):
    codec = bpe.ByteBpe("byte_bpe_multi_50k.tiktoken") if not hasattr(test_merge_tree_on_any_text, "codec") else test_merge_tree_on_any_text.codec
    test_merge_tree_on_any_text.codec = codec
    test_merge_tree_on_any_text.enc = enc = getattr(test_merge_tree_on_any_text, "enc", None) or reference()
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == enc.encode_ordinary(text)


def test_merge_tree_takes_few_steps_and_any_length():
    """Lines of Python that a usual pre-token takes, and long ones of several levels."""
    rng, enc, tree = random.Random(8), reference(), bpe.MergeTree(bpe.load_ranks("byte_bpe_multi_50k.tiktoken"))
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 16))) for _ in range(300)]
    steps = 0

    def count(frame, event, arg):
        nonlocal steps
        steps += event == "line"
        return count

    sys.settrace(count)
    try:
        found = [tree.encode(w.encode()) for w in words]
    finally:
        sys.settrace(None)
    assert found == [enc.encode_ordinary(w) for w in words]
    assert steps < 20 * sum(map(len, words))
    for n in (31, 32, 33, 64, 65, 1023, 1024, 1025, 1057, 40_000):
        for letters in ("a", "ab", "etaoinshrdlu"):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert tree.encode(word.encode()) == enc.encode_ordinary(word)


def test_counts_equal_library(docs):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = token_counts.token_counts(docs, "byte_bpe_50k.json", limit=512, table_size=5, per_task=8, sample_rows=6).collect()
    texts = dict(enumerate(TEXTS)) | {None: "no id"}
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(t.encode(text, add_special_tokens=False).ids)) and r.over_limit == (r.n_tokens > 512)
    assert token_counts.token_counts(docs.where("false"), "byte_bpe_50k.json", 512).count() == 0


def test_packing_is_gapless_and_complete(docs):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, "byte_bpe_50k.json", capacity=256, open_bins=3).collect()
    texts = dict(enumerate(TEXTS)) | {None: "no id"}
    bins, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = [*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.piece, r.start, r.length, len(ids)))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    for spans in parts.values():
        at = 0
        for k, (piece, start, length, n) in enumerate(sorted(spans)):
            assert piece == k and start == at and (length == 256 or k == 0)
            at += length
        assert at == n and (n > 256 or len(spans) == 1)
    assert packing.pack(docs.where("false"), "byte_bpe_50k.json").count() == 0


def test_packing_ids_are_the_librarys():
    """By ranks, by the model where white space is long, and with special strings in the text."""
    from tokenizers import Tokenizer

    path = packing.vocabulary_path("byte_bpe_50k.json")
    library, encode, rng = Tokenizer.from_file(path), packing._ids("byte_bpe_50k.json").encode, random.Random(6)
    texts = ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "  \n\t x", "unseen" * 3000, "it's I'LL 123456 !!\r\n\r\n  end ", "x" + " \n" * 9000 + "y"]
    texts += ["".join(chr(rng.choice([32, 32, 10, 39, 48, 97, 233, 0x4E00, 0x1F600, 0x200D, 9, 0])) for _ in range(200)) for _ in range(300)]
    for text in texts:
        assert encode(text) == b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)
    assert encode(None) == b"" and packing._ranks(packing.vocabulary_path("word_bpe_49k.json"), packing._byte_letters()) is None


def test_packing_hardly_depends_on_the_number_of_tasks(spark):
    rng = random.Random(3)
    rows = [(k, "word " * rng.randint(1, 500)) for k in range(1200)]
    used = []
    for tasks in (1, 60):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks)
        packed = packing.pack(docs, "byte_bpe_50k.json", capacity=512, open_bins=64)
        total, found = packed.agg({"length": "sum"}).first()[0], packed.select("sequence_id").distinct().count()
        used.append(total / (512 * found))
    assert used[1] > used[0] - 0.02 and used[0] > 0.9


def test_best_fit_equals_a_plain_one():
    """Against a search through all open bins."""
    rng, bins, held = random.Random(4), packing.BestFit(60, 5), {}
    for _ in range(2000):
        n = rng.randint(1, 60)
        home, offset = bins.place(n)
        fitting = [free for free in held.values() if free >= n]
        if fitting:
            assert held[home] == min(fitting)
        elif len(held) == 5:
            gone = {b for b in held if b in bins.closed}
            assert len(gone) == 1 and held[min(gone)] == min(held.values())
            held = {b: f for b, f in held.items() if b not in gone}
        assert offset == 60 - held.get(home, 60)
        held[home] = held.get(home, 60) - n
        held = {b: f for b, f in held.items() if f}
        bins.closed.clear()


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 8, 2)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (2, 8)]
    rng, bins, used = random.Random(2), packing.BestFit(100, 8), defaultdict(int)
    for _ in range(3000):
        n = rng.randint(1, 100)
        home, offset = bins.place(n)
        assert used[home] == offset and offset + n <= 100
        used[home] += n
        assert bins.n_open <= 8
    assert sum(used.values()) / (100 * len(used)) > 0.85
