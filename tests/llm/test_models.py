"""Operators 11, 12 and 13, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import delta_lloyd, hard_negatives, neural_lm

VECTORS = "vec_id long, embedding array<double>, label int, cluster string, score string"


def vectors(rng, n, width=64):
    rows = [(k, [rng.gauss(0, 1) + (k % 4 if d == k % 7 else 0) for d in range(width)], k % 3, "c", "s") for k in range(n)]
    odd = [(900, None, 1), (901, [1.0] * (width - 1), 1), (902, [None] + [1.0] * (width - 1), 1), (903, [math.nan] + [1.0] * (width - 1), 1), (904, [math.inf] + [1.0] * (width - 1), 1), (905, [], 1), (906, rows[5][1], None), (None, rows[6][1], 2)]
    return [*rows, *rows[3:6], *((*r, "c", "s") for r in odd)]


def whole(v, width=64):
    return v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)


def plain_lloyd(rows, k, rounds, scale=256):
    x = [(r[0], [math.floor(scale * c) for c in r[1]]) for r in rows if whole(r[1])]
    first = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [c for _, c in first]
    for n in range(rounds + 1):
        at = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in x]
        if n < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, b) in zip(x, at) if b == j]
                if own:
                    centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    return [(i, j, d, j) for (i, _), (d, j) in zip(x, at)], centroids


@pytest.mark.parametrize("far", [1.0, 1e30])
def test_delta_lloyd_equals_plain_rounds(spark, far):
    """Also where doubles and longs can't hold what is added up."""
    rows = vectors(random.Random(3), 120)
    rows = [(r[0], [x * far for x in r[1]] if whole(r[1]) and r[0] != 7 else r[1], *r[2:]) for r in rows]
    df = spark.createDataFrame(rows, VECTORS)
    got = delta_lloyd.clusters(df, k=9, rounds=4).collect()
    want, centroids = plain_lloyd(rows, 9, 4)
    largest = 2**63 - 1
    inertia = Counter()
    for _, j, d, _ in want:
        inertia[j] += min(d, largest)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    key = lambda r: (str(r[0]), *r[1:])
    expected = sorted([(i, j, min(d, largest), min(inertia[j], largest), min(sum(inertia.values()), largest), digest[j]) for i, j, d, _ in want], key=key)
    assert sorted([(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got], key=key) == expected


def test_delta_lloyd_with_few_or_equal_vectors(spark):
    one = [0.5] * 64
    df = spark.createDataFrame([(k, one, 0, "c", "s") for k in range(5)], VECTORS)
    got = delta_lloyd.clusters(df, k=40).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 5
    assert delta_lloyd.clusters(df.where("false")).count() == 0


def test_a_round_compares_moved_centroids_only():
    """Whatever moved, the assignment is the one against all centroids."""
    rng = np.random.default_rng(1)
    v = rng.integers(-9, 9, (300, 4)).astype(float)
    c = rng.integers(-9, 9, (12, 4)).tolist()
    cluster, distance = np.full(300, -1, np.int32), np.zeros(300, np.int64)
    for moved in (range(12), [3], [], [0, 5, 11]):
        for j in moved:
            c[j] = rng.integers(-9, 9, 4).tolist()
        cluster, distance = delta_lloyd.assign(v, cluster, distance, c, np.isin(np.arange(12), list(moved)))
        full = ((v[:, None, :] - np.array(c)[None]) ** 2).sum(axis=2)
        assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def plain_negatives(rows, is_anchor, scale=256, positives=5, k=3):
    """By the definition; an anchor that repeats asks once, with its least label and vector."""
    x = [(r[0], r[2], [math.floor(scale * c) for c in r[1]]) for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    out = []
    for a in sorted({r[0] for r in x if is_anchor(r[0])}):
        label, q = min(r[1:] for r in x if r[0] == a)
        scored = sorted((-sum(p * c for p, c in zip(q, v)), i, l) for i, l, v in x if i != a)
        for s, i, _ in [r for r in scored if r[2] == label][:positives]:
            inside = [(n, j) for n, j, l in scored if l != label and -50 * s <= -100 * n <= -95 * s][:k]
            out += [(a, i, m + 1, j, -s, -n) for m, (n, j) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize(("width", "whole_numbers"), [(64, False), (3, True)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, width, whole_numbers):
    """With blocks and leaves so small that trees are deep; small whole numbers give many ties."""
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    rows = vectors(random.Random(6), 230, width)
    if whole_numbers:
        rows = [(r[0], [float(round(x)) if x is not None and math.isfinite(x) else x for x in r[1]] if r[1] else r[1], *r[2:]) for r in rows]
    df = spark.createDataFrame(rows, VECTORS)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, F.col("label"), candidates=90, anchors=20).collect()
    want = plain_negatives(rows, lambda i: i % 5 == 0)
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == want and len(want) > 100
    assert hard_negatives.hard_negatives(df.where("false"), F.col("vec_id") % 5 == 0, F.col("label")).count() == 0


def test_a_narrow_annulus_spares_most_of_the_tree(monkeypatch):
    """Clustered rows: leaves whose distances miss the window are never scored, and what comes out is complete."""
    monkeypatch.setattr(hard_negatives, "LEAF", 16)
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (32, 3))
    x = (centres[np.arange(8192) % 32] + rng.integers(-6, 7, (8192, 3))).astype(float)
    ids, labels = np.arange(8192), np.arange(8192) % 32 % 3
    tree = hard_negatives.VantageTree(ids, labels, x)
    query = hard_negatives.Query(tree, x[0], 0)
    scores = x @ x[0]
    most = np.sort(scores)[-300]
    found = list(query.nearest(0, False, 5, most * 0.9, most))
    inside = sorted((-s, i) for i, s in zip(ids, scores) if labels[i] != 0 and most * 0.9 <= s <= most)[:5]
    assert [(i, -s) for i, s in found] == [(i, s) for s, i in inside] and len(inside) == 5
    assert len(query.sorted) < len(tree.leaves) / 8


def tokens(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w] + [""]


@pytest.fixture(scope="module")
def corpus():
    """Two languages whose words follow each other at random."""
    rng = random.Random(4)
    pools = [[f"{a}{b}{c}" for a in s for b in s for c in s] for s in (("ka", "lo", "mi", "ru"), ("ben", "dor", "fis", "gul"))]
    rows = [(k, " ".join(rng.choice(pools[k % 2][: 4 if rng.random() < 0.5 else 64]).capitalize() for _ in range(rng.randrange(1, 160)))) for k in range(300)]
    return rows + [(300, None), (301, ""), (302, " \n\t "), (303, "Élan x ÉLAN\vkalomi"), (304, "unseen" * 30_000), (None, "kalomi"), (7, rows[7][1]), (305, "new new new " * 40)]


SMALL = replace(neural_lm.Shape(), words=40, buckets=16, dim=6, rounds=2, batch=128)


def test_language_model_scores(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    got = neural_lm.score_texts(df, held, SMALL).collect()
    counts = Counter(w for i, t in corpus if not out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for i, t in corpus:
        want[i].append((out(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))))
    assert len(got) == len(corpus)
    for r in got:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4], rel=1e-9) for w in want[r.doc_id])
    trained_on_neither = [r for r in got if r.held_out and r.n_tokens > 1]
    assert sum(r.score for r in trained_on_neither) > sum(r.base_score for r in trained_on_neither) + 0.1 * sum(r.n_tokens for r in trained_on_neither)
    # The words that every task holds are a matter of speed.
    key = lambda r: (str(r.doc_id), r.n_tokens)
    for a, b in zip(sorted(got, key=key), sorted(neural_lm.score_texts(df, held, replace(SMALL, known=45)).collect(), key=key)):
        assert (a.n_known, a.n_tokens) == (b.n_known, b.n_tokens) and a.score == pytest.approx(b.score, rel=1e-5) and a.base_score == pytest.approx(b.base_score, rel=1e-9)
    assert neural_lm.score_texts(df.where("false"), held, SMALL).count() == 0
    assert {r.base_score for r in neural_lm.score_texts(df.where("doc_id < 9"), F.lit(True), SMALL).collect()} == {0.0}


def test_frequent_words_are_cut_by_levels(spark):
    rows = [(bytes([65 + k]), n) for k, n in enumerate([9, 9, 9, 500, 400, 80, 80, 3])] + [(b"x" * 65, 900)]
    df = spark.createDataFrame([(bytearray(w), n) for w, n in rows], "word binary, n long")
    order = sorted(rows[:-1], key=lambda x: (-x[1], x[0]))
    for known, words, want in ((100, 2, 8), (5, 2, 4), (5, 5, 5), (1, 1, 1), (1, 3, 1)):
        assert neural_lm.frequent_words(df, replace(SMALL, known=known, words=words)) == order[:want]
    assert neural_lm.frequent_words(df.where("false"), SMALL) == []


def test_probabilities_add_up_to_one(spark, corpus):
    counts = Counter(w.encode() for i, t in corpus for w in tokens(t))
    frequent = sorted(((w, n) for w, n in counts.items() if w), key=lambda x: (-x[1], x[0]))
    buckets = {}
    for w, n in frequent:
        a, b = buckets.get(neural_lm.bucket(w, SMALL), (0, 0))
        buckets[neural_lm.bucket(w, SMALL)] = a + n, b + 1
    v = neural_lm.Vocabulary(frequent, counts[b""], buckets, SMALL)
    model = neural_lm.LogBilinear(v.counts, SMALL)
    trainer = neural_lm.Trainer(model, 0)
    texts = [np.array([*(int(v.cls[v.place[w.encode()]]) for w in tokens(t)[:-1]), 0], np.uint16) for _, t in corpus]
    for _, before, token in neural_lm.stretches(texts, SMALL.context):
        trainer.learn(before, token)
    k = len(v.counts)
    before = np.repeat(np.array([[0, 0], [3, 1], [k - 1, 5]]), k, axis=0)
    p = np.exp(model.log_probabilities(before, np.tile(np.arange(k), 3)).astype(float)).reshape(3, k)
    assert p.sum(axis=1) == pytest.approx(1, abs=1e-4)
    neural_lm.tabulate(spark, model)
    assert model.totals.shape == (k * k,)
    assert np.exp(model.log_probabilities(before, np.tile(np.arange(k), 3)).astype(float)).reshape(3, k) == pytest.approx(p, rel=1e-4)
    # Within a class: its words and one unseen word.
    share = Counter()
    for w, n in frequent:
        cls = int(v.cls[v.place[w]])
        share[cls] += 1 if cls < v.first_bucket else (n + 1) / 10 ** v.log_size[cls]
    assert all(s + (10 ** -v.log_size[c] if c >= v.first_bucket else 0) == pytest.approx(1) for c, s in share.items())


def test_stretches_cut_long_texts_without_losing_context():
    texts = [np.arange(1, 12, dtype=np.uint16), np.array([0], np.uint16), np.arange(20, 25, dtype=np.uint16)]
    flat = lambda parts: [np.concatenate(x).tolist() for x in zip(*parts)]
    assert flat(neural_lm.stretches(texts, 2, 4)) == flat(neural_lm.stretches(texts, 2))
    number, before, token = map(np.array, flat(neural_lm.stretches(texts, 2)))
    assert number.tolist() == [0] * 11 + [1] + [2] * 5 and token.tolist() == [*range(1, 12), 0, *range(20, 25)]
    assert before[0].tolist() == before[11].tolist() == [0, 0] and before[3].tolist() == [3, 2]


def test_noise_contrastive_steps_follow_the_gradient():
    """A step's gradients, against differences of the contrastive loss."""
    shape = replace(SMALL, dim=3, noise=4, context=2, rate=1e-3)
    counts = np.arange(1, 9)
    rng = np.random.default_rng(3)
    before, token = rng.integers(0, 8, (5, 2)), rng.integers(0, 8, 5)
    noise = np.minimum(np.searchsorted(neural_lm.LogBilinear(counts, shape).upto, neural_lm.Trainer(neural_lm.LogBilinear(counts, shape), 0).rng.random(4)), 7)

    def loss(m):
        log_sigmoid = lambda x: -np.log1p(np.exp(-x))
        q = m.predicted(before)
        true = (q * m.out[token]).sum(axis=1) + m.bias[token] - m.log_noise[token] - math.log(4)
        false = q @ m.out[noise].T + m.bias[noise] - m.log_noise[noise] - math.log(4)
        return log_sigmoid(true).sum() + log_sigmoid(-false).sum()

    m = neural_lm.LogBilinear(counts, shape)
    for name in ("seen", "out", "at", "bias"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    step = neural_lm.LogBilinear(counts, shape)
    neural_lm.Trainer(step, 0)._step(before, token)
    for name in ("seen", "out", "at", "bias"):
        value, change = getattr(m, name), (getattr(step, name) - getattr(m, name)) / shape.rate
        for index in list(np.ndindex(value.shape))[::3]:
            slope = []
            for e in (1e-4, -1e-4):
                value[index] += e
                slope.append(loss(m))
                value[index] -= e
            g = (slope[0] - slope[1]) / 2e-4
            assert change[index] == pytest.approx(g / math.sqrt(1 + g * g), abs=2e-2)
