"""Operators 6, 8, 9 and 10, against brute force."""

import gzip
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerflow.llm import passages, simhash, topk, warc
from ledgerflow.operators.components import connected


def prose(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(ids, linked):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_simhash_groups(spark):
    rng = random.Random(5)
    base = prose(rng, 700)
    texts = [None, "", "  ", "One TWO", "one two", "Ünder É x y", base, base, base.upper(), base.replace("w1", "q1", 1), base + " more", prose(rng, 80), prose(rng, 3), "y " * 30000]
    near = base.split()
    texts += [" ".join([*near[:k], f"edit{k}", *near[k + 1 :]]) for k in range(0, 600, 60)]
    df = spark.createDataFrame([(7 + 3 * k, t) for k, t in enumerate(texts)] + [(7, None)], "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    rows = simhash.near_duplicates(df).collect()
    fps = {7 + 3 * k: plain_fingerprint(t) for k, t in enumerate(texts)}
    linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    groups = plain_groups(fps, linked)
    assert len(rows) == len(texts) + 1
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{fps[i]:016x}", groups[i]) for i in fps}
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_grid_finds_every_link_up_to_three_bits(spark):
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    points = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for s in seeds for _ in range(6)} | {0, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    pairs = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    found = {frozenset((r.a, r.b)) for r in pairs}
    assert len(found) == len(pairs)
    assert found == {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_manhattan_distance_is_a_lower_bound(spark):
    """Every pair within three bits passes the embedding's bound; segments by a plain count."""
    rng = random.Random(19)
    rows = [(a, a ^ sum(1 << b for b in rng.sample(range(64), n))) for n in range(0, 9) for a in [rng.getrandbits(64) for _ in range(30)]]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in rows], "p long, q long")
    got = df.select("p", "q", simhash._counts(F.col("p")).alias("x"), simhash._counts(simhash._crossed(F.col("p"))).alias("y")).collect()
    for (a, _), r in zip(rows, got):
        bits = [a >> k & 1 for k in range(64)]
        assert [r.x >> 2 * k & 3 for k in range(32)] == [bits[2 * k] + bits[2 * k + 1] for k in range(32)]
        assert [r.y >> 2 * k & 3 for k in range(32)] == [bits[4 * (k // 2) + k % 2] + bits[4 * (k // 2) + k % 2 + 2] for k in range(32)]


def test_near_copies_at_a_similarity(spark):
    rng = random.Random(8)
    base = prose(rng, 300).split()
    rows = [(10, " ".join(base))] + [(11 + k, " ".join([*base[: 20 * k + 5], "edit", *base[20 * k + 6 :]])) for k in range(10)]
    rows += [(50 + k, prose(rng, 200)) for k in range(20)] + [(90, None), (91, ""), (92, "Short one"), (93, "short  one"), (10, " ".join(base))]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == 10 for k in range(10, 21)) and all(got[k] == k for k in range(50, 70))
    assert got[91] == got[90] == 90 and got[92] == got[93] == 92


def test_sketches_are_of_five_word_shingles():
    """The least shingles of texts sketched together: equal to the least over each text's own runs of five words."""
    rng = random.Random(18)
    texts = [None, "a b", "a b c d", "a b c d e", prose(rng, 11), prose(rng, 12), prose(rng, 90), "", prose(rng, 30)]
    words, runs, least, whole = simhash.sketches(texts)
    assert len(words) == len(runs) == len(least) == len(whole) == len(texts)
    for text, found in zip(texts, least):
        split = (text or "").split()
        grams = {" ".join(split[k : k + 5]) for k in range(len(split) - 4)}
        if grams:
            assert np.array_equal(found, np.min([simhash.sketches([g])[2][0] for g in grams], axis=0))


def test_passages(spark):
    rng = random.Random(4)
    shared, other = prose(rng, 60), prose(rng, 60)
    edited = shared.split()
    edited[3] = "edit"
    rows = [(1, f"{prose(rng, 40)} {shared} {prose(rng, 70)}"), (2, f"{prose(rng, 90)}\n{shared.upper()} {prose(rng, 20)}"), (3, f"{' '.join(edited)} {prose(rng, 200)}")]
    rows += [(4, prose(rng, 300)), (5, None), (6, ""), (7, f"{prose(rng, 30)} {' '.join(other.split()[:30])} {prose(rng, 30)}"), (8, f"{prose(rng, 55)} {' '.join(other.split()[:30])}"), (9, prose(random.Random(77), 80)), (10, prose(random.Random(77), 80)), (1, rows[0][1]), (None, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash"))
    found = passages.repeated_passages(df).collect()
    words = {i: t.lower().split() for i, t in rows if i and t}
    assert {frozenset((r.doc_id, r.of_doc_id)) for r in found} <= {frozenset(p) for p in ((1, 2), (1, 3), (2, 3), (9, 10))}
    assert {r.doc_id for r in found} | {r.of_doc_id for r in found} == {1, 2, 3, 9, 10}
    for r in found:
        a, b = words[r.doc_id][r.start : r.end], words[r.of_doc_id][r.of_start : r.of_end]
        assert min(len(a), len(b)) >= 50 and r.similarity >= 0.8
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        assert r.similarity == pytest.approx(len(x & y) / len(x | y))
    assert passages.repeated_passages(df.where("false")).count() == 0


def test_compact_windows_equal_their_definition():
    rng = random.Random(1)
    made = passages.Windows()
    texts = [b"short", " ".join(str(rng.randrange(40)) for _ in range(140)).encode()]
    rows, _, _, found = made.compact(texts)
    assert rows.tolist() == [1]
    ids, _ = passages.WordHashes().of([texts[1]])
    s = passages._shingled(ids)
    starts = []
    for seed, (c, left, right, h) in zip(made._seeds, found):
        hashes = (passages._mix(s ^ seed) | np.uint64(1)).tolist()
        want = set()
        for at in range(len(hashes)):
            l = max((k + 1 for k in range(at) if hashes[k] <= hashes[at]), default=0)
            r = min((k - 1 for k in range(at + 1, len(hashes)) if hashes[k] < hashes[at]), default=len(hashes) - 1)
            if r - l + 1 >= made.t:
                want.add((l, at, r, hashes[at]))
        assert set(zip(left.tolist(), c.tolist(), right.tolist(), h.tolist())) == want
        starts.append([min(range(k, k + made.t), key=lambda i: hashes[i]) for k in range(len(hashes) - made.t + 1)])
    w = made.of([None, *(t.decode() for t in texts)])
    want = sum(1 + sum(x != y for x, y in zip(both, both[1:])) for a, b in made.pairs for both in [list(zip(starts[a], starts[b]))])
    assert len(w["key"]) == want and set(w["row"].tolist()) == {2}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 90, 95: 90, 90: 90}


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = {k: rng.normal(0, 0.2, 8).tolist() for k in range(150)}
    vectors |= {150 + k: vectors[20] for k in range(40)} | {300: [9.0] + [0.0] * 7, 301: [1.0, 2.0], 302: []}
    bad = [(400, None), (420, [None] * 8), (440, [float("nan")] * 8), (401, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame([(k, v) for k, v in vectors.items()] + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    ints = {k: [int(np.floor(64 * float(np.float32(x)))) for x in v] + [0] * (8 - len(v)) for k, v in vectors.items()}
    want = set()
    for q in (k for k in ints if k % 20 == 0):
        order = sorted(((-sum(a * b for a, b in zip(ints[q], v)), k) for k, v in ints.items() if k != q))[:20]
        want |= {(q, n + 1, k, -s) for n, (s, k) in enumerate(order)}
    for sizes in ({}, {"candidates": 40, "queries": 3}):
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, **sizes).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    few = topk.top_k(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_threshold_search_stops_early_and_is_exact():
    rng = np.random.default_rng(2)
    x = (rng.pareto(1.2, (4000, 4)) * 10).astype(np.int64)
    dense = np.floor(64 * rng.normal(0, 0.125, (4000, 64))).astype(np.int64)
    dense[:300] = dense[rng.integers(300, 4000, 300)]  # ties
    for vectors, q, most in ((x, np.array([5, 3, 0, -1]), 0.1), (x, np.zeros(4, np.int64), 0.0), (dense, dense[9], 1.0), (dense, -dense[3999], 1.0)):
        for kind in (np.int64, np.float64, object):
            lists = topk.SortedLists(np.arange(4000), vectors.astype(kind))
            ids, scores, read = lists.search(q.astype(kind), 17, 20)
            order = sorted((-s, i) for i, s in enumerate((vectors @ q).tolist()) if i != 17)[:20]
            assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == order
            assert read <= most * vectors.size
    few = topk.SortedLists(np.arange(3), dense[:3])
    assert few.search(dense[5], 1, 20)[0].tolist() == sorted((0, 2), key=lambda i: -(dense[i] @ dense[5]))


def test_topk_of_components_beyond_64_bits(spark):
    rows = [(0, [3e38, 1.0]), (1, [2e38, 5.0]), (2, [1.0, 1.0]), (3, [-3e38, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2**63 - 1), (2, 2**63 - 1), (3, -(2**63))]


def test_warc_round_trip(spark, tmp_path):
    body = "<p>" + "é" * 80 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>"
    rows = [(3, "http://a.example/x y\r\nz", body), (1, None, body), (2, "https://b.example", body), (4, "u", None), (5, "u", ""), (6, "u", "tiny"), (7, "u", "tiny"), (8, "http://c.example/long", "q" * 300_000), (2, "https://b.example", body), (None, "n", body)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_page) for r in warc.round_trip(df).collect()), key=str)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        again = html == body and page != 1
        want.append((page or 0, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=str)
    warc.write_archives(df, f"file://{tmp_path}/w")
    kept = {}
    for f in (tmp_path / "w").glob("*.gz"):
        for headers, block in warc.parse(gzip.decompress(f.read_bytes())):
            assert {"warc-type", "warc-record-id", "warc-date", "content-length"} <= headers.keys()
            if headers["warc-type"] == "response":
                kept[headers["warc-record-id"]] = bytes(block).split(b"\r\n\r\n", 1)[1]
    assert body.encode() in kept.values()
    nested = warc.captures(warc.read_records(spark, f"file://{tmp_path}/w", payload=True)).where("page_id = 1").first()
    assert bytes(nested.payload) == body.encode() and nested.request.block.startswith("GET ") and "pageId: 1" in nested.metadata.block
    assert warc.round_trip(df.where("false")).count() == 0
    for broken in (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"WARC/1.1\r\nContent", b"nothing of the kind\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(broken))


def test_records_of_a_stream_cut_anywhere():
    blocks = [b"", b"\r\n\r\n", b"a\r\n", b"WARC/1.1\r\n\r\n", bytes(range(256)) * 3]
    data = b"".join(b"WARC/1.1\r\nWARC-Type: x%d\r\nContent-Length: %d\r\n\r\n" % (k, len(b)) + b + b"\r\n\r\n" for k, b in enumerate(blocks))
    for step in (1, 7, 64, len(data)):
        records, got = warc.Records(), []
        for a in range(0, len(data), step):
            got += records.feed(data[a : a + step])
        records.end()
        assert [b for _, b in got] == blocks and [h["warc-type"] for h, _ in got] == [f"x{k}" for k in range(5)]
    records = warc.Records()
    assert [b for piece in data.removesuffix(b"\r\n\r\n").split(b"\r\n\r\n") for _, b in records.feed(piece + b"\r\n\r\n")] == blocks


def test_passages_behind_fragments_that_come_first(spark):
    """Short documents with a part of the passage come first in the classes that they share."""
    rng = random.Random(12)
    made, shared = passages.Windows(), prose(rng, 60)
    longer = [f"{prose(rng, 150)} {shared} {prose(rng, 150)}" for _ in range(2)]
    w = made.of(longer)
    common = set(w["key"][w["row"] == 0].tolist()) & set(w["key"][w["row"] == 1].tolist())
    words, short = shared.split(), []
    for at in range(0, 31):
        filler = prose(rng, 50).split()
        text = " ".join([*filler[:25], *words[at : at + 30], *filler[25:]])
        if common & set(made.of([text])["key"].tolist()):
            short.append(text)
    assert len(short) >= 3
    rows = [(k, t) for k, t in enumerate([*longer, *short])]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert any({r.doc_id, r.of_doc_id} == {0, 1} and r.end - r.start >= 60 for r in found)


def test_passages_against_brute_force(spark):
    """Recall of planted near passages by similarity, in pairs of documents and in families of eight."""
    rng = random.Random(31)
    rows, due = [], []

    def edited(passage, share):
        return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in passage.split())

    for k in range(240):
        passage, share = prose(rng, rng.choice((60, 90, 150))), rng.choice((0.0, 0.004, 0.01, 0.02))
        members = []
        for _ in range(8 if k % 6 == 0 else 2):
            members.append((len(rows), edited(passage, share)))
            rows.append((len(rows), f"{prose(rng, 80)} {members[-1][1]} {prose(rng, 80)}"))
        sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in members]
        for i, x in enumerate(members):
            like = max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(len(members)) if j != i)
            if like >= 0.8:
                due.append((x[0], like))
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hit = {r.doc_id for r in found} | {r.of_doc_id for r in found}
    for low, high, least in ((0.8, 0.9, 0.9), (0.9, 1.0, 0.97), (1.0, 2.0, 1.0)):
        some = [i for i, like in due if low <= like < high]
        assert len(some) > 30 and sum(i in hit for i in some) >= least * len(some), (low, sum(i in hit for i in some), len(some))


def test_no_passage_at_the_threshold_is_left_out(spark):
    """Shortest passages with one edit, half a passage on either side of a gap, and exact passages that fragments precede: every one of them."""
    rng, rows, due = random.Random(41), [], []

    def plant(*passages_):
        due.append(tuple(range(len(rows), len(rows) + len(passages_))))
        rows.extend([(len(rows) + k, f"{prose(rng, 120 + rng.randrange(60))} {t} {prose(rng, 120)}") for k, t in enumerate(passages_)])

    for k in range(250):
        words = prose(rng, 50).split()
        plant(" ".join(words), " ".join([*words[: 5 + k % 40], "edit", *words[6 + k % 40 :]]))
    for _ in range(20):
        words = prose(rng, 98).split()
        plant(" ".join([*words[:49], prose(rng, 7), *words[49:]]), " ".join([*words[:49], prose(rng, 7), *words[49:]]))
    fragments = []
    for _ in range(40):
        words = prose(rng, 50).split()
        plant(" ".join(words), " ".join(words))
        fragments += [f"{prose(rng, 20)} {' '.join(words[at : at + 30])} {prose(rng, 20)}" for at in range(0, 21, 5)]
    rows += [(10_000 + k, t) for k, t in enumerate(fragments)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {frozenset((r.doc_id, r.of_doc_id)) for r in found}
    assert pairs == {frozenset(d) for d in due}
    assert all(r.similarity >= 0.8 and min(r.end - r.start, r.of_end - r.of_start) >= 50 for r in found)


def test_places_that_share_too_little_are_not_aligned(spark, monkeypatch):
    """Documents that share 30 words and no passage meet their class's first alone; two of them that share more meet as well."""
    rng, verified, plain = random.Random(52), [], passages._verified

    def counted(known, pairs, run):
        pairs = pairs.localCheckpoint()
        verified.append({(r.id, r.of) for r in pairs.collect()})
        return plain(known, pairs, run)

    monkeypatch.setattr(passages, "_verified", counted)
    part, more = prose(rng, 30), prose(rng, 40)
    rows = [(k, f"{prose(rng, 40 + k)} {part} {prose(rng, 60)}") for k in range(14)]
    rows += [(20 + k, f"{prose(rng, 40)} {'the ' * 30} {prose(rng, 70 + k)}") for k in range(14)]
    rows += [(40 + k, f"{prose(rng, 60)} {part} {more} {prose(rng, 70)}") for k in range(2)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {frozenset((r.doc_id, r.of_doc_id)) for r in found} == {frozenset((40, 41))}
    assert sum(map(len, verified[1:])) <= 1 < len(verified[0])


def test_what_may_share_a_passage_by_its_contexts():
    """Two equal runs around a gap, in either direction, against the similarity of the passage that they make."""
    rng, due, contexts = random.Random(3), [], ([], [])
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    def context(words, c):
        ids = (passages.WordHashes().of([" ".join(words).encode()])[0] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        return [ids[k] if 0 <= k < len(ids) else 0 for k in range(c - passages.REACH, c + passages.RUN + passages.REACH)]

    for _ in range(1500):
        one, two, gaps = new(rng.randint(12, 60)), new(rng.randint(0, 49)), [new(rng.randint(0, 7)) for _ in range(2)]
        c, turn = rng.randint(0, len(one) - 12), rng.random() < 0.5
        texts = [one + gap + two for gap in gaps]
        a, b = map(grams, texts)
        near = len(one) >= 25 and len(two) >= 5 and min(map(len, texts)) >= 50 and len(a & b) >= 0.8 * len(a | b)
        due.append(near or len(one) >= 50)
        for held, text in zip(contexts, texts):
            before = new(rng.randint(0, 70))
            words = before + text + new(rng.randint(0, 70))
            at = len(before) + c
            held.append(context(words[::-1] if turn else words, len(words) - at - 12 if turn else at))
    rows, (x, y) = np.arange(1500), (np.array(h, np.uint32) for h in contexts)
    got = passages.may_share(x, y, rows, rows) > 0
    assert sum(due) > 200 and not (np.array(due) & ~got).any() and (got & ~np.array(due)).mean() < 0.05
    assert not passages.may_share(x, y, rows, np.roll(rows, 1)).any()


def test_near_copies_are_covered_by_a_part_of_their_class(spark, monkeypatch):
    """Near copies behind fragments that come first in their classes: few of their places have to meet the whole class."""
    opened, plain = {}, passages._partners

    def counted(full, words, scope, met=None):
        opened[scope] = full.where("open").count()
        return plain(full, words, scope, met)

    monkeypatch.setattr(passages, "_partners", counted)
    rng = random.Random(71)
    base = prose(rng, 160).split()
    edited = [[f"x{rng.randrange(10**6)}" if rng.random() < 0.03 else w for w in base] for _ in range(90)]
    rows = [(k, f"{prose(rng, 60)} {' '.join(words)} {prose(rng, 60)}") for k, words in enumerate(edited)]
    rows += [(100 + at, f"{prose(rng, 10)} {' '.join(base[at : at + 30])} {prose(rng, 10)}") for at in range(0, 131, 2)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {(doc, at) for r in found for doc, s, e in ((r.doc_id, r.start, r.end), (r.of_doc_id, r.of_start, r.of_end)) for at in range(s, e)}
    runs = {}
    for k, words in enumerate(edited):
        for at in range(len(words) - 49):
            runs.setdefault(tuple(words[at : at + 50]), []).append((k, at + 60))
    repeated = {(k, at + w) for held in runs.values() if len(held) > 1 for k, at in held for w in range(50)}
    assert len(repeated) > 5000 and len(repeated - covered) <= 0.001 * len(repeated)
    assert opened["part"] > 200 and opened.get("class", 0) < 0.25 * opened["part"]


def test_shingles_of_many_contexts_and_gaps_where_no_run_is_long():
    rng = np.random.default_rng(5)
    words = rng.integers(1, 2**32, (4, 12 + 2 * passages.REACH), dtype=np.uint64)
    assert (passages._shingled(words, 5) == np.stack([passages._shingled(w, 5) for w in words])).all()
    one = words[:1].astype(np.uint32)
    far, run, gap = words[1:].astype(np.uint32)
    run[60:112] = one[0, 60:112]  # 52 words around the token
    gap[60:100], gap[101:] = one[0, 60:100], one[0, 101:]  # 40 words, another one, and many more
    others, i, j = np.stack([far, run, gap]), np.zeros(3, np.int64), np.arange(3)
    assert passages.may_share(one, others, i, j).tolist() == [0, 52, 40]
    assert passages.may_share(one, others, i, j, sure=True).tolist() == [0, 52, 0]
    assert passages.may_share(one, others[[0, 2]], i[:2], j[:2], sure=True).tolist() == [0, 40]


def test_a_class_of_many_parts_is_dealt_out(spark, monkeypatch):
    """A salted class: members link to their part's first, the firsts to the first of all."""
    monkeypatch.setattr(passages, "HOT", 1e-6)
    monkeypatch.setattr(passages, "SALTS", 4)
    rng = random.Random(6)
    shared = prose(rng, 60)
    rows = [(k, f"{prose(rng, 30 + k % 7)} {shared} {prose(rng, 30)}") for k in range(60)] + [(k, prose(rng, 120)) for k in range(60, 80)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} | {r.of_doc_id for r in found} == set(range(60)) and len({r.doc_id for r in found}) == 59


def near_rows(rng, base, n, share):
    return [" ".join(f"e{rng.randrange(10**7)}" if rng.random() < share else w for w in base) for _ in range(n)]


def test_near_copies_against_brute_force(spark):
    """Pairs at a similarity of 0.8 and a little more, and two large groups of copies, most of which are less similar to each other."""
    rng = random.Random(21)
    texts = []
    for k in range(150):
        base = prose(rng, rng.choice((60, 150, 400))).split()
        texts += [" ".join(base), *near_rows(rng, base, 1, rng.choice((0.01, 0.018)))]
    for share in (0.018, 0.03):
        texts += near_rows(rng, prose(rng, 200).split(), 150, share)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    where = {}
    for i, x in enumerate(sets):
        for gram in x:
            where.setdefault(gram, []).append(i)
    near = {(i, j) for ids in where.values() for i in ids for j in ids if i < j}
    pairs = [(i, j) for i, j in near if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = plain_groups(range(len(texts)), pairs)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(rows).collect()}
    assert all(want[i] == want[c] for i, c in got.items())
    small = [(i, j) for i, j in pairs if j < 300]
    assert len(small) > 60 and sum(got[i] == got[j] for i, j in small) >= 0.97 * len(small)
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.95 * len(pairs)
    spare = lambda of: sum(i != c for i, c in of.items())
    assert spare(got) >= 0.95 * spare(want)
