"""The corpus pipeline's stages on planted cases, and against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(6)
    clean = {k: prose(rng, rng.randint(80, 140)) for k in range(40)}
    shared = prose(rng, 65)
    rows = [(k, t, "en", "a") for k, t in clean.items()]
    rows += [(100, clean[3], "en", "a"), (101, clean[4].replace(" ", "\n", 3), "en", "b"), (102, " ".join(["edited", *clean[5].split()[1:]]), "en", "a")]
    rows += [(110, f"{prose(rng, 60)} {shared} {prose(rng, 60)}", "en", "a"), (111, f"{prose(rng, 90)} {shared} {prose(rng, 70)}", None, "a")]
    rows += [(120, None, "en", "a"), (121, "", "en", "a"), (122, "12 34 !!", "en", None), (123, "# $ % & * | < > " * 60, "en", "a"), (124, "again and again we say " * 40, "en", "a"), (None, prose(rng, 100), "en", "a")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    return df.withColumn("score", F.lit("clash")).withColumn("spans", F.lit(1)), clean, shared


def test_stages_keep_clean_documents_and_catch_planted_ones(spark, planted):
    docs, clean, shared = planted
    kept = {}
    for name, stage in C.STAGES[:4]:
        docs = C.materialise(stage(spark, docs, ""), "stage")
        assert docs.columns == list(C.COLUMNS)
        kept[name] = {r.doc_id for r in docs.collect()}
    assert not kept["language ID"] & {120, 121, 122} and set(clean) | {100, 101, 102, 110, 111, None} <= kept["language ID"]
    assert not kept["quality rules"] & {123, 124} and set(clean) | {100, 101, 102, 110, 111, None} <= kept["quality rules"]
    assert kept["SimHash near-dedup"] == set(clean) | {110, 111, None}
    texts = {r.doc_id: r for r in docs.collect()}
    assert kept["substring dedup"] == set(clean) | {110, 111, None}
    assert shared in texts[110].text and shared.split()[20] not in texts[111].text.split()
    assert all(texts[k].text == t for k, t in clean.items()) and all(r.n_chars == len(r.text) for r in texts.values())
    packed = C.packing_stage(spark, docs, "").collect()
    assert {r.doc_id for r in packed} == set(texts) and len({(r.doc_id, r.piece) for r in packed}) == len(packed)


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_cutting_words():
    text = " one two\nthree  four five "
    assert C.without(text, [(1, 3)]) == "one\nfour five" and C.without(text, [(0, 5)]) == "" and C.without(text, []) == text.strip()
    assert C.without(None, [(0, 1)]) is None and C.without(text, [(0, 2), (1, 4)]) == "five" and C.without("a b", [(5, 9)]) == "a b"


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    rng = random.Random(16)
    shared, one, other = prose(rng, 70), prose(rng, 90), prose(rng, 110)
    rows = [(1, one), (1, f"{other} {shared}"), (2, f"{prose(rng, 40)} {shared}"), (None, other), (3, one), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)
    kept = C.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(r.text or "" for r in kept) == sorted(t or "" for t in {t for _, t in rows})
    cut = [r.text for r in C.substring_stage(spark, docs.where("text IS NOT NULL"), "").collect()]
    assert sum(shared in t for t in cut) == 1 and sum(other in t for t in cut) == 1 and cut.count(one) == 1


def test_language_stage_without_labels_keeps_texts_with_letters(spark):
    docs = spark.createDataFrame([(1, "some words", None, "a", 10), (2, "12 34", None, "a", 5), (3, None, None, "a", 0)], SCHEMA)
    assert [r.doc_id for r in C.language_stage(spark, docs, "").collect()] == [1]


def test_near_duplicates_are_the_operators_groups(spark, monkeypatch):
    """What operator 8 links goes, by its grid, though its five-word shingles be unlike; then what is similar."""
    rng = random.Random(26)
    one = prose(rng, 120)
    rows = [(1, one), (2, f"{one}."), (3, prose(rng, 120)), (4, "# - #"), (5, "# - #\n")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    seen, plain = [], C.simhash.links

    def counted(distinct):
        seen.append(distinct.count())
        return plain(distinct)

    monkeypatch.setattr(C.simhash, "links", counted)
    groups = {r.doc_id: r.component_id for r in C.simhash.near_duplicates(docs).collect()}
    kept = {r.doc_id for r in C.near_duplicate_stage(spark, docs, "").collect()}
    assert seen and len(seen) == 2 and kept == {1, 3, 4} and kept <= {i for i, c in groups.items() if i == c}
