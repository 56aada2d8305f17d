"""Operators 2, 3 and 5."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import language_id, licences, quality

CLEAN = "the quick brown fox of number {k} jumps over a lazy dog near river {j} while seven small birds sing along {i} and rest"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, CLEAN.format(k=k, j=k * 7 % 31, i=k * 5 % 17) * 1 + f" tail{k % 11} end", "en" if k % 2 else None, f"s{k % 2}") for k in range(120)]
    odd = [None, "", " \n\t ", "one two", "a b c d e " * 30, "x#y $z &w |v <u> " * 20, "line one is here for all\nline one is here for all\nother words follow after that now", "w " * 20000]
    rows += [(200 + k, t, "de", None) for k, t in enumerate(odd)] + [(200, None, "de", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit("clash"))


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(docs):
    rows = quality.quality_rules(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        n, *rest = plain_counts(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [n, *rest]
        assert r.base_failed == (n < 10 or 100 * rest[-1] > 20 * n)
        assert not (r.base_failed and r.kept)
    verdict = {r.doc_id: r.kept for r in rows}
    assert all(verdict[k] for k in range(120))
    assert not verdict[205] and not verdict[200]
    assert quality.quality_rules(docs.where("false")).count() == 0


def test_quality_rejects_an_outlier_and_equals_sql(spark):
    rows = [(k, CLEAN.format(k=k, j=k % 9, i=k % 7), "en", "a") for k in range(60)] + [(99, " ".join(f"#{k}$&%|{k * 3}<>" for k in range(80)), "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = quality.quality_rules(df)
    assert {r.doc_id for r in out.collect() if not r.kept} == {99}
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    cols = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"
    want = con.sql(f"SELECT {cols} FROM ({quality.oracle_sql()}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in out.select(*cols.split(", ")).orderBy("doc_id").collect()] == want


def test_consistency_factor():
    assert quality.consistency(0.75) == pytest.approx(1.4853, abs=5e-3)


def test_licences(spark):
    mit = dict(licences.TEMPLATES)["MIT"]
    full = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 400)
    rows = [(1, "Prose first.\nReleased under the MIT License.\nMore prose."), (2, None), (3, ""), (4, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (5, "nothing to see here"), (6, full.replace(". ", ".\n")), (6, full), (7, "Released under the MIT"), (8, "license " * 30000)]
    rows += [(9, "This repository is released under the MIT License. See the file for details and contact us at once."), (10, "Words before. " + full.replace("Software is furnished", "Software\n\nis furnished").replace(" included in all", "\nincluded in all\n\n") + "\nand words after, on the same page."), (11, "Copyright 2021 Foo. Licensed under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licence", F.lit("clash"))
    got = sorted((r.doc_id, r.licence, r.licences, r.n_units) for r in licences.licence_scan(df).collect())
    assert mit and got[0] == (1, "MIT", "MIT", 1)
    assert got[1][1:] == (None, "", 0) and got[2][1:] == (None, "", 0)
    assert got[3][2] == "Apache-2.0,CC-BY-NC-4.0" and got[4][1] is None
    assert got[5][1] == got[6][1] == "MIT" and got[8][1] is None
    assert [r[1] for r in got[9:]] == ["MIT", "MIT", "MIT"]
    con = duckdb.connect()
    single = df.where("doc_id <> 6")
    con.register("documents", single.toPandas())
    want = con.sql(f"SELECT doc_id, licence, dice, licences, n_units, n_windows FROM ({licences.oracle_sql()}) ORDER BY ALL").fetchall()
    have = sorted((tuple(r) for r in licences.licence_scan(single).collect()), key=str)
    assert Counter(map(str, want)) == Counter(map(str, have))
    assert licences.licence_scan(df.where("false")).count() == 0


def test_language_held_out_accuracy_and_edges(spark):
    words = {"aa": ["zor", "kiv", "plu", "mek"], "bb": ["été", "çaé", "où", "èr"], "cc": ["schü", "straß", "önd", "ich"]}
    rows = []
    for k in range(360):
        lang = ["aa", "bb", "cc"][k % 3]
        rows.append((k, " ".join(words[lang][(k * 7 + j * j) % 4] for j in range(40)), lang))
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", "cc"), (1003, "zor kiv " * 20000, None), (1004, "plu", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    net = language_id.train(df.where(~held), "text", "lang", F.col("doc_id"))
    out = {r.doc_id: r for r in language_id.predict_language(df.withColumn("held", held), net).collect()}
    tested = [r for r in out.values() if r.held and r.doc_id < 1000]
    assert sum(r.lang_pred == r.lang for r in tested) >= 0.97 * len(tested) > 0
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (1000, 1001, 1002))
    assert out[1003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in out.values())
    assert language_id.train(df.where("false"), "text", "lang", F.col("doc_id")) is None
    assert {r.lang_pred for r in language_id.predict_language(df, None).collect()} == {"und"}
    assert language_id.predict_language(df.where("false"), net).count() == 0


def test_language_is_learned_past_a_text_s_start_and_for_many_labels(spark):
    rows = [(k, "12345 67890 " * 200 + ("ab ba " if k % 2 else "xy yx ") * 150, "one" if k % 2 else "two") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.train(df, "text", "lang", F.col("doc_id"))
    got = language_id.predict_language(df.select("doc_id", F.expr("substring(text, 2401, 900)").alias("text"), "lang"), net).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    many = spark.createDataFrame([(k, "abc def", f"l{k % 260}") for k in range(520)], "doc_id long, text string, lang string")
    assert len(language_id.train(many, "text", "lang", F.col("doc_id"), language_id.Shape(epochs=1)).labels) == 260


def test_network_equals_a_plain_one():
    """Forward pass and gradient, by loops and by differences."""
    shape = language_id.Shape(window=12, epochs=1, batch=4, filters=2, embedding=3)
    net = language_id.ByteConvNet(["a", "b"], shape)
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 256, (4, 12)).astype(np.uint8), np.array([0, 1, 0, 1])

    def logs(row):
        pooled = []
        for f in range(net.n):
            width = shape.widths[f // shape.filters]
            best = max(sum(float(net.conv[f, k] @ net.emb[:, row[p + k]]) for k in range(width)) for p in range(12 - net.wide + 1))
            pooled.append(max(best + float(net.bias[f]), 0.0))
        z = net.out @ np.array(pooled) + net.out_bias
        return z - np.log(np.exp(z).sum())

    assert np.allclose(net.log_probabilities(x), [logs(r) for r in x], atol=1e-4)
    loss = lambda: -np.mean([logs(r)[k] for r, k in zip(x, y)])
    before, kept = loss(), {k: getattr(net, k).copy() for k in ("emb", "conv", "bias", "out", "out_bias")}
    net.fit(x, y)  # one Adam step moves each weight by the rate against its gradient's sign
    for name, was in kept.items():
        now = getattr(net, name)
        moved = [i for i in np.ndindex(was.shape) if abs(now[i] - was[i]) > 0.5 * shape.rate][:12]
        after = now.copy()
        for other, value in kept.items():
            setattr(net, other, value.copy())
        for i in moved:
            getattr(net, name)[i] += np.float32(1e-3) * np.sign(after[i] - was[i])
            assert loss() <= before + 1e-6
            getattr(net, name)[i] = was[i]
        setattr(net, name, after)
