"""Context trees against a direct recursion, and held-out accuracy."""

import math
import zlib

import numpy as np

from weftline.llm import language_id as L


def direct_bits(counts, text):
    """Code length by asking the tree byte by byte."""
    raw, total = bytes(L.ORDER) + text.encode(), 0.0
    for i in range(L.ORDER, len(raw)):
        context = raw[i - L.ORDER : i]
        while context not in counts:
            context = context[1:]
        while True:
            row = counts[context]
            n, d = row.sum(), np.count_nonzero(row)
            if row[raw[i]]:
                total -= math.log2(row[raw[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
            if not context:
                total += 8
                break
            context = context[1:]
    return total


def test_tables_equal_the_recursion():
    texts = {"aa": ["abra cadabra", "über äpfel", "a"], "bb": ["the cat the hat", "zzz \x00"]}
    counts = {k: L.count_contexts(v) for k, v in texts.items()}
    trees = L.assemble({k: L.code_costs(c) for k, c in counts.items()})
    probes = ["abra", "the über cat", "", "日本", "zz\x00z", "q" * 50, "x\U0001f389y"]
    want = np.array([[direct_bits(counts[k], t) for k in trees.langs] for t in probes])
    assert np.allclose(trees.lengths(probes), want, rtol=1e-6, atol=1e-4)
    assert np.array_equal(trees.lengths(probes), np.vstack([trees.lengths([t]) for t in probes]))


def test_costs_are_a_code():
    for row in L.code_costs(L.count_contexts(["abra cadabra", "die der das"])).values():
        assert np.exp2(-row).sum() <= 1 + 1e-9


def test_no_language_and_odd_texts(spark):
    assert L.assemble({}).predict(["abc", None])[0] == ["und", "und"]
    docs = spark.createDataFrame([(1, "hello there my friend", None, "x"), (None, None, "en", "x"), (3, "12 34 !?", "en", "x"), (4, "", "en", "x")] + [(10 + i, "the cat and the hat", "en", "x") for i in range(6)], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in L.language_id(docs).collect()}
    assert got[1]["lang_pred"] == "en" and got[None]["lang_pred"] == got[3]["lang_pred"] == got[4]["lang_pred"] == "und"
    assert got[3]["score"] == 0 and got[None]["held_out"] is False
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got if i is not None)
    assert L.language_id(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in L.language_id(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("lang is null")).collect()} <= {"und"}


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = L.language_id(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 30").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_prediction_is_of_the_text_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(~L.held_out()).limit(60)
    trees = L.learn(docs)
    text = docs.first()["text"]
    other = spark.createDataFrame([(0, text, "fr"), (1, text, "de"), (999, text, None)], "doc_id long, text string, lang string")
    assert len({(r["lang_pred"], r["score"]) for r in L.predict_languages(other, trees).collect()}) == 1


def test_languages_of_long_texts_alone_are_learned(spark):
    rng = np.random.default_rng(0)
    word = lambda stems: "".join(rng.choice(stems, 2))
    text = lambda stems, n: " ".join(word(stems) for _ in range(n))
    one, two = ["zor", "kul", "vem", "ryx"], ["the", "and", "ing", "hat"]
    rows = [(i, text(one, 5000), "xx") for i in range(30)] + [(100 + i, text(two, 20), "en") for i in range(30)] + [(200 + i, None, "xx") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = L.training_sample(docs).collect()
    assert all(len(r["text"]) <= L.SAMPLE_CHARS for r in sample) and sum(r["lang"] == "xx" for r in sample) == 30
    got = {r["doc_id"]: r["lang_pred"] for r in L.language_id(docs).collect()}
    assert all(got[i] == "xx" for i in range(30)) and all(got[100 + i] == "en" for i in range(30))


def test_columns_of_the_results_names(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "x", 2, "y")], "doc_id long, text string, lang string, Score string, bits_per_byte int, lang_pred string")
    out = L.predict_languages(docs, L.learn(docs.unionByName(docs)))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "bits_per_byte"] and out.first()["lang_pred"] == "en"
