"""The pipeline's stages, each on what its predecessor kept."""

import corpus_pipeline
from weftline.llm import decontaminate, language_id, near_dup, pii
from weftline.llm._shared import stash, table


def test_stages(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "near-duplicates", "decontamination", "personal data", "BPE"]
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stash(stage(spark, docs, sf_dir), "test")
        kept.append(out.count())
        if name != "BPE":
            assert out.columns == columns
        if name == "near-duplicates":
            classes = near_dup.near_duplicate_classes(docs).collect()
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["class_id"] for r in classes}
        if name == "decontamination":
            bad = {r["doc_id"] for r in decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).collect()}
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()} - bad
        if name == "personal data":
            assert out.where("text like '%@mail%.example.com%'").count() == 0 < docs.where("text like '%@mail%.example.com%'").count()
        docs = out
    assert kept[0] >= 0.98 * table(spark, sf_dir, "documents").count() and kept[0] > kept[1] > kept[2] == kept[3] == kept[4]
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))


def test_odd_documents(spark, tmp_path, sf_dir):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "12 34", "en", "s", 5), (None, "the words of a text without a number", "en", "s", 36), (4, "the cat sat on the mat with a hat", "en", "s", 33), (4, "the cat sat on the mat with a hat", "en", "s", 33), (5, "the cat sat on the mat with a hat", "en", "s", 33)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        out = some
        for _, stage in corpus_pipeline.STAGES:
            out = stash(stage(spark, out, sf_dir), "test")
        assert sorted(str(r["doc_id"]) for r in out.collect()) == (["4", "4", "None"] if some is docs else [])


def test_clashing_columns(spark, sf_dir):
    names = ["lang_pred", "score", "bits_per_byte", "class_id", "item_id", "hash", "terms", "spans", "text_hash", "n_tokens", "bucket", "component", "label", "key"]
    docs = table(spark, sf_dir, "documents").limit(30)
    docs = docs.selectExpr("*", *[f"'{x}' AS {x}" for x in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stash(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns and docs.count(), name
        assert all(r[x] == x for r in docs.collect() for x in names)
    assert stash(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir), "test").count() == docs.count()


def test_session_settings_stay(spark, sf_dir):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "5000")
    try:
        docs = table(spark, sf_dir, "documents")
        language_id.language_id(docs).count()
        pii.sanitise(docs).count()
        near_dup.near_duplicate_classes(docs).count()
        assert spark.conf.get(key) == "5000"
        corpus_pipeline.run(spark, sf_dir)
        assert spark.conf.get(key) == "5000"
    finally:
        spark.conf.unset(key)


def test_a_worker_keeps_what_one_operator_needs():
    from weftline.llm import _shared, bpe

    dropped = []
    _shared.begin("one", lambda: dropped.append("one"))
    _shared.begin("one", lambda: dropped.append("one"))
    assert dropped == []
    _shared.begin("two", lambda: None)
    assert dropped == ["one"] and list(_shared._keeps) == ["two"]
    bpe._loaded["x"] = None
    _shared.begin("bpe", bpe.forget)
    _shared.begin("two", lambda: None)
    assert not bpe._loaded
