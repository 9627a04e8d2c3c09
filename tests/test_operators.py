"""Frames, stores, sequences, texts and streams on small rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vectors as V
from weftline.operators import align, frames, graph, kv, search, sequence, vectors
from weftline.streaming import steps


@pytest.mark.parametrize("keys, kind", [([3, 1, 2, 2, None, 9, -4], "long"), (["b", "a", None, "ab", "é", "", "abcdefgh", "abcdefga"], "string"), ([0.5, -1.0, 2.0, 2.0], "double")])
def test_positions(spark, keys, kind):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"k {kind}, tie int").repartition(3)
    got = sorted(((r["pos"], r["k"], r["tie"]) for r in frames.with_position(df, ["k", "tie"]).collect()))
    want = sorted(((k, i) for i, k in enumerate(keys)), key=lambda x: (x[0] is not None, x[0].encode() if isinstance(x[0], str) else x[0] or 0, x[1]))
    assert got == [(p, *x) for p, x in enumerate(want)]


def test_zip_needs_equal_lengths(spark):
    a, b = spark.range(5).withColumnRenamed("id", "a"), spark.range(4).withColumnRenamed("id", "b")
    assert frames.zip_frames([a, spark.range(5).withColumnRenamed("id", "b")], ["a", "b"]).where("a = b").count() == 5
    with pytest.raises(Exception, match="different lengths"):
        frames.zip_frames([a, b], ["a", "b"]).collect()


def test_vectors_without_length(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    got = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.normalize(F.col("a")).alias("n"), V.euclidean(F.col("a"), F.col("b")).alias("e")).collect()
    assert got[0]["c"] == 0 and got[0]["n"] == [0, 0] and got[1]["c"] == pytest.approx(1) and got[1]["n"] == pytest.approx([0.6, 0.8]) and got[1]["e"] == 0


def test_search_of_nothing_and_too_many(spark, monkeypatch):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query array<double>")
    c = spark.createDataFrame([], "id int, v array<double>")
    assert vectors.top_k(q, c, 3, vector="v").count() == 0
    rng = np.random.default_rng(1)
    many = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "query_id int, query array<double>")
    held = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "id int, v array<double>")
    one = sorted(map(tuple, vectors.top_k(many, held, 3, vector="v").collect()))
    monkeypatch.setattr(vectors, "QUERY_BYTES", 300)  # cut into blocks, each a broadcast of its own
    assert sorted(map(tuple, vectors.top_k(many, held, 3, vector="v").collect())) == one and len(one) == 90


def _plain_score(metric, q, c):
    """The score in plain Python; None without one."""
    from functools import reduce
    from operator import add

    if q is None or c is None or len(q) != len(c) or None in q or None in c:
        return None
    with np.errstate(all="ignore"):
        q, c, total = np.array(q, float), np.array(c, float), lambda v: np.float64(reduce(add, v.tolist(), 0.0))  # sum() compensates
        if metric == "euclidean":
            return float(np.sqrt(total((q - c) * (q - c))))
        a, b, dot = np.sqrt(total(q * q)), np.sqrt(total(c * c)), total(q * c)
        return float(dot) if metric == "dot" else 0.0 if a == 0 or b == 0 else float(dot / (a * b))


def _odd_vectors(rng, n):
    """Small vectors with ties, nulls, other lengths, and values that can't be squared."""
    out = []
    for _ in range(n):
        odd = [None, [1.0, None, 2.0], [], [1.0, 2.0], [0.0] * 3, [rng.choice([math.nan, math.inf, -math.inf, 1e200, 1e-200, 0.0]) for _ in range(3)]]
        out.append(rng.choice(odd) if rng.random() < 0.25 else [float(rng.randint(-1, 1)) if rng.random() < 0.6 else rng.gauss(0, 1) for _ in range(3)])
    return out


def _blocks(rng, queries, candidates):
    """Both sides in Arrow, the candidates in batches."""
    import pyarrow as pa

    stated = pa.table({"query_id": pa.array(range(len(queries)), pa.int64()), "query": pa.array(queries, pa.list_(pa.float64()))})
    rows = pa.table({"__0": pa.array(range(len(candidates)), pa.int64()), "__vector": pa.array(candidates, pa.list_(pa.float64()))})
    return stated, iter(rows.to_batches(max_chunksize=rng.choice([4, 9, 100])))


def _said(found):
    return sorted((q, c, str(s)) for q, c, s in found)


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_nearest_in_blocks_equals_all_pairs(metric, monkeypatch):
    from weftline.functions import scores

    monkeypatch.setattr(scores, "TILE", 5), monkeypatch.setattr(scores, "PAIRS", 7), monkeypatch.setattr(scores, "OUT", 11)
    rng = random.Random(metric)
    for k in [1, 2, 5, 40] * 10:
        queries, candidates = _odd_vectors(rng, rng.choice([0, 1, 13])), _odd_vectors(rng, rng.choice([0, 3, 30]))
        stated, batches = _blocks(rng, queries, candidates)
        got = [(r["__query"], r["__0"], r["__score"]) for b in scores.nearest(batches, stated, k, metric, "__vector") for r in b.to_pylist()]
        order = lambda s: (3, 0.0) if s is None else ((2 if metric == "euclidean" else 0), 0.0) if math.isnan(s) else (1, s if metric == "euclidean" else -s)
        want = [(i, j, s) for i, q in enumerate(queries) for _, j, s in sorted((order(s), j, s) for j, c in enumerate(candidates) for s in [_plain_score(metric, q, c)])[:k]]
        assert _said(got) == _said(want)


def test_search_gives_rows_without_a_vector_last(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, query array<double>")
    c = spark.createDataFrame([("b", None, 1), ("a", [3.0, 0.0], 2), ("d", [1.0, 1.0], 3), ("c", [1.0, 1.0], 4)], "id string, v array<double>, label int")
    found = vectors.search(q, c, 3, None, ["label"], vector="v")
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()  # pairs are no rows
    got = sorted((r["query_id"], r["rank"], r["id"], r["distance"], r["label"]) for r in found.collect())
    assert got == [(1, 1, "c", 1.0, 4), (1, 2, "d", 1.0, 3), (1, 3, "a", 2.0, 2), (2, 1, "a", None, 2), (2, 2, "b", None, 1), (2, 3, "c", None, 4)]


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_threshold_in_blocks_equals_all_pairs(spark, metric, monkeypatch):
    from weftline.functions import scores

    rng = random.Random(metric)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, query array<double>")
    c = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [-9.0, 0.0])], "id int, v array<float>")
    found = vectors.within_threshold(q, c, 0.5, metric, vector="v")
    assert "NestedLoop" not in found._jdf.queryExecution().toString()  # pairs are no rows
    assert [tuple(r) for r in found.collect()] == [(1, 2, 0.0 if metric == "euclidean" else 1.0)]
    monkeypatch.setattr(scores, "TILE", 5), monkeypatch.setattr(scores, "PAIRS", 7), monkeypatch.setattr(scores, "OUT", 11)
    for threshold in [-1.0, 0.0, 0.5, 1.0, 2.0, math.inf] * 6:
        queries, candidates = _odd_vectors(rng, rng.choice([0, 1, 13])), _odd_vectors(rng, rng.choice([0, 3, 30]))
        stated, batches = _blocks(rng, queries, candidates)
        got = [(r["__query"], r["__0"], r["__score"]) for b in scores.reaching(batches, stated, threshold, metric, "__vector") for r in b.to_pylist()]
        scored = [(i, j, _plain_score(metric, q, c)) for i, q in enumerate(queries) for j, c in enumerate(candidates)]
        assert _said(got) == _said(x for x in scored if x[2] is not None and (x[2] <= threshold if metric == "euclidean" else math.isnan(x[2]) or x[2] >= threshold))


def test_top_k_makes_no_row_per_pair(spark, sf_dir):
    import __spark_entry__ as entry

    plan = entry.queries()["vec_topk"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan
    q = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id int, query array<double>")  # one id, two vectors
    c = spark.createDataFrame([(i, [1.0, float(i % 3 == 0)]) for i in range(50)], "id int, v array<double>")
    assert sorted((r["rank"], r["id"]) for r in vectors.top_k(q, c, 3, vector="v").collect()) == [(1, 1), (2, 2), (3, 4)]
    assert vectors.top_k(q.limit(0), c, 3, vector="v").count() == 0


def test_copies_are_not_scored_with_every_query(monkeypatch):
    from weftline.functions import scores

    scored, exact = [], scores.exact
    monkeypatch.setattr(scores, "exact", lambda metric, q, c, i, j: scored.append(len(i)) or exact(metric, q, c, i, j))
    candidates = [[1.0, 2.0, 3.0]] * 400 + [[1.0, 2.0, 4.0]]
    stated, batches = _blocks(random.Random(5), [[1.0, 2.0, 3.0]] * 50, candidates)
    got = [(r["__query"], r["__0"]) for b in scores.nearest(batches, stated, 2, "euclidean", "__vector") for r in b.to_pylist()]
    assert sorted(got) == [(q, c) for q in range(50) for c in (0, 1)] and sum(scored) <= 50 * len(candidates) / 2


def test_kv_expiry(spark):
    log = spark.createDataFrame([("a", "1", 1, None), ("a", "2", 2, 10.0), ("b", "x", 1, 5.0), ("c", None, 1, None)], "key string, value string, seq int, expires_at double")
    keys = spark.createDataFrame([("a",), ("b",), ("a",), ("z",), ("c",)], "key string")
    assert sorted((r["key"], str(r["value"])) for r in kv.get(keys, log, 7.0).collect()) == [("a", "2"), ("a", "2"), ("b", "None"), ("c", "None"), ("z", "None")]
    assert {r["key"]: r["exists"] for r in kv.exists(keys, log, 11.0).collect()} == {"a": False, "b": False, "c": False, "z": False}


def test_graph_cycles(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, label string")
    edges = spark.createDataFrame([(1, "a", "b", "t"), (2, "b", "a", "t"), (3, "b", "c", "u")], "id int, src string, dst string, type string")
    start = nodes.where("id = 'a'")
    walk = lambda **k: sorted((r["node"], r["depth"]) for r in graph.traverse(nodes, edges, start, **k).collect())
    assert walk() == [("a", 2), ("b", 1), ("c", 2)]
    assert walk(types=["t"]) == [("a", 2), ("b", 1)] and walk(labels=["y"]) == [("c", 2)] and walk(direction="in", max_depth=1) == [("b", 1)]


def test_gap_merge_edges(spark):
    df = spark.createDataFrame([("s", 0.0, 10.0), ("s", 2.0, 3.0), ("s", 12.0, 13.0), ("s", 16.0, 16.5), ("t", 0.0, 1.0)], "k string, a double, b double")
    got = lambda gap, least=0.0: sorted((r["k"], r["start"], r["end"]) for r in sequence.merge_gaps(df, "k", "a", "b", gap, least).collect())
    assert got(2.0) == [("s", 0, 13), ("s", 16, 16.5), ("t", 0, 1)]
    assert len(got(0.0)) == 5 and got(2.0, 1.0) == [("s", 0, 13), ("t", 0, 1)]


def test_speech_hysteresis():
    machine = sequence.SpeechSegmenter(0.5, 0.35, 2, 1)
    found = []
    for t, p in enumerate([0.1, 0.6, 0.4, 0.3, 0.6, 0.6, 0.3, 0.4, 0.2, 0.9, 0.1, 0.1, 0.1, 0.7, 0.7, 0.7]):
        found += machine.feed(t, p)
    assert [(a, b) for a, b, _ in found + list(machine.flush())] == [(1, 6), (13, 15)]


def test_tracks(spark):
    rows = [("v", float(t), i, [1.0, 0.1 * t] if i == 0 else [0.0, 1.0], [0.0, 0.0, 1.0, 1.0]) for t in range(4) for i in range(2)]
    df = spark.createDataFrame(rows, "v string, ts double, who int, e array<double>, box array<double>")
    got = {(r["ts"], r["who"]): r["track"] for r in sequence.assign_tracks(df, "v", "ts", "e", "box", 0.7).collect()}
    assert len({got[t, 0] for t in range(4)}) == len({got[t, 1] for t in range(4)}) == 1 and got[0, 0] != got[0, 1]


def test_chunks():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "longerword ", "\n", "\n\n", "x" * 30, "é. "]) for _ in range(rng.randint(0, 60)))
        size, overlap = rng.randint(10, 80), rng.randint(0, 9)
        parts = T.chunk_text(text, size, overlap)
        assert all(p and p == p.strip() and len(p) <= size for p in parts)
        assert set("".join(text.split())) == set("".join("".join(parts).split()))
        if overlap == 0:
            assert "".join(text.split()) == "".join("".join(parts).split())
    assert T.chunk_text("", 10, 2) == [] and T.chunk_text("short", 10, 2) == ["short"]
    with pytest.raises(ValueError):
        T.chunk_text("x", 5, 6)


def test_sentences():
    assert T.sentences("One. Two!? Three… ... four") == ["One.", "Two!?", "Three…", "four"]
    assert T.sentences("A. B. Long enough.", 5) == ["A. B.", "Long enough."]
    assert T.sentences("aaa bbb ccc ddd", 0, 7) == ["aaa bbb", "ccc ddd"] and T.sentences("x" * 9, 0, 4) == ["xxxx", "xxxx", "x"]
    assert T.sentences("一。二！") == ["一。", "二！"] and T.sentences("") == []


def test_html_selectors():
    page = '<div id=m class="a b"><p>One <b>two</b></p><p class=x>three<script>no</script></p><img src=i.png></div><p>four'
    pick = lambda *a: T.select_html(page, *a)
    assert pick("p") == ["One two", "three", "four"] and pick("div p.x") == ["three"] and pick(".b") == ["One two three"] and pick("#m > p") == ["One two", "three"]
    assert pick("img[src]", "attribute", "src") == ["i.png"] and pick("b", "html") == ["<b>two</b>"] and pick("table") == []
    assert T.page_text(page) == "One two three four" and T.page_text(None) == ""


def test_alignment():
    reference = ["The quick brown fox jumps over the lazy dog and runs away home"]
    got = align.align([("the quik brown fox", 0.0, 2.0), ("zzzz qqqq", 2.0, 2.5), ("lazzy dog and", 4.0, 5.0)], reference)
    assert got[0] == (0.0, 2.0, "The quick brown fox", False) and got[1][2] == "zzzz qqqq"
    assert (got[2][2], got[2][3]) == ("jumps over the", True) and got[3][2] == "lazy dog and" and got[4] == (5.0, 5.0 + 3 / 2.5, "runs away home", True)


def _frames(spark, tmp_path, rows, schema, parts):
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return steps.source(spark, str(tmp_path / "in"), schema, files_per_trigger=1)


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value").limit(100).collect()]
    stream = _frames(spark, tmp_path, rows, "event_id long, value double", 3)
    out = steps.run_available(steps.filter_stream(stream, {"input": "${value}", "operator": "gt", "value": 50}), "s_filter", str(tmp_path / "c"))
    assert sorted(r["event_id"] for r in out.collect()) == sorted(i for i, v in rows if v > 50)


def test_fragments(spark, tmp_path):
    rows = [("a", 2, "c", True), ("b", 0, "x", False), ("a", 0, "a", False), ("a", 1, None, False), ("b", 1, "y", True)]
    stream = _frames(spark, tmp_path, rows, "id string, seq long, piece string, last boolean", 3)
    out = steps.run_available(steps.join_fragments(stream, "id", "seq", "piece", "last"), "s_join", str(tmp_path / "c"))
    assert sorted(map(tuple, out.collect())) == [("a", "ac"), ("b", "xy")]


def test_streamed_sentences_and_speech(spark, tmp_path):
    text = "First one. Second one! Third is open"
    rows = [("k", i, text[i * 5 : i * 5 + 5], i == 7) for i in range(8)]
    stream = _frames(spark, tmp_path, rows, "id string, seq long, piece string, last boolean", 1)
    out = steps.run_available(steps.split_sentences(stream, "id", "seq", "piece", "last"), "s_sent", str(tmp_path / "c"))
    assert [r["text"] for r in out.orderBy("pos").collect()] == T.sentences(text)
    p = [0.1, 0.9, 0.9, 0.9, 0.1, 0.1, 0.1, 0.9, 0.9]
    spark.createDataFrame([("k", float(i), x) for i, x in enumerate(p)], "id string, ts double, p double").coalesce(1).write.parquet(str(tmp_path / "vad"))
    speech = steps.speech_stream(steps.source(spark, str(tmp_path / "vad"), "id string, ts double, p double"), "id", "ts", "p", threshold=0.5, min_silence=2, min_speech=1)
    got = steps.run_available(speech, "s_vad", str(tmp_path / "c2")).collect()
    assert [(r["start"], r["end"]) for r in got] == [(1.0, 4.0)]


def test_spectrum(spark):
    wave = [("k", i, float(np.sin(i * np.pi / 2))) for i in range(128)]
    rows = sequence.spectrum_bands(spark.createDataFrame(wave, "k string, pos long, v double"), "k", "pos", "v", 64, 32, 4).collect()
    assert {r["frame"] for r in rows} == {0, 1, 2, 3} and all(max(r["bands"]) in r["bands"][1:3] for r in rows)


def test_positions_of_ties_prefixes_and_types(spark):
    rows = [(i, f"https://example.org/a/long/common/prefix/{i % 50:04d}", 1, None if i % 7 == 0 else float(i % 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, url string, same int, x double").repartition(5)
    for order in ("url", "same", "x", ["x", "url"], ["same", "id"], F.lower("url")):
        placed = frames.with_position(df, order).collect()
        assert sorted(r["pos"] for r in placed) == list(range(600))
        keys = [order] if isinstance(order, str) else order if isinstance(order, list) else ["url"]
        in_place = [tuple((r[k] is not None, r[k]) for k in keys) for r in sorted(placed, key=lambda r: r["pos"])]
        assert in_place == sorted(in_place, key=lambda t: [(a, b if a else 0) for a, b in t])
    # no bucket holds the rows of one head, nor those of one value
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for order in ("url", "same"):
            sizes = frames.with_position(df, order).groupBy(F.spark_partition_id()).count().collect()
            assert max(r["count"] for r in sizes) < 400
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert frames.with_position(df.limit(0), "url").count() == 0
    assert sorted(r["id"] for r in frames.prefix_fraction(df, "id", 0.1).collect()) == list(range(60))


def test_clip_equals_the_plain_condition(spark):
    rng = np.random.default_rng(3)
    spans = [(i, float(a), float(a + w)) for i, (a, w) in enumerate(zip(rng.uniform(-50, 300, 40), rng.choice([0.5, 3, 90, 400], 40), strict=True))]
    times = [(i, float(x)) for i, x in enumerate(rng.uniform(-60, 500, 300))] + [(1000 + i, s[1]) for i, s in enumerate(spans)] + [(2000 + i, s[2]) for i, s in enumerate(spans)] + [(5000, None)]
    got = sequence.clip(spark.createDataFrame(times, "id int, t double"), "t", spark.createDataFrame(spans, "span int, start double, end double"))
    assert sorted((r["id"], r["span"]) for r in got.collect()) == sorted((i, s) for i, t in times if t is not None for s, a, b in spans if a <= t < b)
    assert sequence.clip(spark.createDataFrame(times, "id int, t double"), "t", spark.createDataFrame([], "span int, start double, end double")).count() == 0


def test_speech_has_padding_probabilities_and_ends(spark, tmp_path):
    p = [0.1, 0.9, 0.8, 0.9, 0.4, 0.1, 0.4, 0.1, 0.9, 0.9, 0.9]
    machine = sequence.SpeechSegmenter(threshold=0.5, low=0.35, min_silence=2, min_speech=1, pad=0.5)
    got = [x for i, v in enumerate(p) for x in machine.feed(float(i), v)] + list(machine.flush())
    assert [(a, b) for a, b, _ in got] == [(0.5, 5.5), (7.5, 10.5)]
    assert abs(got[0][2] - np.mean([0.9, 0.8, 0.9, 0.4, 0.1, 0.4, 0.1])) < 1e-9 and abs(got[1][2] - 0.9) < 1e-9
    rows = [("k", float(i), v, i == len(p) - 1) for i, v in enumerate(p)] + [("open", 0.0, 0.9, False), ("open", 5.0, 0.9, False)]
    kinds = "id string, ts double, p double, end boolean"
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = steps.source(spark, str(tmp_path / "in"), kinds, files_per_trigger=1)
    out = steps.speech_stream(stream, "id", "ts", "p", last="end", threshold=0.5, low=0.35, min_silence=2, min_speech=1, pad=0.5)
    done = sorted(map(tuple, steps.run_available(out, "s_vad2", str(tmp_path / "c")).collect()))
    assert [x[:3] for x in done] == [("k", 0.5, 5.5), ("k", 7.5, 10.5)]


def test_selectors_and_paths():
    page = '<html><body><ul id=u><li class="a x">1<li-x>n</li-x></li><li class=b data-k="v-1">2<b>bold</b></li><li>3</li></ul><div><p lang=en-GB>one</p><span>s</span><p>two<i>it</i></p><p>three</p></div><section><div><p>deep</p></div></section></body></html>'
    pick = lambda s, *a: T.select_html(page, s, *a)
    for css, want in {
        "li": ["1 n", "2 bold", "3"], "p, b": ["bold", "one", "two it", "three", "deep"], "div > p": ["one", "two it", "three", "deep"], "body > div > p": ["one", "two it", "three"], "section p": ["deep"],
        "p + p": ["three"], "span ~ p": ["two it", "three"], "li:first-child": ["1 n"], "li:nth-child(2n+1)": ["1 n", "3"], "li:nth-child(even)": ["2 bold"], "li:last-child": ["3"], "li:not(.a)": ["2 bold", "3"],
        "p:nth-of-type(2)": ["two it"], "p:last-of-type": ["three", "deep"], "[data-k^=v]": ["2 bold"], "[data-k$='1']": ["2 bold"], "[class~=x]": ["1 n"], "[lang|=en]": ["one"], "[data-k*=\"-\"] b": ["bold"], "#u .b": ["2 bold"],
    }.items():
        assert pick(css) == want, css
    for path, want in {
        "//p": ["one", "two it", "three", "deep"], "//div/p[2]": ["two it"], "//ul/li[@class='b']/b": ["bold"], "//li[last()]": ["3"], "//li[contains(@class, 'x')]": ["1 n"], "//p[contains(text(), 'w')]": ["two it"],
        "/html/body/div/p[1]": ["one"], "//li/@class": ["a x", "b"], "//section//p/text()": ["deep"], "//*[@lang]": ["one"], "//b/..": ["2 bold"], "//li[@class and @data-k]": ["2 bold"], "//p[text()='three' or @lang]": ["one", "three"], "//li[@class!='b']": ["1 n"],
    }.items():
        assert pick(path) == want, path
    assert T.select_html("<b>x<b>y</b></b>", "b") == ["x y", "y"] and pick("i", "html") == ["<i>it</i>"]
    for bad in ("p >", "p:odd-one", "[", "//p[", "//p[1 +]"):
        with pytest.raises(ValueError):
            pick(bad)
    assert T.select_html("<div>" * 3000 + "x", "div:only-child")[0] == "x"


def test_separators_of_languages():
    names = "python javascript typescript java kotlin scala go rust cpp c csharp ruby php swift html markdown latex sql solidity proto".split()
    assert all(T.separators_of(n)[-1] == "" for n in names) and T.separators_of(None) == T.SEPARATORS
    assert T.separators_of("python")[:3] == ("\nclass ", "\ndef ", "\n\tdef ") and T.separators_of("js") == T.separators_of("javascript")
    assert T.separators_of("latex")[:5] == ("\n\\chapter{", "\n\\section{", "\n\\subsection{", "\n\\subsubsection{", "\n\\begin{enumerate}") and T.separators_of("sql")[3] == "\nGROUP BY "
    assert T.separators_of("html")[:2] == ("<body", "<div") and T.separators_of("html")[-2:] == ("<title", "")
    code = "import x\nclass A:\n    pass\ndef f():\n    return 1\ndef g():\n    return 2"
    assert T.chunk_text(code, 30, 0, T.separators_of("python")) == ["import x", "class A:\n    pass", "def f():\n    return 1", "def g():\n    return 2"]
    with pytest.raises(ValueError):
        T.separators_of("cobol")


def test_search_folds_accents(spark):
    docs = spark.createDataFrame([(1, "Über den Élan vital"), (2, "uber elan"), (3, "e\u0301lan"), (4, None)], "id int, text string")
    q = spark.createDataFrame([(1, "ÉLAN"), (2, "über den"), (3, "")], "query_id int, query string")
    assert sorted((r["query_id"], r["id"]) for r in search.phrase_hits(docs, q, "text").collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert search.phrase_hits(docs, q.where("query_id = 3"), "text").count() == 0


def test_audio_and_image_measures(spark):
    import io
    import wave

    from weftline.functions import media

    rate, t = 48_000, np.arange(48_000 * 5) / 48_000
    tone = 10 ** (-23 / 20) * np.sin(2 * np.pi * 997 * t)
    m = media.measure_audio(tone, rate)
    assert abs(m["integrated_loudness"] - (-26.0)) < 0.1 and abs(m["sample_peak_dbfs"] + 23) < 0.01 and m["loudness_range"] < 0.1  # one channel of a tone at -23 dBFS
    quiet = media.measure_audio(np.concatenate([tone, np.zeros(rate * 5)]), rate)
    assert abs(quiet["integrated_loudness"] - m["integrated_loudness"]) < 0.3  # silence is gated
    assert media.measure_audio(np.zeros(rate), rate)["integrated_loudness"] is None and media.measure_audio([], rate)["sample_count"] == 0
    between = media.measure_audio(np.sin(2 * np.pi * 12_000 * t[:4800] + np.pi / 4), rate)
    assert between["sample_peak_dbfs"] < -2.9 and abs(between["true_peak_dbtp"]) < 0.2
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.array([[32767, -32768], [16384, 16384]], "<i2").tobytes())
    df = spark.createDataFrame([(1, bytearray(buffer.getvalue())), (2, bytearray(b"no")), (3, None)], "id int, c binary")
    got = {r["id"]: r["a"] for r in df.select("id", media.decode_wav(F.col("c")).alias("a")).collect()}
    assert got[1]["rate"] == 8000 and np.allclose(got[1]["samples"], [-1 / 65536, 0.5]) and got[2]["rate"] is None and got[3] is None
    sharp = media.measure_luma(np.indices((8, 8)).sum(0) % 2 * 255)
    assert sharp["laplacian_variance"] > media.measure_luma(np.tile(np.linspace(0, 255, 8), (8, 1)))["laplacian_variance"] == 0.0 and media.measure_luma([]) is None


def test_levels_add_up_and_round_as_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rng = np.random.default_rng(60)
    rows = [(u * 80 + k, u, float(v)) for u in range(300) for k, v in enumerate(rng.integers(0, 30_000, 80) / 100)]  # means of 80 such values often end in a half of the last digit
    rows += [(90_000, 300, None), (90_001, 1, None), (90_002, 301, 0.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    theirs = con.execute(f"SELECT user_id, peak, rms, dc_offset, clipped FROM ({entry.oracle_sql()['audio_levels']})").fetchall()
    assert sorted(map(tuple, entry.queries()["audio_levels"](spark, str(tmp_path)).collect())) == sorted(theirs) and len(theirs) == 300


def test_percentiles_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(g, float(x)) for g, values in {"a": rng.normal(size=4000), "b": rng.integers(0, 4, 3000), "c": [7.0], None: rng.random(50)}.items() for x in values] + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for ranked in (10_000, 500):  # whole groups, and values near the places alone
        monkeypatch.setattr(sequence, "RANKED", ranked)
        got = {r["__g0"]: (r["p"], r["q"]) for r in sequence.percentiles(df, "v", {"p": 0.01, "q": 0.5}, ["g"]).collect()}
        for g in ("a", "b", "c", None):
            assert np.allclose(got[g], np.percentile([v for k, v in rows if k == g], [1, 50])), (g, ranked)
        assert "d" not in got
    assert sequence.profile(df, "v").first()["n"] == 7051


def test_files_in_chunks_and_copies(spark, tmp_path):
    from weftline.sources import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(bytes(range(256)) * 10)
    (tmp_path / "in" / "b.bin").write_bytes(b"")
    rows = files.read_chunks(spark, str(tmp_path / "in"), 1000).collect()
    whole = {p: b"".join(bytes(r["content"]) for r in sorted(rows, key=lambda r: r["chunk"]) if r["path"].endswith(p)) for p in ("a.bin", "b.bin")}
    assert whole == {"a.bin": bytes(range(256)) * 10, "b.bin": b""} and [r["chunk"] for r in rows] == [0, 1, 2]
    files.save(spark, str(tmp_path / "in" / "a.bin"), str(tmp_path / "out.bin"))
    assert (tmp_path / "out.bin").read_bytes() == whole["a.bin"]


def test_relationships_are_updated(spark):
    edges = spark.createDataFrame([(1, 10, 11, "knows", {"a": "1", "b": "2"}), (2, 11, 12, "likes", {})], "id int, src int, dst int, type string, props map<string,string>")
    changes = spark.createDataFrame([(1, {"b": "3", "c": "4"}, None), (9, {}, "x")], "id int, props map<string,string>, type string")
    got = {r["id"]: r for r in graph.update_edges(edges, changes).collect()}
    assert got[1]["props"] == {"a": "1", "b": "3", "c": "4"} and got[1]["type"] == "knows" and set(got) == {1, 2} and got[2]["props"] == {}


def test_queue_streams(spark, tmp_path):
    from weftline.sources import queue

    for k in range(2):
        spark.createDataFrame([("s", k, f"item{k}"), ("t", k, "other")], "session string, seq int, item string").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = queue.dequeue_stream(spark, str(tmp_path / "log"), "session string, seq int, item string", "s")
    assert sorted(r["item"] for r in steps.run_available(stream, "queue", str(tmp_path / "c")).collect()) == ["item0", "item1"]


def test_model_tokens(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "weaving plain cloth"), (2, None), (3, "")], "id int, t string")
    got = {r["id"]: r["x"] for r in df.select("id", T.model_tokens(F.col("t"), path).alias("x")).collect()}
    from tokenizers import Tokenizer

    assert got[1] == Tokenizer.from_file(path).encode("weaving plain cloth", add_special_tokens=False).ids and got[2] is None and got[3] == []
