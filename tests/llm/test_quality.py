"""Quality rules and importance resampling against plain Python."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import importance, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", "   \n\t ", "one", "a b c a b c", "x x x x x", "line\nline\n\nline\n  \nother", "a b c d", "#1 *2 $3 %4 &5 |6 <7> 8", "é ü 日本\r\nx\x0by\x0cz", "w " * 3000,
    " ".join(f"word{i} more{i % 7}" for i in range(60)), "a b c d a b c e b c d", "🎉 🎉 🎉 🎉",
]


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


def test_measures(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_words string")
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality_rules.quality_rules(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_fences_follow_the_group(spark):
    good = " ".join(f"word{i}" for i in range(80))
    junk = " ".join(f"word{i}###" for i in range(80))
    rows = [(i, good, "en", "a") for i in range(300)] + [(1000 + i, junk, "en", "a") for i in range(20)]
    rows += [(2000 + i, junk, "xx", "b") for i in range(300)] + [(3000, good, None, None), (3001, junk, None, None)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(20))
    assert all(got[2000 + i] for i in range(300))  # where all texts are like that, it is no outlier
    assert got[3000]


def test_sketch_quantiles(spark):
    rng = np.random.default_rng(1)
    values = rng.lognormal(1, 1, 2000)
    rows = [(float(v),) for v in values]
    b = spark.createDataFrame(rows, "v double").select(quality_rules.bucket(quality_rules.F.col("v")).alias("b")).groupBy("b").count().orderBy("b").select("b", "count", quality_rules.bucket_value(quality_rules.F.col("b")).alias("x")).collect()
    seen = np.cumsum([r["count"] for r in b])
    for q in (0.25, 0.5, 0.9):
        found = b[int(np.searchsorted(seen, np.ceil(q * 2000)))]["x"]
        assert abs(found / np.quantile(values, q, method="inverted_cdf") - 1) < 0.011


def test_small_groups_borrow_and_word_length_has_two_sides(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    good = lambda: " ".join(word(int(n)) for n in rng.integers(3, 8, 80))
    junk = " ".join(f"{word(5)}###" for _ in range(80))
    rows = [(i, good(), "en", "a") for i in range(400)]
    rows += [(1000, good(), "en", "tiny"), (1001, junk, "en", "tiny"), (1002, good(), "yy", "other"), (1003, junk, "yy", "other")]
    rows += [(2000, " ".join(word(1) for _ in range(80)), "en", "a"), (2001, " ".join(word(15) for _ in range(80)), "en", "a")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert np.mean([got[i] for i in range(400)]) > 0.98 and got[1000] and got[1002]
    assert not (got[1001] or got[1003] or got[2000] or got[2001])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, 1.0000000001])), max_size=40), st.integers(-1, 45))
def test_kth_largest(spark, values, k):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = sorted((v for v in values if v is not None), reverse=True)
    want = None if not known or k < 1 else known[min(k, len(known)) - 1]
    assert importance.kth_largest(df, "v", k) == want


def test_kept_of_documents_that_no_model_saw(spark):
    """Labels of every other document are hidden; clean ones stay alike whether they were seen or not."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = importance.resample(docs, labels.where("doc_id % 2 = 0")).join(labels, "doc_id").collect()
    rate = lambda q, t, seen: np.mean([r["kept"] for r in rows if (r["quality"], r["toxic"]) == (q, t) and (r["doc_id"] % 2 == 0) == seen])
    assert rate(1, 0, False) > 0.9 and abs(rate(1, 0, False) - rate(1, 0, True)) < 0.04
    assert rate(1, 1, False) < 0.2 and rate(0, 0, False) < 0.05


def test_toxic_documents_of_good_quality_go(spark):
    rng = np.random.default_rng(3)
    words = lambda stem, n: " ".join(f"{stem}{k}" for k in rng.integers(0, 40, n))
    texts = [(words("clean", 60), 1, 0) for _ in range(120)] + [(words("clean", 30) + " " + words("slur", 30), 1, 1) for _ in range(40)] + [(words("junk", 60), 0, 0) for _ in range(40)]
    rows = [(i, *x) for i, x in enumerate(texts)]
    all_rows = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in importance.resample(all_rows.select("doc_id", "text"), all_rows.select("doc_id", "quality", "toxic")).collect()}
    rate = lambda q, t: np.mean([kept[i] for i, _, x, y in rows if (x, y) == (q, t)])
    assert rate(1, 0) > 0.9 and rate(1, 1) < 0.1 and rate(0, 0) < 0.1


def test_resampling_cases(spark):
    docs = spark.createDataFrame([(1, "good text here"), (2, None), (3, ""), (4, "### ###"), (4, "### ###"), (None, "good")], "doc_id long, text string").withColumn("key", importance.F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["kept"] for r in importance.resample(docs, none).collect()] == [True] * 6
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, None), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    out = importance.resample(docs, labels, k=1).collect()
    assert len(out) == 6 and sum(r["kept"] for r in out) >= 1
    same = [r["key"] for r in out if r["doc_id"] == 4]
    assert same[0] == same[1]
    assert importance.resample(docs.limit(0), labels).count() == 0
    assert not any(r["kept"] for r in importance.resample(docs, labels, k=0).collect())


def test_weights_keys_and_kept_equal_plain_python(spark):
    rng = np.random.default_rng(5)
    texts = ["the cat sat on the mat", "the dog", "### !!! ###", "the cat", "", None]
    texts += [" ".join(rng.choice(["the", "cat", "dog", "mat", "sat"] if i % 3 == 0 else ["the", "cat", "###", "!!!", "sat"], 12)) for i in range(6, 60)]
    texts += [texts[7]] * 5 + [texts[9]]  # copies count once
    target = {i for i in range(len(texts)) if i % 3 == 0}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i in target), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")

    def grams(i):
        words = (texts[i] or "").split()
        return Counter([(0, w) for w in words] + [(1, *x) for x in zip(words, words[1:], strict=False)])

    found = {i: grams(i) for i in range(len(texts))}
    want = {}
    for i, own in found.items():
        raw, good = Counter(), Counter()
        for text in {texts[j] for j in found} - {texts[i]}:
            same = [j for j in found if texts[j] == text]
            raw.update(found[same[0]])
            if target & set(same):
                good.update(found[same[0]])
        of = lambda c, kind: sum(n for g, n in c.items() if g[0] == kind)
        total = 0.0
        for g, n in own.items():
            share, prior = of(good, g[0]) / max(of(raw, g[0]), 1), importance.PRIOR[g[0]]
            e = raw[g] * share
            if abs(good[g] - e) > importance.SURE * np.sqrt(e + prior):
                total += n * np.log((good[g] + prior) / (e + prior))
        want[i] = total
    rows = importance.resample(docs, labels).collect()
    assert all(np.isclose(r["log_weight"], want[r["doc_id"]]) for r in rows) and len(rows) == len(texts)
    noise = {r["doc_id"]: r["g"] for r in docs.select("doc_id", importance.gumbel(importance.F.col("doc_id")).alias("g")).collect()}
    keys = {i: want[i] + noise[i] for i in want}
    k = round(len(texts) * len(target) / len(texts))
    best = set(sorted(keys, key=lambda i: -keys[i])[:k])
    assert 0 < k < len(texts) and {r["doc_id"] for r in rows if r["kept"]} == best
    few = {r["doc_id"] for r in importance.resample(docs, labels, k=5).collect() if r["kept"]}
    assert few == set(sorted(keys, key=lambda i: -keys[i])[:5])
