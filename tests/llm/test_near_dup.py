"""Classes against brute force, and the sampling law."""

import random

import numpy as np
import pytest

from weftline.llm import near_dup as N


def brute(texts, slots):
    """Smallest id of each class, by comparing all pairs."""
    sets = {i: N.shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    ids = sorted(i for i in texts if len(sets[i][0]))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if N.similarity(sets[a], sets[b], slots) >= N.SIMILARITY:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in texts}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed=0, copies=3):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for _ in range(12):
        base = " ".join(word() for _ in range(rng.randint(60, 300)))
        texts += [base, base.upper(), base + " ", *family(rng, base, copies, 1), *family(rng, base, 2, 12)]
    texts += [" ".join(word() for _ in range(80)) for _ in range(30)]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def classes(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r["class_id"] for r in N.near_duplicate_classes(df).collect()}


def levels(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return N.slot_levels(*N.document_frequencies(df.repartition(3)))


def test_classes_equal_brute_force(spark):
    texts = corpus()
    assert classes(spark, texts) == brute(texts, levels(spark, texts))


def test_large_family_and_chain(spark):
    rng = random.Random(5)
    base = " ".join(f"b{i}" for i in range(400))
    chain = [base.split()]
    for k in range(12):  # each link is alike to the next, the ends are not alike
        words = list(chain[-1])
        for j in range(4):
            words[(k * 31 + j * 7) % 400] = f"c{k}x{j}"
        chain.append(words)
    texts = dict(enumerate([" ".join(w) for w in chain] + family(rng, " ".join(f"h{i}" for i in range(200)), 120, 2) + [f"other text number {i} with its own words q{i} r{i}" for i in range(40)]))
    want, got = brute(texts, levels(spark, texts)), classes(spark, texts)
    assert got == want
    assert len({got[i] for i in range(13)}) == 1


def test_blocks_and_join_ways_agree(spark, monkeypatch):
    texts = corpus(7)
    one = classes(spark, texts)
    monkeypatch.setattr(N, "BLOCK_ROWS", 2)
    monkeypatch.setattr("weftline.llm._shared.BROADCAST_KEYS", -1)
    assert classes(spark, texts) == one


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "short"), (5, "Short "), (6, "short text"), (7, "x " * 4000), (7, "x " * 4000), (None, "short"), (8, "y z " * 30), (9, "Y z " * 30)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, class_id string")
    got = sorted(((r["doc_id"], r["class_id"]) for r in N.near_duplicate_classes(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (7, 7), (None, None), (8, 8), (9, 8)], key=str)
    assert N.near_duplicate_classes(df.limit(0)).count() == 0
    kept = N.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 7, 7, None, 8]))


def test_samples_follow_weighted_jaccard():
    rng = np.random.default_rng(0)
    slots = np.zeros(N.SLOTS, np.int8)
    slots[: N.SLOTS // 2] = -5
    sampler = N.Sampler(slots)
    for shared in (20, 60, 90):
        agree, want = [], []
        for _ in range(60):
            h = rng.integers(0, 1 << 64, 130, dtype=np.uint64)
            a, b = np.sort(h[:115]), np.sort(np.r_[h[115 - shared : 115], h[115:]])
            m, n = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
            agree.append((sampler.sample(a, m) == sampler.sample(b, n)).mean())
            want.append(N.similarity((a, m), (b, n), slots))
        assert abs(np.mean(agree) - np.mean(want)) < 0.03


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 5000])
def test_parts_of_a_set_give_the_whole_sample(n, monkeypatch):
    rng = np.random.default_rng(n)
    h, c = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64)), np.ones(n, int)
    sampler = N.Sampler(np.zeros(N.SLOTS, np.int8))
    one = sampler.sample(h, c)
    monkeypatch.setattr(N, "PART", 1 << 20)
    assert np.array_equal(sampler.sample(h, c), one)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    label = {i: i for i in range(400)}
    for _ in range(400):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    nodes = spark.range(400).withColumnRenamed("id", "doc_id")
    got = N.components(nodes, spark.createDataFrame(links, "a long, b long"))
    assert {r["doc_id"]: r["component"] for r in got.collect()} == label


def test_common_shingles_weigh_less():
    frequencies = np.full(N.SLOTS, 3)
    frequencies[:4] = [3 + 10, 3 + 100, 3 + 1000, 3 + 10_000]
    weights = np.exp(N.slot_levels(frequencies, 10_000)[:5] * N.STEP)
    assert weights[4] == weights[0] == 1 and weights[0] >= weights[1] > weights[2] > weights[3]


def test_a_passage_of_many_documents_ties_no_others(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = " ".join(word() for _ in range(140))
    with_it = [passage + " " + " ".join(word() for _ in range(15)) for _ in range(40)]
    texts = dict(enumerate(with_it + [" ".join(word() for _ in range(80)) for _ in range(40)]))
    a, b = N.shingles(with_it[0]), N.shingles(with_it[1])
    plain = len(np.intersect1d(a[0], b[0])) / len(np.union1d(a[0], b[0]))
    slots = levels(spark, texts)
    assert plain >= N.SIMILARITY > N.similarity(a, b, slots)
    assert classes(spark, texts) == {i: i for i in texts}


def test_recall_by_similarity(spark, sf_dir):
    """Of all pairs of different texts, compared one by one, none that reaches the cut is missed."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    slots = levels(spark, texts)
    sets = {i: x for i, t in texts.items() if len((x := N.shingles(t))[0])}
    got, found, links = classes(spark, texts), {}, 0
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            s = N.similarity(sets[a], sets[b], slots)
            if s >= 0.1:
                found.setdefault(int(s * 10), []).append(got[a] == got[b])
            links += s >= N.SIMILARITY
    assert links and all(all(v) for k, v in found.items() if k >= 8)


def test_blocks_score_like_pairs():
    texts = [*corpus(3).values(), "", None, "x", "a a a a a a a a a a"]
    slots = np.random.default_rng(0).integers(-5, 1, N.SLOTS).astype(np.int8)
    block, sets = N.Block(texts, slots), [N.shingles(t) for t in texts]
    for text in (*texts[::7], "", None, "no such words here at all"):
        own = N.shingles(text)
        assert np.allclose(block.scores(text), [N.similarity(own, s, slots) for s in sets])
    assert len(N.Block([], slots).scores("x")) == 0
