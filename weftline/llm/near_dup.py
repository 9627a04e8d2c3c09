"""Near-duplicate classes by improved consistent weighted sampling.

A text is a weighted set of shingles of ``SHINGLE`` words: the weight grows with the logarithm of the
shingle's count in the text and with its inverse document frequency. ``HASHES`` consistent weighted
samples of it, in ``BANDS`` bands, propose candidates; a candidate pair becomes a link if the weighted
Jaccard similarity of the whole texts is ``SIMILARITY`` or more. Classes are the connected components
of the links.

A sample is kept as its shingle alone, without its quantised weight (so-called 0-bit samples): a
shingle of slightly different weight in two texts may then agree where the full sample would not, which
can only add candidates. The random triples are drawn from a table of ``TRIPLES``. How far the share of
agreeing samples lies from the similarity is measured in the tests.

How it stays small: equal texts are folded into their first document before anything else. A bucket
(band, value) never emits its pairs. First every member is compared with the bucket's smallest
document. After the components of those links are known, only buckets that still hold several
components are looked at: the members outside of a bucket's largest component are compared with all
its members in blocks, where a whole block is scored against a query by numpy and only links leave
the task. So every pair of a bucket is either compared or known to be connected.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hashing import forget as forget_words
from ._hashing import window_hashes, word_hashes, words_of
from ._shared import begin, drop_stash, give_back, in_arrow, sized_broadcast, stash

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
HASHES = BANDS * ROWS
#: Slots of the sketch of document frequencies, its blocks, and the share of all documents up to which
#: a shingle has full weight, so that the size of a group of copies hardly counts against its members.
SLOTS, BLOCKS, RARE = 1 << 18, 64, 0.01
#: Steps of the logarithm of a weight, and how many of them are told apart.
STEP, LEVELS = 0.125, 64
#: Random (r, c, beta) triples that a shingle and hash choose from.
TRIPLES = 1 << 16
#: Shingles that are sampled at once.
PART = 1024
#: Members, and queries, of a bucket that are compared as one block.
BLOCK_ROWS = 500
SEED = 20_031


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text and their counts; fewer words than a shingle are one."""
    return np.unique(window_hashes(word_hashes(words_of(text)), SHINGLE), return_counts=True)


def slot(hashes: np.ndarray) -> np.ndarray:
    """Sketch slot of shingle hashes."""
    return (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents per sketch slot, number of documents) over all texts.

    Tasks add up their own sketch and send it in ``BLOCKS`` rows; each block is added up by itself, so
    one number per slot reaches the driver, whatever the size of the corpus.
    """
    width = SLOTS // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for a in range(0, batch.num_rows, 500):
                found = [slot(shingles(t)[0]) for t in batch.column(0).slice(a, 500).to_pylist()]
                total += np.bincount(np.concatenate(found), minlength=SLOTS)
        give_back()
        parts = total.astype("<u4").reshape(BLOCKS, width)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([n] + [0] * (BLOCKS - 1), pa.int64()), pa.array([x.tobytes() for x in parts])], ["block", "docs", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width, np.int64), 0
        for batch in batches:
            n += sum(batch.column(1).to_pylist())
            for x in batch.column(2).to_pylist():
                total += np.frombuffer(x, "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()])], ["block", "docs", "counts"])

    kinds = "block int, docs long, counts binary"
    out, n = np.zeros((BLOCKS, width), np.int64), 0
    for row in in_arrow(docs.select("text"), count, kinds).groupBy("block").applyInArrow(add, kinds).collect():
        out[row["block"]] = np.frombuffer(row["counts"], np.int64)
        n += row["docs"]
    return out.reshape(-1), n


def slot_levels(frequencies: np.ndarray, n: int) -> np.ndarray:
    """Log-weight of a slot's shingles in steps of ``STEP``, 0 for full weight, negative for common.

    The median load of the slots is the noise that rare shingles share and is taken off. The weight is
    (1 + idf) / 2, where idf = log(df / n) / log(RARE): 1 for a shingle in a share of ``RARE`` of the
    documents or less, 1/2 for one in a tenth, 0 for one in all.
    """
    own = np.maximum(frequencies - np.median(frequencies), 1) / max(n, 1)
    idf = np.log(np.clip(own, RARE, 1)) / np.log(RARE)
    return np.round(np.log((1 + idf) / 2) / STEP).astype(np.int8)


def levels_of(hashes: np.ndarray, counts: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Weight level of every shingle of a text: that of its slot, raised by 1 + log(count)."""
    raised = np.round(np.log1p(np.log(counts)) / STEP).astype(np.int64)
    return np.clip(slots[slot(hashes)] + raised + 8, 0, LEVELS - 1)


def weights_of(levels: np.ndarray) -> np.ndarray:
    """Weights of levels."""
    return np.exp((levels - 8) * STEP)


@functools.cache
def sample_table() -> np.ndarray:
    """For every weight level and random triple, the order of ln a in the upper 32 bits.

    With r, c from Gamma(2, 1) and beta from U(0, 1): t = floor(ln w / r + beta),
    ln a = ln c - r (t - beta) - r; the sample of a set is the element of least ln a.
    """
    rng = np.random.default_rng(SEED)
    r, c, beta = rng.gamma(2, 1, TRIPLES), rng.gamma(2, 1, TRIPLES), rng.random(TRIPLES)
    log_w = (np.arange(LEVELS) - 8)[:, None] * STEP
    log_a = np.log(c) - r * (np.floor(log_w / r + beta) - beta) - r
    low, high = log_a.min(), log_a.max()
    log_a -= low
    log_a *= (2**32 - 1) / (high - low)
    out = log_a.astype(np.uint64).reshape(-1)
    out <<= np.uint64(32)
    return out


def forget() -> None:
    """Drops the table and the remembered words from this worker."""
    sample_table.cache_clear()
    forget_words()


def multipliers() -> np.ndarray:
    """An odd multiplier per hash."""
    return np.random.default_rng(SEED + 1).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Sampler:
    """Samples of texts under given slot levels."""

    def __init__(self, slots: np.ndarray):
        self.slots, self.table, self.factors = slots, sample_table(), multipliers()

    def sample(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ``HASHES`` sampled shingles (lower half of their hash) of one non-empty set."""
        base = levels_of(hashes, counts, self.slots) * TRIPLES
        least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
        for a in range(0, len(hashes), PART):
            some = hashes[a : a + PART]
            at = (some * self.factors[:, None] >> np.uint64(48)).astype(np.int64) + base[a : a + PART]
            least = np.minimum(least, (self.table[at] | (some & np.uint64(0xFFFFFFFF))).min(1))
        return (least & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], slots: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of (hashes, counts)."""
    (x, m), (y, n) = a, b
    u, v = weights_of(levels_of(x, m, slots)), weights_of(levels_of(y, n, slots))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = np.minimum(u[i], v[j]).sum()
    total = u.sum() + v.sum() - shared
    return float(shared / total) if total > 0 else 0.0


def signatures(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """doc_id, digest (of the words in order; null without words), bands (array<long>). No shuffle."""
    table = docs.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near-dup", forget)
        sampler = Sampler(table.value)
        salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            digests, bands = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                if not words:
                    digests.append(None), bands.append(None)
                    continue
                found = sampler.sample(*np.unique(window_hashes(word_hashes(words), SHINGLE), return_counts=True))
                key = window_hashes_by_row(found.reshape(BANDS, ROWS).astype(np.uint64)) + salt
                digests.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                bands.append((key * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "digest", "bands"])
        give_back()

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, digest binary, bands array<long>")


def window_hashes_by_row(rows: np.ndarray) -> np.ndarray:
    """One hash per row of uint64 values."""
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out = (out ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(__own, text) of the named documents: a broadcast filter if they are few, a shuffle join else.

    Of rows that share a doc_id, the smallest text counts.
    """
    named = stash(ids.select(F.col(ids.columns[0]).alias("__id")).distinct(), "candidate-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("__own"), "text").join(sized_broadcast(named), F.col("__own") == F.col("__id"), "left_semi")
    return stash(texts.groupBy("__own").agg(F.min("text").alias("text")), "candidate-texts")


def verify(pairs: DataFrame, docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts are similar enough.

    Only texts of documents in a pair are moved. Each is joined to its pairs; a document in very many
    pairs is one row on its side, and Spark splits the partitions of the other side.
    """
    pairs = stash(pairs, "candidate-pairs")
    texts = texts_of(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))), docs)
    both = pairs.join(texts.select(F.col("__own").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("__own").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    table = docs.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            a, b, kept = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if last is None or last[0] != b[k]:
                    last = b[k], shingles(y)
                if similarity(shingles(x), last[1], table.value) >= SIMILARITY:
                    kept.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in kept], pa.int64()), pa.array([b[k] for k in kept], pa.int64())], ["a", "b"])
        give_back()

    out = stash(in_arrow(both, run, "a long, b long"), "links")
    drop_stash(texts)
    return out


class Block:
    """Texts of a block, to be scored against one text at a time.

    For every shingle the texts that hold it are listed, so a text costs its own length and what it
    shares with the block: loose members of a bucket, which share little, cost next to nothing.
    """

    def __init__(self, texts: list[str | None], slots: np.ndarray):
        self.slots, self.size = slots, len(texts)
        sets = [shingles(t) for t in texts]
        weights = [weights_of(levels_of(*x, slots)) for x in sets]
        self.totals = np.array([w.sum() for w in weights])
        hashes = np.concatenate([x[0] for x in sets]) if sets else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.owners = np.repeat(np.arange(self.size), [len(w) for w in weights])[order]
        self.weights = np.concatenate(weights)[order] if weights else np.zeros(0)
        self.words, self.starts, self.counts = np.unique(hashes[order], return_index=True, return_counts=True)

    def scores(self, text: str | None) -> np.ndarray:
        """Weighted Jaccard similarity of a text with each text of the block; 0 of a text without words."""
        hashes, counts = shingles(text)
        own = weights_of(levels_of(hashes, counts, self.slots))
        _, mine, at = np.intersect1d(hashes, self.words, assume_unique=True, return_indices=True)
        n = self.counts[at]
        places = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.owners[places], np.minimum(self.weights[places], np.repeat(own[mine], n)), self.size)
        return shared / np.maximum(self.totals + own.sum() - shared, 1e-300)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, component): the smallest doc_id that each node is connected with by links (a, b).

    Every round takes the smallest label among neighbours and jumps along labels, on tables in the
    shared folder, until no label changes. Only linked nodes take part in the rounds.
    """
    links = links.where("a <> b")
    both = stash(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "link-ends")
    labels = stash(both.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("x")).select("doc_id", F.least("doc_id", "x").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["doc_id"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["doc_id"] == near["a"], "left").select("doc_id", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("doc_id").alias("__at"), F.col("label").alias("__to"))
        new = new.join(jump, new["label"] == jump["__at"], "left").select("doc_id", "was", F.least("label", F.coalesce("__to", "label")).alias("label"))
        new, last = stash(new, "labels"), labels
        labels = new.drop("was")
        drop_stash(last)
        if new.where("was <> label").isEmpty():
            break
    out = nodes.join(labels.withColumnRenamed("doc_id", "__node"), F.col("doc_id") == F.col("__node"), "left")
    return out.select("doc_id", F.coalesce("label", "doc_id").alias("component"))


def hubs(members: DataFrame) -> DataFrame:
    """(bucket, hub): the smallest doc_id of every bucket that holds several. Found by an aggregate that
    is combined map-side, so a hot bucket moves no rows for it, and written, so that the joins with it
    are plain joins, whose hot partitions Spark splits."""
    found = members.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("__last"))
    return stash(found.where("hub < __last").select("bucket", "hub"), "near-dup-hubs")


def residual_links(members: DataFrame, found: DataFrame, docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """Links (a, b) between different components inside one bucket.

    The members outside of a bucket's largest component are the queries. Members and queries of a
    bucket are cut into blocks of about ``BLOCK_ROWS`` and every block of queries meets every block of
    members, so no bucket gathers in one task; a pair that shares several buckets is compared in each,
    but leaves a task only as a link.
    """
    rows = members.join(found, "doc_id")
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", "component")).alias("top")
    mixed = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), top, F.sum("n").alias("size")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    mixed = mixed.select("bucket", F.col("top.component").alias("main"), blocks(F.col("size")).alias("blocks"), blocks(F.col("size") - F.col("top.n")).alias("q_blocks"))
    mixed = stash(mixed, "mixed-sizes")
    rows = stash(rows.join(sized_broadcast(mixed, width=4), "bucket"), "mixed-buckets")
    rows = rows.join(texts_of(rows.select("doc_id"), docs), F.col("doc_id") == F.col("__own"))
    of = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    everyone = rows.select("bucket", of("blocks", 1).alias("block"), each("q_blocks").alias("with_block"), "doc_id", "component", "text")
    queries = rows.where("component <> main").select(F.col("bucket").alias("q_bucket"), each("blocks").alias("q_block"), of("q_blocks", 2).alias("q_with"), F.col("doc_id").alias("q_id"), F.col("component").alias("q_component"), F.col("text").alias("q_text"))
    table = docs.sparkSession.sparkContext.broadcast(slots)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if len(left) and len(right):
            ids, own = left["doc_id"].to_numpy(), left["component"].to_numpy()
            theirs = right["q_component"].to_numpy()
            if len(set(own.tolist()) | set(theirs.tolist())) > 1:
                block = Block(left["text"].to_pylist(), table.value)
                for k, (i, text) in enumerate(zip(right["q_id"].to_pylist(), right["q_text"].to_pylist(), strict=True)):
                    hit = (own != theirs[k]) & (block.scores(text) >= SIMILARITY) if (own != theirs[k]).any() else []
                    out_a += ids[hit].tolist() if len(hit) else []
                    out_b += [i] * int(np.sum(hit))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    pairs = everyone.groupBy("bucket", "block", "with_block").cogroup(queries.groupBy("q_bucket", "q_block", "q_with")).applyInArrow(compare, "a long, b long")
    return stash(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id for every row: class_id is the smallest doc_id of the row's class.

    ``docs`` needs doc_id and text. Texts are compared by their lower-case words; texts without words
    (null, empty, white space) are alike to nothing and stand alone. Rows without doc_id get a null
    class. Repeated rows share a class. A text shorter than a shingle is one shingle. Ties between
    samples go to the smaller hash. Empty tables give an empty result.
    """
    slots = slot_levels(*document_frequencies(docs))
    signed = stash(signatures(docs, slots), "near-dup-signatures")
    worded = signed.where("digest is not null and doc_id is not null")
    copies = worded.groupBy(F.col("digest").alias("__digest")).agg(F.min("doc_id").alias("first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    copies = sized_broadcast(stash(copies, "near-dup-copies"), width=3)
    worded = worded.join(copies, F.col("digest") == F.col("__digest"), "left").where("first is null or doc_id = first")
    firsts = stash(worded.select("doc_id", "digest", "bands").dropDuplicates(["doc_id", "digest"]), "near-dup-firsts")
    members = firsts.select("doc_id", F.explode("bands").alias("bucket"))
    members = stash(members.join(sized_broadcast(hubs(members), width=2), "bucket"), "near-dup-members")
    stars = members.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    members = members.drop("hub")
    links = verify(stars, docs, slots)
    nodes = members.select("doc_id").distinct()
    found = stash(components(nodes, links), "near-dup-components")
    links = links.unionByName(residual_links(members, found, docs, slots))
    found = stash(components(nodes, links), "near-dup-components").where("component <> doc_id")
    found = sized_broadcast(stash(found.withColumnRenamed("doc_id", "__first"), "near-dup-linked"), width=2)
    out = signed.select("doc_id", "digest").join(copies, F.col("digest") == F.col("__digest"), "left")
    out = out.withColumn("first", F.when(F.col("digest").isNotNull(), F.coalesce("first", "doc_id")))
    out = out.join(found, F.col("first") == F.col("__first"), "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first", "doc_id")).alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: that with the smallest doc_id.

    Repeated rows of that document are one document and stay; so do rows without doc_id.
    """
    classes = near_duplicate_classes(docs).where("doc_id is not null")
    gone = stash(classes.where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-dup-gone")
    return docs.join(sized_broadcast(gone), F.col("doc_id") == F.col("__gone"), "left_anti")
