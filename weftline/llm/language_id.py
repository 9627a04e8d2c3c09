"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of what followed.
A byte costs its share in the longest context that the tree has; where it never followed there, an
escape is paid and the next shorter context is asked, down to equal shares of all 256 bytes. The
counts are frozen after training, so every cost is a number in a table, and the code length of a
text in a language is an exact sum of table entries, looked up by numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from ._shared import begin, give_back, in_arrow, nothing, sized_broadcast

#: Longest context in bytes.
ORDER = 3
#: Bound of the sample that the trees are fitted on: documents per language, and characters of each (of
#: a longer text, a window at a hashed place).
SAMPLE_DOCS, SAMPLE_CHARS = 400, 20_000
#: Bits a byte beyond which no learned language explains a text (8: equal shares).
MOST_BITS = 7.0
#: Bytes that are scored at once.
CHUNK_BYTES = 1 << 20

LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def training_sample(docs: DataFrame) -> DataFrame:
    """(lang, text) of at most ``SAMPLE_DOCS`` documents per language, those of the smallest hash of
    their doc_id and text. Rows with null lang, and null or empty texts, teach nothing; of texts over
    ``SAMPLE_CHARS`` characters a window of that many is taken at a place that the hash fixes, so every
    language with any text is learned.

    The usable rows of a language are counted first, and only hashes below a bound that lets about
    ``4 * SAMPLE_DOCS`` of them pass are ranked, so the group of a language stays small at any size.
    """
    found = docs.where("lang is not null and text is not null and text <> ''")
    counts = found.groupBy("lang").agg(F.count("*").alias("__n")).withColumnRenamed("lang", "__lang")
    found = found.select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("__hash"))
    found = found.join(sized_broadcast(counts), F.col("lang") == F.col("__lang"))
    found = found.where(F.pmod("__hash", F.lit(1 << 30)) < F.lit(4.0 * SAMPLE_DOCS * (1 << 30)) / F.col("__n"))
    more = F.length("text") - SAMPLE_CHARS
    start = F.when(more > 0, F.pmod(F.xxhash64("__hash"), F.greatest(more, F.lit(0)) + 1)).otherwise(0)
    found = found.withColumn("text", F.substring("text", start.cast("int") + 1, F.lit(SAMPLE_CHARS)))
    order = Window.partitionBy("lang").orderBy(F.pmod("__hash", F.lit(1 << 30)), "__hash", "doc_id")
    return found.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= SAMPLE_DOCS).select("lang", "text")


def count_contexts(texts: list[str]) -> dict[bytes, np.ndarray]:
    """For every context of 0 to ``ORDER`` bytes, the counts of the 256 next bytes.

    A text is preceded by ``ORDER`` zero bytes.
    """
    pad = bytes(ORDER)
    raw = np.frombuffer(b"".join(pad + t.encode() for t in texts), np.uint8).astype(np.int64)
    starts = np.cumsum([0] + [ORDER + len(t.encode()) for t in texts[:-1]]) if texts else np.zeros(0, int)
    inside = np.ones(len(raw), bool)
    for k in range(ORDER):
        inside[starts + k] = False
    at = np.flatnonzero(inside)
    out: dict[bytes, np.ndarray] = {}
    for order in range(ORDER + 1):
        code = raw[at]
        for k in range(1, order + 1):
            code = code | raw[at - k] << 8 * k
        values, counts = np.unique(code, return_counts=True)
        cuts = np.flatnonzero(np.r_[True, np.diff(values >> 8) != 0])
        for a, b in zip(cuts, [*cuts[1:], len(values)], strict=True):
            row = np.zeros(256)
            row[values[a:b] & 255] = counts[a:b]
            out[int(values[a] >> 8).to_bytes(order, "big")] = row
    return out


def code_costs(counts: dict[bytes, np.ndarray]) -> dict[bytes, np.ndarray]:
    """Bits of each next byte in every context: method C escapes, with exclusion of no byte.

    A context with n observations of d different bytes gives a byte n_b / (n + d), the escape
    d / (n + d).
    """
    out: dict[bytes, np.ndarray] = {}
    for context in sorted(counts, key=len):
        row = counts[context]
        n, d = row.sum(), np.count_nonzero(row)
        shorter = out[context[1:]] if context else np.full(256, 8.0)
        with np.errstate(divide="ignore"):
            out[context] = np.where(row > 0, -np.log2(row / (n + d)), shorter - np.log2(d / (n + d)))
    return out


@dataclass
class Trees:
    """The trees of all languages as tables.

    ``letter`` numbers the bytes that occur (0: the others), ``node`` gives the longest context that
    any language has for the numbers of the last ``ORDER`` bytes, ``bits[node, letter, lang]`` the cost.
    """

    langs: list[str]
    letter: np.ndarray
    node: np.ndarray
    bits: np.ndarray

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of every text in every language, for whole texts."""
        out = np.zeros((len(texts), len(self.langs)))
        raw = [t.encode() for t in texts]
        at = 0
        while at < len(raw):
            to, size = at, 0
            while to < len(raw) and (to == at or size + len(raw[to]) <= CHUNK_BYTES):
                size += len(raw[to])
                to += 1
            self._some(raw[at:to], out[at:to])
            at = to
        return out

    def _some(self, raw: list[bytes], out: np.ndarray) -> None:
        data = np.frombuffer(bytes(ORDER) + bytes(ORDER).join(raw), np.uint8)
        sizes = np.array([len(x) for x in raw])
        starts = np.cumsum(sizes + ORDER) - sizes
        letters = self.letter[data]
        width = np.int32(self.letter.max() + 1)
        code = letters[:-ORDER].astype(np.int32)
        for k in range(1, ORDER):
            code = code * width + letters[k : len(letters) - ORDER + k]
        bits = self.bits[self.node[code], letters[ORDER:]]
        total = np.zeros((len(bits) + 1, bits.shape[1]))
        for a in range(0, len(bits), 1 << 18):  # running sums of float32 in float64
            total[a + 1 : a + (1 << 18) + 1] = total[a] + np.cumsum(bits[a : a + (1 << 18)], 0, dtype=np.float64)
        out[:] = total[starts - ORDER + sizes] - total[starts - ORDER]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a byte of every text.

        The score is the language's share among all, by their code lengths. Null texts and texts
        without a letter are ``und`` with score 0, as is everything if no language was learned.
        Equal code lengths go to the language that sorts first.
        """
        known = [bool(t) and LETTER.search(t) is not None for t in texts]
        n = np.array([max(len((t or "").encode()), 1) for t in texts])
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), 8.0)
        bits = self.lengths([t or "" for t in texts])
        best = bits.argmin(1)
        least = bits[np.arange(len(texts)), best] if len(texts) else np.zeros(0)
        score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        return [self.langs[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0), least / n


def assemble(costs: dict[str, dict[bytes, np.ndarray]]) -> Trees:
    """One table for the trees of all languages; a language that lacks a context uses its own longest
    shorter one, at no cost of an escape."""
    langs = sorted(costs)
    contexts = sorted({c for x in costs.values() for c in x}, key=lambda c: (len(c), c))
    used = sorted({b for c in contexts for b in c} | {0})
    letter = np.zeros(256, np.int32)
    letter[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    place = {c: i for i, c in enumerate(contexts)}
    unseen = next((b for b in range(256) if not letter[b]), 0)  # all bytes that never occur cost the same
    shown = [unseen, *used]
    bits = np.empty((max(len(contexts), 1), width, len(langs)), np.float32)
    for k, lang in enumerate(langs):
        own = costs[lang]
        for c, i in place.items():
            x = c
            while x not in own:
                x = x[1:]
            bits[i, :, k] = own[x][shown]
    node = np.zeros((width,) * ORDER, np.int32)
    for c, i in place.items():  # shorter contexts first, so longer ones overwrite their part
        node[(..., *(int(letter[b]) for b in c))] = i
    return Trees(langs, letter, node.reshape(-1), bits)


def learn(docs: DataFrame) -> Trees:
    """Trees of every language of ``docs`` (lang, text, doc_id), fitted in one task per language on
    :func:`training_sample`. What comes to the driver is bounded by that sample."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = count_contexts(sorted(pdf["text"]))
        blob = b"".join(bytes([len(c)]) + c + int(np.count_nonzero(v)).to_bytes(2, "little") + np.flatnonzero(v).astype(np.uint8).tobytes() + v[v > 0].astype("<u4").tobytes() for c, v in counts.items())
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "tree": [blob]})

    costs = {}
    for row in training_sample(docs).groupBy("lang").applyInPandas(fit, "lang string, tree binary").collect():
        counts, at, blob = {}, 0, row["tree"]
        while at < len(blob):
            size = blob[at]
            context, at = bytes(blob[at + 1 : at + 1 + size]), at + 1 + size
            d, at = int.from_bytes(blob[at : at + 2], "little"), at + 2
            v = np.zeros(256)
            v[np.frombuffer(blob, np.uint8, d, at)] = np.frombuffer(blob, "<u4", d, at + d)
            counts[context], at = v, at + 5 * d
        costs[row["lang"]] = code_costs(counts)
    return assemble(costs)


def held_out(doc_id: F.Column = None) -> F.Column:
    """Whether a document is kept from training: crc32 of its doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict_languages(docs: DataFrame, trees: Trees, names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """Adds the language, its score and its bits a byte under ``names`` to every row, from its text
    alone; no shuffle.

    The tables are sent to the workers once. Extra columns pass through; those that have one of the
    names already (in any case of letters) are replaced. Null texts are ``und``.
    """
    taken = {x.lower() for x in names}
    docs = docs.drop(*[x for x in docs.columns if x.lower() in taken])
    at = docs.columns.index("text")
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("language", nothing)
        for batch in batches:
            langs, score, bits = model.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], [*batch.schema.names, *names])
        give_back()

    kinds = StructType(list(docs.schema))
    for name, kind in zip(names, (StringType(), DoubleType(), DoubleType()), strict=True):
        kinds = kinds.add(name, kind)
    return in_arrow(docs, run, kinds)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    Learns from documents that are not held out and have a lang; rows without doc_id count as not
    held out.
    """
    out = held_out()
    trees = learn(docs.select("doc_id", "lang", "text").where(~out))
    return predict_languages(docs.select("doc_id", out.alias("held_out"), "text"), trees).select("doc_id", "held_out", "lang_pred", "score")
