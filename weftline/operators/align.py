"""Reranking, and alignment of transcript segments with a reference text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Speaking rates for sentences without a time of their own.
WORDS_PER_SECOND = 2.5


def rerank(df: DataFrame, query: Sequence[str], score: Column, threshold: float | None = None, top_k: int | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Adds score and rank: documents of each query by score, then those over the threshold, then the
    first ``top_k``."""
    order = Window.partitionBy(*query).orderBy(F.col("score").desc(), *tie)
    out = df.withColumn("score", score).withColumn("rank", F.row_number().over(order))
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    return out.where(F.col("rank") <= top_k) if top_k is not None else out


def normal_words(text: str) -> list[str]:
    """Words in compatibility form and case-folded."""
    return WORD.findall(unicodedata.normalize("NFKC", text or "").casefold())


class Pattern:
    """A text to be compared with many: edit distance by bit-parallel columns, one step per letter."""

    def __init__(self, text: str):
        self.size, self.masks = len(text), {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, other: str) -> int:
        """Edits between the text and another."""
        if not self.size:
            return len(other)
        full, last = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, total = full, 0, self.size
        for c in other:
            same = self.masks.get(c, 0)
            column = same | minus
            row = (((same & plus) + plus) ^ plus) | same
            up, down = minus | ~(row | plus), plus & row
            total += 1 if up & last else -1 if down & last else 0
            up, down = (up << 1) | 1, down << 1
            plus, minus = (down | ~(column | up)) & full, up & column & full
        return total

    def likeness(self, other: str, least: float = 0.0) -> float:
        """1 - edit distance over the longer length; below ``least`` perhaps only a bound of it."""
        longest = max(self.size, len(other))
        if not longest:
            return 1.0
        bound = 1 - abs(self.size - len(other)) / longest
        return bound if bound < least else 1 - self.distance(other) / longest


def likeness(a: str, b: str) -> float:
    """1 - edit distance over the longer length."""
    return Pattern(a).likeness(b)


def align(segments: Sequence[tuple[str, float, float]], reference: Sequence[str], threshold: float = 0.6, multiplier: float = 3.0, least_window: int = 20) -> list[tuple[float, float, str, bool]]:
    """(start, end, text, estimated): segments with the reference's words, and sentences between them.

    Each segment looks forward from the cursor in a window of ``max(least_window, n * multiplier)``
    words for the span of n-2 to n+2 words that is most like it (the first of ties). Below the
    threshold it keeps its own text. Reference words that are passed over become an estimated segment
    in the time between, those at the end one at a speaking rate.
    """
    words = [(w, n) for s in reference for w, n in zip(WORD.findall(s), normal_words(s), strict=False)]
    forms = [n for _, n in words]
    out: list[tuple[float, float, str, bool]] = []
    at, clock = 0, 0.0
    for text, start, end in segments:
        own = normal_words(text)
        n, best, span = len(own), threshold, None
        pattern = Pattern(" ".join(own))
        window = range(at, min(len(words), at + max(least_window, int(n * multiplier))))
        same = next((a for a in window if n and forms[a : a + n] == own), None)  # the best there can be
        if same is not None:
            best, span, window = 1.0, (same, same + n), ()
        for a in window:
            for size in range(max(1, n - 2), n + 3):
                if a + size <= len(words):
                    found = pattern.likeness(" ".join(forms[a : a + size]), best)
                    if found > best or (span is None and found >= best):
                        best, span = found, (a, a + size)
        if span is None:
            out.append((start, end, text, False))
        else:
            if span[0] > at and start > clock:
                out.append((clock, start, " ".join(w for w, _ in words[at : span[0]]), True))
            out.append((start, end, " ".join(w for w, _ in words[span[0] : span[1]]), False))
            at = span[1]
        clock = max(clock, end)
    if at < len(words):
        rest = [w for w, _ in words[at:]]
        out.append((clock, clock + len(rest) / WORDS_PER_SECOND, " ".join(rest), True))
    return out


def align_transcripts(df: DataFrame, key: str, **limits: float) -> DataFrame:
    """key, start, end, text, estimated; ``df``: key, segments (array of text, start_time, end_time),
    reference (string). Documents are independent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k, parts, reference in pdf[[key, "segments", "reference"]].itertuples(index=False):
            found = align([(p["text"], p["start_time"], p["end_time"]) for p in parts], [reference or ""], **limits)
            rows += [(k, *x) for x in found]
        return pd.DataFrame(rows, columns=[key, "start", "end", "text", "estimated"])

    kind = df.schema[key].dataType.simpleString()
    rows, most = df.select(key, "segments", "reference"), df.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < most:  # few files: the work is in the rows, not in their bytes
        rows = rows.repartition(4 * most)
    return rows.mapInPandas(lambda it: (run(p) for p in it), f"{key} {kind}, start double, end double, text string, estimated boolean")
