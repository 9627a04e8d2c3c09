"""Quality rules with thresholds that follow each language and source.

Native: DataFrame expressions only. Every text is measured once; the measures go through mergeable
log-bucket quantile sketches per (lang, source), and each document is joined with the fences of its
own group. A sketch is a set of (bucket, count) rows: buckets of width ``GAMMA`` in the logarithm,
so counts of parts simply add up, the number of rows per group is bounded by the range of a double,
and quantiles have a relative error below ``(GAMMA - 1) / 2``.

No fence is a fixed number. It lies ``REACH`` times the group's own spread off its median: the distance
of the quartiles, and where they coincide (most texts have no symbol, no repeat) what a single event
weighs in a short text of the group, and no less than the sketch can tell apart. Small groups borrow from their language, and languages from the
corpus: their sketches get that of the larger one added, scaled to ``BORROWED`` documents, so nothing
switches at any size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import sized_broadcast, stash

#: What separates words, and the symbols that are counted.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Growth of a sketch bucket's upper bound.
GAMMA = 1.02
#: Values below this share bucket 0.
TINY = 1e-3
#: Measures, with what one event adds to their numerator (a symbol, a character, the six words of a
#: repeated window, a line) and the size that it is a share of.
EVENTS = {"symbol_share": (1, "n_words"), "word_length": (1, "n_words"), "repeat_share": (6, "n_words"), "dup_line_share": (1, "n_lines")}
#: Measures of which too little is as odd as too much.
TWO_SIDED = ("word_length",)
#: Fences lie this many spreads off the median.
REACH = 4.0
#: Documents of the language (of the corpus) that a group's (a language's) sketch borrows.
BORROWED = 200.0
#: Slack of a rank, as a share of the total, for sums of fractions.
SLACK = 1e-9
#: Fixed base rules.
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50


def _window_hashes(words: Column) -> Column:
    """Hashes of all 3-word windows; none for fewer words."""
    first = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(first, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    Null or empty text has no words; all counts are 0. Extra columns pass through. Whole texts are
    read in one pass, without a shuffle; memory is that of one document.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    words, lines, windows, twice, starts = (f"__{k}_{text}" for k in ("words", "lines", "windows", "twice", "starts"))
    out = docs.withColumns(
        {
            words: F.filter(F.split(raw, r"[ \t-\r]+"), lambda w: w != ""),
            lines: F.filter(F.split(raw, "\n"), lambda x: F.translate(x, SPACES, "") != ""),
            "word_chars": F.length(F.translate(raw, SPACES, "")).cast("long"),
            "n_symbols": (F.length(raw) - F.length(F.translate(raw, SYMBOLS, ""))).cast("long"),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            windows: _window_hashes(F.col(words)),
        }
    ).drop(words, lines)
    # only texts that repeat a window have theirs sorted
    pair = lambda h, i: F.struct(h.alias("h"), i.alias("i"))
    w = F.col(windows)
    out = out.withColumn(twice, F.when(F.size(F.array_distinct(w)) < F.size(w), F.array_sort(F.transform(w, pair))))
    t = F.col(twice)
    again = F.filter(t, lambda x, j: x["h"].eqNullSafe(F.get(t, j - 1)["h"]) | x["h"].eqNullSafe(F.get(t, j + 1)["h"]))
    out = out.withColumn(starts, F.when(t.isNotNull(), F.array_sort(F.transform(again, lambda x: x["i"]))).otherwise(F.array().cast("array<int>")))
    p = F.col(starts)
    steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
    return out.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)).drop(windows, twice, starts)


def _measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / words,
        "word_length": F.col("word_chars") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


def bucket(value: Column) -> Column:
    """The sketch bucket of a value of 0 or more."""
    return F.when(value < TINY, 0).otherwise(F.ceil(F.log(value / TINY) / math.log(GAMMA)) + 1).cast("int")


def bucket_value(b: Column) -> Column:
    """The value that stands for a bucket."""
    return F.when(b == 0, F.lit(0.0)).otherwise(TINY * F.pow(F.lit(GAMMA), b - 1.5))


def _ranked(raw: Column, total: Column, q: float) -> Column:
    """The bucket in which a sketch (array of bucket and n, sorted) reaches the share ``q``."""
    empty = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("int").alias("at"))
    found = F.aggregate(raw, empty, lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + x["n"] >= total * (q - SLACK), x["bucket"])).alias("at")))
    return bucket_value(found["at"])


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, raw, total): the sketch of every group, with what it borrows.

    The rows of a group are summed map-side before they are shuffled, so one source with a third of
    all documents sends no more rows than any other. What is borrowed is one row per language and
    measure, bounded by the range of the buckets.
    """
    names = _measures() | {k: F.col(k) for k in ("n_words", "n_lines")}
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v.cast("double")).alias("bucket")) for k, v in names.items()]))
    fine = measured.select("lang", "source", long.alias("m")).groupBy("lang", "source", F.col("m.measure").alias("measure"), F.col("m.bucket").alias("bucket")).agg(F.count("*").alias("n"))
    fine = stash(fine, "quality-sketches")

    def level(*keys: str) -> DataFrame:
        rows = fine.groupBy(*keys, "measure", "bucket").agg(F.sum("n").cast("double").alias("n"))
        return rows.groupBy(*keys, "measure").agg(F.collect_list(F.struct("bucket", "n")).alias("raw"), F.sum("n").alias("total"))

    def lent(df: DataFrame, keys: dict[str, str]) -> DataFrame:
        scaled = F.transform("raw", lambda x: F.struct(x["bucket"].alias("bucket"), (x["n"] * BORROWED / F.col("total")).alias("n")))
        return F.broadcast(df.select(*[F.col(k).alias(v) for k, v in keys.items()], scaled.alias("__lent")))

    def with_lent(df: DataFrame, lender: DataFrame, on: Column) -> DataFrame:
        names = [x for x in df.columns if x not in ("raw", "total")]
        return df.join(lender, on).select(*names, F.concat("raw", "__lent").alias("raw"), (F.col("total") + BORROWED).alias("total"))

    same = F.col("measure") == F.col("__m")
    language = with_lent(level("lang"), lent(level(), {"measure": "__m"}), same)
    group = with_lent(level("lang", "source"), lent(language, {"measure": "__m", "lang": "__l"}), same & F.col("lang").eqNullSafe(F.col("__l")))
    return group.withColumn("raw", F.array_sort("raw"))


def fences(measured: DataFrame) -> DataFrame:
    """lang, source, and __low_m and __high_m of every measure m."""
    found = sketches(measured)
    raw, total = F.col("raw"), F.col("total")
    found = found.select("lang", "source", "measure", *[_ranked(raw, total, q).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)])
    of = lambda m, q: F.max(F.when(F.col("measure") == m, F.col(q)))
    sides = []
    for m, (event, size) in EVENTS.items():
        width = REACH * F.greatest(of(m, "q75") - of(m, "q25"), event / F.greatest(of(size, "q25"), F.lit(1.0)), (GAMMA - 1) * of(m, "q50"))
        sides += [(of(m, "q50") - width if m in TWO_SIDED else F.lit(0.0)).alias(f"__low_{m}"), (of(m, "q50") + width).alias(f"__high_{m}")]
    return found.groupBy("lang", "source").agg(*sides)


def judge(measured: DataFrame) -> DataFrame:
    """Adds base_failed and kept.

    A document stays if it passes the base rules and every measure lies within the fences of its
    (lang, source). Null languages and sources are groups of their own. Values on a fence stay.
    """
    limits = stash(fences(measured).withColumnsRenamed({"lang": "__l", "source": "__s"}), "quality-fences")
    out = measured.join(sized_broadcast(limits), F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s")), "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    inside = F.lit(True)
    for m, v in _measures().items():
        inside &= v.between(F.col(f"__low_{m}"), F.col(f"__high_{m}"))
    return out.withColumns({"base_failed": failed, "kept": ~failed & inside}).select(*measured.columns, "base_failed", "kept")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    ``docs`` needs doc_id, text, lang, source; other columns are not read. One row per input row,
    repeated rows included; an empty table gives an empty result. The measures are written once, so
    that texts are read and measured a single time.
    """
    measured = stash(measure(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-measures")
    return judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
