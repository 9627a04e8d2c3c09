"""Benchmark decontamination by template canonicalisation.

Native: DataFrame expressions only. Numbers, names and units become typed placeholders; windows of
``WIDTH`` template tokens of documents are hash-joined with those of the benchmark. A document that
shares enough of an item's windows along one alignment is contaminated if the slots agree: a value
of the item must always meet the same value of the document. So re-parameterised questions are found
as well as literal copies.

A window that is mostly placeholders, or an item of few tokens, would meet clean documents as a
template. Such windows are joined by their own tokens instead, slots included: literal copies of
arithmetic, tables, lists of names and short questions are found, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import sized_broadcast, stash

#: Template tokens in a window; an item with fewer is one window. Items of fewer than SHORTEST tokens are
#: joined by their own tokens; those of fewer than ALONE are found only where they are the whole text.
WIDTH, SHORTEST, ALONE = 8, 5, 3
#: Literal tokens that a window joined by its template has at least, as a share of its tokens.
LITERAL = 0.5
#: Share of an item's windows that a document must hold, and share of the item's slot values that
#: must meet one value each along an alignment.
LEAST_SHARE, LEAST_CONSISTENT = 0.3, 0.8

#: Words that count as units when a number stands before them.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds lb lbs "
    "ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degree degrees mph kmh hz khz mhz kb mb gb tb watt watts volt volts"
).split()
#: A capitalised word within a sentence: after a lower-case letter, digit, comma, semicolon or colon and
#: a space; words in capitals alone are no names.
INNER_CAPITAL = r"([\p{Ll}\p{N},;:] )(\p{Lu}\p{Ll})"
NAME_MARK = "\u0001"
TOKEN = NAME_MARK + r"?\p{L}[\p{L}\p{M}]*|\p{N}+(?:[.,]\p{N}+)*"


def tokens(text: Column) -> Column:
    """Words and numbers of a text; names bear a mark. None for null."""
    marked = F.coalesce(text, F.lit(""))
    for _ in range(2):  # a match takes the letter before it, which the end of a short name may be
        marked = F.regexp_replace(marked, INNER_CAPITAL, f"$1{NAME_MARK}$2")
    return F.regexp_extract_all(marked, F.lit(TOKEN), F.lit(0))


def template(raw: Column) -> Column:
    """Template tokens of :func:`tokens`: <num>, <name>, <unit>, or the word in lower case."""
    first = lambda x: F.substring(x, 1, 1)
    number = lambda x: (first(x) >= "0") & (first(x) <= "9") | F.rlike(first(x), F.lit(r"^\p{N}"))

    def one(x: Column, i: Column) -> Column:
        low = F.lower(x)
        unit = low.isin(UNITS) & (i > 0) & F.coalesce(F.rlike(F.get(raw, i - 1), F.lit(r"^\p{N}")), F.lit(False))
        return F.when(first(x) == NAME_MARK, "<name>").when(number(x), "<num>").when(unit, "<unit>").otherwise(low)

    return F.transform(raw, one)


def windows(hashes: Column, width: int) -> Column:
    """Hashes of all windows of ``width`` tokens, from the tokens' hashes; none for fewer."""
    whole = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (width - 1), F.lit(0)))
    return F.transform(whole, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, width)]))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """item_id, width, exact, at, hash, n_windows, raw (tokens of the window), is_slot, slots of every
    window of every item.

    ``exact`` windows bear the hash of their own tokens in lower case, the others that of their
    template; exact ones have no slots to check. Items without a token have no window.
    """
    base = items.select("item_id", tokens(F.col("text")).alias("raw")).where(F.size("raw") > 0)
    base = base.withColumn("width", F.least(F.lit(WIDTH), F.size("raw"))).withColumn("form", template(F.col("raw")))
    base = base.withColumns({"h": F.transform("form", lambda x: F.xxhash64(x)), "own": own_hashes(F.col("raw"))})
    rows = None
    for width in range(1, WIDTH + 1):
        both = F.arrays_zip(windows(F.col("h"), width).alias("h"), windows(F.col("own"), width).alias("own"))
        part = base.where(F.col("width") == width).select("item_id", "width", "raw", "form", F.posexplode(both).alias("at", "both"))
        rows = part if rows is None else rows.unionByName(part)
    cut = lambda c: F.slice(c, F.col("at") + 1, F.col("width"))
    slot = lambda x: x.isin("<num>", "<name>", "<unit>")
    rows = rows.select("item_id", "width", "at", "both", cut(F.col("raw")).alias("raw"), F.transform(cut(F.col("form")), slot).alias("is_slot"))
    slots = F.size(F.filter("is_slot", lambda x: x))
    rows = rows.withColumn("exact", (F.col("width") < SHORTEST) | (F.col("width") - slots < F.col("width") * LITERAL))
    rows = rows.withColumn("slots", F.when(F.col("exact"), 0).otherwise(slots)).withColumn("hash", F.when(F.col("exact"), F.col("both.own")).otherwise(F.col("both.h"))).drop("both")
    usable = rows.groupBy("item_id").agg(F.countDistinct("at").alias("n_windows"))
    return rows.join(usable, "item_id")


def own_hashes(raw: Column) -> Column:
    """Hashes of :func:`tokens` in lower case; the mark of a name is no part of it."""
    return F.transform(raw, lambda x: F.xxhash64(F.ltrim(F.lower(x), F.lit(NAME_MARK))))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_matched, share, consistent: every contaminated document with its items.

    Texts are read once; only (doc_id, position, hash) of each window meets the benchmark's windows,
    which are broadcast if their number is small and joined by shuffle else. Windows of a kind (width;
    template or own tokens) that no item has are not made. Slots are checked for matches in windows
    with placeholders alone, whose documents are read once more.

    Null texts and null items match nothing; a null doc_id is a document of its own name; repeated
    rows count once; slots of an item that occurs twice in a text are judged per occurrence. Items of
    one or two tokens are found only where they are a document's whole text. Empty tables give an
    empty result.
    """
    bench = stash(benchmark_windows(benchmark.select("item_id", "text").where("item_id is not null").distinct()), "benchmark-windows")
    keys = bench.groupBy("hash", "width", "exact").agg(F.collect_set(F.struct("item_id", "at", "slots")).alias("at_items"))
    counts = bench.groupBy("width", "exact").count().collect()
    keys = sized_broadcast(keys, sum(r["count"] for r in counts))
    text = docs.select("doc_id", F.col("text"))
    kinds = sorted({(r["width"], r["exact"]) for r in counts} | {(WIDTH, False)})
    hashed = text.select("doc_id", tokens(F.col("text")).alias("raw")).withColumn("form", template(F.col("raw")))
    own = [own_hashes(F.col("raw")).alias("own")] if any(x for _, x in kinds) else []
    hashed = hashed.select("doc_id", F.transform("form", lambda x: F.xxhash64(x)).alias("h"), *own)
    found = None
    for width, exact in kinds:
        some = hashed.where(F.size("own") == width) if width < ALONE else hashed
        rows = some.select("doc_id", F.lit(width).alias("width"), F.lit(exact).alias("exact"), F.posexplode(windows(F.col("own" if exact else "h"), width)).alias("doc_at", "hash"))
        rows = rows.join(keys, ["hash", "width", "exact"]).select("doc_id", "width", "doc_at", F.explode("at_items").alias("x"))
        rows = rows.select("doc_id", "width", "doc_at", "x.item_id", "x.at", "x.slots")
        found = rows if found is None else found.unionByName(rows)
    found = stash(found.withColumn("shift", F.col("doc_at") - F.col("at")), "benchmark-matches")
    totals = bench.select("item_id", "n_windows").distinct()
    held = found.groupBy("doc_id", "item_id").agg(F.countDistinct("at").alias("n_matched"))
    held = held.join(totals, "item_id").withColumn("share", F.col("n_matched") / F.col("n_windows")).where(F.col("share") >= LEAST_SHARE)
    agreed = slot_agreement(text, bench, found)
    held = held.join(agreed, held["doc_id"].eqNullSafe(agreed["__doc_id"]) & (held["item_id"] == agreed["__item_id"]), "left")
    held = held.withColumn("consistent", F.coalesce("agreeing", F.lit(1.0))).where(F.col("consistent") >= LEAST_CONSISTENT)
    return held.select("doc_id", "item_id", "n_matched", "share", "consistent")


def slot_agreement(text: DataFrame, bench: DataFrame, found: DataFrame) -> DataFrame:
    """agreeing per (__doc_id, __item_id): the share of the item's slot values, of each alignment, that
    always met the same value of the document."""
    places = found.where("slots > 0").groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "at", "doc_at", "width", "shift")).alias("places")).withColumnRenamed("doc_id", "__named")
    places = stash(places, "benchmark-places")  # one row per document that holds a template with slots
    rows = text.join(sized_broadcast(places, places.agg(F.sum(F.size("places"))).first()[0] or 0), F.col("doc_id").eqNullSafe(F.col("__named"))).select("__named", "places", tokens(F.col("text")).alias("doc_raw"))
    cut = lambda x: F.struct(x["item_id"].alias("item_id"), x["at"].alias("at"), x["shift"].alias("shift"), F.slice(F.col("doc_raw"), x["doc_at"] + 1, x["width"]).alias("own"), x["width"].alias("width"))
    rows = rows.select(F.col("__named").alias("doc_id"), F.explode(F.transform("places", cut)).alias("x")).select("doc_id", "x.*")
    rows = rows.join(bench.select("item_id", "at", "raw", "is_slot").distinct(), ["item_id", "at"])
    own = F.col("own")
    rows = rows.where(F.size(own) == F.col("width"))
    pairs = F.filter(F.arrays_zip(F.col("is_slot").alias("slot"), F.col("raw").alias("theirs"), own.alias("ours")), lambda x: x["slot"])
    rows = rows.select("doc_id", "item_id", "shift", F.explode(pairs).alias("p"))
    values = rows.groupBy("doc_id", "item_id", "shift", F.lower("p.theirs").alias("v")).agg(F.countDistinct(F.lower("p.ours")).alias("n"))
    return values.groupBy(F.col("doc_id").alias("__doc_id"), F.col("item_id").alias("__item_id")).agg(F.avg((F.col("n") == 1).cast("double")).alias("agreeing"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents; rows without doc_id cannot be named and stay."""
    bad = stash(contaminated(docs, benchmark).select(F.col("doc_id").alias("__bad")).where("__bad is not null").distinct(), "contaminated")
    return docs.join(sized_broadcast(bad), F.col("doc_id") == F.col("__bad"), "left_anti")
