"""Personal data: fixed patterns, and terms that give a protected entity away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Each distinct value is
a protected entity. From all texts it is estimated how strongly a term reveals an entity: the
pointwise mutual information of term and entity over the information content of the entity, where
all counts are of different texts, so that copies change nothing. Terms whose share reaches
``GENERALISE`` are generalised, from ``REMOVE`` on removed, wherever they stand in a text that
mentions the entity. A generalised term gives way to a broader one: the class that its form and its
neighbours show (a person, a place, an organisation, a time, a code, a name, or any word).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import begin, in_arrow, nothing, sized_broadcast, stash

#: Kinds in the order of the result, their patterns, and what stands for them.
KINDS = ("email", "ip", "card", "phone")
#: The characters of an address before its @, and the rest of it.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": "[REMOVED]"}
#: Words that show the class of the term beside them, before it and after it, and words of time.
BEFORE = {
    "mr": "PERSON", "mrs": "PERSON", "ms": "PERSON", "miss": "PERSON", "dr": "PERSON", "prof": "PERSON", "professor": "PERSON", "sir": "PERSON", "madam": "PERSON",
    "herr": "PERSON", "frau": "PERSON", "monsieur": "PERSON", "madame": "PERSON", "mme": "PERSON", "señor": "PERSON", "señora": "PERSON", "sr": "PERSON", "sra": "PERSON",
}
AFTER = {
    "street": "PLACE", "road": "PLACE", "avenue": "PLACE", "lane": "PLACE", "square": "PLACE", "city": "PLACE", "county": "PLACE", "river": "PLACE", "lake": "PLACE",
    "inc": "ORGANISATION", "ltd": "ORGANISATION", "llc": "ORGANISATION", "corp": "ORGANISATION", "company": "ORGANISATION", "gmbh": "ORGANISATION", "university": "ORGANISATION", "bank": "ORGANISATION",
}
TIMES = frozenset("monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split())
NEIGHBOUR_BEFORE, NEIGHBOUR_AFTER = re.compile(r"[^\W\d_]+\.?[ ]\Z"), re.compile(r"[ ][^\W\d_]+")

TERM = re.compile(r"[^\W\d_]{3,}")
DIGITS = re.compile(r"[0-9]")
#: The least number of different texts that tie a term to an entity.
LEAST_TEXTS = 2
#: Shares of an entity's information from which a term is generalised or removed.
GENERALISE, REMOVE = 0.75, 0.9


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses: for every @, the run of characters before it that an address can have, and the domain
    behind it. No character is looked at more than twice, however long the runs are."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        done = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", done)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base spans in code points, by kind and start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in emails(text)]
    if not DIGITS.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))] if "." in text else []
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(digits := "".join(DIGITS.findall(m[0]))) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGITS.findall(m[0])) <= 15]
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end of spans, joined by commas."""
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def entities_of(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The distinct protected entities of a text, sorted: kind and value of its base spans."""
    return sorted({f"{kind}:{text[a:b].lower() if kind in ('email', 'ip') else ''.join(DIGITS.findall(text[a:b]))}" for kind, a, b in spans})


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of all terms of the whole text in order; parts of any span are no terms."""
    taken = iter([*sorted((a, b) for _, a, b in spans), (len(text), len(text))])
    first, last = next(taken)
    for m in TERM.finditer(text):
        start, end = m.span()
        while last <= start and last < len(text):
            first, last = next(taken)
        if end <= first or last <= start:
            yield m[0].lower(), start, end


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, entities array<string>, terms array<string>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, what :func:`base_spans` finds in every whole text, and the distinct entities
    and terms of texts that mention an entity.

    One pass without a shuffle. Null text is empty.
    """
    names = ["doc_id", "text_hash", *(x.split()[0] for x in FOUND.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("pii", nothing)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            spans = [base_spans(t) for t in texts]
            counts = [pa.array([sum(x[0] == k for x in s) for s in spans], pa.int64()) for k in KINDS]
            lists = [listed(s) for s in spans]
            entities = [entities_of(t, s) if s else [] for t, s in zip(texts, spans, strict=True)]
            terms = [sorted({x[0] for x in terms_of(t, s)}) if s else [] for t, s in zip(texts, spans, strict=True)]
            several = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lists], pa.string()), pa.array(lists, pa.string()), pa.array(entities, several), pa.array(terms, several)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run, f"doc_id {kind}, text_hash long, {FOUND}")


def _mentions(found: DataFrame) -> DataFrame:
    """(text_hash, entity, n_e) of different texts, for entities in ``LEAST_TEXTS`` of them at least."""
    rows = stash(found.select("text_hash", F.explode("entities").alias("entity")).distinct(), "pii-entities")
    n_e = stash(rows.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= LEAST_TEXTS), "pii-known")
    return stash(rows.join(sized_broadcast(n_e), "entity"), "pii-mentions")


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, share) of terms whose share of the entity's information reaches ``GENERALISE``.

    share = log2(N n_te / (n_t n_e)) / log2(N / n_e), where N counts the different texts, n_e those
    that mention the entity, n_t those that hold the term and n_te those that hold both, anywhere. As n_te is at most n_e, a term whose share is large enough has
    n_t of at most n_e ** (3 / 4) N ** (1 / 4) (for ``GENERALISE`` = 3 / 4): others leave before terms
    meet entities, and no result changes by it. n_t is counted over all texts, map-side first.
    """
    return _disclosing(docs, found, _mentions(found))


def _disclosing(docs: DataFrame, found: DataFrame, mentions: DataFrame) -> DataFrame:
    # a row of a text that c rows hold counts 1 / c, so that texts need not meet to be counted once
    copies = stash(found.groupBy("text_hash").agg(F.count("*").alias("c")).where("c > 1").withColumnRenamed("text_hash", "__pii_text"), "pii-copies")
    rows = docs.select("text").join(sized_broadcast(copies), F.xxhash64("text") == F.col("__pii_text"), "left")
    words = rows.select(F.explode(F.array_distinct(F.transform(F.split("text", r"[^\p{L}\p{Nl}\p{No}]+"), F.lower))).alias("term"), (1 / F.coalesce("c", F.lit(1))).alias("part"))
    n_t = words.where(F.length("term") >= 3).groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("n_t"))
    total = float(max(found.select("text_hash").distinct().count(), 1))
    most = lambda n: F.pow(n, F.lit(GENERALISE)) * total ** (1 - GENERALISE) * (1 + 1e-9)
    known = mentions.groupBy("text_hash").agg(F.max("n_e").alias("most"))
    rows = found.where(F.size("entities") > 0).select("text_hash", F.explode("terms").alias("term")).distinct().join(sized_broadcast(known), "text_hash")
    # a term that the two patterns read differently has no n_t
    rows = rows.join(n_t, "term", "left").where(F.col("n_t").isNull() | F.col("n_t").between(LEAST_TEXTS, most(F.col("most")))).select("text_hash", "term", "n_t")
    pairs = rows.join(mentions, "text_hash").where(F.col("n_t").isNull() | (F.col("n_t") <= most(F.col("n_e"))))
    shared = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.max("n_e").alias("n_e"), F.max("n_t").alias("n_t")).where(F.col("n_te") >= LEAST_TEXTS)
    shared = shared.withColumn("n_t", F.greatest(F.coalesce("n_t", F.lit(0)), F.col("n_te")))
    information = F.log2(F.lit(total) / F.col("n_e"))
    share = F.when(information > 0, F.log2(F.lit(total) * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / information).otherwise(0.0)
    return shared.select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE)


def term_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, terms: array of start, end, kind) for documents with disclosing terms.

    kind: general or removed. A term that discloses an entity is found wherever it stands in a text
    that mentions the entity. The terms of one entity are gathered before the join, so an entity with
    very many mentions meets one row, and Spark splits its partition; of texts, only those with
    disclosing terms are read again.
    """
    mentions = _mentions(found)
    known = stash(_disclosing(docs, found, mentions), "pii-disclosing")
    known = known.groupBy("entity").agg(F.collect_list(F.struct("term", (F.col("share") >= REMOVE).alias("removed"))).alias("known"))
    hit = mentions.select("text_hash", "entity").join(known, "entity").groupBy("text_hash").agg(F.array_distinct(F.flatten(F.collect_list("known"))).alias("known"))
    hit = stash(hit.withColumnRenamed("text_hash", "__pii_text"), "pii-text-terms")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = rows.join(sized_broadcast(hit, _sizes(hit, "known")), F.col("text_hash") == F.col("__pii_text")).select("doc_id", "text_hash", "text", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("pii", nothing)
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            out = []
            for text, listed_terms in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                removed = {}
                for x in listed_terms:
                    removed[x["term"]] = x["removed"] or removed.get(x["term"], False)
                out.append([{"start": a, "end": b, "kind": "removed" if removed[t] else "general"} for t, a, b in terms_of(text, base_spans(text)) if t in removed])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kinds)], ["doc_id", "text_hash", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = in_arrow(rows, run, f"doc_id {kind}, text_hash long, terms array<struct<start:int,end:int,kind:string>>")
    return out.where(F.size("terms") > 0).dropDuplicates(["doc_id", "text_hash"])


def _sizes(df: DataFrame, column: str) -> int:
    """Number of entries in the lists of all rows: what decides whether the rows are few enough to broadcast."""
    return df.agg(F.sum(F.size(column))).first()[0] or 0


def _with_terms(df: DataFrame, terms: DataFrame, text_hash: str) -> DataFrame:
    terms = terms.select(F.col("doc_id").alias("__pii_doc"), F.col("text_hash").alias("__pii_text"), F.col("terms").alias("__pii_terms"))
    return df.join(terms, F.col("doc_id").eqNullSafe(F.col("__pii_doc")) & (F.col(text_hash) == F.col("__pii_text")), "left").drop("__pii_doc", "__pii_text")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row.

    ``docs`` needs doc_id and text; other columns are not read. Null text has no spans. Repeated rows
    give repeated results. ``spans`` lists the base spans, then general and removed terms by start.
    """
    found = stash(scan(docs), "pii-found")
    terms = stash(term_spans(docs.select("doc_id", "text"), found), "pii-term-spans")
    out = _with_terms(found.drop("entities", "terms"), sized_broadcast(terms, _sizes(terms, "terms")), "text_hash")
    extra = F.concat_ws(",", F.transform(F.array_sort(F.transform("__pii_terms", lambda x: F.struct(x["kind"], x["start"], x["end"]))), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("__pii_terms").isNotNull(), extra))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))


def broader(text: str, start: int, end: int) -> str:
    """The class that takes the place of the term at text[start:end]."""
    term = text[start:end]
    if term.lower() in TIMES:
        return "[TIME]"
    if m := NEIGHBOUR_BEFORE.search(text, max(0, start - 24), start):
        if found := BEFORE.get(m[0].rstrip(". ").lower()):
            return f"[{found}]"
    if m := NEIGHBOUR_AFTER.match(text, end):
        if found := AFTER.get(m[0].strip().lower()):
            return f"[{found}]"
    return "[CODE]" if term.isupper() else "[NAME]" if term[0].isupper() else "[WORD]"


def mask(text: str | None, terms: list[tuple[int, int, str]]) -> str | None:
    """The text with every span replaced by its mask, generalised terms by their class (see
    :func:`broader`); of spans that overlap, the one that starts first (then the longest) takes the
    place of all that it touches."""
    if not text:
        return text
    spans = sorted([(a, -b, k) for k, a, b in base_spans(text)] + [(a, -b, k) for a, b, k in terms])
    if not spans:
        return text
    out, at, end = [], 0, -1
    for a, b, kind in spans:
        if a < end:
            end = at = max(end, -b)
            continue
        out += [text[at:a], broader(text, a, -b) if kind == "general" else MASKS[kind]]
        at = end = -b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with spans and disclosing terms masked in text, and n_chars (if present) renewed.

    Every row and column stays.
    """
    found = stash(scan(docs), "pii-found")
    terms = stash(term_spans(docs.select("doc_id", "text"), found), "pii-term-spans")
    rows = _with_terms(docs.withColumn("__pii_hash", F.xxhash64("text")), sized_broadcast(terms, _sizes(terms, "terms")), "__pii_hash")
    at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("pii", nothing)
        for batch in batches:
            terms = [[(x["start"], x["end"], x["kind"]) for x in row or ()] for row in batch.column(batch.num_columns - 1).to_pylist()]
            texts = pa.array([mask(t, x) for t, x in zip(batch.column(at).to_pylist(), terms, strict=True)], pa.string())
            columns = batch.columns[:width]
            columns[at] = texts
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[: len(columns)])

    out = in_arrow(rows.select(*docs.columns, "__pii_terms"), run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
