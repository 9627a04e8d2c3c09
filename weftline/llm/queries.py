"""The queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html_text, importance, language_id, near_dup, pii, quality_rules, token_file, warc
from ._shared import table


def vocabulary() -> str:
    """Place of the default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), vocabulary())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_roundtrip(table(spark, sf_dir, "pages"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_file_roundtrip(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_html_extraction, op3_bpe, op4_warc, op5_token_ids, op6_pii, op7_decontamination, op8_language_id, op9_quality_rules, op10_quality_classifier)}


def _op7_sql() -> str:
    """Windows as text in place of hashes; the rest as in :mod:`decontaminate`."""
    d = decontaminate
    units = ", ".join(f"'{u}'" for u in d.UNITS)
    mark = lambda x: f"regexp_replace({x}, '{d.INNER_CAPITAL}', '\\1' || chr(1) || '\\2', 'g')"
    marked = mark(mark("coalesce(text, '')"))
    raw = f"regexp_extract_all({marked}, '\\x01?\\p{{L}}[\\p{{L}}\\p{{M}}]*|\\p{{N}}+(?:[.,]\\p{{N}}+)*')"
    form = f"list_transform(raw, lambda x, i: CASE WHEN x[1] = chr(1) THEN '<name>' WHEN regexp_matches(x, '^\\p{{N}}') THEN '<num>' WHEN lower(x) IN ({units}) AND i > 1 AND regexp_matches(raw[i - 1], '^\\p{{N}}') THEN '<unit>' ELSE lower(x) END)"
    slot = "x IN ('<num>', '<name>', '<unit>')"
    plain = "array_to_string(list_transform({0}, lambda x: ltrim(lower(x), chr(1))), ' ')"
    return f"""WITH b0 AS (SELECT item_id, raw, {form} AS form, least({d.WIDTH}, len(raw)) AS width FROM (SELECT DISTINCT item_id, {raw} AS raw FROM benchmark WHERE item_id IS NOT NULL) WHERE len(raw) > 0),
b1 AS (SELECT item_id, width, at_, raw[at_ + 1:at_ + width] AS raw, form[at_ + 1:at_ + width] AS form FROM (SELECT *, unnest(range(len(raw) - width + 1)) AS at_ FROM b0)),
b2 AS (SELECT *, len(list_filter(form, lambda x: {slot})) AS n_slots FROM b1),
b3 AS (SELECT *, width < {d.SHORTEST} OR width - n_slots < width * {d.LITERAL} AS exact FROM b2),
b4 AS (SELECT *, CASE WHEN exact THEN 0 ELSE n_slots END AS slots, CASE WHEN exact THEN {plain.format("raw")} ELSE array_to_string(form, ' ') END AS win FROM b3),
b AS (SELECT *, (SELECT count(DISTINCT at_) FROM b4 y WHERE y.item_id = b4.item_id) AS n_windows FROM b4),
d0 AS (SELECT doc_id, raw, {form} AS form FROM (SELECT doc_id, {raw} AS raw FROM documents)),
d1 AS (SELECT doc_id, width, exact, doc_at, raw[doc_at + 1:doc_at + width] AS own, CASE WHEN exact THEN {plain.format("raw[doc_at + 1:doc_at + width]")} ELSE array_to_string(form[doc_at + 1:doc_at + width], ' ') END AS win FROM (SELECT doc_id, raw, form, width, exact, unnest(range(len(raw) - width + 1)) AS doc_at FROM d0, (SELECT DISTINCT width, exact FROM b) WHERE len(raw) >= width AND (width >= {d.ALONE} OR len(raw) = width))),
m AS (SELECT doc_id, item_id, at_, doc_at, doc_at - at_ AS shift, n_windows, slots, b.raw AS theirs, b.form, own FROM d1 JOIN b ON d1.win = b.win AND d1.width = b.width AND d1.exact = b.exact),
h AS (SELECT doc_id, item_id, count(DISTINCT at_) AS n_matched, count(DISTINCT at_) / any_value(n_windows) AS share FROM m GROUP BY ALL),
s AS (SELECT doc_id, item_id, shift, lower(theirs[k]) AS v, count(DISTINCT lower(own[k])) AS n FROM (SELECT *, unnest(range(1, len(form) + 1)) AS k FROM m WHERE slots > 0) WHERE form[k] IN ('<num>', '<name>', '<unit>') GROUP BY ALL),
a AS (SELECT doc_id, item_id, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS agreeing FROM s GROUP BY ALL)
SELECT h.doc_id, h.item_id, n_matched, share, coalesce(agreeing, 1.0)::DOUBLE AS consistent FROM h LEFT JOIN a ON h.doc_id IS NOT DISTINCT FROM a.doc_id AND h.item_id = a.item_id WHERE share >= {d.LEAST_SHARE} AND coalesce(agreeing, 1.0) >= {d.LEAST_CONSISTENT}"""


def _op9_sql() -> str:
    """The log-bucket sketches as counts per bucket, quantiles as running counts."""
    q = quality_rules
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    measures = {"symbol_share": "n_symbols / greatest(n_words, 1)", "word_length": "word_chars / greatest(n_words, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)"}
    sizes = {"n_words": "n_words", "n_lines": "n_lines"}
    long = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, ({v})::DOUBLE AS v FROM w" for k, v in (measures | sizes).items())
    value = lambda b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE {q.TINY} * pow({q.GAMMA}, {b} - 1.5) END"
    ranks = ", ".join(f"min(b) FILTER (seen >= total * {x - q.SLACK!r}) AS b{int(x * 100)}" for x in (0.25, 0.5, 0.75))
    of = lambda m, k: f"max(CASE WHEN measure = '{m}' THEN q{k} END)"
    width = {m: f"{q.REACH} * greatest({of(m, 75)} - {of(m, 25)}, {event} / greatest({of(size, 25)}, 1.0), {q.GAMMA - 1!r} * {of(m, 50)})" for m, (event, size) in q.EVENTS.items()}
    sides = ", ".join(f"{f'{of(m, 50)} - {x}' if m in q.TWO_SIDED else '0.0'} AS low_{m}, {of(m, 50)} + {x} AS high_{m}" for m, x in width.items())
    inside = " AND ".join(f"{v} BETWEEN low_{m} AND high_{m}" for m, v in measures.items())
    return f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
p AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: translate(x, {spaces}, '') <> '') AS lines FROM d),
wi AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM p WHERE len(words) >= 3)),
du AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wi) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM du, (VALUES (0), (1), (2)) o(k) GROUP BY doc_id),
w AS (SELECT p.doc_id, lang, source, len(words)::BIGINT AS n_words, length(translate(t, {spaces}, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '{q.SYMBOLS}', '')))::BIGINT AS n_symbols, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words FROM p LEFT JOIN rw ON p.doc_id = rw.doc_id),
l AS (SELECT lang, source, measure, CASE WHEN v < {q.TINY} THEN 0 ELSE ceil(ln(v / {q.TINY}) / {math.log(q.GAMMA)!r})::INT + 1 END AS b FROM ({long})),
c AS (SELECT lang, source, measure, b, count(*)::DOUBLE AS n FROM l GROUP BY ALL),
ca AS (SELECT measure, b, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY measure) AS total FROM c GROUP BY measure, b),
la AS (SELECT DISTINCT lang, measure FROM c),
cl AS (SELECT lang, measure, b, sum(n) AS n FROM (SELECT lang, measure, b, n FROM c UNION ALL SELECT lang, measure, b, n * {q.BORROWED} / total FROM la JOIN ca USING (measure)) GROUP BY ALL),
cm AS (SELECT *, sum(n) OVER (PARTITION BY lang, measure) AS total FROM cl),
ga AS (SELECT DISTINCT lang, source, measure FROM c),
cg AS (SELECT lang, source, measure, b, sum(n) AS n FROM (SELECT lang, source, measure, b, n FROM c UNION ALL SELECT ga.lang, source, ga.measure, b, n * {q.BORROWED} / total FROM ga JOIN cm ON ga.measure = cm.measure AND ga.lang IS NOT DISTINCT FROM cm.lang) GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY b) AS seen, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM cg),
f AS (SELECT lang, source, measure, {ranks} FROM r GROUP BY ALL),
v AS (SELECT lang, source, measure, {value("b25")} AS q25, {value("b50")} AS q50, {value("b75")} AS q75 FROM f),
g AS (SELECT lang, source, {sides} FROM v GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEAT_PERCENT} * n_words) AS base_failed, NOT (n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEAT_PERCENT} * n_words) AND {inside} AS kept FROM w JOIN g ON w.lang IS NOT DISTINCT FROM g.lang AND w.source IS NOT DISTINCT FROM g.source"""


ORACLE_SQL: dict[str, str] = {
    "op4_warc": f"""WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS x, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE octet_length(x) >= {warc.LEAST_SHARED} GROUP BY payload_digest)
SELECT page_id, url, octet_length(x) AS payload_bytes, p.payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest""",
    "op7_decontamination": _op7_sql(),
    "op9_quality_rules": _op9_sql(),
}
