"""Personal data against the plain patterns, and terms that disclose."""

import hashlib
import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
CARD = "4539 1488 0343 6467"


def good(kind, s):
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in PLAIN.items() for m in p.finditer(text or "") if good(k, m[0])]


TEXTS = [
    None, "", "no data", "mail a.b+c@x-y.example.com now", "a@b", "a@b.c@d.e", "a@b.c_d@e.f", "x@@y.z @y.z q@y..z", "ip 1.2.3.4, 256.1.1.1 1.2.3.4.5 0001.02.3.4 1.2.3", f"card {CARD} and 4539-1488-0343-6467 5",
    "+1 (555) 123-4567 +12 +123456789012345678 +1+1 (555) 555-5555", "é@x.y日本 ü.z@x.y", "1" * 400, "1.1." * 60, "a" * 3000 + "@", "+" + "1 " * 50, "12.34.56.78@mail.com +49.30.123456.7",
]


def test_base_spans_equal_the_patterns():
    for t in TEXTS:
        assert pii.base_spans(t) == brute(t), t


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1 @.+-()_%é\n9", max_size=60))
def test_base_spans_equal_the_patterns_on_any_text(text):
    assert pii.base_spans(text) == brute(text)


def test_generated_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in pii.find_pii(docs).collect():
        spans = brute(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s[0] == k for s in spans) for k in PLAIN)
        assert r["spans"].startswith(listed)


def corpus(spark, extra=()):
    """Mail of one person, twice next to a rare nickname in different words; common words elsewhere."""
    rows = [(1, "The zorblatt person writes from jo@example.org about looms today", 0), (2, "Ask zorblatt via jo@example.org for silk and wool prices", 0), (3, "Write to max@example.org about looms", 0)]
    rows += [(10 + i, f"Plain words about looms and silk number {chr(97 + i % 26)} today", 0) for i in range(200)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, terms int")


def test_terms_that_disclose(spark):
    got = {r["doc_id"]: r for r in pii.find_pii(corpus(spark)).collect()}
    a = "The zorblatt person writes from jo@example.org about looms today".index("zorblatt")
    assert f"removed:{a}:{a + 8}" in got[1]["spans"] and "removed:4:12" in got[2]["spans"]
    assert "silk" not in got[2]["spans"] and got[3]["spans"] == "email:9:24" and got[10]["spans"] == ""


def test_shares_equal_the_formula(spark):
    docs = corpus(spark)
    shares = {(r["entity"], r["term"]): r["share"] for r in pii.disclosing_terms(docs, pii.scan(docs)).collect()}
    assert math.isclose(shares["email:jo@example.org", "zorblatt"], math.log2(203 * 2 / (2 * 2)) / math.log2(203 / 2))
    assert set(shares) == {("email:jo@example.org", "zorblatt")}


def test_terms_are_found_in_the_whole_text(spark):
    filler = " ".join("abcdefghijklmnopqrstuvwxyz"[k : k + 4] for k in range(12))
    texts = [f"Snorkel wrote this\n{filler} {filler} to al@example.org now\n{filler * 9}\nsigned SNORKEL", f"About snorkel\nmail al@example.org today", "Write to bo@example.org about snorkels"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10 + i, f"Plain words about this {filler} today to now mail signed wrote {chr(97 + i % 26)}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    assert [s for s in got[0].split(",") if s.startswith("removed")] == [f"removed:{m.start()}:{m.end()}" for m in re.finditer("(?i)snorkel", texts[0])]
    assert "removed:6:13" in got[1] and got[2] == "email:9:23"
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "snorkel" not in (out[0] + out[1]).lower() and out[2] == "Write to [EMAIL] about snorkels"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc1 @.+-é\n9", max_size=60))
def test_terms_are_no_parts_of_spans(text):
    spans = pii.base_spans(text)
    want = [(m[0].lower(), *m.span()) for m in pii.TERM.finditer(text) if not any(a < m.end() and m.start() < b for _, a, b in spans)]
    assert list(pii.terms_of(text, spans)) == want


def test_copies_are_one_context(spark):
    text = "The snorkel person is al@example.org here"
    rows = [(i, text) for i in range(5)] + [(9, "other words")]
    assert pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).where("spans like '%removed%'").count() == 0


def test_copies_of_a_text_change_no_share(spark):
    texts = ["The snorkel person is al@example.org here", "Ask snorkel or mail al@example.org"] + [f"Plain words {chr(97 + i % 26) * (3 + i // 26)} today" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    copied = spark.createDataFrame([*enumerate(texts), *((1000 + i, texts[0]) for i in range(500))], "doc_id long, text string")
    want, got = ({(r["entity"], r["term"]): r["share"] for r in pii.disclosing_terms(d, pii.scan(d)).collect()} for d in (docs, copied))
    assert want == got == {("email:al@example.org", "snorkel"): 1.0}
    assert pii.find_pii(copied).where("spans like '%removed%'").count() == 502


def test_a_sentence_in_different_texts_counts_in_each(spark):
    rows = [(i, f"Page {chr(97 + i) * 3}\nAsk snorkel via al@example.org today") for i in range(20)] + [(100 + i, f"Ask via today {chr(97 + i % 26) * (3 + i // 26)}") for i in range(300)]
    out = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.where("text like '%snorkel%'").count() == 0 and out.where("text like '%via [EMAIL]%'").count() == 20


def test_masks_and_rows_stay(spark):
    docs = corpus(spark, [(None, "by +1 555 123 4567", 7), (5, None, 7), (5, None, 7), (6, "", 7)])
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[1] == "The [REMOVED] person writes from [EMAIL] about looms today"
    assert got[None] == "by [PHONE]" and got[5] is None and got[6] == "" and got[12] == "Plain words about looms and silk number c today"
    assert pii.sanitise(docs.limit(0)).count() == 0 == pii.find_pii(docs.limit(0)).count()


def test_overlapping_spans_leave_nothing():
    text = "call +49.30.12.34.56.78 now"
    assert pii.mask(text, []) == "call [PHONE] now"
    assert pii.mask("ab cd ef", [(0, 5, "removed"), (3, 8, "general")]) == "[REMOVED]"


def test_general_terms_give_way_to_their_class():
    said = {"ask Mr. Smith now": "PERSON", "near Baker Street": "PLACE", "at Acme Ltd": "ORGANISATION", "on Monday we": "TIME", "the XKCD thing": "CODE", "the Zed thing": "NAME", "the zed thing": "WORD", "zed": "WORD"}
    for text, kind in said.items():
        term = next(w for w in ("Smith", "Baker", "Acme", "Monday", "XKCD", "Zed", "zed") if w in text)
        a = text.index(term)
        assert pii.mask(text, [(a, a + len(term), "general")]) == text.replace(term, f"[{kind}]")
        assert pii.mask(text, [(a, a + len(term), "removed")]) == text.replace(term, "[REMOVED]")


def test_long_runs_take_linear_time():
    import time

    began = time.time()
    for text in ("a" * 1_000_000 + "@", "a@" * 300_000, "a.b@c" * 200_000, "1" * 1_000_000, "1." * 300_000, "+" * 500_000, "a@b.c " * 100_000):
        pii.base_spans(text)
        assert list(pii.emails(text[:2000])) == [m.span() for m in PLAIN["email"].finditer(text[:2000])]
    text = "x@y.zz word " * 50_000
    spans = pii.base_spans(text)
    assert len(spans) == 50_000 == len(list(pii.terms_of(text, spans)))
    assert time.time() - began < 30
