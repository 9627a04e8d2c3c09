"""Main text of pages, and WARC archives."""

import glob
import hashlib
import math
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from weftline.llm import html_text, warc
from weftline.llm._shared import fresh_dir

PROSE = "This is a long enough sentence about weaving cloth on a wooden loom, with some more words. "
PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{x:y}}</style><script>var a = "<p>no</p>";</script></head><body class="with-sidebar">
<header><h2>Site name</h2></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies.</div><div id="content"><article><header><h1>The &lt;title&gt;</h1></header>
<p><b>Lead {PROSE}<br><p>{PROSE * 3}</p><ul><li>one<li>two</ul><aside>Related: <a href=/x>x</a></aside><form><input><p>Name</p></form>
<p>Last&nbsp;one,\n\n split   over lines.</p></article><section class="comments"><p>{PROSE}reader says</p></section></div>
<div class="sidebar"><p>{PROSE}</p></div><div class="ad">Buy {PROSE}</div><footer>&copy; 2024 {PROSE}</footer></body></html>"""


def test_article_alone_is_kept():
    one = PROSE.strip()
    want = ["The <title>", "Lead " + one, " ".join([one] * 3), "one", "two", "Last one, split over lines."]
    assert html_text.extract(PAGE).split("\n\n") == want


def test_pages_without_marked_articles():
    plain = f"<body><div id=menu><a href=a>a</a><a href=b>b</a></div><div class=story><p>{PROSE * 2}<p>{PROSE * 2}</div><div><a href=c>c c c</a></div></body>"
    assert html_text.extract(plain).split("\n\n") == [(PROSE * 2).strip()] * 2


def test_wrapped_pages():
    two = f"<p>{PROSE * 2}</p>" * 2
    page = f"<body><div class=wrap><div class=top><a href=a>a</a> <a href=b>b</a></div><div class=content><h1>T</h1>{two}<ul><li>x y<li>z</ul>{two}</div><div class=more><a href=c>c c c</a><a href=d>d d d d</a></div></div>"
    assert html_text.extract(page).split("\n\n") == ["T", *[(PROSE * 2).strip()] * 2, "x y", "z", *[(PROSE * 2).strip()] * 2]
    parts = f"<body><div class=wrap><div class=part>{two}</div><div class=part>{two}</div><div><a href=c>c c c</a></div></div>"
    assert len(html_text.extract(parts).split("\n\n")) == 4
    quoted = f"<body><div class=wrap><div class=story><p>{PROSE}</p><blockquote>{two}{two}</blockquote><p>{PROSE}</p></div><div class=top><a href=a>a</a></div></div>"
    assert len(html_text.extract(quoted).split("\n\n")) == 6


@pytest.mark.parametrize("source, want", [(None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\n\nb"), ("<p>unclosed <b>bold", "unclosed bold"), ("a < b & c", "a < b & c"), ("<script>x</script>", ""), ("</p></div>x", "x"), ("<", ""), ("<p", "")])
def test_odd_sources(source, want):
    assert html_text.extract(source) == want


def test_deep_and_long_pages_end():
    assert html_text.extract("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert len(html_text.extract("<p>" + "word " * 200_000)) == 999_999
    html_text.extract("<a " * 20_000)


def test_generated_pages(spark, sf_dir):
    import html as h
    import re

    rows = html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        inner = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        parts = [" ".join(h.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:h1|p)>", inner)]
        assert r["text"] == "\n\n".join(filter(None, parts)) and r["n_chars"] == len(r["text"])


def plain_density(tree, body):
    """(chars, tags, link chars, link tags, density) of (name, kids) by the formula, from the leaves up."""
    name, kids = tree
    counts = [0, 0, 0, 0]
    for kid in kids:
        part = [len(kid), 0, 0, 0] if isinstance(kid, str) else [*plain_density(kid, body)[:4]]
        if not isinstance(kid, str):
            part[1] += 1
        counts = [x + y for x, y in zip(counts, part, strict=True)]
    if name == "a":
        counts[2:] = counts[0], counts[1] + 1
    chars, tags, link_chars, link_tags = counts
    if not chars or body is None:
        return (*counts, 0.0)
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body[2] / max(body[0], 1) * chars + math.e)
    return (*counts, chars / t * (math.log(chars / lc * t / lt) if base <= 1 else max(math.log(chars / lc * t / lt) / math.log(base), 0)))


def random_tree(rng, depth=0):
    name = rng.choice(["div", "section", "span", "a", "b"] if depth < 5 else ["b", "i"])
    kids = [rng.choice(["word", "some more words", "x" * rng.randint(1, 90)]) if rng.random() < 0.5 or depth > 4 else random_tree(rng, depth + 1) for _ in range(rng.randint(1, 4))]
    return name, [k for k in kids if name != "a" or isinstance(k, str)] or ["link"]


def render(tree):
    return tree if isinstance(tree, str) else f"<{tree[0]}>" + "".join(map(render, tree[1])) + f"</{tree[0]}>"


def test_densities_equal_the_formula():
    rng = random.Random(8)
    for _ in range(60):
        body = "body", [random_tree(rng) for _ in range(rng.randint(1, 4))]
        tree = "html", [body]
        whole = plain_density(tree, None)
        root = html_text.build(render(body))
        html_text.measure(root)
        todo = [(tree, root)]
        while todo:
            want, got = todo.pop()
            assert math.isclose(got.density, plain_density(want, whole)[4], rel_tol=1e-9, abs_tol=1e-9)
            below = [k for k in want[1] if not isinstance(k, str)]
            assert math.isclose(got.below, sum(plain_density(k, whole)[4] for k in below), rel_tol=1e-9, abs_tol=1e-9)
            nodes = [k for k in got.kids if not isinstance(k, str)]
            assert [k.name for k in nodes] == [k[0] for k in below]
            todo += zip(below, nodes, strict=True)
        # the largest sum is in what is selected
        best = max(html_text.visible(root), key=lambda n: n.below)
        assert best.below <= 0 or any(html_text._within(best, x) for x in html_text.select(root))


LONG = PROSE * 8


def texts(source):
    return html_text.extract(source).split("\n\n")


def test_densities_decide_between_candidates():
    assert LONG.strip() in texts(f"<main><p>x y</p></main><div><p>{LONG}</div>")
    assert texts(f"<article><p>{LONG}</article><div><p>{PROSE}</div><article><p>{LONG}</article>") == [LONG.strip()] * 2
    assert texts(f"<main><h1>T</h1><article><p>{LONG}<p>{LONG}</article><div><a href=x>more</a></div></main>") == ["T", LONG.strip(), LONG.strip(), "more"]
    assert texts(f"<div><div><p>{LONG}<p>{LONG}</div><div>Short note beside it without any link at all, of ninety characters or not.</div><div>ok</div></div>")[:2] == [LONG.strip()] * 2


def test_words_in_an_articles_own_markings():
    long = f"<article><h2>T</h2><p>{LONG}</p><p class=%s>{LONG}</p></article>"
    for name in ("related-work", "legal", "notice", "reply", "share"):
        assert len(texts(long % name)) == 3, name
    for name in ("advert", "comments", "cookie-notice", "newsletter"):
        assert len(texts(long % name)) == 2, name
    assert len(texts(f"<article><p>{LONG}</p><p class=notice>We changed our terms.</p><div class=replies><p>{LONG}</p></div></article>")) == 1


@pytest.mark.parametrize(
    "source, want",
    [
        ("<p class=it's>Hello world</p><p>middle text</p><p>Don't</p><p>tail</p>", "Hello world|middle text|Don't|tail"),
        ("<p title='a>b'>x</p><p title=\"<p>\">y</p><p title = z>z</p>", "x|y|z"),
        ("<p a='never closed>one</p><p>two</p>", "one|two"),
        ("<!-- a <p>b</p> --!><p>c</p><!--><p>d</p><!-- open <p>e", "c|d"),
        ("<p>1 < 2 <3 &lt;4 &amp;amp; &#65;&nbsp;B</p><!doctype x><?php y ?></ z><p>end", "1 < 2 <3 <4 &amp; A B|end"),
        ("<head><title>t</title><p>no body tag<div>a<div/>b</div>", "no body tag|a|b"),
        ("<script>a</scripty></script ><p>x<textarea><p>y</textarea><P>Z</P>", "x|Z"),
        ("<table><tr><td>a<td>b</div><tr><td>c</table>", "a|b|c"),
    ],
)
def test_tags_are_read_as_browsers_do(source, want):
    assert html_text.extract(source).replace("\n\n", "|") == want


def test_links_without_quotes_are_links():
    root = html_text.build("<p>text <a href=http://e.org/>link</a></p>")
    html_text.measure(root)
    assert root.link_chars == 4


def test_time_grows_with_the_length_alone():
    import time

    began = time.time()
    for part in ("<a href='x y ", "<div>", "<p><b>", "<a ", "<!--", "</div>", "<script>", "<ul><li>", "<i><b></i>", "<a b=\"", "<article>"):
        html_text.extract(part * 20_000 + "x")
    assert time.time() - began < 60


def test_odd_pages(spark):
    rows = [(None, None, None, "a", 1), (1, "u", "<p>x", "b", 2), (1, "u", "<p>x", "b", 2), (2, None, "", "c", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, html_text.main_text(pages).collect()), key=str)
    assert got == sorted([(None, None, "", 0), (1, "u", "x", 1), (1, "u", "x", 1), (2, None, "", 0)], key=str)
    empty = html_text.main_text(pages.limit(0))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]


ROWS = [(5, "u5", "x" * 150, 0), (2, "u2", "x" * 150, 0), (7, None, "x" * 150, 0), (1, "u1", "small", 0), (3, "u\r\n3", "small", 0), (4, "u4", None, 0), (None, "u", "x" * 150, 0), (8, "é", "é" * 60, 0), (9, "é", "é" * 60, 0)]
SCHEMA = "page_id long, url string, html string, payload_bytes int"


def test_archives_round_trip(spark):
    got = {(r["page_id"], r["url"]): r for r in warc.warc_roundtrip(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(ROWS)
    first = {"x" * 150: 2, "é" * 60: 8}
    for page, _, source, _ in ROWS:
        r = next(v for k, v in got.items() if k[0] == page)
        raw = (source or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        refers = first.get(source) if page is not None and first.get(source) not in (None, page) else None
        assert (r["record_type"], r["refers_to"]) == ("response" if refers is None else "revisit", refers)
    assert warc.warc_roundtrip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_records_are_frames_behind_a_dictionary(spark, sf_dir):
    folder = fresh_dir(spark, "test-warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = warc.write_archives(pages, folder)
    assert manifest.agg(F.sum("n_records")).first()[0] == pages.count()
    for path in glob.glob(folder.removeprefix("file://") + "/*.warc.zst"):
        data = open(path, "rb").read()
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
        size = int.from_bytes(data[4:8], "little")
        words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        rest, n = data[8 + size :], 0
        while rest:  # each record is a frame that the dictionary alone opens
            engine = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
            fields, block = warc.parse(engine.decompress(rest))
            assert fields["WARC-Type"] in ("response", "revisit") and len(block) == int(fields["Content-Length"])
            rest, n = engine.unused_data, n + 1
        assert n
    back = warc.read_archives(manifest, folder)
    both = back.where("record_type = 'response'").join(pages.select("page_id", "html"), "page_id")
    assert both.where("decode(payload, 'UTF-8') <> html").count() == 0 < both.count()


def test_damage_is_found(tmp_path):
    writer = warc.Writer(str(tmp_path), warc.build_dictionary([]))
    writer.add(warc.render(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None))
    name = writer.close()[0][0]
    data = (tmp_path / name).read_bytes()
    (tmp_path / name).write_bytes(data[:-3])
    with open(tmp_path / name, "rb") as f, pytest.raises(Exception):
        list(warc.read_records(f))


@pytest.mark.parametrize("n, size", [(1, 10), (3, 400_000), (5, 2_000), (9, 300_000), (300, 500)])
def test_every_archive_has_a_dictionary(spark, n, size):
    rows = [(i, f"http://e.org/{i}", f"<p>page {i} " + f"shared words of all pages {i} " * (size // 20)) for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    samples = warc.sampled_records(pages)
    assert len(samples) == n and all(len(x) < warc.SAMPLE_CHARS + 600 for x in samples)
    assert any(b"shared" in x and b"<p>" not in x for x in samples) or size < warc.SAMPLE_CHARS  # windows are spread over the text
    folder = fresh_dir(spark, "test-warc")
    manifest = warc.write_archives(pages, folder)
    for path in glob.glob(folder.removeprefix("file://") + "/*.warc.zst"):
        data = open(path, "rb").read(8)
        assert int.from_bytes(data[4:], "little") > 200
    assert {r["page_id"]: r["payload"].decode() for r in warc.read_archives(manifest, folder).collect()} == {i: h for i, _, h in rows}
