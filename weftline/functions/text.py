"""Text functions: chunks, sentences, tokens, and HTML by selectors."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markup

#: Separators in the order in which they are tried, and characters that end a sentence.
SEPARATORS = ("\n\n", "\n", " ", "")
ENDS = ".!?。！？…\n"

#: Words that begin a line at which code is cut, by language, in the order in which they
#: are tried. Each stands between a line end and a space; SEPARATORS follow.
LINE_WORDS = {
    "python": "class def \tdef",
    "javascript": "function const let var class if for while switch case default",
    "typescript": "function const let var class interface type enum namespace if for while switch case default",
    "java": "class public protected private static if for while switch case",
    "kotlin": "class object interface fun val var if for while when",
    "scala": "class object trait def val var if for while match",
    "go": "func var const type if for switch case",
    "rust": "fn const let static struct enum trait impl if for while loop match",
    "cpp": "class void int float double if for while switch case",
    "c": "void int float double char struct if for while switch",
    "csharp": "class public private protected internal static namespace if for foreach while switch",
    "ruby": "def class module if unless while for do begin",
    "php": "function class if foreach while for switch case",
    "swift": "func class struct enum protocol extension if for while switch case",
    "solidity": "pragma using contract interface library constructor type function event modifier error struct enum mapping if for while do assembly",
    "proto": "message service enum options import syntax",
}
#: Clauses of SQL, elements of HTML (nothing but single characters follows them), and the
#: marks of texts.
SQL_CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP BY", "ORDER BY", "HAVING", "JOIN", "LEFT JOIN", "RIGHT JOIN", "INNER JOIN", "OUTER JOIN", "UNION", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER")
HTML_ELEMENTS = "body div p br li h1 h2 h3 h4 h5 h6 span table tr td th ul ol header footer nav head style script meta title"
MARKDOWN = ("\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "```\n", "\n\n---\n", "\n\n***\n", "\n\n___\n")
LATEX_PARTS = ("chapter", "section", "subsection", "subsubsection")
LATEX_BLOCKS = ("enumerate", "itemize", "description", "list", "quote", "quotation", "verse", "verbatim", "align")


def separators_of(language: str | None) -> tuple[str, ...]:
    """The separators of a language; the plain ones for none."""
    if language is None:
        return SEPARATORS
    name = {"js": "javascript", "ts": "typescript", "c++": "cpp", "c#": "csharp"}.get(language.lower(), language.lower())
    if name == "html":
        return (*(f"<{x}" for x in HTML_ELEMENTS.split()), "")
    if name == "sql":
        return (*(f"\n{x} " for x in SQL_CLAUSES), *SEPARATORS)
    if name == "markdown":
        return (*MARKDOWN, *SEPARATORS)
    if name == "latex":
        return (*(f"\n\\{x}{{" for x in LATEX_PARTS), *(f"\n\\begin{{{x}}}" for x in LATEX_BLOCKS), "$$", "$", *SEPARATORS)
    if name not in LINE_WORDS:
        raise ValueError(f"no separators are known for {language!r}")
    return (*(f"\n{x} " for x in LINE_WORDS[name].split(" ")), *SEPARATORS)


def chunk_text(text: str, size: int = 1000, overlap: int = 200, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of up to ``size`` characters with up to ``overlap`` shared characters.

    The text is cut at the first separator that it holds, which stays at the head of the later piece;
    pieces that are too long are cut by the separators behind it. Pieces are then packed; a new chunk
    begins with as many last pieces of the one before as fit the overlap. Chunks are stripped, empty
    ones dropped.
    """
    if overlap > size:
        raise ValueError("the overlap is larger than a chunk")
    at = next((k for k, s in enumerate(separators) if s == "" or s in text), len(separators))
    if at == len(separators):
        pieces = [text]
    elif separators[at] == "":
        pieces = list(text)
    else:
        first, *rest = text.split(separators[at])
        pieces = [first, *(separators[at] + x for x in rest)]
    out: list[str] = []
    fitting: list[str] = []
    for piece in filter(None, pieces):
        if len(piece) < size or separators[at:] in ((), ("",)):
            fitting.append(piece)
            continue
        out += pack_pieces(fitting, size, overlap)
        fitting = []
        out += chunk_text(piece, size, overlap, separators[at + 1 :]) if at + 1 < len(separators) else [piece.strip()]
    return [x for x in out + pack_pieces(fitting, size, overlap) if x]


def pack_pieces(pieces: Sequence[str], size: int, overlap: int) -> list[str]:
    """Joins neighbouring pieces into chunks of up to ``size``."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    if held:
        out.append("".join(held).strip())
    return [x for x in out if x]


def sentences(text: str, min_length: int = 0, max_length: int | None = None) -> list[str]:
    """Sentences that end in one or more of ENDS; short ones join the next until ``min_length``; long
    ones are cut at the last white space within ``max_length``. The tail stays even if it is short."""
    found = [m.strip() for m in re.findall(rf"[^{re.escape(ENDS)}]*[{re.escape(ENDS)}]+|[^{re.escape(ENDS)}]+", text)]
    found = [m for m in found if m.strip(ENDS + " \t\r")]
    out: list[str] = []
    held = ""
    for s in found:
        held = f"{held} {s}" if held else s
        if len(held) >= min_length:
            out.append(held)
            held = ""
    if held:
        out.append(held)
    if max_length is None:
        return out
    cut: list[str] = []
    for s in out:
        while len(s) > max_length:
            at = s.rfind(" ", 0, max_length + 1)
            at = at if at > 0 else max_length
            cut.append(s[:at].rstrip())
            s = s[at:].lstrip()
        if s:
            cut.append(s)
    return cut


def chunks(text: Column, size: int = 1000, overlap: int = 200, separators: Sequence[str] = SEPARATORS, language: str | None = None) -> Column:
    """array<string> of :func:`chunk_text`; null for null."""
    separators = separators_of(language) if language else tuple(separators)
    if overlap > size:
        raise ValueError("the overlap is larger than a chunk")

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: None if t is None else chunk_text(t, size, overlap, separators))

    return run(text)


def sentence_list(text: Column, min_length: int = 0, max_length: int | None = None) -> Column:
    """array<string> of :func:`sentences`; null for null."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: None if t is None else sentences(t, min_length, max_length))

    return run(text)


def basic_sentences(text: Column) -> Column:
    """Sentences without length limits, inside the JVM."""
    ends = "[.!?。！？…\n]"
    found = F.transform(F.regexp_extract_all(text, F.lit(f"[^.!?。！？…\n]*{ends}+|[^.!?。！？…\n]+"), F.lit(0)), lambda x: F.trim(F.regexp_replace(x, r"^[ \t\r\n]+|[ \t\r\n]+$", "")))
    return F.filter(found, lambda x: F.regexp_replace(x, r"[.!?。！？…\s]", "") != "")


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def model_tokens(text: Column, vocabulary: str, special: bool = False) -> Column:
    """array<int>: the token ids of a model's tokenizer file (JSON); null for null. The file is read once
    per worker, so its path must be one that workers see."""

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.no_truncation(), tokenizer.no_padding()
        for part in parts:
            known = part.dropna()
            found = [x.ids for x in tokenizer.encode_batch(known.tolist(), add_special_tokens=special)]
            out = pd.Series(found, index=known.index, dtype=object).reindex(part.index)
            yield out.where(out.notna(), None)

    return run(text)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def select_html(source: str | None, selector: str, mode: str = "text", attribute: str | None = None) -> list[str]:
    """Text, markup or an attribute of the elements that a CSS selector or an XPath (one that begins
    with / or ./) names, in the order of the page; malformed pages give what can be read. An XPath that
    ends in ``/@name`` or ``/text()`` gives that attribute or the elements' own text."""
    page = markup.read(source or "")
    if selector.startswith(("/", "./", "(")):
        found, last = markup.by_xpath(page, selector)
        if last == "text()":
            return [t for x in found if (t := x.own_text())]
        mode, attribute = ("attribute", last[1:]) if last else (mode, attribute)
    else:
        found = markup.by_selector(page, selector)
    if mode == "attribute":
        return [x.attributes[attribute] for x in found if attribute in x.attributes]
    return [x.markup() if mode == "html" else x.text() for x in found]


def page_text(source: str | None) -> str:
    """All text of a page but that of script and style, pieces joined by a space."""
    return markup.read(source or "").text()


def html_select(source: Column, selector: str, mode: str = "text", attribute: str | None = None) -> Column:
    """array<string> of :func:`select_html`."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: select_html(x, selector, mode, attribute))

    return run(source)


def html_page_text(source: Column) -> Column:
    """Text of :func:`page_text`."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(page_text)

    return run(source)
