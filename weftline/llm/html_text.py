"""Main text of web pages by composite text density.

Every node of the page's tree counts the characters and tags below it, and those inside links. Its
density is characters per tag, adjusted by how much of that is link text relative to the page body.
The node whose children's densities have the largest sum is the article; the smallest density on its
path up to body is the threshold from which other nodes are content, too. What is no article by its own
element or role (menus, headers of the page, notices, forms, comments and the like) is no part of
the tree that is measured.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import in_arrow

# Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe noembed noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("dd dt li tbody td tfoot th thead tr body html legend summary figcaption".split())
#: An opening tag that ends an open element of these names, unless one of the others lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SKIP = frozenset(
    "nav aside footer form button select input textarea script style noscript template head title iframe object embed "
    "applet svg math canvas audio video map menu dialog fieldset legend label datalist output progress meter search".split()
)
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id values that mark what is no article.
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars sidenav aside footer masthead "
    "comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets "
    "pagination pager toolbar skip copyright legal disclaimer".split()
)
#: Those of them that an article's own prose may bear, too: there they count only for what is short or links.
WEAK_WORDS = frozenset("reply replies respond notice notices share sharing social related recommended recommendations skip copyright legal disclaimer promotion signup login".split())
#: Words that turn a marking into a description of the layout or of a topic, and those of an article's own parts.
LAYOUT_WORDS = frozenset("with has no without work works study studies research literature".split())
ARTICLE_WORDS = frozenset("article entry post story content".split())
#: Elements that an article is made of, and unlinked characters from which weak words do not remove one.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure".split())
REAL_TEXT = 200
#: Elements that SKIP_WORDS never removes.
KEEP = frozenset("html body main article h1".split())
#: Elements of a head; any other one, and text, ends it.
IN_HEAD = frozenset("title meta link base basefont bgsound style script noscript noframes template head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a closing tag within them does not reach out of.
CELLS = ("table", "td", "th", "caption", "object", "template")

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The name of an attribute, as far as one follows, and the equals sign before its value.
ATTRIBUTE_NAME = re.compile(r"[\s/]*+(=?[^\s/>=]*+)(?:\s*+(=)\s*+)?")
UNQUOTED = re.compile(r"[^\s>]*+")
COMMENT_END = re.compile(r"--!?>")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
SPACE = re.compile(r"\s+")


class Node:
    """An element: name, parent, children (nodes and texts), and what its subtree counts."""

    __slots__ = ("below", "chars", "density", "inside", "kids", "link_chars", "link_tags", "name", "parent", "skipped", "tags", "weak")

    def __init__(self, name: str, parent: Node | None, skipped: bool, weak: bool = False):
        self.name, self.parent, self.skipped, self.weak, self.inside = name, parent, skipped, weak, False
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.below = 0.0


def _marks(name: str, attributes: list[tuple[str, str]], inside: bool) -> tuple[bool, bool]:
    """Whether an element is no article, and whether only weak words say so. A header counts as one only
    ``inside`` article or main."""
    if name in SKIP or (name == "header" and not inside):
        return True, False
    weak = False
    if name not in KEEP:
        for key, value in attributes:
            if key in ("class", "id"):
                for token in value.split():
                    words = {w.lower() for w in WORDS.findall(token)}
                    found = words & SKIP_WORDS if not words & LAYOUT_WORDS else set()
                    if "header" in words and not inside and not words & ARTICLE_WORDS or found - WEAK_WORDS:
                        return True, False
                    weak |= bool(found)
            elif key == "role" and value.strip().lower() in SKIP_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True, False
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False
    own = weak and inside and name in PROSE
    return weak and not own, own


def _attributes(source: str, at: int, quotes: dict[str, int]) -> tuple[list[tuple[str, str]], int]:
    """The attributes from behind a tag's name, and the place behind the tag (beyond the source if it
    never ends). ``quotes`` holds the last place of either quote: one that never closes quotes nothing."""
    found = []
    while True:
        m = ATTRIBUTE_NAME.match(source, at)
        at = m.end()
        if not m[1]:
            return found, at + 1
        value = ""
        if m[2]:
            quote = source[at : at + 1]
            if at < quotes.get(quote, -1):
                end = source.index(quote, at + 1)
                value, at = source[at + 1 : end], end + 1
            else:
                m2 = UNQUOTED.match(source, at)
                value, at = m2[0], m2.end()
        found.append((m[1].lower(), value))


class Builder:
    """Puts tags and texts into a tree. Unclosed and stray tags are settled as browsers do for the
    common cases. The open elements of a name, and the open blocks, are known by their place, so a tag
    costs the same at any depth."""

    def __init__(self):
        self.root = Node("html", None, False)
        self.open = [self.root]
        self.places: dict[str, list[int]] = {"html": [0]}
        self.blocks = [0]

    def last(self, names) -> int:
        """Place of the innermost open element of some names; -1 if none is open."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=-1)

    def end(self, place: int) -> None:
        """Closes all elements from a place on; never the first one."""
        while len(self.open) > max(place, 1):
            name = self.open.pop().name
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def text(self, text: str) -> None:
        if self.places.get("head") and not text.isspace() and self.open[-1].name == "head":
            self.end(self.places["head"][-1])
        self.open[-1].kids.append(html.unescape(text) if "&" in text else text)

    def close(self, name: str) -> None:
        place = self.last((name,))
        bar = self.last(CELLS) if name in BLOCK and name not in CELLS else self.blocks[-1] if name not in BLOCK else -1
        if place > 0 and place >= bar:
            self.end(place)

    def start(self, name: str, attributes: list[tuple[str, str]]) -> Node | None:
        """The new element; None for a second html or body."""
        if name == "html" or name == "body" and any(isinstance(x, Node) and x.name == "body" for x in self.root.kids):
            return None
        if name not in IN_HEAD and self.places.get("head"):
            self.end(self.places["head"][-1])
        if name in CLOSES_P and (place := self.last("p")) > self.last(("table", "td", "th", "button", "body")):
            self.end(place)
        if name in ENDS:
            names, bars = ENDS[name]
            if (place := self.last(names)) > self.last(bars):
                self.end(place)
            if (place := self.last("p")) > self.last(("table", "td", "th", "body", "ul", "ol", "dl")):
                self.end(place)
        if name in HEADINGS and self.open[-1].name in HEADINGS:
            self.end(len(self.open) - 1)
        if name == "a" and (place := self.last("a")) > self.blocks[-1]:
            self.end(place)
        here = self.open[-1]
        inside = here.inside or name in ("article", "main")
        skipped, weak = _marks(name, attributes, inside)
        node = Node(name, here, here.skipped or skipped, weak)
        node.inside = inside
        here.kids.append(node)
        if name not in VOID and name not in RAW:
            self.places.setdefault(name, []).append(len(self.open))
            if name in BLOCK:
                self.blocks.append(len(self.open))
            self.open.append(node)
        return node


def build(source: str) -> Node:
    """The tree of a page, read in one pass: a tag that never ends is dropped with what follows it, a
    comment that never ends reaches to the end of the page, a < that opens no tag is text."""
    tree, at, size = Builder(), 0, len(source)
    quotes = {q: source.rfind(q) for q in "\"'"}
    while at < size:
        begin = source.find("<", at)
        if begin != at:
            tree.text(source[at:begin] if begin >= 0 else source[at:])
        if begin < 0 or begin + 1 == size:
            break
        closes = source[begin + 1] == "/"
        if m := TAG_NAME.match(source, begin + 1 + closes):
            name = m[0].lower()
            attributes, at = _attributes(source, m.end(), quotes)
            if at > size:
                break
            if closes:
                tree.close(name)
            elif (node := tree.start(name, attributes)) and name in RAW:  # its content is text without tags
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                node.skipped = True
                at = size if end is None else source.find(">", end.end()) + 1 or size
        elif source.startswith("<!--", begin):
            m = COMMENT_END.search(source, begin + (2 if source.startswith(("<!-->", "<!--->"), begin) else 4))
            at = m.end() if m else size
        elif closes or source[begin + 1] in "!?":
            at = source.find(">", begin + 2) + 1 or size
        else:
            tree.text("<")
            at = begin + 1
    return tree.root


def visible(root: Node) -> list[Node]:
    """The nodes that are not skipped, every one before those below it."""
    order = [root]
    for node in order:
        order.extend(x for x in node.kids if isinstance(x, Node) and not x.skipped)
    return order


def measure(root: Node) -> None:
    """Characters, tags, link characters and link tags of every node, then densities. A node that only
    weak words mark is skipped here if it is short or mostly links."""
    for node in reversed(visible(root)):
        for x in node.kids:
            if isinstance(x, str):
                node.chars += len(x) if "\n" not in x and "  " not in x else len(SPACE.sub(" ", x))
            elif not x.skipped:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        node.skipped |= node.weak and node.chars - node.link_chars < max(REAL_TEXT, node.link_chars)
    order = visible(root)
    body = root
    for node in order:
        c, t = node.chars, max(node.tags, 1)
        if c:
            lc, lt = max(node.link_chars, 1), max(node.link_tags, 1)
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + body.link_chars / max(body.chars, 1) * c + math.e)
            node.density = c / t * max(math.log(c / lc * (t / lt)) / math.log(base) if base > 1 else 0.0, 0.0) if base > 1.0 else c / t * math.log(c / lc * (t / lt))
    for node in reversed(order):
        node.below = sum(x.density for x in node.kids if isinstance(x, Node) and not x.skipped)


def select(root: Node) -> list[Node]:
    """The nodes whose text is the article.

    That is the subtree of the largest density sum. Where it lies in an article or main element, or
    such elements hold half of its text or more, they are its bounds, and others of them count that
    reach the threshold, the least density on the path of the subtree up to body. Without them, what
    stands beside the subtree and reaches the threshold belongs to it.
    """
    order = visible(root)
    best = max(order, key=lambda x: x.below)
    named = [x for x in order if x.name in ("article", "main") and x.chars and not x.parent.inside]
    if best.below <= 0:
        return named or [root]
    threshold, path = best.density, [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
        if path[-1].name != "html":
            threshold = min(threshold, path[-1].density)
    home = [x for x in named if x in path]
    if not home and best.name not in ("article", "main"):
        below = [x for x in named if _within(x, best)]
        if sum(x.chars for x in below) * 2 >= best.chars:
            home = [max(below, key=lambda x: x.chars)]
    if home:
        return [x for x in named if x in home or _plain(x) and x.density >= threshold]
    # the largest sum may lie in a list or quotation of the article: go up while prose stands beside it
    node = best
    while node.parent is not None and node.parent.name not in ("body", "html") and any(x.name in PROSE and _plain(x) for x in _others(node)):
        node = node.parent
    if node.name in ("html", "body"):
        return [node]
    beside = [x for x in _others(node) if _plain(x) and (x.name in PROSE or x.density >= threshold)]
    return [x for x in node.parent.kids if x is node or x in beside]


def _others(node: Node) -> list[Node]:
    """Elements beside a node that are measured and hold text."""
    return [x for x in node.parent.kids if isinstance(x, Node) and x is not node and not x.skipped and x.chars]


def _plain(node: Node) -> bool:
    """Whether less than half of a node's text is links."""
    return node.link_chars * 2 < node.chars


def _within(node: Node, outer: Node) -> bool:
    while node is not None:
        if node is outer:
            return True
        node = node.parent
    return False


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below the nodes in page order, white space settled, empty ones left out."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if text := SPACE.sub(" ", "".join(run)).strip():
            out.append(text)
        run.clear()

    for top in nodes:
        stack: list[tuple[Node, Iterator]] = [(top, iter(top.kids))]
        end()
        while stack:
            node, kids = stack[-1]
            for x in kids:
                if isinstance(x, str):
                    run.append(x)
                elif x.name == "br" or x.name == "wbr":
                    run.append(" " if x.name == "br" else "")
                elif not x.skipped:
                    if x.name in BLOCK:
                        end()
                    stack.append((x, iter(x.kids)))
                    break
            else:
                stack.pop()
                if node.name in BLOCK:
                    end()
        end()
    return out


def extract(source: str | None) -> str:
    """Main text of a page: blocks joined by an empty line; empty for null, empty or textless html."""
    if not source:
        return ""
    root = build(source)
    measure(root)
    return "\n\n".join(blocks(select(root)))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of ``pages`` (page_id, url, html).

    Null html is empty; ids and urls may be null or repeated; other columns are not read; an empty
    table gives an empty result. Pages are independent: no shuffle, and memory is that of one batch.
    The time of a page grows with its length, whatever its markup.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return in_arrow(pages.select("page_id", "url", "html"), run, f"page_id {kind}, url string, text string, n_chars long")
