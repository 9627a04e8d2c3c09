"""Pages as trees, and the elements that CSS selectors and XPath expressions name."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

# Elements without content, and those whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset({"script", "style"})


class Element:
    """An element: its tag, attributes, children (elements and texts) and place in the page."""

    def __init__(self, tag: str, attributes: dict[str, str], raw: str, parent: Element | None, place: int):
        self.tag, self.attributes, self.raw, self.parent, self.place = tag, attributes, raw, parent, place
        self.children: list[Element | str] = []

    def elements(self) -> list[Element]:
        return [x for x in self.children if isinstance(x, Element)]

    def walk(self) -> Iterator[tuple[str, Element | str]]:
        """("open" | "close", element) and ("text", text) of all that is below, in page order."""
        stack: list[tuple[str, Element | str]] = [("open", x) if isinstance(x, Element) else ("text", x) for x in reversed(self.children)]
        while stack:
            kind, x = stack.pop()
            yield kind, x
            if kind == "open":
                stack.append(("close", x))
                stack += [("open", y) if isinstance(y, Element) else ("text", y) for y in reversed(x.children)]

    def below(self) -> Iterator[Element]:
        return (x for kind, x in self.walk() if kind == "open")

    def text(self) -> str:
        """All text but that of script and style, pieces joined by a space."""
        silent, out = int(self.tag in SILENT), []
        for kind, x in self.walk():
            if kind == "text":
                out += [] if silent else [x]
            elif x.tag in SILENT:
                silent += 1 if kind == "open" else -1
        return " ".join(" ".join(out).split())

    def own_text(self) -> str:
        """Text that stands directly in the element."""
        return " ".join(" ".join(x for x in self.children if isinstance(x, str)).split())

    def markup(self) -> str:
        if self.tag in VOID:
            return self.raw
        parts = [x if kind == "text" else x.raw if kind == "open" else "" if x.tag in VOID else f"</{x.tag}>" for kind, x in self.walk()]
        return "".join([self.raw, *parts, f"</{self.tag}>"])

    def ancestors(self) -> Iterator[Element]:
        x = self.parent
        while x is not None:
            yield x
            x = x.parent

    def position(self, same: bool = False, last: bool = False) -> int:
        """1-based place among its siblings, of the same tag if wanted, from the end if wanted."""
        row = [x for x in self.parent.elements() if not same or x.tag == self.tag] if self.parent else [self]
        return (len(row) - row.index(self)) if last else row.index(self) + 1


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, "", None, -1)
        self.open = [self.root]
        self.n = 0

    def handle_starttag(self, tag, attrs):
        here = self.open[-1]
        x = Element(tag, {k: v or "" for k, v in attrs}, self.get_starttag_text() or "", here, self.n)
        self.n += 1
        here.children.append(x)
        if tag not in VOID:
            self.open.append(x)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        if any(x.tag == tag for x in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data):
        self.open[-1].children.append(data)


def read(source: str) -> Element:
    """The root above a page's elements."""
    reader = _Reader()
    reader.feed(source)
    reader.close()
    return reader.root


Test = Callable[[Element], bool]
_TOKEN = re.compile(
    r"\s*([>+~,])\s*|(\s+)|(\*|[a-zA-Z][\w-]*)|#([\w-]+)|\.([\w-]+)"
    r"|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+)))?\s*\]|:([\w-]+)(?:\(((?:[^()]|\([^()]*\))*)\))?"
)


def _attribute(name: str, sign: str | None, value: str) -> Test:
    ways: dict[str | None, Callable[[str], bool]] = {
        None: lambda v: True, "=": lambda v: v == value, "~=": lambda v: value in v.split(), "|=": lambda v: v == value or v.startswith(value + "-"),
        "^=": lambda v: bool(value) and v.startswith(value), "$=": lambda v: bool(value) and v.endswith(value), "*=": lambda v: bool(value) and value in v,
    }
    return lambda x: name in x.attributes and ways[sign](x.attributes[name])


def _every(formula: str) -> Callable[[int], bool]:
    """The test of an+b, odd, even or a number."""
    formula = {"odd": "2n+1", "even": "2n"}.get(formula.strip().lower(), formula.replace(" ", "").lower())
    m = re.match(r"(?:([+-]?\d*)n([+-]\d+)?|([+-]?\d+))\Z", formula)
    if m is None:
        raise ValueError(f"can't read the place {formula!r}")
    if m[3]:
        return lambda k: k == int(m[3])
    a, b = int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)
    return lambda k: (k - b) % a == 0 and (k - b) // a >= 0 if a else k == b


def _pseudo(name: str, value: str | None) -> Test:
    places = {"nth-child": (False, False), "nth-last-child": (False, True), "nth-of-type": (True, False), "nth-last-of-type": (True, True)}
    if name in places:
        same, last = places[name]
        holds = _every(value or "")
        return lambda x: holds(x.position(same, last))
    if name == "not":
        inner = selector(value or "")
        return lambda x: not inner(x)
    simple: dict[str, Test] = {
        "first-child": lambda x: x.position() == 1, "last-child": lambda x: x.position(last=True) == 1, "only-child": lambda x: len(x.parent.elements()) == 1,
        "first-of-type": lambda x: x.position(True) == 1, "last-of-type": lambda x: x.position(True, True) == 1,
        "empty": lambda x: not x.children, "root": lambda x: x.parent is not None and x.parent.parent is None,
    }
    if name not in simple:
        raise ValueError(f"unknown pseudo-class {name!r}")
    return simple[name]


def selector(text: str) -> Test:
    """The test of a CSS selector: tags, #ids, .classes, [attributes], pseudo-classes, lists by commas,
    and the combinators of descendants, children and siblings."""
    choices: list[list[tuple[str, list[Test]]]] = [[("", [])]]
    at, text = 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"can't read selector {text!r}")
        at = m.end()
        if m[1] == ",":
            choices.append([("", [])])
        elif m[1] or m[2]:
            choices[-1].append((m[1] or " ", []))
        else:
            value = next((v for v in m.group(8, 9, 10) if v is not None), "")
            tests = choices[-1][-1][1]
            if m[3]:
                tests.append(lambda x, tag=m[3].lower(): tag in ("*", x.tag))
            elif m[4]:
                tests.append(_attribute("id", "=", m[4]))
            elif m[5]:
                tests.append(_attribute("class", "~=", m[5]))
            elif m[6]:
                tests.append(_attribute(m[6].lower(), m[7], value))
            else:
                tests.append(_pseudo(m[11], m[12]))
    if any(not tests for parts in choices for _, tests in parts):
        raise ValueError(f"can't read selector {text!r}")

    def holds(x: Element, parts: list[tuple[str, list[Test]]]) -> bool:
        how, tests = parts[-1]
        if not all(t(x) for t in tests):
            return False
        if len(parts) == 1:
            return True
        if how in "+~":
            before = [y for y in x.parent.elements() if y.place < x.place] if x.parent else []
            return any(holds(y, parts[:-1]) for y in (before[-1:] if how == "+" else before))
        above = [y for y in x.ancestors() if y.parent is not None]
        return any(holds(y, parts[:-1]) for y in (above[:1] if how == ">" else above))

    return lambda x: any(holds(x, parts) for parts in choices)


def by_selector(page: Element, text: str) -> list[Element]:
    """The elements of a page that a selector names, in page order."""
    test = selector(text)
    return [x for x in page.below() if test(x)]


_STEP = re.compile(r"(//|/)\s*(\.\.|\.|\*|@[\w-]+|text\(\)|(?:child::|descendant::)?[\w-]+)((?:\[(?:[^\[\]\"']|\"[^\"]*\"|'[^']*')*\])*)")
_CONDITION = re.compile(r"(?:(@[\w-]+|text\(\)|\.)\s*(?:(!?=)\s*(?:\"([^\"]*)\"|'([^']*)'))?|contains\(\s*(@[\w-]+|text\(\)|\.)\s*,\s*(?:\"([^\"]*)\"|'([^']*)')\s*\)|(\d+)|(last\(\)))\s*\Z")


def _value(x: Element, name: str) -> str | None:
    return x.attributes.get(name[1:]) if name[0] == "@" else x.own_text() if name == "text()" else x.text()


def _condition(text: str) -> Callable[[Element, int, int], bool]:
    for word, join in ((" or ", any), (" and ", all)):
        if word in text:
            parts = [_condition(t) for t in text.split(word)]
            return lambda x, k, n: join(p(x, k, n) for p in parts)
    m = _CONDITION.match(text.strip())
    if m is None:
        raise ValueError(f"can't read condition {text!r}")
    if m[8]:
        return lambda x, k, n: k == int(m[8])
    if m[9]:
        return lambda x, k, n: k == n
    if m[5]:
        part = m[6] if m[6] is not None else m[7]
        return lambda x, k, n: part in (_value(x, m[5]) or "")
    if m[2] is None:
        return lambda x, k, n: bool(_value(x, m[1])) or m[1][0] == "@" and _value(x, m[1]) is not None
    value = m[3] if m[3] is not None else m[4]
    return lambda x, k, n: (_value(x, m[1]) == value) == (m[2] == "=") and _value(x, m[1]) is not None


def by_xpath(page: Element, text: str) -> tuple[list[Element], str | None]:
    """The elements that an XPath names, in page order, and its last step if that is ``@name`` or
    ``text()``. Steps are / and // with names, *, . and ..; conditions are places, last(), attributes,
    text, their (in)equality and contains(), joined by ``and`` or ``or``."""
    text = text.strip().removeprefix(".")
    here, at, last = [page], 0, None
    while at < len(text):
        m = _STEP.match(text, at)
        if m is None or last is not None:
            raise ValueError(f"can't read path {text!r}")
        at, name = m.end(), m[2].removeprefix("child::")
        deep = m[1] == "//" or name.startswith("descendant::")
        name = name.removeprefix("descendant::").lower() if not name.startswith("@") else name
        if name.startswith("@") or name == "text()":
            here = list({id(y): y for x in here for y in ([x, *x.below()] if deep else [x])}.values())
            last = name
            continue
        found: dict[int, Element] = {}
        for x in here:
            if name in (".", ".."):
                row = [x] if name == "." else [x.parent] if x.parent is not None else []
                groups = [row + ([*x.below()] if deep and name == "." else [])]
            else:
                groups = [[y for y in z.elements() if name in ("*", y.tag)] for z in ([x, *x.below()] if deep else [x])]
            for row in groups:
                for c in re.findall(r"\[((?:[^\[\]\"']|\"[^\"]*\"|'[^']*')*)\]", m[3]):
                    holds = _condition(c)
                    row = [y for k, y in enumerate(row, 1) if holds(y, k, len(row))]
                found |= {y.place: y for y in row}
        here = [found[k] for k in sorted(found)]
    return [x for x in here if x.parent is not None], last
