"""Selectors over stored pages: a small engine for CSS and XPath on the standard library's HTML parser.

CSS: tag, ``*``, ``.class``, ``#id``, attribute tests, the four combinators, lists by comma, ``:not``, ``:has-text``-like ``:contains``,
``:empty``, ``:first-child``, ``:last-child``, ``:only-child``, ``:nth-child`` and ``:nth-of-type`` with their forms from the end, ``::text`` and
``::attr(name)``. XPath: ``/``, ``//``, ``..``, ``*``, ``@attr``, ``text()``, and conditions of ``and``, ``or``, ``not()``, comparisons, positions, ``last()``,
``contains``, ``starts-with``, ``normalize-space``, ``string-length``, ``count`` and relative paths. Pages need not be well formed: void and unclosed
elements, scripts and entities are taken as browsers do.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import urls as U

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def texts(self) -> Iterator[str]:
        todo = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                yield node
            else:
                todo += reversed(node.children)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close({"p"}, stop={"div", "body", "article", "td", "li"})
        if tag in CLOSES:
            self._close(CLOSES[tag], stop={"ul", "ol", "table", "select", "dl", "div", "body"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def _close(self, tags, stop):
        node = self.at
        while node is not self.root and node.tag not in stop:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_PART = re.compile(r"([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]*))\s*)?\]|:([\w-]+)(\()?")
_ATTR = {None: lambda x, v: True, "=": str.__eq__, "^=": str.startswith, "$=": str.endswith, "*=": str.__contains__, "~=": lambda x, v: v in x.split(), "|=": lambda x, v: x == v or x.startswith(v + "-")}


def _elements(node: Node) -> list[Node]:
    """The elements of the node's parent, itself included."""
    return [c for c in node.parent.children if isinstance(c, Node)] if node.parent else [node]


def _nth(text: str):
    """The test for a place, from 1, that ``an+b``, ``odd`` or ``even`` makes."""
    text = {"odd": "2n+1", "even": "2n"}.get(text.strip().lower(), re.sub(r"\s", "", text))
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", text)
    if not m:
        return lambda k, b=int(text): k == b
    a, b = {"": 1, "+": 1, "-": -1}.get(m.group(1)) or int(m.group(1) or 1), int(m.group(2) or 0)
    return lambda k: k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0


def _pseudo(name: str, inside: str | None):
    places = {"first-child": (False, False, "1"), "last-child": (False, True, "1"), "first-of-type": (True, False, "1"), "last-of-type": (True, True, "1"), "nth-child": (False, False, inside), "nth-last-child": (False, True, inside), "nth-of-type": (True, False, inside), "nth-last-of-type": (True, True, inside)}
    if name in places:
        typed, backwards, rule = places[name]
        fits = _nth(rule or "")

        def test(node: Node) -> bool:
            row = [c for c in _elements(node) if not typed or c.tag == node.tag]
            k = next(k for k, c in enumerate(row) if c is node)
            return fits(len(row) - k if backwards else k + 1)

        return test
    if name == "only-child":
        return lambda n: len(_elements(n)) == 1
    if name == "empty":
        return lambda n: not n.children
    if name == "contains":
        return lambda n, v=(inside or "").strip().strip("\"'"): v in "".join(n.texts())
    if name == "not":
        chains = _chains(inside or "")
        return lambda n: not any(_matches(n, c) for c in chains)
    raise ValueError(f"unknown pseudo-class: {name}")


def _close(text: str, at: int) -> int:
    """The place of the parenthesis or bracket that closes the one before ``at``; what is quoted doesn't count."""
    depth, quote = 1, ""
    while at < len(text):
        c = text[at]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return at
        at += 1
    raise ValueError(f"not closed: {text}")


def _split(text: str, marks: str) -> list[str]:
    """Parts and the marks between them, at the top level only."""
    out, start, at = [], 0, 0
    quote = ""
    while at < len(text):
        c = text[at]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            at = _close(text, at + 1)
        elif c in marks:
            out += [text[start:at], c]
            start = at + 1
        at += 1
    return [*out, text[start:]]


def _simple(text: str):
    tests, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"unknown selector: {text}")
        tag, ident, cls, attr, op, *quoted, pseudo, opened = m.groups()
        at = m.end()
        if tag:
            if tag != "*":
                tests.append(lambda n, v=tag.lower(): n.tag == v)
        elif ident:
            tests.append(lambda n, v=ident: n.attrs.get("id") == v)
        elif cls:
            tests.append(lambda n, v=cls: v in n.attrs.get("class", "").split())
        elif attr:
            value = next((q for q in quoted if q is not None), "")
            tests.append(lambda n, a=attr.lower(), v=value, f=_ATTR[op]: a in n.attrs and f(n.attrs[a], v))
        else:
            end = _close(text, at) if opened else at
            tests.append(_pseudo(pseudo.lower(), text[at:end] if opened else None))
            at = end + 1 if opened else at
    return lambda n: n.tag != "#root" and all(t(n) for t in tests)


def _matches(node: Node, steps: list) -> bool:
    """steps: (combinator before it, test), the last one's subject is the node."""
    how, test = steps[-1]
    if not test(node):
        return False
    if len(steps) == 1:
        return True
    if how in "+~":
        row = _elements(node)
        k = next(k for k, c in enumerate(row) if c is node)
        return any(_matches(c, steps[:-1]) for c in (row[max(0, k - 1) : k] if how == "+" else row[:k]))
    up = node.parent
    if how == ">":
        return up is not None and _matches(up, steps[:-1])
    while up is not None:
        if _matches(up, steps[:-1]):
            return True
        up = up.parent
    return False


@functools.lru_cache(1024)
def _chains(selector: str) -> list[list]:
    chains = []
    for one in _split(selector, ",")[::2]:
        steps, how = [], " "
        for w in _split(re.sub(r"\s+", " ", one.strip()), " >+~"):
            if w in (">", "+", "~"):
                how = w
            elif w.strip():
                steps.append((how, _simple(w)))
                how = " "
        chains.append(steps or [(" ", _simple("*"))])
    return chains


def css(root: Node, selector: str) -> list[str]:
    """Texts, attribute values, or the whole text of each match, in document order."""
    m = re.search(r"::(text|attr\(\s*([\w-]+)\s*\))\s*$", selector)
    chains = _chains(selector[: m.start()] if m else selector)
    out: list[str] = []
    for node in root.walk():
        if any(_matches(node, c) for c in chains):
            if m is None:
                out.append("".join(node.texts()))
            elif m.group(2):
                out += [node.attrs[m.group(2).lower()]] if m.group(2).lower() in node.attrs else []
            else:
                out += [c for c in node.children if isinstance(c, str)]
    return out


def _words(text: str, word: str) -> list[str]:
    """The parts of a condition around ``and`` or ``or`` at its top level."""
    parts, held = [], ""
    for piece in _split(text, " "):
        if piece == word:
            parts.append(held)
            held = ""
        else:
            held += piece
    return [*parts, held]


def _string(x) -> str:
    if isinstance(x, list):
        x = x[0] if x else ""
    return "".join(x.texts()) if isinstance(x, Node) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)


def _expression(text: str) -> Callable[[Node, int, int], object]:
    """What an expression of a condition gives for a node, its place and the number of places: a number, a string, a truth value or a
    list of nodes and strings. The text is read here, once, and not again for each node."""
    text = text.strip()
    for word in ("or", "and"):
        parts = _words(text, word)
        if len(parts) > 1:
            some, terms = any if word == "or" else all, [_expression(p) for p in parts]
            return lambda n, k, size: some(_true(t(n, k, size), None) for t in terms)
    for op in ("!=", "<=", ">=", "=", "<", ">"):
        cut = _split(text.replace(op, "\x00") if op in text else text, "\x00")
        if len(cut) > 1:
            left, right = (_expression(x.replace("\x00", op)) for x in (cut[0], "".join(cut[2:])))
            return lambda n, k, size: _compare(op, left(n, k, size), right(n, k, size))
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        return lambda n, k, size, v=float(text): v
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return lambda n, k, size, v=text[1:-1]: v
    m = re.match(r"([a-z-]+)\(", text)
    if m and m.group(1) != "text" and _close(text, m.end()) == len(text) - 1:
        if m.group(1) not in _FUNCTIONS:
            raise ValueError(f"unknown function: {text}")
        call, args = _FUNCTIONS[m.group(1)], [_expression(x) for x in _split(text[m.end() : -1], ",")[::2] if x.strip()]
        return lambda n, k, size: call(n, k, size, [a(n, k, size) for a in args])
    if text == ".":
        return lambda n, k, size: [n]
    path = _path(text if text[:1] == "/" else "/" + text if not text.startswith("./") else text[1:])
    return lambda n, k, size: path([n])


def _compare(op: str, left, right) -> bool:
    if isinstance(left, float) or isinstance(right, float) or op[0] in "<>":
        try:
            a, b = (x if isinstance(x, float) else float(_string(x)) for x in (left, right))
        except ValueError:
            return op == "!="
        return {"!=": a != b, "<=": a <= b, ">=": a >= b, "=": a == b, "<": a < b, ">": a > b}[op]
    some = lambda x: [_string([y]) for y in x] if isinstance(x, list) else [_string(x)]
    return any((a == b) == (op == "=") for a in some(left) for b in some(right))


def _first(node: Node, args: list) -> str:
    return _string(args[0]) if args else "".join(node.texts())


#: By name: what a function gives for a node, its place, the number of places and the arguments.
_FUNCTIONS = {
    "position": lambda n, k, size, args: float(k),
    "last": lambda n, k, size, args: float(size),
    "not": lambda n, k, size, args: not _true(args[0], None),
    "count": lambda n, k, size, args: float(len(args[0])),
    "contains": lambda n, k, size, args: _string(args[1]) in _first(n, args),
    "starts-with": lambda n, k, size, args: _first(n, args).startswith(_string(args[1])),
    "normalize-space": lambda n, k, size, args: " ".join(_first(n, args).split()),
    "string-length": lambda n, k, size, args: float(len(_first(n, args))),
    "string": lambda n, k, size, args: _first(n, args),
}


def _true(x, place: int | None) -> bool:
    """A number alone is a place."""
    return x == place if isinstance(x, float) and place is not None else bool(x)


_STEP = re.compile(r"(//?)(?:(@[\w*-]+)|(text\(\))|(\.\.)|([\w*-]+))")


@functools.lru_cache(1024)
def _path(path: str) -> Callable[[list], list]:
    """The function from nodes to what the path selects from them."""
    steps, at = [], 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"unknown path: {path}")
        axis, attr, text, up, name = m.groups()
        at = m.end()
        conditions = []
        while path[at : at + 1] == "[":
            end = _close(path, at + 1)
            conditions.append(path[at + 1 : end])
            at = end + 1
        if attr:
            step = _attributes(attr)
        elif text:
            step = lambda n: [c for c in n.children if isinstance(c, str)]
        elif up:
            step = lambda n: [n.parent] if n.parent is not None else []
        else:
            step = _kids(name.lower(), [_expression(c) for c in conditions])
        steps.append((axis == "//", step))

    def run(nodes: list) -> list:
        for deep, step in steps:
            found: list = []
            for node in nodes:
                if not isinstance(node, str):
                    for n in node.walk() if deep else (node,):
                        found += step(n)
            nodes = list({id(x): x for x in found}.values()) if found and isinstance(found[0], Node) else found
        return nodes

    return run


def _attributes(attr: str) -> Callable[[Node], list[str]]:
    if attr == "@*":
        return lambda n: list(n.attrs.values())
    name = attr[1:].lower()
    return lambda n: [n.attrs[name]] if name in n.attrs else []


def _kids(name: str, tests: list) -> Callable[[Node], list[Node]]:
    """The elements of that name in a node that fit each test in turn, by their places among those left."""

    def step(node: Node) -> list[Node]:
        kids = [c for c in node.children if isinstance(c, Node) and name in ("*", c.tag)]
        for test in tests:
            kids = [c for k, c in enumerate(kids, 1) if _true(test(c, k, len(kids)), k)]
        return kids

    return step


def xpath(root: Node, path: str) -> list[str]:
    """The values that a path, or several joined by ``|``, selects."""
    found = [x for one in _split(path, "|")[::2] for x in _path(one.strip())([root])]
    return [x if isinstance(x, str) else "".join(x.texts()) for x in found]


def matches(values: list[str], pattern: str) -> list[str]:
    """All that a pattern finds in the values: its groups where it has some, else the whole of each match."""
    out: list[str] = []
    for v in values:
        for m in re.finditer(pattern, v):
            out += [g or "" for g in m.groups()] if m.groups() else [m.group()]
    return out


def follow_all(pages: DataFrame, urls: list[str] | None = None, css: str | None = None, xpath: str | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, url): absolute links of every page, from exactly one of given addresses, a CSS selector or a path. Elements stand
    for their ``href``; those without one are skipped."""
    if sum(x is not None for x in (urls, css, xpath)) != 1:
        raise ValueError("exactly one of urls, css and xpath is needed")
    base = F.col("_base")
    if urls is not None:
        rows = pages.select(key, F.col(url).alias("_base"), F.posexplode(F.array(*map(F.lit, urls))).alias("pos", "href"))
    else:
        selector = css if css is not None else xpath
        if css is not None and "::" not in css:
            selector = f"{css}::attr(href)"
        elif xpath is not None and not re.search(r"(/@[\w-]+|text\(\))\s*$", xpath):
            selector = f"{xpath}/@href"
        found = select(pages, {"link": selector}, key, html).select(key, "pos", F.trim("value").alias("href"))
        rows = found.join(pages.select(key, F.col(url).alias("_base")), key)
    return rows.where("href is not null").select(key, "pos", U.join_absolute(base, U.quote(F.col("href"))).alias("url"))


def visible_text(root: Node) -> str:
    """The text outside of scripts and styles, white space run together."""
    parts, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            parts.append(node)
        elif node.tag not in ("script", "style", "title"):
            todo += reversed(node.children)
    return " ".join("".join(parts).split())


def select(pages: DataFrame, selectors: dict[str, str], key: str = "page_id", html: str = "html", patterns: dict[str, str] | None = None) -> DataFrame:
    """(key, field, pos, value): every match of every selector; a selector that begins with / is XPath. Each page is parsed once.
    ``patterns``: for some fields a regular expression, whose finds in the values take their place."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                root = parse(text.as_py())
                for field, selector in selectors.items():
                    values = (xpath if selector.startswith("/") else css)(root, selector)
                    if patterns and field in patterns:
                        values = matches(values, patterns[field])
                    rows += [(k, field, pos, v) for pos, v in enumerate(values)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (batch.schema.field(0).type, pa.string(), pa.int32(), pa.string()))], names=[key, "field", "pos", "value"])

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, field string, pos int, value string")


def texts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([visible_text(parse(t.as_py())) for t in batch.column(1)], pa.string())], names=[key, "text"])

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, text string")


def detect_encoding(body: bytes, content_type: str | None = None) -> str:
    """Declared in the header, by a byte-order mark or in the page, else the first of ascii, utf-8 and cp1252 that fits."""
    m = re.search(r"charset=[\"']?([\w-]+)", content_type or "", re.I)
    if m:
        return m.group(1).lower()
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if body.startswith(mark):
            return name
    m = re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)|<\?xml[^>]+encoding=[\"']([\w-]+)", body[:4096], re.I)
    if m:
        return (m.group(1) or m.group(2)).decode().lower()
    for name in ("ascii", "utf-8"):
        try:
            body.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return "cp1252"
