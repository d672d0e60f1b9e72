"""Visible text of HTML pages, laid out.

A tolerant tokenizer and tree builder (implied end tags, void and raw-text elements, unclosed tags) give a tree; rendering
walks it with rules of visibility and block layout: hidden elements vanish, blocks stand on lines of their own with the
spacing that their kind asks for, list items carry their bullet or number at their depth, preformatted text keeps its white
space, and the cells of a table are aligned in columns. All visible text is emitted, navigation and footers included; choosing
the main text is another operator's task.

Defined results: null and empty pages give the empty text; malformed markup never fails, a stray "<" is text; equal pages give
equal texts; trees deeper than MAX_DEPTH are cut flat there, their visible text kept; rows of a repeated or null page_id are rendered each for itself; a cell covers MAX_COLSPAN columns and MAX_ROWSPAN rows at
most, all cells' text kept; very long pages take a time that grows with their length; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

# Fixed values of the HTML standard: element kinds.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
RAW = frozenset({"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"})
HIDDEN = frozenset({"head", "script", "style", "template", "noscript", "iframe", "object", "audio", "video", "canvas", "datalist", "title", "meta", "link", "noembed", "noframes"})
BLOCK = frozenset({"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "caption", "ul"})
SPACED = frozenset({"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table", "ul", "ol", "dl", "menu", "dir", "figure", "fieldset", "hr"})
CLOSES_P = BLOCK - {"html", "body", "caption", "tbody", "tfoot", "thead", "tr", "option", "optgroup", "legend"}
#: A start tag that ends open elements of these kinds, looked for up to an element of the second set.
IMPLIED_END = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir", "table"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})),
    "optgroup": (frozenset({"optgroup", "option"}), frozenset({"select"})),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "thead": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "tfoot": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset()),
}
SCOPE = frozenset({"table", "td", "th", "caption", "html", "template", "button", "object"})

MAX_DEPTH = 200
#: Columns and rows that one cell covers at most: a number in a page must not make its table large.
MAX_COLSPAN, MAX_ROWSPAN = 100, 1000
EMPTY: list[str] = []

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What a start tag's attributes go up to: its end, or a quoted value, which may hold one.
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Scanner:
    """Tags and comments of a page, found in a time that grows with its length, however its marks are broken."""

    def __init__(self, page: str):
        self.page = page
        self.stops = [m.start() for m in _STOP.finditer(page)]
        self.ends: dict[int, int] = {}  # for a quote outside of values, where its tag ends
        self.last = page.rfind(">")

    def end_of_tag(self, at: int) -> int:
        """The place of the > that ends a start tag whose attributes begin here; -1 if a quote stays open or there is none.

        Attempts that meet at a quote end alike, so each quote is followed once.
        """
        passed, out = [], -1
        while (k := bisect_left(self.stops, at)) < len(self.stops):
            stop = self.stops[k]
            if self.page[stop] == ">":
                out = stop
                break
            if stop in self.ends:
                out = self.ends[stop]
                break
            passed.append(stop)
            at = self.page.find(self.page[stop], stop + 1) + 1
            if not at:
                break
        self.ends.update(dict.fromkeys(passed, out))
        return out

    def next(self, at: int) -> tuple[int, int, str | None, str, bool] | None:
        """(start, end, name, attributes, closing) of the first mark from here on: name None for comments and declarations."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                k = page.find("-->", start + 4)
                return start, k + 3 if k >= 0 else len(page), None, "", False
            if start > self.last:  # no tag can end: only an unclosed comment may follow
                k = page.find("<!--", start)
                return (k, len(page), None, "", False) if k >= 0 else None
            after = page[start + 1 : start + 2]
            if after in ("!", "?"):
                return start, page.find(">", start) + 1, None, "", False
            closing = after == "/"
            m = _NAME.match(page, start + 1 + closing)
            if m is None:
                at = start + 1
                continue
            k = page.find(">", m.end()) if closing else self.end_of_tag(m.end())
            if k >= 0:
                return start, k + 1, m[0].lower(), "" if closing else page[m.end() : k], closing
            at = m.end()  # within the name nothing else could end
        return None


class Deep:
    """The open elements below MAX_DEPTH: their names, and how many of them are hidden. Their visible text belongs to the last element above."""

    def __init__(self):
        self.open: list[tuple[str, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.hidden = 0

    def add(self, tag: str, hidden: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, hidden))
        self.hidden += hidden

    def last(self, kinds) -> int:
        """The place of the innermost element of these kinds, -1 if there is none."""
        return max((self.places[t][-1] for t in kinds if self.places.get(t)), default=-1) if self.open else -1

    def cut(self, k: int) -> None:
        while len(self.open) > k:
            tag, hidden = self.open.pop()
            self.places[tag].pop()
            self.hidden -= hidden


def parse(page: str) -> Node:
    """The tree of a page; text nodes are strings."""
    root = Node("#root", {})
    stack = [root]
    deep = Deep()
    at = 0

    def text(s: str) -> None:
        if s and not deep.hidden:
            stack[-1].children.append(html.unescape(s))

    def shrink(k: int) -> None:
        del stack[k:]
        deep.cut(0)

    def close_until(kinds: frozenset, stop: frozenset) -> None:
        """End the innermost open element of these kinds, if none of stop is open above it."""
        inner, barred = deep.last(kinds), deep.last(stop)
        if inner >= 0 or barred >= 0:
            if inner > barred:
                deep.cut(inner)
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in kinds:
                shrink(k)
                return
            if stack[k].tag in stop:
                return

    scanner, n = Scanner(page), len(page)
    while at < n:
        mark = scanner.next(at)
        if mark is None:
            text(page[at:])
            break
        start, end, tag, given, closing = mark
        text(page[at:start])
        at = end
        if tag is None:
            continue
        if closing:
            inner = deep.last((tag,))
            if inner >= 0:
                deep.cut(inner)
                continue
            if tag == "p" and not any(x.tag == "p" for x in stack):
                if not deep.hidden:
                    stack[-1].children.append(Node("p", {}))
                continue
            if deep.last(("table", "td", "th")) >= 0 and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    shrink(k)
                    break
                if stack[k].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break  # an end tag inside a cell doesn't end what stands outside it
            continue
        attrs = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(given)}
        if tag in IMPLIED_END:
            kinds, stop = IMPLIED_END[tag]
            close_until(kinds, stop)
            if tag in ("tr", "tbody", "thead", "tfoot"):
                while len(stack) > 1 and not deep.open and stack[-1].tag in kinds and (tag != "tr" or stack[-1].tag != "tbody"):
                    stack.pop()
        if tag in CLOSES_P:
            close_until(frozenset({"p"}), SCOPE)
        if stack[-1].tag == "head" and tag not in HIDDEN and tag not in ("base",):
            shrink(len(stack) - 1)
        node = Node(tag, attrs)
        if not deep.hidden:
            stack[-1].children.append(node)
        if tag in RAW:
            m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            end = m.start() if m and m.start() < scanner.last else n
            if end > at:
                raw = page[at:end]
                node.children.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
            at = page.find(">", end) + 1 if end < n else n
        elif tag not in VOID and not given.rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
            if len(stack) < MAX_DEPTH:
                stack.append(node)
            else:
                deep.add(tag, not visible(node))
    return root


def visible(node: Node) -> bool:
    a = node.attrs
    return not (node.tag in HIDDEN or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or node.tag == "input" and a.get("type", "").lower() == "hidden" or _HIDDEN_STYLE.search(a.get("style", "")))


def columns_of(s: str) -> int:
    """Places that a text takes in a fixed-width line."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Layout:
    """Collects lines; white space collapses, blank lines between blocks don't add up."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0

    def text(self, s: str) -> None:
        words = s.split()
        if not words:
            self.space |= bool(s)
            return
        self._begin()
        lead = self.space or s[:1].isspace()
        self.line.append((" " if lead and self.line and not self.line[-1].endswith("\n") else "") + " ".join(words))
        self.space = s[-1:].isspace()

    def _begin(self) -> None:
        if not self.line:
            self.space = False
            if self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0

    def literal(self, line: str) -> None:
        """A line as it is."""
        self.end(0)
        self._begin()
        self.lines.append(line.rstrip())
        self.gap = max(self.gap, 1)

    def end(self, gap: int) -> None:
        """End the line; at least gap - 1 blank lines before the next."""
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
            self.gap = 1
        self.space = False
        if self.lines:
            self.gap = max(self.gap, gap)


def _inline(node: Node, out: Layout, depth: int) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
        elif visible(child):
            _element(child, out, depth)


def _lines(node: Node, depth: int) -> list[str]:
    inner = Layout()
    _inline(node, inner, depth)
    inner.end(0)
    return inner.lines


def _element(node: Node, out: Layout, depth: int) -> None:
    tag = node.tag
    if tag == "br":
        if out.line:
            out.end(1)
        else:
            out.literal("")
    elif tag == "img":
        out.text(node.attrs.get("alt", ""))
    elif tag == "hr":
        out.end(1)
        out.literal("-" * 20)
    elif tag == "pre":
        out.end(2)
        body = "".join(_raw(node)).replace("\r\n", "\n").removeprefix("\n").rstrip("\n")
        for line in body.split("\n"):
            out.literal(line)
        out.end(2)
    elif tag in ("ul", "ol", "menu", "dir"):
        out.end(2 if depth == 0 else 1)
        number = _int(node.attrs.get("start", "1"), 1)
        for child in node.children:
            if isinstance(child, str):
                out.text(child)
            elif visible(child) and child.tag == "li":
                number = _int(child.attrs.get("value", ""), number)
                mark = f"{number}. " if tag == "ol" else "- "
                number += 1
                out.end(1)
                for k, line in enumerate(_lines(child, depth + 1) or [""]):
                    out.literal((mark if k == 0 else " " * len(mark)) + line if line or k == 0 else "")
            elif visible(child):
                _element(child, out, depth)
        out.end(2 if depth == 0 else 1)
    elif tag == "table":
        out.end(2)
        for line in _table(node, depth):
            out.literal(line)
        out.end(2)
    elif tag == "blockquote":
        out.end(2)
        for line in _lines(node, depth):
            out.literal(f"> {line}")
        out.end(2)
    elif tag == "dd":
        out.end(1)
        for line in _lines(node, depth):
            out.literal(f"    {line}" if line else "")
    elif tag in BLOCK:
        gap = 2 if tag in SPACED else 1
        out.end(gap)
        _inline(node, out, depth)
        out.end(gap)
    else:
        _inline(node, out, depth)


def _raw(node: Node):
    for child in node.children:
        if isinstance(child, str):
            yield child
        elif child.tag == "br":
            yield "\n"
        elif visible(child):
            yield from _raw(child)


def _int(s: str, default: int) -> int:
    return int(s) if re.fullmatch(r"-?\d{1,9}", s.strip()) else default


def _rows(node: Node, captions: list[Node]):
    """The rows of a table, sections opened; loose cells form a row."""
    loose = Node("tr", {})
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                loose.children.append(Node("td", {}))
                loose.children[-1].children.append(child)
            continue
        if not visible(child):
            continue
        if child.tag in ("td", "th"):
            loose.children.append(child)
            continue
        if loose.children:
            yield loose
            loose = Node("tr", {})
        if child.tag == "tr":
            yield child
        elif child.tag in ("tbody", "thead", "tfoot", "form"):
            yield from _rows(child, captions)
        elif child.tag == "caption":
            captions.append(child)
        elif child.tag not in ("colgroup", "col"):
            loose.children.append(child)
    if loose.children:
        yield loose


def _table(node: Node, depth: int) -> list[str]:
    captions: list[Node] = []
    grid: list[list[list[str]]] = []
    held: dict[int, int] = {}  # columns that a cell of an earlier row still covers, and for how many rows
    for row in _rows(node, captions):
        cells: list[list[str]] = []

        def skip() -> None:
            while held.get(len(cells), 0) > 0:
                held[len(cells)] -= 1
                cells.append(EMPTY)

        for cell in row.children:
            if isinstance(cell, str):
                if not cell.strip():
                    continue
                wrap = Node("td", {})
                wrap.children.append(cell)
                cell = wrap
            if not visible(cell):
                continue
            skip()
            own = cell if cell.tag in ("td", "th") else _wrapped(cell)
            lines = _lines(own, depth + 1)
            span = min(MAX_COLSPAN, max(1, _int(cell.attrs.get("colspan", "1"), 1)))
            down = min(MAX_ROWSPAN, max(1, _int(cell.attrs.get("rowspan", "1"), 1)))
            for k in range(span):
                if down > 1:
                    held[len(cells)] = down - 1
                cells.append(lines if k == 0 else EMPTY)
        skip()
        if any(cells):
            grid.append(cells)
    width = [0] * max(map(len, grid), default=0)
    for cells in grid:
        for k, lines in enumerate(cells):
            width[k] = max([width[k], *map(columns_of, lines)])
    out = [line for c in captions for line in _lines(c, depth + 1)]
    for cells in grid:
        for k in range(max(map(len, cells))):
            parts = [lines[k] if k < len(lines) else "" for lines in cells]
            out.append("  ".join(p + " " * (w - columns_of(p)) for p, w in zip(parts, width, strict=False)).rstrip())
    return out


def _wrapped(node: Node) -> Node:
    cell = Node("td", {})
    cell.children.append(node)
    return cell


def render(page: str | None) -> str:
    """The visible text of a page."""
    out = Layout()
    _inline(parse(page or ""), out, 0)
    out.end(0)
    return "\n".join(out.lines).strip("\n")


def title(page: str | None) -> str | None:
    """The text of the first title element."""
    page = page or ""
    m = re.search(r"<title(?=[\s>])", page, re.I)
    start = page.find(">", m.end()) + 1 if m else 0
    if not start:
        return None
    end = re.compile("</title", re.I).search(page, start)
    return " ".join(html.unescape(page[start : end.start() if end else len(page)]).split())


def extract(pages: DataFrame, id_col: str = "page_id", page_col: str = "html") -> DataFrame:
    """The page's id, title, visible text and its numbers of characters and lines."""

    @F.arrow_udf("struct<title:string,text:string>")
    def read_page(texts: pa.Array) -> pa.Array:
        rows = [t.as_py() for t in texts]
        return pa.StructArray.from_arrays([pa.array(list(map(title, rows)), pa.string()), pa.array(list(map(render, rows)), pa.string())], ["title", "text"])

    ship(pages.sparkSession)
    out = pages.select(F.col(id_col), read_page(page_col).alias("_p")).select(id_col, "_p.title", "_p.text")
    return out.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint"))
