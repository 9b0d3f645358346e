"""Visible text of HTML pages: a tree with implied tags, rendered by block, list and table rules."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element names of the public HTML standard, by their role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object datalist svg math audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul caption optgroup option".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr menu".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot li dd dt caption legend option optgroup summary".split())
#: An open element that the start of another one closes, up to the elements that bound it.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
}
#: Comments, declarations, and tags with their attributes. Nothing is read twice: what is never closed ends with the page.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|=)*+)(>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(\"[^\"]*+\"?|'[^']*+'?|[^\s>]++))?")
UNSEEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
VISIBILITY = re.compile(r"visibility\s*:\s*(\w+)", re.IGNORECASE)
#: Deeper nesting is flattened into the deepest element, so no page exhausts the stack; hidden elements stay hidden there.
MAX_DEPTH = 200
#: Columns that one cell can span, and rows.
MAX_SPAN = 100


@dataclass
class Element:
    """A node of the tree: children are elements and strings."""

    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)

    def hidden(self) -> bool:
        a = self.attributes
        if self.name in HIDDEN or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
            return True
        return self.name == "input" or bool(UNSEEN.search(a.get("style", "")))

    def seen(self, inherited: bool) -> bool:
        """Whether its own text shows; unlike a hidden element's, its children can differ."""
        said = VISIBILITY.findall(self.attributes.get("style", ""))
        return said[-1].lower() not in ("hidden", "collapse") if said else inherited

    def number(self, name: str, default: int) -> int:
        value = self.attributes.get(name, "").strip()
        return int(value) if re.fullmatch(r"[+-]?[0-9]{1,9}", value) else default


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return found


class OpenElements:
    """The elements that are open, and where those of each name are."""

    def __init__(self, root: Element) -> None:
        self.path = [root]
        self.places: dict[str, list[int]] = {}

    def last(self, names: tuple[str, ...]) -> int:
        """The place of the innermost open element of these names, 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def push(self, element: Element) -> None:
        self.places.setdefault(element.name, []).append(len(self.path))
        self.path.append(element)

    def cut(self, place: int) -> None:
        """Close the element at a place and all within it."""
        for element in self.path[place:]:
            self.places[element.name].pop()
        del self.path[place:]

    def close(self, names: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        """Close the elements of these names that lie within the innermost bound."""
        bound = self.last(bounds)
        while (place := self.last(names)) > bound:
            self.cut(place)


def parse(page: str) -> Element:
    """The tree of a page. Missing end tags are implied, stray ones dropped, and so is a tag that the page cuts off."""
    root = Element("html")
    opened = OpenElements(root)
    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            opened.path[-1].children.append(html.unescape(text))
        if not m or m[2] and not m[4]:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if place := opened.last((name,)):
                opened.cut(place)
            elif name == "p":
                opened.path[-1].children.append(Element("p"))
            continue
        if name == "html":
            continue
        if name in CLOSES_P:
            opened.close(("p",), ("td", "th", "button", "table", "caption"))
        if name in IMPLIED:
            opened.close(*IMPLIED[name])
        if name == "body":
            opened.close(("head",), ())
        element, parent = Element(name, attributes(m[3]) if m[3] else {}), opened.path[-1]
        deep = len(opened.path) >= MAX_DEPTH and name not in RAW and name not in VOID
        if deep and not element.hidden() and element.seen(True):
            element.children = parent.children  # what it holds goes to the deepest element
        elif not deep:
            parent.children.append(element)
        if name in RAW:
            end = re.compile(rf"</{name}\s*+>", re.IGNORECASE).search(page, at)
            stop = end.start() if end else len(page)
            element.children.append(page[at:stop] if name in ("script", "style") else html.unescape(page[at:stop]))
            at = end.end() if end else len(page)
        elif name not in VOID and not m[3].endswith("/"):
            opened.push(element)
    return root


class Writer:
    """Lines of text with the blank lines that blocks ask for, and collapsed white space."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank, self.gap, self.prefix, self.first = True, 0, "", ""

    def add(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.blank = text[-1] == " "

    def text(self, text: str, keep: bool) -> None:
        if keep:
            head, *more = text.split("\n")
            self.add(head)
            for part in more:
                self.end(keep=True)
                self.add(part)
            return
        text = re.sub(r"[ \t\n\r\f]+", " ", text)
        self.add(text[1:] if text.startswith(" ") and self.blank else text)

    def end(self, keep: bool = False) -> None:
        line = "".join(self.parts)
        line = line.rstrip() if not keep else line
        if line.strip() or keep and self.lines:
            if self.lines and self.gap:
                self.lines.extend([""] * self.gap)
            self.lines.append((self.first or self.prefix) + line)
            self.gap, self.first = 0, ""
        self.parts, self.blank = [], True

    def space(self, blank: int) -> None:
        self.end()
        self.gap = max(self.gap, blank)


class Table:
    """The rows of cells of a table, through any elements between, and what else stands in it."""

    def __init__(self, table: Element, seen: bool) -> None:
        self.rows: list[list[list[str]]] = []
        self.captions: list[tuple[Element, bool]] = []
        self.stray: list[tuple[Element | str, bool]] = []
        self.below: dict[int, int] = {}
        self.collect(table, seen)

    def collect(self, node: Element, seen: bool) -> None:
        loose: list[Element] = []

        def row_of_loose() -> None:
            if loose:
                self.row(Element("tr", {}, list(loose)), seen)
                loose.clear()

        for c in node.children:
            if isinstance(c, str):
                if c.strip():
                    self.stray.append((c, seen))
            elif c.hidden():
                continue
            elif c.name == "caption":
                self.captions.append((c, c.seen(seen)))
            elif c.name in ("td", "th"):
                loose.append(c)
            elif c.name == "tr":
                row_of_loose()
                self.row(c, c.seen(seen))
            elif c.name in ("thead", "tbody", "tfoot") or any(isinstance(x, Element) and x.name in ROW_PARTS for x in c.children):
                row_of_loose()
                self.collect(c, c.seen(seen))
            else:
                self.stray.append((c, seen))
        row_of_loose()

    def row(self, row: Element, seen: bool) -> None:
        """Add a row; cells of earlier rows that reach down keep their columns."""
        made: list[list[str]] = []

        def skip() -> None:
            while self.below.get(len(made), 0):
                self.below[len(made)] -= 1
                made.append([])

        def place(node: Element, seen: bool) -> None:
            for c in node.children:
                if isinstance(c, str):
                    if c.strip():
                        self.stray.append((c, seen))
                elif c.hidden():
                    continue
                elif c.name in ("td", "th"):
                    skip()
                    columns, rows = (max(1, min(c.number(n, 1), MAX_SPAN)) for n in ("colspan", "rowspan"))
                    lines = render(c, c.seen(seen)).split("\n")
                    for k in range(columns):
                        if rows > 1:
                            self.below[len(made)] = rows - 1
                        made.append([] if k else lines)
                elif any(isinstance(x, Element) and x.name in ("td", "th") for x in c.children):
                    place(c, c.seen(seen))
                else:
                    self.stray.append((c, seen))

        place(row, seen)
        skip()
        self.rows.append(made)

    def lines(self) -> Iterator[str]:
        """The rows as text, columns aligned; a cell of several lines makes its row as many."""
        columns = max(map(len, self.rows), default=0)
        wide = [max((len(x) for r in self.rows if i < len(r) for x in r[i]), default=0) for i in range(columns)]
        for row in self.rows:
            for k in range(max([1, *map(len, row)])):
                yield " | ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(row, wide, strict=False))


ROW_PARTS = frozenset("tr td th thead tbody tfoot".split())


def write_table(table: Element, out: Writer, seen: bool) -> None:
    """Append a table: what stands in it outside of cells first, then its caption and its rows."""
    found = Table(table, seen)
    for stray, shown in found.stray:
        write(Element("span", {}, [stray]), out, seen=shown)
    out.space(1)
    for caption, shown in found.captions:
        write(caption, out, seen=shown)
        out.end()
    for line in found.lines():
        out.add(line)
        out.end()
    out.space(1)


def write(node: Element, out: Writer, keep: bool = False, seen: bool = True) -> None:
    """Append a node's visible text."""
    step = -1 if "reversed" in node.attributes else 1
    items = sum(isinstance(c, Element) and c.name == "li" for c in node.children) if step < 0 else 1
    number = node.number("start", items)
    for child in node.children:
        if isinstance(child, str):
            if seen:
                out.text(child, keep)
            continue
        if child.hidden():
            continue
        name, shown = child.name, child.seen(seen)
        if name == "br":
            out.end(keep=True)
        elif name == "img":
            out.text(child.attributes.get("alt", "") if shown else "", keep)
        elif name == "table":
            write_table(child, out, shown)
        elif name == "li":
            out.space(0)
            number = child.number("value", number)
            before, mark = out.prefix, f"{number}. " if node.name == "ol" else "- "
            number += step
            out.first, out.prefix = before + mark, before + " " * len(mark)
            write(child, out, keep, shown)
            out.space(0)
            out.first, out.prefix = "", before
        elif name in BLOCK:
            blank = 1 if name in SPACED and not (name in ("ul", "ol") and node.name == "li") else 0
            out.space(blank)
            if name == "hr" and shown:
                out.add("---")
            before = out.prefix
            out.prefix += {"blockquote": "> ", "dd": "  "}.get(name, "")
            write(child, out, keep or name == "pre", shown)
            out.space(blank)
            out.prefix = before
        else:
            write(child, out, keep, shown)


def render(node: Element, seen: bool = True) -> str:
    out = Writer()
    write(node, out, seen=seen)
    out.end()
    return "\n".join(out.lines).strip("\n")


def extract(pages: DataFrame, html_column: str = "html", text: str = "rendered") -> DataFrame:
    """``pages`` with the visible text of their HTML in place of it.

    Narrow, and linear in the length of a page. A null page gives a null text, a page without visible
    text an empty one; what is no markup is text. Text of a table outside its cells stands before it, and cells
    keep the lines of their blocks. Rows keep their order and repeats. A column named
    ``text`` is replaced.
    """
    kept = [c for c in pages.columns if c not in (html_column, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [None if p is None else render(parse(p)) for p in part.column(html_column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(texts, pa.string())], names=[*kept, text])

    return pages.mapInArrow(run, T.StructType([*pages.select(*kept).schema.fields, T.StructField(text, T.StringType())]))
