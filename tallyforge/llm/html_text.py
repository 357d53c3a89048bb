"""Operator 7, HTML extraction: a tree with implied tags and visibility rules, rendered as laid-out text.

All visible text is emitted. Blocks stand on lines of their own, paragraphs and headings have a blank line around
them, list items are marked and indented, and the cells of a table are aligned in columns.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

# Fixed values of the HTML standard: elements by kind.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link datalist iframe audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption li dd dt option".split())
# An opening tag on the left ends the open elements on the right, up to the scope.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*+")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_GONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
_BUTTONS = ("submit", "button", "reset")
#: How an element is seen: its own text is, or is not but that of elements inside may be, or nothing inside is.
SEEN, UNSEEN, GONE = 0, 1, 2
_SPACE = re.compile(r"[ \t\n\r\f\v]+")


#: Elements below this depth stand in the one at it, as lines of their own, so that rendering never nests deeper.
DEEPEST = 200
#: End tags of cells and tables pass these; others don't.
_CELLS, _TABLE_TAGS = ("table", "td", "th"), frozenset("table tr tbody thead tfoot td th body html".split())


class Node:
    __slots__ = ("tag", "children", "hidden", "start", "span", "rows", "value")

    def __init__(self, tag: str, hidden: int = SEEN, start: int = 1, span: int = 1, rows: int = 1, value: int | None = None):
        self.tag, self.children, self.hidden, self.start, self.span, self.rows, self.value = tag, [], hidden, start, span, rows, value


def tokens(page: str):
    """(text before, kind, tag, rest) of each tag in order; kind is "open", "close", "raw" (the text is all of a raw
    element) or "" (no tag). Every place is looked at a bounded number of times.

    A tag ends at the first ">" outside quotes. A quote that is never closed is a plain sign; where quotes leave no
    end, the tag ends at the next ">"; without any ">", the rest of the page is text.
    """
    last = {q: page.rfind(q) for q in "\"'>"}
    begin = at = 0
    while True:
        at = page.find("<", at)
        if at < 0:
            yield page[begin:], "", "", ""
            return
        if page.startswith(("<!", "<?"), at):
            long = page.startswith("<!--", at)
            end = page.find("-->" if long else ">", at + 2)
            yield page[begin:at], "", "", ""
            begin = at = len(page) if end < 0 else end + (3 if long else 1)
            continue
        m = _TAG.match(page, at + 1)
        if m is None or m.end() > last[">"]:
            at += 1
            continue
        k = m.end()
        while k < len(page) and page[k] != ">":
            k = _PLAIN.match(page, k).end()
            if k < len(page) and page[k] != ">":
                k = page.index(page[k], k + 1) + 1 if k < last[page[k]] else k + 1
        if k >= len(page):
            k = page.find(">", m.end())
        tag, rest = m[2].lower(), page[m.end() : k]
        yield page[begin:at], "close" if m[1] else "open", tag, rest
        begin = at = k + 1
        if tag in RAW and not m[1]:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            yield page[at : end.start() if end else len(page)], "raw", tag, ""
            begin = at = end.end() if end else len(page)


class _Open:
    """The open elements, and for each tag where it is open."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        if len(self.nodes) > DEEPEST:
            node.children = self.top().children
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags) -> int:
        """Where the innermost element of these tags is; 0 if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def cut(self, k: int) -> None:
        for node in self.nodes[k:]:
            self.places[node.tag].pop()
        deep = len(self.nodes) > DEEPEST + 1 and any(n.tag in BLOCK for n in self.nodes[max(k, DEEPEST + 1) :])
        del self.nodes[k:]
        if deep and len(self.nodes) > DEEPEST:
            self.top().children.append(Node("div"))

    def end(self, tags, scope) -> None:
        """Ends all elements of these tags inside the scope."""
        while (k := self.last(tags)) > self.last(scope):
            self.cut(k)


def parse(page: str) -> Node:
    """The tree of a page: nodes and, for text, strings. Text in a hidden element is left out."""
    root = Node("#root")
    open_ = _Open(root)
    for text, kind, tag, rest in tokens(page):
        if kind == "raw":
            node = open_.top().children[-1]
            if not node.hidden:
                node.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
            continue
        if text and not open_.top().hidden:
            open_.top().children.append(html.unescape(text) if "&" in text else text)
        if kind == "close":
            if tag == "p" and not open_.last({"p"}):
                open_.top().children.append(Node("p"))
            k = open_.last({tag})
            if k and (tag in _TABLE_TAGS or k > open_.last(_CELLS)):
                open_.cut(k)
        if kind != "open":
            continue
        attributes = {x[0].lower(): x[1] or x[2] or x[3] for x in _ATTRIBUTE.findall(rest)} if rest.strip(" /\t\n") else {}
        if tag in IMPLIED_END:
            open_.end(*IMPLIED_END[tag])
        if tag in CLOSES_P:
            open_.end({"p"}, {"table", "td", "th", "button", "object"})
        if re.fullmatch("h[1-6]", open_.top().tag) and re.fullmatch("h[1-6]", tag):
            open_.cut(len(open_.nodes) - 1)
        if tag in ("td", "th") and open_.top().tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", open_.top().hidden)
            open_.top().children.append(row)
            open_.push(row)
        style, hidden = attributes.get("style", ""), open_.top().hidden
        if hidden == GONE or tag in HIDDEN or "hidden" in attributes or _GONE.search(style):
            hidden = GONE
        elif said := _VISIBILITY.findall(style):
            hidden = SEEN if said[-1].lower() == "visible" else UNSEEN
        number = lambda name, other=1: int(x) if re.fullmatch(r"-?\d{1,9}", x := attributes.get(name, "").strip()) else other
        size = lambda name: min(max(number(name), 1), 1000)
        node = Node(tag, hidden, number("start"), size("colspan"), size("rowspan"), number("value", None) if tag == "li" else None)
        if tag == "input" and not hidden and attributes.get("type", "").lower() in _BUTTONS:
            open_.top().children.append(html.unescape(attributes.get("value", "")))
        keeps = tag not in RAW and tag not in VOID and not (rest.endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "em", "strong", "span"))
        if not keeps or len(open_.nodes) <= DEEPEST:
            open_.top().children.append(node)
        elif tag in BLOCK and not hidden:
            open_.top().children.append(Node("div"))
        if keeps:
            open_.push(node)
    return root


class Lines:
    """Lines of text under way: inline text flows, blocks break, blank lines don't pile up."""

    def __init__(self):
        self.done: list[str] = []
        self.line = ""
        self.gap = False

    def flow(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text.strip(" ") == "":
            if text and self.line and not self.line.endswith(" "):
                self.line += " "
            return
        if not self.line or self.line.endswith(" "):
            text = text.lstrip(" ")
        self.line += text

    def stop(self, blank: bool = False) -> None:
        if self.line.strip(" "):
            if self.gap and self.done:
                self.done.append("")
            self.done.append(self.line.rstrip(" "))
            self.gap = False
        self.line = ""
        self.gap |= blank

    def put(self, lines: list[str], indent: str = "", mark: str = "") -> None:
        """Whole lines; mark stands before the first."""
        self.stop()
        if lines:
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            first = mark or indent
            self.done += [(first if k == 0 else indent) + x if x else "" for k, x in enumerate(lines)]


def render(node: Node) -> list[str]:
    """Lines of an element's content."""
    out = Lines()
    _into(node, out)
    out.stop()
    return out.done


def _into(node: Node, out: Lines) -> None:
    number = node.start
    for child in node.children:
        if isinstance(child, str):
            out.flow(child)
        elif child.hidden == GONE:
            continue
        elif child.tag == "br":
            if out.line.strip(" "):
                out.stop()
            else:  # a line without text
                out.line, out.gap = "", out.gap or bool(out.done)
        elif child.hidden and child.tag not in BLOCK:
            _into(child, out)
        elif child.tag == "img":
            continue
        elif child.tag == "hr":
            out.stop(True)
        elif child.tag == "pre":
            out.stop(True)
            out.put("".join(_raw(child)).strip("\n").split("\n"))
            out.stop(True)
        elif child.tag == "table":
            out.stop(True)
            out.put(_table(child))
            out.stop(True)
        elif child.tag == "li":
            number = number if child.value is None else child.value
            mark = ("" if child.hidden else f"{number}. ") if node.tag == "ol" else "" if child.hidden else "- "
            number += 1
            out.put(render(child), " " * len(mark), mark)
        elif child.tag in ("dd", "blockquote"):
            out.stop(child.tag in SPACED)
            out.put(render(child), "  ")
            out.stop(child.tag in SPACED)
        elif child.tag in BLOCK:
            spaced = child.tag in SPACED and not (child.tag in ("ul", "ol") and node.tag == "li")
            out.stop(spaced)
            _into(child, out)
            out.stop(spaced)
        else:
            _into(child, out)


def _raw(node: Node):
    for child in node.children:
        if isinstance(child, str):
            yield child
        elif child.hidden != GONE:
            yield "\n" if child.tag == "br" else ""
            yield from _raw(child)


#: Padding of a table is at most so many times its text; else its widest columns stay ragged, or one long cell among
#: many short rows would make the output grow with the square of the page.
_PADDING = 100


Cell = tuple[list[str], int, int]  # lines, columns and rows that it takes


def _table(node: Node) -> list[str]:
    """Rows with cells padded to the column's width; other content stands before the rows."""
    rows: list[list[Cell]] = []
    before = Lines()

    def collect(part: Node) -> None:
        for child in part.children:
            if isinstance(child, str):
                before.flow(child)
            elif child.hidden == GONE:
                continue
            elif child.tag in ("thead", "tbody", "tfoot"):
                collect(child)
            elif child.tag == "tr":
                cells = [(render(c), c.span, c.rows) for c in child.children if isinstance(c, Node) and c.hidden != GONE and c.tag in ("td", "th")]
                loose = Node("#loose")
                loose.children = [c for c in child.children if isinstance(c, str) or (c.hidden != GONE and c.tag not in ("td", "th"))]
                before.put(render(loose))
                if cells:
                    rows.append(cells)
            else:
                before.put(render(child))

    collect(node)
    before.stop()
    if all(len(row) == 1 for row in rows):  # the layout of a page: blocks, apart where one has several lines
        for lines, _, _ in (row[0] for row in rows):
            before.gap |= len(lines) > 1 and bool(before.done)
            before.put(lines)
            before.gap = len(lines) > 1
        return before.done
    return before.done + _aligned(_placed(rows))


def _placed(rows: list[list[Cell]]) -> list[list[tuple[list[str], int]]]:
    """Rows with an empty cell where one from above reaches down."""
    out, down = [], {}
    for row in rows:
        at, cells, left = 0, [], {k: n - 1 for k, n in down.items() if n > 1}
        for lines, span, high in row:
            while down.get(at, 0):
                cells.append(([], 1))
                at += 1
            cells.append((lines, span))
            if high > 1:
                left |= dict.fromkeys(range(at, at + span), high - 1)
            at += span
        out.append(cells)
        down = left
    return out


def _aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    widths: dict[int, int] = {}
    wide = []
    for row in rows:
        at = 0
        for lines, span in row:
            size = max(map(len, lines), default=0)
            if span == 1:
                widths[at] = max(widths.get(at, 0), size)
            else:
                wide.append((at, span, size))
            at += span
    for at, span, size in wide:  # a cell over several columns widens the last of them where they are too narrow
        have = sum(widths.get(k, 0) for k in range(at, at + span)) + 3 * (span - 1)
        widths[at + span - 1] = widths.get(at + span - 1, 0) + max(size - have, 0)
    heights = [max(max((len(lines) for lines, _ in row), default=0), 1) for row in rows]
    # padding of tables inside is no text, so that tables in tables do not multiply it
    room = _PADDING * sum(len(x) - x.count(" ") + 1 for row in rows for lines, _ in row for x in lines)
    gaps = sum(3 * len(row) * (height - 1) for row, height in zip(rows, heights, strict=True))
    loose = gaps > room  # many columns beside one tall cell: its further lines begin at the left
    room -= 0 if loose else gaps
    for k in sorted(widths, key=lambda k: (widths[k], k)):
        room -= widths[k] * (len(rows) if loose else sum(heights))
        if room < 0:
            widths[k] = 0
    out = []
    for row, height in zip(rows, heights, strict=True):
        at, off, cells, tall = 0, 0, [], []
        for lines, span in row:
            width = sum(widths.get(k, 0) for k in range(at, at + span)) + 3 * (span - 1)
            cells.append((lines[0] if lines else "").ljust(width))
            tall.append((0 if loose else off, lines))
            at, off = at + span, off + width + 3
        out.append(" | ".join(cells).rstrip())
        for line in range(1, height):
            tall = [x for x in tall if line < len(x[1])]  # so that all lines together cost as much as their number
            text = ""
            for off, lines in tall:
                text = (text.ljust(off) if len(text) <= off else text + "   ") + lines[line]
            out.append(text.rstrip())
    return out


def page_text(page: str) -> str:
    return "\n".join(render(parse(page)))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The columns of pages but the HTML, with text, n_chars and n_lines.

    Null and empty pages have empty text; a page without tags is its text; unclosed and stray tags are taken as
    browsers do in the common cases; equal rows get equal results; an empty table gives no rows.
    """
    names = [c for c in pages.columns if c not in (html_col, "text", "n_chars", "n_lines")]

    def run(batches):
        for batch in slices(batches, 256):
            text = [page_text(x or "") for x in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(text, pa.string())], names=[*names, "text"])

    rows = pages.select(*names, F.col(html_col).cast("string").alias(html_col))
    out = rows.mapInArrow(run, rows.select(*names).schema.add("text", "string"))
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return out.withColumns({"n_chars": F.length("text").cast("long"), "n_lines": lines.cast("long")})


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as text."""
    return extract_text(table(spark, sf_dir, "pages"))
