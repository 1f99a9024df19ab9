"""Operator 7, HTML extraction: a tree builder with implied tags, and a renderer of all visible text.

The tokenizer and tree builder follow the HTML rules that change the text: implied ends of p, li, dt, dd, option,
tr, td, th and table sections, implied tr and tbody, raw text in script and style, void elements, unclosed tags and
comments, character references. What stands in a table outside its cells and captions is fostered: it goes before
the table. Hidden are head, script, style, template, noscript, elements with ``hidden`` or inline ``display:none``
whole, and the text of elements with inline ``visibility:hidden`` but for descendants made visible again. The renderer
keeps block spacing (a blank line around paragraphs and headings, a line for other blocks), list markers with
indentation, preformatted text, and tables with cells aligned in columns; a cell with ``colspan`` or ``rowspan`` takes
its columns and rows.

Work is row by row in Arrow batches, no shuffle. The time of a page is linear in its length and in that of the text
that comes out (deep nesting indents and pads it): tokens are matched without backtracking, open elements are found
by their tag and not by a walk down the stack, and builder and renderer are loops, so depth is bounded by the page.

Defined results: null html gives null text, empty or invisible html ''; broken markup is text or ignored as a browser
would, a tag that the page's end cuts off is dropped; numbers that are none or have over nine digits count as absent;
repeated rows get equal results; extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._frames import map_arrow

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?>[^>=]++|=(?:\s*+(?:\"[^\"]*+\"|'[^']*+'))?+)*+)(>|\Z)|[^<]+|<", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes datalist object audio video canvas".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr menu dir".split())
BLOCK = SPACED | frozenset("html body div section article aside nav header footer main address form fieldset legend details summary li dt dd figcaption center option optgroup tr caption thead tbody tfoot hgroup search dialog".split())
#: A start tag of the key ends open elements of the values, up to the barrier.
CLOSES = {x: ("p",) for x in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()}
CLOSES |= {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("td", "th", "tr", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}
CLOSES |= {x: ("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup", "p") for x in ("thead", "tbody", "tfoot")}
BARRIER = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "optgroup": ("select",)}
TABLE = frozenset("table html template".split())
#: Elements that hold only those of KEPT and white space; anything else in them is fostered.
GRID = frozenset("table thead tbody tfoot tr".split())
PARTS = frozenset("thead tbody tfoot tr td th caption colgroup col".split())
KEPT = PARTS | frozenset("script style template".split())
CELL = frozenset("td th caption template".split())
#: What a part leaves open of the table it starts in.
STAY = {"tr": ("thead", "tbody", "tfoot"), "td": ("thead", "tbody", "tfoot", "tr"), "th": ("thead", "tbody", "tfoot", "tr"), "col": ("colgroup",)}
SCOPE = frozenset("table td th caption button html template object".split())
STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z]+)", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?")
NUMBER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]{1,9})(?![0-9])")
WHITE = re.compile(r"[ \t\n\r\f]+")
#: The bounds that HTML sets.
COLSPAN, ROWSPAN = 1000, 65534


class Node:
    __slots__ = ("tag", "children", "hidden", "start", "seen", "spans", "lines")

    def __init__(self, tag: str, hidden: bool = False, start: int = 1, seen: bool = True, spans: tuple[int, int] = (1, 1)):
        self.tag, self.children, self.hidden, self.start, self.seen, self.spans = tag, [], hidden, start, seen, spans
        self.lines: list[str] = []


def number(text: str, default: int) -> int:
    m = NUMBER.match(text)
    return int(m[1]) if m else default


class Stack:
    """The open elements, and for each tag where they stand."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """Where the innermost of the tags stands, 0 if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)


def attributes_of(text: str, tag: str, seen: bool) -> tuple[bool, int, bool, tuple[int, int]]:
    """Whether the element is hidden, its list's first number, whether its text is seen, its column and row span."""
    found: dict[str, str] = {}
    for k, v in ATTRIBUTE.findall(text):
        found.setdefault(k.lower(), v[1:-1] if v[:1] in ('"', "'") else v)
    hidden = "hidden" in found or (tag == "input" and found.get("type", "").lower() == "hidden")
    for k, v in STYLE.findall(found.get("style", "")):
        if k.lower() == "display":
            hidden = hidden or v.lower() == "none"
        else:
            seen = v.lower() not in ("hidden", "collapse")
    start = number(found.get("start", ""), 1) if tag == "ol" else 1
    spans = (1, 1)
    if tag in ("td", "th"):
        spans = (min(max(number(found.get("colspan", ""), 1), 1), COLSPAN), min(max(number(found.get("rowspan", ""), 1), 1), ROWSPAN))
    return hidden, start, seen, spans


def parse(page: str) -> Node:
    """The tree: nodes and strings."""
    root = Node("html")
    stack = Stack(root)
    nodes = stack.nodes
    at, end = 0, len(page)

    def close(names: tuple[str, ...], barrier) -> None:
        while (i := stack.last(names)) > stack.last(barrier):
            stack.cut(i)
            if len(names) == 1 or stack.last(names) < max(1, i - 3):
                break

    def table_at(barrier: frozenset) -> int:
        """Where the innermost table stands on the stack, 0 if none does or the barrier is met first."""
        t = stack.last(("table",))
        return t if t > stack.last(barrier) else 0

    def put(child) -> None:
        """Into the current node; what that cannot hold as part of a table goes before the table."""
        if nodes[-1].tag == "colgroup":
            stack.cut(len(nodes) - 1)
        t = table_at(CELL) if nodes[-1].tag in GRID else 0
        if t:
            nodes[t - 1].children.insert(-1, child)  # an open table is the last child
        else:
            nodes[-1].children.append(child)

    def push(node: Node) -> None:
        if node.tag in KEPT:
            nodes[-1].children.append(node)
        else:
            put(node)
        stack.push(node)

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        ended, tag = m[1], m[2]
        if tag is not None:
            if not m[4]:
                break  # cut off by the end
            tag = tag.lower()
            if tag in ("html", "body"):
                if tag == "body":
                    close(("head",), ())
                continue
            t = table_at(frozenset(("template",))) if tag in PARTS else table_at(CELL) if tag in ("table", "form") else 0
            if t and tag in PARTS:
                while t + 1 < len(nodes) and nodes[t + 1].tag in STAY.get(tag, ()):
                    t += 1
                stack.cut(t + 1)
            elif t and tag == "form":
                put(Node("form"))  # empty: what follows it is the table's
                continue
            elif t:
                stack.cut(t)  # a table directly in a table ends it
            if tag in CLOSES and not (t and tag in PARTS):
                close(CLOSES[tag], BARRIER.get(tag, TABLE if tag in ("tr", "td", "th", "thead", "tbody", "tfoot") else SCOPE))
            if tag in ("tr", "td", "th") and not stack.last(("table",)):
                continue  # cells outside a table are ignored
            if tag == "tr" and nodes[-1].tag == "table":
                push(Node("tbody", seen=nodes[-1].seen))
            elif tag in ("td", "th") and nodes[-1].tag in ("table", "tbody", "thead", "tfoot"):
                if nodes[-1].tag == "table":
                    push(Node("tbody", seen=nodes[-1].seen))
                push(Node("tr", seen=nodes[-1].seen))
            attributes = m[3]
            node = Node(tag, tag in HIDDEN, seen=nodes[-1].seen)
            if attributes and not attributes.isspace():
                hidden, node.start, node.seen, node.spans = attributes_of(attributes, tag, node.seen)
                node.hidden = node.hidden or hidden
            if tag in VOID:
                (nodes[-1].children.append if tag in KEPT else put)(node)
                continue
            push(node)
            if tag in RAW:
                close_tag = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                body = page[at : close_tag.start() if close_tag else end]
                at = close_tag.end() if close_tag else end
                if body and tag == "textarea":
                    nodes[-1].children.append(unescape(body))
                stack.cut(len(nodes) - 1)
        elif ended is not None:
            tag = ended.lower()
            if tag == "br":
                put(Node("br"))
            elif tag == "p" and not stack.last(("p",)):
                put(Node("p"))
            elif tag in ("html", "body"):
                continue
            else:
                barrier = ("html", "template") if tag == "table" else TABLE if tag in ("tr", "td", "th", "thead", "tbody", "tfoot") else SCOPE - {tag}
                i = stack.last((tag,))
                if i > stack.last(barrier):
                    stack.cut(i)
        else:
            text = m[0]
            if text == "<" or text[0] != "<":
                text = unescape(text)
                if text.strip(" \t\n\r\f"):
                    put(text)
                else:
                    nodes[-1].children.append(text)
    return root


class Page:
    """Lines under construction: spacing between blocks, prefixes of lists."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # line ends owed before the next text
        self.indent = 0
        self.marker = ""
        self.space = False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            for i, part in enumerate(s.split("\n")):
                if i:
                    self.line(1)
                if part:
                    self.begin()
                    self.now.append(part)
            return
        parts = WHITE.split(s)
        joined = " ".join(p for p in parts if p)
        if not joined:
            self.space = self.space or bool(s)
            return
        if (self.space or s[0] in " \t\n\r\f") and self.now:
            self.now.append(" ")
        self.begin()
        self.now.append(joined)
        self.space = s[-1] in " \t\n\r\f"

    def begin(self) -> None:
        if not self.now:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0
            self.now.append(" " * (self.indent - len(self.marker)) + self.marker)
            self.marker = ""

    def line(self, gap: int) -> None:
        """End the line; gap 2 asks for an empty line before the next text."""
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.gap = max(self.gap, gap)
        self.space = False

    def done(self) -> list[str]:
        self.line(1)
        return self.lines


def table_rows(table: Node) -> tuple[list[list[Node]], list[Node]]:
    """Rows of cells, and the captions."""
    rows, captions, todo = [], [], [table]
    while todo:
        node = todo.pop()
        if isinstance(node, str) or node.hidden:
            continue
        if node.tag == "tr":
            rows.append([c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th") and not c.hidden])
        elif node.tag == "caption":
            captions.append(node)
        elif node is table or node.tag in ("thead", "tbody", "tfoot"):
            todo.extend(reversed(node.children))
    return rows, captions


def table_lines(table: Node) -> list[str]:
    """The table's lines, from its cells' lines. Only columns that a cell begins in are laid out."""
    rows, captions = table_rows(table)
    out = [line for c in captions for line in c.lines]
    placed: list[list[tuple[int, int, Node]]] = []  # row by row: first column, the column after the last, cell
    taken: list[tuple[int, int, int]] = []  # columns of cells from rows above: first, after the last, row after the last
    for y, row in enumerate(rows):
        here, x = [], 0
        if row:
            taken = sorted(t for t in taken if t[2] > y)
            k = 0
            for cell in row:
                while k < len(taken) and taken[k][0] <= x:
                    x = max(x, taken[k][1])
                    k += 1
                here.append((x, x + cell.spans[0], cell))
                x += cell.spans[0]
            taken += [(a, b, y + c.spans[1]) for a, b, c in here if c.spans[1] > 1]
        placed.append(here)
    starts = sorted({a for row in placed for a, _, _ in row})
    at = {x: i for i, x in enumerate(starts)}
    widths = [0] * len(starts)
    wide: list[tuple[int, int, int]] = []
    for row in placed:
        for a, b, cell in row:
            i, j = at[a], bisect_left(starts, b)
            need = max((len(x) for x in cell.lines), default=0)
            if j == i + 1:
                widths[i] = max(widths[i], need)
            else:
                wide.append((i, j, need))
    for i, j, need in wide:  # the last of its columns holds what the others leave
        widths[j - 1] = max(widths[j - 1], need - sum(widths[i : j - 1]) - 2 * (j - 1 - i))
    for row in placed:
        for k in range(max((len(c.lines) for _, _, c in row), default=0)):
            parts, i = [], 0
            for a, b, cell in row:
                while i < at[a]:  # a cell of a row above stands here
                    parts.append(" " * widths[i])
                    i += 1
                j = bisect_left(starts, b)
                parts.append((cell.lines[k] if k < len(cell.lines) else "").ljust(sum(widths[i:j]) + 2 * (j - i - 1)))
                i = j
            out.append("  ".join(parts).rstrip(" "))
    return out


def lines_of(parent: Node) -> list[str]:
    """The visible lines of a node's children; cells within must have theirs."""
    page = Page()
    counters: list[list] = []  # open lists: kind, next number
    todo: list = [(c, False, parent.seen) for c in reversed(parent.children)]
    pre = 0
    while todo:
        node, leaving, seen = todo.pop()
        if isinstance(node, str):
            if seen:
                page.text(node, pre > 0)
            continue
        tag = node.tag
        if leaving:
            if tag == "pre":
                pre -= 1
            if tag in ("ul", "ol", "menu", "dir"):
                counters.pop()
            if tag == "li":
                page.line(1)
                page.marker = ""
                page.indent = node.start
            elif tag in ("dd", "blockquote"):
                page.line(1)
                page.indent = node.start
            nested = tag in ("ul", "ol", "menu", "dir") and counters
            page.line(2 if tag in SPACED and not nested else 1)
            continue
        if node.hidden:
            continue
        if tag == "br":
            if not page.now:
                page.gap = max(page.gap, 2 if page.lines else 1)
            page.line(1)
            continue
        if tag == "hr":
            page.line(2)
            continue
        if tag == "table":
            page.line(2)
            for line in table_lines(node):
                page.begin()
                page.now.append(line)
                page.line(1)
            page.line(2)
            continue
        if tag not in BLOCK:
            todo.extend((c, False, node.seen) for c in reversed(node.children))
            continue
        nested = tag in ("ul", "ol", "menu", "dir") and counters
        page.line(2 if tag in SPACED and not nested else 1)
        if tag == "pre":
            pre += 1
        if tag in ("ul", "ol", "menu", "dir"):
            counters.append([tag, node.start])
        elif tag == "li":
            marker = "- "
            if counters and counters[-1][0] == "ol":
                marker = f"{counters[-1][1]}. "
                counters[-1][1] += 1
            node.start = page.indent
            page.indent += len(marker)
            page.marker = marker
        elif tag in ("dd", "blockquote"):
            node.start = page.indent
            page.indent += 2
        todo.append((node, True, node.seen))
        todo.extend((c, False, node.seen) for c in reversed(node.children))
    return page.done()


def render(page: str) -> str:
    root = parse(page)
    cells, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in ("td", "th", "caption"):
            cells.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node) and not c.hidden)
    for cell in reversed(cells):  # inner ones first
        cell.lines = lines_of(cell)
    return "\n".join(lines_of(root))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text)."""
    taken = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def step(batch: pa.RecordBatch):
        texts = [None if h is None else render(h) for h in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])

    return map_arrow(taken, step, f"page_id {taken.dtypes[0][1]}, text string")


def op7_layout_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
