"""HTML extraction by layout-aware rendering.

A tree is built with the tags that HTML lets authors leave out (ends of paragraphs, items, cells and
rows, and what an end tag closes on its way); rules of visibility drop what a browser does not show; the
rest is written as text: white space collapsed as in a browser, blocks on lines of their own, paragraphs,
lists, tables and headings apart by an empty line, items marked and indented, table cells aligned in
columns, the lines of a cell (its paragraphs, lists and preformatted text) below each other, preformatted text as it is. All visible text is kept, navigation and footers too.

Defined cases: a null or empty page gives ''; markup that never closes is closed at the end; a '<' that
opens no tag is text; deep nesting needs no recursion; equal pages give equal texts; a very
long page is rendered whole, in one task; an empty table gives an empty result; a column of the
input named like a result is replaced."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm.texts import per_row

_token = re.compile(
    r"""<!--(?:.*?)(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^"'>])*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.DOTALL
)
_attribute = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_space = re.compile(r"[ \t\n\r\f\v]+")
_hidden_style = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_visibility = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)
#: A table whose columns would take more than so many spaces for each of its own characters, or that lies in so many others, is written with two spaces
#: between cells; an indent has so many characters at most. So a text is at most some tens of times as long as its page.
MOST_SPACES, MOST_TABLES, MOST_INDENT = 8, 3, 40

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements that are never shown as text.
HIDDEN = frozenset("head script style template noscript title meta link base iframe object embed audio video canvas svg datalist noembed noframes param source track map".split())
#: Elements on lines of their own; those with an empty line before and after.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu dir".split())
BLOCK = APART | frozenset("html body address article aside center dd details dialog div dt fieldset figcaption footer form header hgroup legend li main nav optgroup option search section summary caption thead tbody tfoot tr".split())
#: Starts that end an open paragraph.
ENDS_P = (APART | frozenset("address article aside center details dialog dir div dl fieldset figcaption footer form header hgroup main menu nav search section summary li dd dt".split())) - {"dir"}
#: For a start, the open elements that it ends, and those beyond which it does not look.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
#: An end tag of other elements does not close these.
SCOPE = frozenset(("table", "td", "th", "caption", "template", "html"))
_table_parts = frozenset("table tbody thead tfoot tr td th caption".split())


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        """An attribute's value; '' if it has none; None if it isn't there."""
        if name not in self.attributes.lower():
            return None
        for m in _attribute.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape((m[2] or "").strip("\"'"))
        return None

    def number(self, name: str) -> int:
        value = self.get(name) or ""
        return max(1, min(1000, int(value))) if value.isdigit() else 1

    def shown(self) -> bool:
        if self.tag in HIDDEN:
            return False
        if not self.attributes:
            return True
        if self.get("hidden") is not None or self.tag == "input":
            return False
        style = self.get("style")
        return not (style and _hidden_style.search(style))

    def seen(self, above: bool) -> bool:
        """Whether text in this element can be seen: visibility is handed down until an element below sets it again."""
        style = self.get("style") if self.attributes else None
        found = _visibility.findall(style) if style else None
        return found[-1].lower() == "visible" if found else above

    def parts(self) -> list[Node | str]:
        """The children that are shown: of a closed details element its summary alone."""
        if self.tag != "details" or self.get("open") is not None:
            return self.children
        return [c for c in self.children if not isinstance(c, str) and c.tag == "summary"][:1]


def tree(page: str) -> Node:
    """The page's elements and texts (str) below a root node."""
    root = Node("#root")
    stack, at = [root], 0
    opened: Counter[str] = Counter()  # open elements by tag, so that what isn't open is not looked for
    find = _token.search

    def cut(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    def text(value: str) -> None:
        if value:
            stack[-1].children.append(html.unescape(value) if "&" in value else value)

    def close(tags: set[str], stops: set[str] | frozenset[str]) -> None:
        """Ends the outermost open element of these tags within the nearest stop, and all that is open in it."""
        if not any(map(opened.__getitem__, tags)):
            return
        last = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                last = i
            if stack[i].tag in stops or stack[i].tag == "table":
                break
        if last:
            cut(last)

    while m := find(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                stack[-1].children.append(Node("br"))
                continue
            stops = {"table"} if tag in _table_parts else SCOPE
            if not opened[tag]:
                if tag == "p":
                    stack[-1].children.append(Node("p"))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    cut(i)
                    break
                if stack[i].tag in stops:
                    break
            continue
        name = m[2] or m[4]
        if not name:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:-3]))
            continue
        tag, attributes = name.lower(), (m[3] if m[2] else m[5]) or ""
        if tag in ENDS_P:
            close({"p"}, {"td", "th", "caption", "button"})
        if tag in IMPLIED_ENDS:
            close(*IMPLIED_ENDS[tag])
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*>", re.IGNORECASE).search(page, at) if tag != "plaintext" else None
            content, at = (page[at : end.start()], end.end()) if end else (page[at:], len(page))
            if content:
                node.children.append(html.unescape(content) if tag in ("textarea", "title") else content)
        elif tag not in VOID and not (tag in ("svg", "math") and attributes.rstrip().endswith("/")):
            stack.append(node)
            opened[tag] += 1
    text(page[at:])
    return root


class Flow:
    """Lines of text in the making."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.space = False
        self.indent = ""
        self.mark = ""

    def words(self, value: str) -> None:
        squeezed = _space.sub(" ", value)
        if squeezed == " " or not squeezed:
            self.space = self.space or bool(squeezed)
            return
        if squeezed[0] == " ":
            self.space = True
        if not self.now:
            self.begin()
        elif self.space:
            self.now.append(" ")
        self.space = squeezed[-1] == " "
        self.now.append(squeezed.strip(" "))

    def begin(self) -> None:
        if self.lines and self.gap > 1:
            self.lines.append("")
        self.gap = 0
        self.now.append(self.indent + self.mark)
        if self.mark:
            self.indent = (self.indent + " " * len(self.mark))[:MOST_INDENT]
            self.mark = ""

    def end_line(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
            self.gap = 1
        self.space = False

    def apart(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def as_is(self, value: str) -> None:
        rows = value.split("\n")
        for i, row in enumerate(rows):
            if row or self.now:
                if not self.now:
                    self.begin()
                self.now.append(row.rstrip("\r"))
            if i < len(rows) - 1:
                if self.now:
                    self.end_line()
                elif self.lines:
                    self.lines.append("")
        self.space = False

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, list[str], bool]]]:
    """For each row its cells (column, lines, whether the cell is one column wide), where spans of cells above and before let them stand.

    What a row takes of later rows is kept as ranges of columns with the last row they reach, so that a span costs the same whatever its size."""
    below: list[tuple[int, int, int]] = []  # first and last column, last row
    out = []
    for r, row in enumerate(rows):
        below = [x for x in below if x[2] >= r]
        taken, cells, c, new, i = sorted(x[:2] for x in below), [], 0, [], 0
        for lines, wide, high in row:
            while i < len(taken) and taken[i][0] <= c:
                c = max(c, taken[i][1] + 1)
                i += 1
            cells.append((c, lines, wide == 1))
            if high > 1:
                new.append((c, c + wide - 1, r + high - 1))
            c += wide
        below += new
        out.append(cells)
    return out


def aligned(rows: list[list[tuple[list[str], int, int]]], inside: int = 0) -> list[str]:
    """Lines of a table from rows of (lines, columns, rows) cells; inside: how many tables it lies in. Columns are as wide as their widest cell of one
    column; a row is as high as its highest cell, and the lines of a cell stay below each other. See MOST_SPACES for tables that this would blow up."""
    grid = placed(rows)
    widths: dict[int, int] = {}
    for cells in grid:
        for c, lines, single in cells:
            if single:
                widths[c] = max(widths.get(c, 0), max(map(len, lines), default=0))
    starts, at = {}, 0
    columns = sorted({c for cells in grid for c, _, _ in cells})
    for c in columns:
        starts[c] = at
        at += widths.get(c, 0) + (2 if widths.get(c, 0) else 0)
    # where the last cell of each line begins, against what the table says
    spaces = sum(max((starts[c] for c, lines, _ in cells if k < len(lines) and lines[k]), default=0) for cells in grid for k in range(max((len(lines) for _, lines, _ in cells), default=0)))
    letters = sum(len("".join(line.split())) for cells in grid for _, lines, _ in cells for line in lines)
    if inside >= MOST_TABLES or spaces > MOST_SPACES * letters:
        starts = dict.fromkeys(starts, 0)
    out = []
    for cells in grid:
        for k in range(max((len(lines) for _, lines, _ in cells), default=0)):
            line = ""
            for c, lines, _ in cells:
                if k < len(lines) and lines[k]:
                    line = (line.rstrip() + "  ").ljust(starts[c]) if line.strip() and len(line) > starts[c] else line.ljust(starts[c])
                    line += lines[k]
            out.append(line.rstrip())
    return out


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    flows = [Flow()]
    lists: list[list] = []  # kind, number of the next item, indent outside
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    work: list[tuple[str, Node | str]] = [("in", tree(page))]
    pre, seen = 0, [True]
    while work:
        step, node = work.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if seen[-1]:
                flow.as_is(node) if pre else flow.words(node)
            continue
        tag = node.tag
        if step == "in":
            if not node.shown():
                continue
            if tag == "br":
                if flow.now:
                    flow.end_line()
                elif flow.lines:
                    flow.gap = max(flow.gap, 2)
                continue
            if tag in BLOCK:
                flow.apart(2 if tag in APART and not (tag in ("ul", "ol") and lists) else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append(["ol" if tag == "ol" else "ul", node.number("start"), flow.indent])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1, flow.indent]
                flow.indent = kind[2]
                flow.mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
            elif tag in ("dd", "blockquote"):
                lists.append(["in", 0, flow.indent])
                flow.indent = (flow.indent + "  ")[:MOST_INDENT]
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                flows.append(Flow())
            elif tag == "pre":
                pre += 1
            seen.append(node.seen(seen[-1]))
            work.append(("out", node))
            work.extend(("in", child) for child in reversed(node.parts()))
            continue
        seen.pop()
        if tag in ("td", "th") and tables and len(flows) > 1:
            value = flows.pop().text()
            tables[-1][-1].append((value.split("\n") if value else [], node.number("colspan"), node.number("rowspan")))
            continue
        if tag == "table" and tables:
            rows = tables.pop()
            for line in aligned(rows, len(tables)):
                if line:
                    flow.as_is(line)
                    flow.end_line()
                elif flow.lines:
                    flow.lines.append("")
        if tag in ("ul", "ol", "menu", "dir", "dd", "blockquote") and lists:
            flow.end_line()
            flow.indent = lists.pop()[2]
        if tag == "li":
            flow.end_line()
            flow.mark = ""
            flow.indent = lists[-1][2] if lists else ""
        if tag == "pre":
            pre -= 1
        if tag in BLOCK:
            flow.apart(2 if tag in APART and not (tag in ("ul", "ol") and lists) else 1)
    while len(flows) > 1:
        last = flows.pop().text()
        flows[-1].as_is(last)
    return flows[0].text()


def extracted(pages: DataFrame, columns: list[str] | None = None, source: str = "html") -> DataFrame:
    """Columns of pages (default: all but the page itself), visible_text, n_chars and n_lines for each row; one pass without a shuffle."""
    results = [T.StructField("visible_text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_lines", T.LongType())]
    columns = [c for c in (pages.columns if columns is None else columns) if c != source]

    def maker():
        def make(found: pa.Array) -> list[pa.Array]:
            texts = [render(page) for page in found.to_pylist()]
            return [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())]

        return make

    return per_row(pages, columns, source, results, maker)
