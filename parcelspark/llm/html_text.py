"""HTML extraction by layout-aware rendering: a small tree builder with implied tags, then a renderer of what is visible.

The builder closes elements that HTML closes by implication (paragraphs before blocks, list items, table parts, options, the
head before body content), ignores stray end tags and treats void and raw-text elements as such. The renderer emits all visible text: it
skips the head, scripts, styles, templates and elements hidden by attribute or inline style (``visibility`` is inherited and can be turned on again; rules in style sheets are not looked at), collapses white space outside
``pre``, sets blocks on lines of their own (with an empty line around paragraphs, headings, lists and tables), marks and indents list
items, and pads table cells so that columns align, cells of several rows or columns included. Both walk with explicit stacks, so depth is no limit.

Layout is bounded, text never is: indents stop at ``MOST_INDENT``, columns are padded to ``MOST_WIDTH`` at most (a longer cell is written whole and shifts what
follows on its line), a gap in a table line is ``MOST_GAP`` spaces at most, cells span columns and rows among the first ``MOST_COLUMNS`` only, and tables in more than ``MOST_NESTED`` others are written cell by cell. So output is linear in the page, and so is the time, unclosed tags and
quotes and deep nesting included.

Defined results: null and empty pages give an empty text; text without tags is rendered as it is; broken markup never fails. Rows are
independent, so an empty table gives an empty result, repeated rows repeat, and further columns stay as they are.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Comments and declarations as a whole; of a tag its beginning, up to what may be quoted.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>"'<]*)""", re.S)
SPECIAL = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
DISPLAY, VISIBILITY = (re.compile(rf"(?:^|;)\s*{name}\s*:\s*([a-z-]+)", re.I) for name in ("display", "visibility"))
SPACE = re.compile(r"[ \t\n\r\f]+")
# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes audio video canvas datalist defs desc metadata symbol title meta link".split())
HEAD = frozenset("html head title meta link base script style template noscript".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table ul xmp".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr listing ol p pre table ul menu dir fieldset".split())
ENDS_P = (BLOCK | {"table"}) - {"body", "html", "option", "optgroup", "legend", "caption"}
#: What a start tag closes, and the elements beyond which it does not look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "body": ({"head"}, set()),
}
MOST_INDENT, MOST_WIDTH, MOST_GAP, MOST_COLUMNS, MOST_NESTED = 60, 60, 200, 1000, 16
#: An end tag does not close elements outside of these.
SCOPES = frozenset({"table", "td", "th", "caption", "html", "template"})


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v[1:-1] if v[:1] in "\"'" else v) for k, v in ATTRIBUTE.findall(text)}


class TagEnds:
    """Where a tag ends: the first ``>`` that is not in quotes. Each quote and each ``>`` of a page is looked at once, however many tags are never closed."""

    def __init__(self, page: str):
        self.page, self.places = page, [m.start() for m in SPECIAL.finditer(page)]
        self.last = {c: page.rfind(c) for c in "\"'"}
        self.known: dict[int, int] = {}

    def find(self, at: int) -> int:
        """Its place, or -1."""
        path, end = [], -1
        while True:
            i = bisect_left(self.places, at)
            if i == len(self.places):
                break
            s = self.places[i]
            if s in self.known:
                end = self.known[s]
                break
            path.append(s)
            c = self.page[s]
            if c == ">":
                end = s
                break
            if s >= self.last[c]:
                break
            at = self.page.find(c, s + 1) + 1
        self.known.update(dict.fromkeys(path, end))
        return end


def build(page: str) -> Node:
    """The tree of a page; text children are strings, already unescaped. Time is in proportion to the page: where the open elements of each name are is kept, so none are searched for."""
    root = Node("#root")
    stack, at, end = [root], 0, len(page)
    opened: defaultdict[str, list[int]] = defaultdict(list)
    ends = TagEnds(page)

    def pop_to(i: int) -> None:
        while len(stack) > i:
            opened[stack.pop().tag].pop()

    def push(node: Node) -> None:
        opened[node.tag].append(len(stack))
        stack.append(node)

    def nearest(tags) -> int:
        """The place of the innermost open element of these; 0 if there is none."""
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def close(tags: set, stop: set) -> None:
        while (i := nearest(tags)) > nearest(stop):
            pop_to(i)

    def text(raw: str) -> None:
        if raw:
            if len(stack) > 1 and stack[-1].tag == "head" and raw.strip():
                pop_to(len(stack) - 1)
            stack[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    while at < end:
        found = TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        name, attrs = found[2], ""
        if name:
            close_at = ends.find(found.end())
            if close_at < 0:  # no tag, but text
                text(page[at: found.end()])
                at = found.end()
                continue
            attrs = page[found.end(): close_at]
        text(page[at: found.start()])
        at = close_at + 1 if name else found.end()
        if not name:
            continue
        name = name.lower()
        if found[1]:
            if name == "br":
                stack[-1].children.append(Node("br"))
                continue
            i = nearest((name,))
            if i and (name in ("table", "html", "body", "tr", "tbody", "thead", "tfoot") or i >= nearest(SCOPES)):
                pop_to(i)
            continue
        if name not in HEAD and stack[-1].tag == "head":
            pop_to(len(stack) - 1)
        if name in ENDS_P:
            close({"p"}, {"table", "td", "th", "button", "object", "#root"})
        if name in CLOSES:
            close(*CLOSES[name])
        if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            stack[-1].children.append(Node("tr"))
            push(stack[-1].children[-1])
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in VOID or attrs.endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            if name in ("textarea", "xmp"):
                inside = page[at: stop.start() if stop else end]
                node.children.append(html.unescape(inside) if name == "textarea" else inside)
            at = stop.end() if stop else end
            continue
        push(node)
    return root


def unseen(node: Node) -> bool:
    if node.tag in UNSEEN:
        return True
    if not node.attrs or node.attrs == "/":
        return node.tag == "dialog"
    low = node.attrs.lower()
    if "hidden" in low or "display" in low or "dialog" == node.tag:
        found = attributes(node.attrs)
        return "hidden" in found and found["hidden"].lower() != "until-found" or DISPLAY.findall(found.get("style", ""))[-1:] == ["none"] \
            or node.tag == "dialog" and "open" not in found
    return False


def visible(node: Node, inherited: bool) -> bool:
    """Whether the element's own text is seen: ``visibility`` is inherited, and can be turned on again further in."""
    if not node.attrs or "visibility" not in node.attrs.lower():
        return inherited
    said = [v.lower() for v in VISIBILITY.findall(attributes(node.attrs).get("style", "")) if v.lower() in ("visible", "hidden", "collapse")]
    return said[-1] == "visible" if said else inherited


class Flow:
    """Lines of a block context: the page, or a table cell."""

    def __init__(self):
        self.lines, self.line, self.gap, self.indent, self.marker = [], [], 0, 0, ""

    def words(self, text: str) -> None:
        text = SPACE.sub(" ", text)
        if not self.line or self.line[-1].endswith((" ", "\n")):
            text = text.lstrip(" ")
        if text:
            self.line.append(text)

    def flush(self, always: bool = False) -> None:
        body = "".join(self.line).rstrip(" ")
        self.line = []
        if not body and not always:
            return
        if self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        lead = " " * min(MOST_INDENT, self.indent - len(self.marker)) + self.marker
        self.marker = ""
        self.lines.append((lead + body).rstrip())

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)


def span(text: str | None, most: int) -> int:
    return max(1, min(int(text), most)) if text and re.fullmatch(r"\d{1,5}", text.strip()) else 1


def placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, list[str]]]]:
    """The column of each cell (lines, columns, rows), past the columns that cells of rows above reach down into."""
    until: dict[int, tuple[int, int]] = {}  # column: (first row below the cell that takes it, the cell's columns)
    out = []
    for r, row in enumerate(rows):
        at, cells = 0, []
        for lines, across, down in row:
            while at < MOST_COLUMNS and at in until and until[at][0] > r:
                at += 1
            cells.append((at, lines))
            if down > 1:
                for k in range(at, min(at + across, MOST_COLUMNS)):
                    until[k] = (r + down, across)
            at += across if at < MOST_COLUMNS else 1
        out.append(cells)
    return out


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table. A cell that spans columns widens none of them."""
    grid = placed(rows)
    widths: dict[int, int] = {}
    for cells, row in zip(grid, rows):
        for (at, lines), (_, across, _) in zip(cells, row):
            wide = min(MOST_WIDTH, max(map(len, lines), default=0)) if across == 1 else 0
            widths[at] = max(wide, widths.get(at, 0))
    starts, at = {}, 0
    for k in sorted(widths):
        starts[k] = at
        at += widths[k] + 2
    out = []
    for cells in grid:
        tall = [c for c in cells if c[1]]
        k = 0
        while tall:
            parts, held = [], 0
            for at, lines in tall:
                if lines[k]:
                    gap = starts[at] - held
                    if parts or gap > 0:
                        gap = min(MOST_GAP, max(gap, 2 if parts else 0))
                        parts.append(" " * gap)
                        held += gap
                    parts.append(lines[k])
                    held = max(held + len(lines[k]), starts[at] + min(len(lines[k]), MOST_WIDTH))
            out.append("".join(parts).rstrip())
            k += 1
            tall = [c for c in tall if len(c[1]) > k]
    return out


def render(page: str) -> str:
    flows, tables, lists = [Flow()], [], []
    walk: list[tuple[Node | str, bool, int, bool]] = [(build(page), True, 0, True)]
    while walk:
        node, enter, pre, seen = walk.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not seen:
                continue
            if tables and tables[-1] is not None and len(flows) == tables[-1]["depth"]:
                if not node.strip():
                    continue  # white space between cells
            if pre:
                first, *more = node.replace("\r\n", "\n").split("\n")
                flow.line.append(first)
                for part in more:
                    flow.flush(True)
                    flow.line.append(part)
            else:
                flow.words(node)
            continue
        tag = node.tag
        if enter:
            if unseen(node):
                continue
            seen = visible(node, seen)
            if tag == "br":
                flow.flush(True)
                continue
            if tag in ("pre", "xmp"):
                pre = 1
                if node.children and isinstance(node.children[0], str) and node.children[0][:1] == "\n":
                    node.children[0] = node.children[0][1:]
            if tag in BLOCK:
                flow.block(1 if tag in SPACED and not (lists and tag in ("ul", "ol", "menu", "dir")) else 0)
            if tag in ("ul", "ol", "menu", "dir"):
                start = attributes(node.attrs).get("start", "1") if tag == "ol" and node.attrs else "1"
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                marker = "- "
                if lists and lists[-1][0] == "ol":
                    marker = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                flow.indent += len(marker)
                flow.marker = marker if seen else ""
                node.attrs = len(marker)
            elif tag in ("blockquote", "dd"):
                flow.indent += 2
            elif tag == "table":
                tables.append({"rows": [], "depth": len(flows)} if len(tables) < MOST_NESTED else None)
            elif tag in ("tr", "td", "th") and tables and tables[-1] is None:
                flow.block(0)
            elif tag == "tr" and tables:
                tables[-1]["rows"].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]["rows"]:
                    tables[-1]["rows"].append([])
                flows.append(Flow())
            walk.append((node, False, pre, seen))
            walk.extend((c, True, pre, seen) for c in reversed(node.children))
            continue
        if tag in ("td", "th") and tables and tables[-1] is not None and len(flows) > tables[-1]["depth"]:
            cell = flows.pop()
            cell.flush()
            found = attributes(node.attrs) if "span" in node.attrs.lower() else {}
            tables[-1]["rows"][-1].append((cell.lines, span(found.get("colspan"), MOST_COLUMNS), span(found.get("rowspan"), 65534)))
            continue
        if tag == "table":
            done = tables.pop()
            flow.flush()
            for line in aligned(done["rows"]) if done else ():
                flow.line.append(line)
                flow.flush()
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.flush()
            lists.pop()
        elif tag == "li":
            flow.flush()
            flow.indent, flow.marker = flow.indent - node.attrs, ""
        elif tag in ("blockquote", "dd"):
            flow.flush()
            flow.indent -= 2
        if tag in BLOCK:
            flow.block(1 if tag in SPACED and not (lists and tag in ("ul", "ol", "menu", "dir")) else 0)
        elif tag == "caption":
            flow.block(0)
    flows[0].flush()
    return "\n".join(flows[0].lines).strip("\n")


def _render_all(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series(["" if p is None else render(p) for p in batch], dtype=object)


def rendered(column: str) -> Column:
    """Visible text of a column of pages."""
    return F.pandas_udf(_render_all, T.StringType())(F.col(column))
