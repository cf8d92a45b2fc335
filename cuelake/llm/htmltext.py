"""Visible text of HTML pages, laid out: blocks, lists and aligned table cells.

A page is tokenised, built into a tree with the tags that authors leave out, and rendered in one walk:
what stands before a line (list marks, quote marks) is carried down to it, so the time is in
proportion to the page however deep it nests.  Depth is bounded by memory alone; beyond ``INDENT``
characters lines are not indented further, and tables within ``TABLES`` others are rendered as blocks, with all
their text.  Pages are independent: the operator is a map over them, with no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from cuelake.llm.common import slices

# Fixed values of the HTML standard, as far as layout needs them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noembed noframes iframe noscript datalist meta link object audio video canvas defs desc metadata rp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table ul caption tbody thead tfoot tr td th textarea".split())
SPACED = frozenset("p blockquote h1 h2 h3 h4 h5 h6 ul ol dl pre table figure menu dir".split())
LISTS = frozenset("ul ol menu dir".split())
TABLE_PARTS = frozenset("tbody thead tfoot tr td th caption".split())
IN_HEAD = frozenset("base link meta noscript script style template title head".split())
#: opening the first closes an open one of the second, up to an element of the third
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
#: an open paragraph ends where one of these opens
ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "textarea"}
P_BORDERS = {"td", "th", "caption", "table", "button", "object"}
CELLS = {"td", "th"}
HOLDERS = {"tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table", "tbody", "thead", "tfoot"}, "tbody": {"table"}}
HOLDERS |= {"th": HOLDERS["td"], "thead": HOLDERS["tbody"], "tfoot": HOLDERS["tbody"]}
MOST_COLUMNS, MOST_ROWS = 1000, 65534

COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>]*>", re.S)
END_TAG = re.compile(r"</([a-zA-Z][^\s/>]*)[^>]*>")
TAG = re.compile(r"<([a-zA-Z][^\s/>]*)((?:=[ \t\n\f\r]*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>")
LOOSE_TAG = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
READ = re.compile(r"hidden|style|start|span|selected|multiple|size|open", re.I)
STYLE = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)", re.I)
LONG_REFERENCE = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{7,}));?")
INTEGER = re.compile(r"[ \t\n\f\r]*([+-]?)0*([0-9]+)")
SPACES = re.compile(r"[ \t\n\f\r]+")
#: wrapping and indenting of the layout; no text depends on them
BREAK, WIDEST_COLUMN, INDENT, TABLES = "\0", 60, 40, 6


class Node:
    __slots__ = ("attributes", "children", "name", "seen", "unseen")

    def __init__(self, name: str, attributes: dict[str, str] | None = None):
        self.name, self.children, self.attributes = name, [], attributes or {}
        self.unseen, self.seen = name in UNSEEN or "hidden" in self.attributes, None
        for key, value in STYLE.findall(self.attributes.get("style", "")):
            if key.lower() == "display":
                self.unseen = self.unseen or value.lower() == "none"
            else:
                self.seen = value.lower() not in ("hidden", "collapse")

    def number(self, key: str, otherwise: int) -> int:
        """An attribute's integer; 1 where it is none or beyond 32 bits."""
        m = INTEGER.match(self.attributes.get(key, ""))
        if m is None or len(m[2]) > 10 or int(m[2]) >= 1 << 31:
            return otherwise
        return int(m[1] + m[2])


def _reference(m: re.Match) -> str:
    digits = (m[1] or m[2]).lstrip("0") or "0"
    return unescape(f"&#{'' if m[1] else 'x'}{digits};") if len(digits) < 8 else "�"


def resolved(text: str) -> str:
    """Text with its character references resolved; numbers of any length are taken."""
    if "&" not in text:
        return text
    return unescape(LONG_REFERENCE.sub(_reference, text) if "&#" in text else text)


def build(html: str) -> Node:
    """The tree of a page; text is in strings, references resolved.

    A tag whose quotes never close ends, as do all tags after it, at the next ``>``.
    """
    root = Node("html")
    stack, at, tag = [root], 0, TAG
    places: dict[str, list[int]] = {"html": [0]}  # where on the stack each name is open, outermost first

    def pop(k: int) -> None:
        for node in stack[k:]:
            places[node.name].pop()
        del stack[k:]

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        places.setdefault(node.name, []).append(len(stack))
        stack.append(node)

    def innermost(names: set[str]) -> int:
        return max((own[-1] for n in names if (own := places.get(n))), default=0)

    def close(names: set[str], borders: set[str]) -> None:
        """End all that is open from the outermost of ``names`` within the innermost border."""
        if not any(places.get(n) for n in names):
            return
        border, cut = innermost(borders - names), len(stack)
        for n in names:
            own = places.get(n, [])
            first = bisect_right(own, border)
            if first < len(own):
                cut = min(cut, own[first])
        pop(cut)

    def say(text: str) -> None:
        if stack[-1].name == "head" and text.strip():
            pop(len(stack) - 1)
        stack[-1].children.append(resolved(text))

    size, last = len(html), html.rfind(">")
    said = 0  # text from here on is still to be said
    while True:
        at = html.find("<", at)
        if at < 0 or at > last and not html.startswith("<!--", at):
            break
        kind = html[at + 1 : at + 2]
        if kind == "/":
            m = END_TAG.match(html, at) or COMMENT.match(html, at)
        elif kind in ("!", "?"):
            m = COMMENT.match(html, at)
        else:
            m = tag.match(html, at)
            if m is None and kind.isalpha() and kind.isascii():
                tag = LOOSE_TAG
                m = tag.match(html, at)
        if m is None:
            at += 1
            continue
        if at > said:
            say(html[said:at])
        at = said = m.end()
        if not m.re.groups:
            continue
        name = m[1].lower()
        if m.re is END_TAG:
            if places.get(name) and name != "html":
                k = places[name][-1]
                if name in TABLE_PARTS or k >= innermost({"table"}):
                    pop(k)
            elif name == "br":
                stack[-1].children.append(Node("br"))
            continue
        if name == "html":
            continue
        if places.get("head") and name not in IN_HEAD:
            close({"head"}, {"html"})
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in ENDS_P:
            close({"p"}, P_BORDERS)
        if name in HOLDERS and places.get("table"):  # what stands between a table's parts ends
            k = innermost(HOLDERS[name])
            if k and k >= innermost(CELLS):
                pop(k + 1)
            if name in CELLS and stack[-1].name in HOLDERS["tr"]:
                push(Node("tr"))
        attributes = {}
        if m[2] and READ.search(m[2]):
            for x in ATTRIBUTE.finditer(m[2]):
                attributes.setdefault(x[1].lower(), resolved(x[2] or x[3] or x[4] or ""))
        node = Node(name, attributes)
        if name in RAW:
            stack[-1].children.append(node)
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
            stop = end.start() if end else size
            if not node.unseen:
                node.children.append(html[at:stop] if name == "xmp" else resolved(html[at:stop]))
            at = said = html.find(">", stop) + 1 or size
        elif name in VOID:
            stack[-1].children.append(node)
        else:
            push(node)
    if said < size:
        say(html[said:])
    return root


class Writer:
    """Lines of one flow.

    A level is what stands before lines: a list item, a quotation, a definition.  A gap is a blank line that is
    still owed at a level; it is written only between lines of that level.
    """

    def __init__(self):
        self.lines: list[str] = []
        self.run: list[str] = []
        self.levels: list[list] = [["", False]]  # what stands before its lines, and whether it has any
        self.lists: list[list] = []
        self.first, self.gap, self.pre = None, None, 0

    def put(self, line: str) -> None:
        if self.gap is not None:
            self.lines.append(self.levels[self.gap][0].rstrip())
            self.gap = None
        before = self.levels[-1][0] if self.first is None else self.first
        self.lines.append(before + line if line else before.rstrip())
        self.first = None
        for level in reversed(self.levels):
            if level[1]:
                break
            level[1] = True

    def space(self) -> None:
        k = len(self.levels) - 1
        if self.levels[k][1] and (self.gap is None or k < self.gap):
            self.gap = k

    def flush(self) -> None:
        if not self.run:
            return
        text = "".join(self.run)
        self.run.clear()
        lines = text.replace(BREAK, "\n").split("\n") if self.pre else [SPACES.sub(" ", x).strip(" ") for x in text.split(BREAK)]
        low, high = 0, len(lines)
        while low < high and not lines[low].strip():
            low += 1
        while low < high and not lines[high - 1].strip():
            high -= 1
        for x in lines[low:high]:
            self.put(x)

    def enter(self, mark: str, rest: str) -> tuple:
        """Open a level whose first line has ``mark`` before it and the others ``rest``; gives what ``leave`` needs."""
        before, was = self.levels[-1][0], self.first
        if len(before) + len(rest) > INDENT:
            rest = ""
        own = before if was is None else was
        if len(own) <= 2 * INDENT:
            self.first = own + mark
        self.levels.append([before + rest, False])
        return was, mark

    def leave(self, opened: tuple) -> None:
        self.flush()
        was, mark = opened
        if not self.levels[-1][1]:
            if mark.strip() and mark != "> ":
                self.put("")
            else:
                self.first = was
        self.levels.pop()
        if self.gap is not None and self.gap >= len(self.levels):
            self.gap = None

    def done(self) -> list[str]:
        self.flush()
        return self.lines


class Grid:
    """A table: rows of (lines, columns, rows) cells, and lines that stand between rows."""

    def __init__(self):
        self.items: list = []
        self.row: list[tuple[list[str], int, int]] | None = None


def _wrapped(line: str) -> list[str]:
    """A line cut at spaces into parts within the widest column; longer words stay whole."""
    if len(line) <= WIDEST_COLUMN:
        return [line]
    out, now = [], ""
    for word in line.split(" "):
        if now and len(now) + 1 + len(word) > WIDEST_COLUMN:
            out.append(now)
            now = word
        else:
            now = f"{now} {word}" if now else word
    return [*out, now]


def _laid(items: list) -> list[str]:
    """Lines of a table: cells side by side in columns as wide as their widest line, spans observed."""
    held: dict[int, int] = {}  # columns that a cell above still takes, and for how many rows
    rows: list = []
    for item in items:
        if not isinstance(item, tuple):
            rows.append(item)
            continue
        placed, column = [], 0
        for lines, wide, deep in item[0]:
            while held.get(column):
                column += 1
            placed.append((column, wide, lines))
            for k in range(column, column + wide) if deep > 1 else ():
                held[k] = deep
            column += wide
        held = {k: n - 1 for k, n in held.items() if n > 1}
        rows.append(tuple(placed))
    columns = sorted({c for row in rows if isinstance(row, tuple) for c, _, _ in row})
    if len(columns) <= 1:
        return [x for row in rows for x in ([line for _, _, lines in row for line in lines] if isinstance(row, tuple) else row)]
    number = {c: k for k, c in enumerate(columns)}
    after = {c: number.get(c + 1, k + 1) for k, c in enumerate(columns)}
    ends = sorted(number.items())
    widths = [0] * len(columns)
    spanning = []
    out_rows = []
    for row in rows:
        if not isinstance(row, tuple):
            out_rows.append(row)
            continue
        cells = []
        for c, wide, lines in row:
            lines = [x for line in lines for x in _wrapped(line)]
            k = number[c]
            stop = after[c] if wide == 1 else next((n for x, n in ends[k:] if x >= c + wide), len(columns))
            need = max((len(x) for x in lines if len(x) <= WIDEST_COLUMN), default=0)
            if stop - k <= 1:
                widths[k] = max(widths[k], need)
            else:
                spanning.append((k, stop, need))
            cells.append((k, lines))
        out_rows.append(tuple(cells))
    for k, stop, need in spanning:
        widths[stop - 1] += max(0, need - sum(widths[k:stop]) - 2 * (stop - k - 1))
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + 2)
    out = []
    for row in out_rows:
        if not isinstance(row, tuple):
            out.extend(row)
            continue
        for n in range(max((len(lines) for _, lines in row), default=0)):
            line = ""
            for k, lines in row:
                if n < len(lines) and lines[n]:
                    line = line.ljust(starts[k]) if len(line) <= starts[k] else line + "  "
                    line += lines[n]
            out.append(line.rstrip())
    return out


def _choose(select: Node) -> None:
    """Hide the options of a drop-down list that are not the chosen one; a list box shows all, line by line."""
    options, stack = [], [select]
    while stack:
        node = stack.pop()
        for child in reversed(node.children):
            if isinstance(child, Node):
                stack.append(child)
        if node.name == "option":
            options.append(node)
    if "multiple" in select.attributes or select.number("size", 1) > 1:
        for x in options:
            x.name = "div"
        return
    chosen = [x for x in options if "selected" in x.attributes][-1:] or options[:1]
    for x in options:
        x.unseen = x.unseen or x is not chosen[0]


def render(root: Node) -> str:
    """The text of a tree in one walk with its own stack."""
    writers, grids, inside = [Writer()], [], ["flow"]
    stack: list[list] = [[root, 0, True, None]]

    def loose() -> None:
        """What was said in a table or row outside its cells becomes lines or a cell of their own."""
        lines = writers[-1].done()
        if lines:
            if inside[-1] == "row":
                grids[-1].row.append((lines, 1, 1))
            else:
                grids[-1].items.append(lines)
            writers[-1] = Writer()

    def enter(node: Node):
        """Start an element; gives what has to be done at its end."""
        what = start(node)
        if what is None or what[0] == "block":
            if inside[-1] in ("table", "row") and not (inside[-1] == "table" and node.name in HOLDERS["tr"]):
                inside.append("flow")  # said outside the cells
                return (*(what or ("inline", None)), True)
        return what and (*what, False)

    def start(node: Node):
        name, w = node.name, writers[-1]
        if name == "br":
            w.run.append(BREAK)
        elif name == "select":
            _choose(node)
        elif name == "details" and "open" not in node.attributes:
            node.children = [x for x in node.children if isinstance(x, Node) and x.name == "summary"][:1]
        if inside[-1] == "table" and name in ("tbody", "thead", "tfoot"):
            return None
        if name == "table" and len(grids) < TABLES:
            w.flush()
            w.space()
            grids.append(Grid())
            writers.append(Writer())
            inside.append("table")
            return ("table", None)
        if name == "tr" and inside[-1] == "table":
            loose()
            grids[-1].row = []
            writers.append(Writer())
            inside.append("row")
            return ("row", None)
        if name in ("td", "th") and inside[-1] == "row":
            loose()
            writers.append(Writer())
            inside.append("cell")
            return ("cell", None)
        if name not in BLOCKS:
            return None
        w.flush()
        if name in SPACED:
            w.space()
        if name == "hr":
            w.put("---")
        elif name in LISTS:
            w.lists.append([name, node.number("start", 1)])
        elif name in ("pre", "textarea"):
            w.pre += 1
        elif name == "blockquote":
            return ("block", w.enter("> ", "> "))
        elif name == "dd":
            return ("block", w.enter("  ", "  "))
        elif name == "li" and w.lists:
            kind, number = w.lists[-1]
            w.lists[-1][1] += 1
            mark = f"{number}. " if kind == "ol" else "- "
            return ("block", w.enter(mark, " " * len(mark)))
        return ("block", None)

    def leave(node: Node, what) -> None:
        kind, opened, flow = what
        if flow:
            inside.pop()
        if kind == "inline":
            return
        if kind == "block":
            w = writers[-1]
            w.flush()
            if opened is not None:
                w.leave(opened)
            if node.name in LISTS and w.lists:
                w.lists.pop()
            elif node.name in ("pre", "textarea"):
                w.pre -= 1
            if node.name in SPACED:
                w.space()
            return
        if kind == "cell":
            lines = writers.pop().done()
            inside.pop()
            wide, deep = node.number("colspan", 1), node.number("rowspan", 1)
            grids[-1].row.append((lines, min(max(1, wide), MOST_COLUMNS), min(max(1, deep), MOST_ROWS)))
            return
        loose()
        writers.pop()
        inside.pop()
        if kind == "row":
            if grids[-1].row:
                grids[-1].items.append((grids[-1].row,))
            grids[-1].row = None
            return
        lines = _laid(grids.pop().items)
        for x in lines:
            writers[-1].put(x)
        writers[-1].space()

    while stack:
        frame = stack[-1]
        node, k, seen, what = frame
        if k < len(node.children):
            frame[1] += 1
            child = node.children[k]
            if isinstance(child, str):
                if seen:
                    writers[-1].run.append(child.replace(BREAK, "�"))
            elif not child.unseen and (child.name in ("br", "hr") or child.name not in VOID):
                stack.append([child, 0, seen if child.seen is None else child.seen, enter(child)])
            continue
        stack.pop()
        if what is not None:
            leave(node, what)
    return "\n".join(writers[0].done())


def extract(html: str | None) -> str:
    return render(build(html)) if html else ""


def visible_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the visible text of each in ``out_col`` (replaced if present); null or empty pages give ''."""
    kept = pages.drop(out_col)
    at = kept.columns.index(html_col)

    def run(batches):
        for whole in batches:
            cells = whole.column(at)
            for a, b in slices(cells.to_pylist(), 8 << 20):
                part = whole.slice(a, b - a)
                texts = [extract(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*whole.schema.names, out_col])

    return kept.mapInArrow(run, kept.selectExpr("*", f"cast('' as string) `{out_col}`").schema)
