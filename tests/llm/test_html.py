"""HTML text against a plain recursive renderer, and over hostile and mutated pages."""

import random
import re
import time

import pytest

from cuelake.llm import htmltext
from cuelake.llm.htmltext import extract


def assemble(events):
    """Lines of one level from its events: text, ends of lines, owed blank lines and finished lines."""
    out, run, owed = [], [], False

    def put(lines):
        nonlocal owed
        for x in lines:
            if owed and out:
                out.append("")
            owed = False
            out.append(x)

    def flush():
        lines = [re.sub(r"\s+", " ", x).strip() for x in "".join(run).split("\n")]
        run.clear()
        while lines and not lines[0]:
            lines.pop(0)
        while lines and not lines[-1]:
            lines.pop()
        put(lines)

    for kind, value in events:
        if kind == "text":
            run.append(value)
            continue
        flush()
        if kind == "gap":
            owed = owed or bool(out)
        elif kind == "lines":
            put(value)
    flush()
    return out


def prefixed(lines, mark, rest):
    return [((mark if k == 0 else rest) + x).rstrip() for k, x in enumerate(lines)]


def plain(node):
    """Events of (name, children) trees; strings are text."""
    if isinstance(node, str):
        return [("text", node.replace("\n", " "))]
    name, children = node
    if name == "br":
        return [("text", "\n")]
    if name == "hr":
        return [("line", None), ("lines", ["---"])]
    if name == "b":
        return [e for c in children for e in plain(c)]
    if name in ("ul", "ol"):
        out = [("gap", None)]
        for k, (_, item) in enumerate(children, 1):
            mark = f"{k}. " if name == "ol" else "- "
            lines = assemble([e for c in item for e in plain(c)])
            out.append(("lines", prefixed(lines or [""], mark, " " * len(mark))))
        return [*out, ("gap", None)]
    if name == "table":
        cells = [[assemble([e for c in td for e in plain(c)]) for _, td in tr] for _, tr in children]
        widths = [max(len(x) for row in cells if k < len(row) for x in [*row[k], ""]) for k in range(max(len(row) for row in cells))]
        lines = []
        for row in cells:
            for n in range(max(len(c) for c in row)):
                lines.append("  ".join((c[n] if n < len(c) else "").ljust(w) for c, w in zip(row, widths)).rstrip())
        return [("gap", None), ("lines", lines), ("gap", None)]
    inner = [e for c in children for e in plain(c)]
    if name == "blockquote":
        return [("gap", None), ("lines", prefixed(assemble(inner), "> ", "> ")), ("gap", None)]
    edge = ("gap" if name == "p" else "line", None)
    return [edge, *inner, edge]


def tree(r, depth, inline=False):
    if inline or depth == 0 or r.random() < 0.45:
        return r.choice(["word ", " some  text", "x", "\n", ("br", []), ("b", ["bold", ("br", []), " more"])])
    name = r.choice(["p", "div", "ul", "ol", "blockquote", "table", "hr"])
    if name == "hr":
        return (name, [])
    if name in ("ul", "ol"):
        return (name, [("li", [tree(r, depth - 1) for _ in range(r.randrange(4))]) for _ in range(1, 4)])
    if name == "table":
        return (name, [("tr", [("td", ["c" + "c" * r.randrange(9), *(tree(r, 0, True) for _ in range(r.randrange(3)))]) for _ in range(r.randrange(1, 4))]) for _ in range(r.randrange(1, 4))])
    children = [tree(r, 0, True) for _ in range(r.randrange(1, 4))] if name == "p" else [tree(r, depth - 1) for _ in range(r.randrange(1, 5))]
    return (name, children)


def html(node):
    if isinstance(node, str):
        return node
    name, children = node
    return f"<{name}>" if name in ("br", "hr") else f"<{name}>{''.join(map(html, children))}</{name}>"


def test_against_a_recursive_renderer():
    r = random.Random(4)
    for _ in range(1500):
        page = [tree(r, 3) for _ in range(r.randrange(1, 6))]
        text = "".join(map(html, page))
        assert extract(text) == "\n".join(assemble([e for x in page for e in plain(x)])), text


PIECES = ["<p>", "</p>", "<ul>", "<li>", "<ol start=3>", "<ol start='--5'>", "</ul>", "<table>", "<tr>", "<td>", "<td colspan=3>", "<td rowspan=70000>", "<td colspan=99999999999999>", "</table>", "<b>", "</b>", "text", " ", "&amp;", "&#", "9" * 30, "&#x110000;", "&#0;", "<a href=\"x>y\">", "<a b='", '"', "'", "=", "<", ">", "</", "<!", "<!--", "-->", "<![CDATA[", "<script>", "</script>", "<textarea>", "</textarea>", "<select>", "<option selected>", "</select>", "<details>", "<summary>", "<pre>\n", "</pre>", "<blockquote>", "</blockquote>", "<dd>", "<svg><text>", "</svg>", "<p style='visibility:hidden'>", "<i style=visibility:visible>", "<div hidden>", "</div>", "<head>", "<body>", "<br/>", "</br>", "\0", "é", "</td>", "</tr>", "<caption>", "<tbody>", "</p", "\ud800"]


def test_mutated_pages_do_not_crash(spark):
    r = random.Random(9)
    for _ in range(10_000):
        assert isinstance(extract("".join(r.choice(PIECES) for _ in range(r.randrange(40)))), str)
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect():
        for _ in range(5):
            page = list(row.html or "")
            for _ in range(20):
                at = r.randrange(len(page) + 1)
                page[at : at + r.randrange(4)] = r.choice(PIECES)
            extract("".join(page))


HOSTILE = ["<blockquote>x", "<ul><li>x", "<table><tr><td>x", "<table><tr><td>a<td>", '<a x=">" ', "<!", "<a b='", "<a '", "<!--", "<b>", "<p>", "&#", "<td rowspan=9>x", "<div><p>", "<section><p>x", "<dl><dt>x<dd>y", "<select><option>x", "<b><p>x</b>", "<table><td><p>", "<p><span>x</div>", "<li><b>x", "</p>"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_pages_take_linear_time(piece):
    """Four times the page takes about four times as long; sixteen times would be quadratic."""
    seconds = []
    for n in (10_000, 40_000):
        began = time.process_time()
        text = extract(piece * n)
        seconds.append(time.process_time() - began)
        assert len(text) < 100 * len(piece) * n
    assert seconds[1] < 9 * max(seconds[0], 0.1)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<ol start="--5"><li>a', "1. a"),
        ("<ol start=1234567890><li>a<li>b", "1234567890. a\n1234567891. b"),
        ("<ol start=-2><li>a", "-2. a"),
        ("&#" + "9" * 5000 + ";x&#x" + "0" * 5000 + "41;", "�xA"),
        ("<img src=data:" + "A" * 30_000 + ">z", "z"),
        ("a<textarea> b\n c</textarea>d", "a\n b\n c\nd"),
        ("<select><option>a<option selected>b<optgroup><option>c</select>", "b"),
        ("<select><option>a<option>b</select>", "a"),
        ("<select multiple><option>a<option>b</select>", "a\nb"),
        ("<svg><title>n</title><desc>d</desc><text>hi</text></svg>", "hi"),
        ('<div style="visibility:hidden">a<b style="visibility: visible">yes</b></div>', "yes"),
        ("<div hidden>a<b style='visibility:visible'>no</b></div>x", "x"),
        ("<details><summary>S</summary>hidden</details><details open><summary>T</summary>shown</details>", "S\nT\nshown"),
        ("<table><tr><td colspan=2>wide cell<td>x<tr><td>a<td>b<td>c</table>", "wide cell  x\na  b       c"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>3</table>", "r  1\n   3"),
        ("<table><td>a<td>b</table>", "a  b"),
        ("<table><tr><td>" + "long " * 20 + "<td>x<tr><td>s<td>y</table>", " ".join(["long"] * 12) + "  x\n" + " ".join(["long"] * 8) + "\ns" + " " * 60 + "y"),
        ("<head><title>t</title><p>seen", "seen"),
        ("<head>text", "text"),
        ("<!-->shown<!--->too<!-- not --!>end", "showntooend"),
    ],
)
def test_rules(page, text):
    assert extract(page) == text


def test_columns_and_nulls(spark):
    pages = spark.createDataFrame([(1, None, "u"), (1, "<p>a", None), (None, "<p>a", "t")], "page_id long, html string, text string")
    assert sorted((x.page_id or 0, x.text) for x in htmltext.visible_text(pages).collect()) == [(0, "a"), (1, ""), (1, "a")]
