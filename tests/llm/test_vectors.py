"""Embedding near-dedup, exact top-k and HTML text against brute force and hand-made pages."""

import random
from collections import Counter

import numpy as np
import pytest

from cuelake.llm import htmltext, nndescent, topk
from tests.llm.test_first import components

ODD = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15]


def test_nndescent_against_all_pairs(spark):
    r = np.random.default_rng(4)
    rows = []
    for group in range(60):
        base = r.standard_normal(16)
        for _ in range([1, 2, 3, 30][group % 4]):
            rows.append((base + r.standard_normal(16) * 0.03 * r.integers(0, 4)).astype(np.float32).tolist())
    rows += rows[:7]
    data = [(i, v, i % 3 if i % 11 else None) for i, v in enumerate(rows)] + [(5000 + i, v, 1) for i, v in enumerate(ODD)] + [(9000, rows[5], None), (9001, [1.0, 2.0], 1), (3, rows[3], 0)]
    got = nndescent.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()
    usable = [(i, np.array(v, np.float64), k) for i, v, k in data if v and k is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, degree = [], Counter()
    for a in range(len(usable)):
        for b in range(a):
            (i, x, k), (j, y, m) = usable[a], usable[b]
            if k == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links.append((i, j))
                degree[a] += 1
                degree[b] += 1
    want = components({i for i, _, _ in data}, links)
    assert Counter(x.vec_id for x in got) == Counter(i for i, _, _ in data)
    assert all(x.component_id == want[x.vec_id] and x.kept == (x.vec_id == want[x.vec_id]) for x in got)
    assert sorted((x.vec_id, x.n_links) for x in got) == sorted([(i, degree[a]) for a, (i, _, _) in enumerate(usable)] + [(i, 0) for i, v, k in data if not any(v is u[1] or (u[0] == i and u[2] == k) for u in usable)])
    assert nndescent.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_saturated_component_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "COMPONENT_BLOCK", 20)
    r = np.random.default_rng(6)
    base = r.standard_normal(32)
    data = [(i, (base + 0.02 * r.standard_normal(32)).tolist(), 1) for i in range(90)] + [(100 + i, r.standard_normal(32).tolist(), 1) for i in range(50)]
    got = {x.vec_id: x for x in nndescent.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i].n_links == 89 and got[i].component_id == 0 for i in range(90))
    assert all(got[100 + i].n_links == 0 and got[100 + i].kept for i in range(50))


def test_topk_against_all_products(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.standard_normal(16) * r.choice([0.05, 0.2, 1, 3])).tolist()) for i in range(900)]
    rows += [(1000 + i, v) for i, v in enumerate(ODD)] + [(2000, rows[3][1]), (2001, rows[3][1]), (2002, [1.0, 2.0]), (2020, [1.0, 2.0]), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as score")
    vectors = topk.integer_vectors(frame)
    got = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, bucket=64, block=16).collect()
    good = [(i, np.floor(64 * np.array(v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in good:
        if i % 20 == 0:
            scores = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))
            want += [(i, n, j, -s) for n, (s, j) in enumerate(scores[:20], 1)]
    assert sorted(tuple(x) for x in got) == sorted(want)
    assert topk.top_k(vectors.where("false"), vectors.where("false")).count() == 0


def test_topk_of_large_values_and_repeated_rows(spark):
    """Scores beyond 2**53 are exact, repeated rows count each, and scores beyond 64 bits are an error."""
    r = random.Random(3)
    rows = [(i, [r.randrange(-(1 << 30), 1 << 30) / 64.0 for _ in range(6)]) for i in range(150)]
    rows += [rows[7], (300, rows[7][1]), (20, rows[9][1])]
    frame = spark.createDataFrame([(i, v, 1, b"x") for i, v in rows], "vec_id long, embedding array<double>, dims int, vec binary")
    vectors = topk.integer_vectors(frame)
    got = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=5, bucket=32, block=4).collect()
    whole = [(i, [int(x * 64) for x in v]) for i, v in rows]
    want = []
    for i in {i for i, _ in whole if i % 20 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for h, q in whole if h == i for j, v in whole if j != i)
        want += [(i, n, j, -s) for n, (s, j) in enumerate(scores[:5], 1)]
    assert sorted(tuple(x) for x in got) == sorted(want)
    huge = topk.integer_vectors(spark.createDataFrame([(0, [1e15]), (1, [1e15])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(huge, huge).collect()


def test_html_layout():
    page = "<title>no</title><p>One<p>Two <b>bold</b>\n text<br>next<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><th>Name<th>Age<tr><td>Bo<td>3<tr><td>Longer name<td>44</table>tail<div style='display: none'>x</div><ol start=3><li>q<li>w</ol><pre> a\n  b</pre>&amp;&copy;<script>var a='</p>';</script><hr><blockquote>q<p>r</blockquote><dl><dt>t<dd>d</dl>"
    want = ["One", "", "Two bold text", "next", "", "- a", "- b", "", "  - c", "", "Name         Age", "Bo           3", "Longer name  44", "", "tail", "", "3. q", "4. w", "", " a", "  b", "", "&©", "---", "", "> q", ">", "> r", "", "t", "  d"]
    assert htmltext.extract(page).split("\n") == want


def test_html_edges(spark):
    assert htmltext.extract(None) == htmltext.extract("") == htmltext.extract("<!-- only --><script>x</script>") == ""
    assert htmltext.extract("a < b > c") == "a < b > c"
    assert "z" in htmltext.extract('<a href="x>y <b>z') and htmltext.extract("<p hidden>a</p>b<input value=x>") == "b"
    assert htmltext.extract("<div>" * 30_000 + "x" + "<b>" * 30_000 + "y").split() == ["xy"]
    assert htmltext.extract("<table><thead><tr><td>a<td>b</thead><tbody><tr><td>cc<td>d</tbody></table>") == "a   b\ncc  d"
    assert htmltext.extract("<table><tr><td>one<br>two<td>x</table>") == "one  x\ntwo"
    assert htmltext.extract("<li>loose<li>items") .split() == ["loose", "items"]
    pages = spark.createDataFrame([(1, None, "u"), (1, "<p>a", None), (None, "<p>a", "t")], "page_id long, html string, text string")
    assert sorted((x.page_id or 0, x.text) for x in htmltext.visible_text(pages).collect()) == [(0, "a"), (1, ""), (1, "a")]
    assert htmltext.visible_text(pages.where("false")).count() == 0
    seen = htmltext.visible_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()
    assert all("track(" not in x.text and "<p" not in x.text and x.text for x in seen)
