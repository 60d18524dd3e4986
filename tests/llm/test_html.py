"""Main text of pages: planted layouts, broken markup, and the tables' pages against their known form."""

import html as escapes
import re

import numpy as np
import pytest

from tracewell.llm import html, queries
from tracewell.llm.shared import table

P = "Plain words of an article that goes on for a while, with a comma and a full stop at its end."
MENU = '<ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li><li><a href="/c">Three</a></li></ul>'
PAGES = {
    "article": (f"<nav>{MENU}</nav><div class=ad>Buy now {P}</div><article><h1>T</h1><p>{P}<p>Short.</p></article><footer>{P}</footer>", ["T", P, "Short."]),
    "comments": (f"<main><h1>T</h1><p>{P}</p><section id=comments><article class=comment><p>{P * 5}</p></article></section></main>", ["T", P]),
    "form around all": (f"<form id=page><header><h1>Site</h1></header><main><h1>T</h1><p>{P}</p><form>Search <input></form></main></form>", ["T", P]),
    "layout words": (f'<body class=has-sidebar><div class="content with-sidebar"><h1>T</h1><p>{P}</p><p>{P}</p></div><div class=sidebar><p>{P}</p></div></body>', ["T", P, P]),
    "no marks": (f"<div><div>{MENU}</div><h1>T</h1><div><p>{P}</p><p>{P}</p><p>x</p></div></div>", ["T", P, P, "x"]),
    "table": (f"<table><tr><td><a href=a>a</a><br><a href=b>b</a></td><td><h1>T</h1>{P}<p>{P}</td></tr></table>", ["T", P, P]),
    "article header": (f"<article><header><h1>T</h1><div>menu</div></header><p>{P}</p><aside>{P}</aside><div class=cookie-notice>{P}</div><p>End</p></article>", ["T", P, "End"]),
    "characters": ("<article><p>a &amp;&lt;b&gt; &eacute; &#233;\n\t c\xa0&nbsp;d<br>e <b>f</b>g</p></article>", ["a &<b> é é c d e fg"]),
    "scripts": ("<article><script>var a = '<p>no</p>';</script><style>p{}</style><p>yes<!-- no --></p><textarea>no</textarea></article>", ["yes"]),
    "inline advert": ('<article><p>before <span class="ad">buy <span>this</span></span> after</p></article>', ["before after"]),
    "broken": ("<![odd <p>a<![if x]>b</p><p>c</b></i></td> d<a href=", ["ab", "c d"]),
    "hidden": (f"<article><p hidden>no</p><p style='display: none'>no</p><p>{P}</p></article>", [P]),
    "plain": ("just  text", ["just text"]),
    "links only": ("<p><a href=a>only a link</a></p>", ["only a link"]),
    "all marked": (f"<div class=comment><p>{P}</p></div>", [P]),
    "empty": ("<html><body></body></html>", []),
    "two articles": (f"<main><article><h1>T</h1><p>{P}</p><p>{P}</p></article><article class=related><p>{P}</p></article></main>", ["T", P, P]),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    page, blocks = PAGES[name]
    assert html.main_text(page) == "\n\n".join(blocks)


def test_deep_and_long_pages():
    assert html.main_text("<div>" * 20_000 + P) == P
    assert html.main_text("<b><i>" * 20_000 + P) == P
    assert html.main_text("<p>" + "w " * 1_000_000) == ("w " * 1_000_000).strip()
    assert len(html.main_text("<article>" + f"<p>{P}" * 20_000).split("\n\n")) == 20_000


def test_smoothing():
    values = np.array([0.0, 0, 9, 0, 0, 0, 4])
    window = np.exp(-np.array([4, 1, 0, 1, 4]) / 2)
    want = [sum(window[j - k + 2] * values[j] for j in range(max(0, k - 2), min(7, k + 3))) / sum(window[j - k + 2] for j in range(max(0, k - 2), min(7, k + 3))) for k in range(7)]
    assert np.allclose(html.smoothed(values), want)
    assert html.content_lines(values, np.ones(7, bool)).tolist() == [False, False, True, False, False, False, True]


def test_tables_of_pages(spark):
    assert html.extract_pages(spark.createDataFrame([], "page_id long, html string")).collect() == []
    rows = [(1, None, "a", 5), (1, None, "a", 5), (None, PAGES["article"][0], None, None), (2, "", "b", 6)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, `c0` long")
    got = html.extract_pages(df)
    assert got.columns == ["page_id", "c0", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 5, ""), (1, 5, ""), (None, None, "\n\n".join(PAGES["article"][1])), (2, 6, "")], key=str)


def test_query_on_known_form(spark, sf_dir):
    def blocks(page):
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = [re.sub("<[^>]*>", " ", re.sub("</?b>", "", p)) for p in re.split("</?(?:p|h1)>", inner)]
        return "\n\n".join(t for t in (" ".join(escapes.unescape(p).split()) for p in parts) if t)

    want = {r["page_id"]: (r["url"], blocks(r["html"])) for r in table(spark, sf_dir, "pages").collect()}
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.op13_html_extraction(spark, sf_dir).collect()}
    assert got == {k: (u, t, len(t)) for k, (u, t) in want.items()}
