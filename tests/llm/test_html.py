import re
import time
from html import unescape

import pytest

from claimworks.llm import html

PROSE = "It was, as they say, a long and winding road, and nobody knew where it led. "


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<html><body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>a\n  b<p>c</article><footer>f</footer></body></html>", "T & U\na b\nc"),
        ("<body><article><h1>x</h1><p><b>one<br><p>two</p></article>", "x\none\ntwo"),
        ('<body><div class="ad">buy</div><script>var t="</p><p>no</p>";</script><article><p>yes</article>', "yes"),
        ("<body><article><!-- <p>no</p> --><p>yes <a href='x>y'>l</a>&nbsp;&lt;b&gt;</p></article>", "yes l <b>"),
        (f"<body><header><h2>Site</h2></header><div id=content><p>{PROSE * 3}</p><p>short</p><ul><li>i<li>j</ul></div><div id=sidebar><p>{PROSE}</p></div>", f"{PROSE * 3}".strip() + "\nshort\ni\nj"),
        (f"<body><main><h1>H</h1><div class='post-body'><p>{PROSE}</p></div><section id='comments'><p>{PROSE * 5}</p></section></main>", f"H\n{PROSE.strip()}"),
        (f"<body><div class=wrap-with-sidebar><article><p>{PROSE}</p><aside>no</aside><form>no<input></form></article></div>", PROSE.strip()),
        (f"<div class='cookie-notice'>{PROSE}</div><div><p>{PROSE}</p></div>", PROSE.strip()),
        ("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        ("<article><p>a < b and 'c' > d</p></article>", "a < b and 'c' > d"),
        ("<article><p>Let <math>x</math> be <svg><text>y</text></svg></p><noscript>z</noscript></article>", "Let x be y\nz"),
        (f"<article><p class='header'>Intro</p><p class=related>{PROSE}</p><h2 class=social>T</h2><div class=share>no</div></article>", f"Intro\n{PROSE.strip()}\nT"),
        (f"<div class=x><p>{PROSE * 3}<p>{PROSE * 2}</div><div class=y><p>{PROSE[:20]}</div>", f"{(PROSE * 3).strip()}\n{(PROSE * 2).strip()}"),
        (f"<table><tr><td><a href=/>{PROSE}</a><a href=/>{PROSE}</a></td><td><p>{PROSE * 4}</p>tail</td></tr></table>", f"{(PROSE * 4).strip()}\ntail"),
        (f"<div><ul><li><a href=/>{PROSE}</a><li><a href=/>{PROSE}</a></ul></div><div><div><p>{PROSE}</p></div></div>", PROSE.strip()),
        ("<p>1 < 2 <a href='", "1 < 2 <a href='"),
        ("<p>x</p><select><option>a</select><p>y <textarea>b</textarea></p>", "x\ny"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("unit", ["<a ", "<div>x", "<a b='", "<li>x</li>", "<span hidden><p></p>", "<td>x", "<!-", "</", "<script>", "&amp", "<p>x", "<span hidden>", '<div class="ad">', "<b>x</b>"])
def test_long_pages_take_linear_time(unit):
    page = "<div>" * 20_000 + unit * ((1 << 20) // len(unit))
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 6  # a quadratic scan takes hours


def test_points_decide(monkeypatch):
    page = f"<article><p>Short teaser.</p></article><div><p>{PROSE * 5}</p><p>{PROSE * 9}</p></div>" + f"<div><p>{PROSE * 9}</p></div>" * 9
    assert "winding" in html.main_text(f"<body><article><p>Teaser.</p></article><section>{page}</section></body>")
    page = f"<body><div><p>{PROSE[:40]}</p></div><div><p>{PROSE * 9}</p></div></body>"
    assert html.main_text(page) == (PROSE * 9).strip()
    monkeypatch.setattr(html, "START_POINTS", {"div": 5000.0})
    assert html.main_text(page) != (PROSE * 9).strip()


def test_extract_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("*", "1 as text", "2 as n_chars")
    for r in html.extract(pages).collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        lines = re.split(r"</?(?:p|h1|br)>", inner.replace("<b>", "").replace("</b>", ""))
        want = "\n".join(x for x in (" ".join(unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in lines) if x)
        assert r.text == want and r.n_chars == len(want)
    assert html.extract(pages.where("false")).count() == 0
