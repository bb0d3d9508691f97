"""Main texts of hand-made and generated pages whose articles are known."""

import random

import pytest

from tablemend.llm import extraction
from tablemend.llm.extraction import main_text
from tablemend.llm.queries import QUERIES
from tests.llm.conftest import prose

P1 = "The harbour was quiet that morning, and only two of the boats had left before the fog came in."
P2 = "Nobody on the quay could say when the others would follow; the radio had been silent for hours."
P3 = "By noon the wind had turned, the fog was gone and the first of them came home with empty nets."
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">World news</a></li><li><a href="/c">Weather &amp; traffic</a></li></ul>'
BODY = f"<p>{P1}</p><p>{P2}</p><p>{P3}</p>"
TEXT = f"{P1} {P2} {P3}"


@pytest.mark.parametrize("page", [
    f"<html><body><nav>{MENU}</nav><article>{BODY}</article><footer>&copy; Someone</footer></body></html>",
    f"<body><div class='top-menu'>{MENU}</div><div id=content>{BODY}</div><div id=footer>All rights reserved. {P1}</div>",
    f"<body><header><h1>The Daily Paper</h1>{MENU}</header><main><section>{BODY}</section></main></body>",
    f"<body><div class='cookie-notice'>We use cookies to make this page better for you and for all. <button>OK</button></div><main>{BODY}</main>",
    f"<body class='with-sidebar'><main>{BODY}</main><aside><p>{P2} {P2} {P2}</p></aside></body>",
    f"<body><article>{BODY}<div class=ad>Buy a boat now, only today.</div><form><label>Your mail</label><input name=m></form></article></body>",
    f"<body><article>{BODY}</article><section id='comments'><h2>Comments</h2><article class='comment'><p>{P1} I was there.</p></article></section>",
    f"<BODY><DIV CLASS='Sidebar'>{P1}{P2}</DIV><ARTICLE><P>{P1}<P>{P2}<P>{P3}</ARTICLE></BODY>",
    f"<body><script>var x = '<p>{P1}</p>';</script><style>p {{}}</style><!-- <p>{P2}</p> --><article>{BODY}",
    f"<body><div><div><div>{MENU}</div><div>{BODY}</div><div><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li><li><a href=z>Three</a></li></ul></div></div></div>",
    f'<body><article title="a > b" data-x=\'<p>\'>{BODY}</article><p>',
])
def test_articles_are_found(page):
    assert main_text(page) == TEXT


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<html></html>", ""), ("<nav>Menu only</nav>", ""), ("plain words", "plain words"),
    ("<article><h1>Title</h1><p>a<b>b</b>c <i>d</i>\n\t e</p><p>f<br>g</p></article>", "Title abc d e f g"),
    ("<article><p>Caf&eacute; &amp; &#8220;tea&#x201d; &nosuch; 5 < 6 &lt;b&gt;</p></article>", "Café & “tea” &nosuch; 5 < 6 <b>"),
    ("<article><p>cut off &am", "cut off &am"), ("<article><p>cut off <a hr", "cut off"), ("<article>cut <!-- off", "cut"),
    ("<article>a<ul><li>b<li>c</ul><table><tr><td>d<td>e</table></article>", "a b c d e"),
    ("<article><header><h1>Its title</h1></header><p>words</p></article>", "Its title words"),
    ("<article><p>one</p></article>" * 2, "one one"),
    ("<article><p>A null \x00 and a &#0; and a &#xD800;.</p></article>", "A null \x00 and a � and a �."),
])
def test_markup_and_references(page, text):
    assert main_text(page) == text


def test_generated_pages():
    rng = random.Random(4)
    for _ in range(60):
        paragraphs = [prose(rng, rng.randint(20, 80)) for _ in range(rng.randint(2, 12))]
        title = prose(rng, 6)
        inner = f"<h1>{title}</h1>" + "".join(f"<p>{p}" + rng.choice(["", "</p>"]) for p in paragraphs)
        noise = [f"<div class='{c}'>{prose(rng, 12)}</div>" for c in ("advert", "share-bar", "newsletter box", "related-posts")]
        noise += [f"<nav>{MENU}</nav>", f"<aside>{prose(rng, 40)}</aside>", f"<footer>{prose(rng, 20)}</footer>"]
        rng.shuffle(noise)
        before, after = noise[:3], noise[3:]
        holder = rng.choice(["article", "main", "div", "section"])
        page = f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{''.join(before)}<{holder}>{inner}</{holder}>{''.join(after)}"
        assert main_text(page) == " ".join([title, *paragraphs])


def test_density_prefers_text_over_links():
    plain, linked = extraction._density(400, 2, 0, 0, 0.2), extraction._density(400, 12, 380, 10, 0.2)
    assert plain > 10 * linked > 0


def test_long_and_deep_pages_take_linear_time():
    assert main_text("<div>" * 20_000 + "<p>deep words here</p>") == "deep words here"
    long = "".join(f"<p>paragraph {k} of many <b>words" for k in range(30_000))
    assert main_text(f"<article>{long}</article>").startswith("paragraph 0 of many words paragraph 1")
    assert main_text('<a "' * 20_000) == "" and main_text("<" * 50_000) == "<" * 50_000


def test_query_and_clashing_columns(spark, tmp_path):
    rows = [(1, "http://a", f"<article>{BODY}</article>", "x"), (1, "http://a", f"<article>{BODY}</article>", "x"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert [r["__text"] for r in extraction.extract(pages).orderBy("page_id").collect()] == ["", TEXT, TEXT]
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    found = sorted(map(tuple, QUERIES["op13_composite_density"](spark, str(tmp_path)).collect()), key=repr)
    assert found == [(1, "http://a", TEXT, len(TEXT))] * 2 + [(None, None, "", 0)]
    assert extraction.extract(pages.limit(0)).collect() == []
