"""Main text of pages with known articles."""

import os
import re
import time
from html import unescape

import pytest

from repoloom.llm.html_text import extract, main_text

PAGES = "/root/testdata/sf0.001/pages.parquet"
LONG = "A sentence with enough words to be the main text of a page, over and over again. " * 3


def page(article, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{before}{article}{after}</body></html>"


def test_boilerplate_goes():
    before = '<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><div id="ad-top">Buy <b>now</b></div>'
    after = '<aside>See also</aside><div class="comments"><p>' + LONG + '</p></div><form><label>Name</label></form><footer>&copy; x</footer><script>var a="<p>no</p>";</script>'
    article = f"<article><h1>Title &amp; more</h1><p>{LONG}<p>Short.<p>One<br>two &lt;b&gt;\n  three</article>"
    want = f"Title & more\n{LONG.strip()}\nShort.\nOne two <b> three"
    assert main_text(page(article, before, after)) == want


def test_without_article_the_densest_container_is_taken():
    links = "<div><ul>" + "".join(f'<li><a href="{k}">Link {k}</a></li>' for k in range(20)) + "</ul></div>"
    body = f"<div><div><p>{LONG}</p><p>Tiny.</p><p>{LONG}</p></div></div>"
    assert main_text(page(body, links, links)) == f"{LONG.strip()}\nTiny.\n{LONG.strip()}"


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>open <b>tags", "open tags"), ("<div hidden>x</div>", ""), ("<", "<"), ("a&nbsp;b &eacute;", "a b é")])
def test_odd_pages(html, text):
    assert main_text(html) == text


def test_very_long_page():
    assert len(main_text(page("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"))) > 5000 * 200


LI = "<li>" + LONG + "</li>"
PARTS = {
    "list": "<ul>" + LI * 8 + "</ul>",
    "table": "<table>" + f"<tr><td>{LONG}</td><td>{LONG}</td></tr>" * 4 + "</table>",
    "quote": "<blockquote>" + f"<p>{LONG}</p>" * 8 + "</blockquote>",
    "terms": "<dl>" + f"<dt>Term</dt><dd>{LONG}</dd>" * 8 + "</dl>",
    "figure": "<figure>" + f"<div>{LONG}</div>" * 8 + "</figure>",
    "section": "<section>" + f"<p>{LONG}</p>" * 8 + "</section>",
}
LINKS = "<div><ul>" + "".join(f'<li><a href="{k}">Link {k}</a></li>' for k in range(20)) + "</ul></div>"


def words(html):
    return [x for b in re.split(r"</?(?:p|h1|h2|li|ul|td|tr|table|div|dl|dt|dd|section|article|blockquote|figure)\b[^>]*>", html) if (x := re.sub(r"<[^>]+>", "", b).strip())]


@pytest.mark.parametrize("kind", PARTS)
@pytest.mark.parametrize("intro", ["An intro.", LONG])
def test_a_large_part_is_not_the_whole_text(kind, intro):
    content = f"<div id=content><h1>Title</h1><p>{intro}</p>{PARTS[kind]}<p>The end.</p></div>"
    assert main_text(page(content, LINKS, LINKS)).split("\n") == words(content)


@pytest.mark.parametrize("tag", ["section", "article", "div"])
def test_text_in_several_parts_is_kept(tag):
    content = f"<{tag}><h1>One</h1>" + f"<p>{LONG}</p>" * 7 + f"</{tag}><{tag}><h2>Two</h2>" + f"<p>{LONG}</p>" * 3 + f"</{tag}>"
    assert main_text(page(content, LINKS, LINKS)).split("\n") == words(content)
    assert main_text(page(f"<div>{content}</div>", LINKS, LINKS)).split("\n") == words(content)


def test_link_lines_inside_the_text_are_kept():
    content = f'<div id=content><p>{LONG}</p><p>{LONG}</p>' + '<ul><li><a href="x">A reference</a></li></ul>' * 9 + f'<p>{LONG}</p><p>See <a href="y">another reference</a></p></div>'
    assert main_text(page(content, LINKS, LINKS)).split("\n") == words(content)
    article = f"<article><p>{LONG}</p>{LINKS}</article>"
    assert main_text(page(article, LINKS, LINKS)).split("\n") == words(article)


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "page-with-nav", "social-science"])
def test_names_of_wrappers_do_not_drop_the_text(name):
    side = '<div class="sidebar"><p>Aside.</p></div>'
    for tag in ("article", "div"):
        content = f"<div class={name}><{tag}><h1>Title</h1>" + f"<p>{LONG}</p>" * 3 + f"</{tag}>{side}</div>"
        assert main_text(page(content)).split("\n") == ["Title"] + [LONG.strip()] * 3
    comments = f'<div id="comments"><article class="comment"><p>{LONG}</p><p>{LONG}</p></article></div>'
    assert main_text(page(f"<main><h1>Title</h1><p>{LONG}</p>{comments}</main>")) == f"Title\n{LONG.strip()}"


def test_missing_end_tags():
    text = f"<h1>Title</h1><p>{LONG}<p>{LONG}"
    want = f"Title\n{LONG.strip()}\n{LONG.strip()}"
    assert main_text(f"<html><head><title>T</title><body>{text}") == want
    assert main_text(f"<html><head><title>T</title><div>{text}</div>") == want
    assert main_text(page(f"<div><p class=notice>Note<h1>Title</h1><p>{LONG}<p>{LONG}</div>")) == want
    items = f"<ul><li class=promo>Buy<li>{LONG}<li>{LONG}</ul>"
    assert main_text(page(f"<div>{items}</div>")) == f"{LONG.strip()}\n{LONG.strip()}"
    cells = f"<table><tr><td class=ad>Buy<td>{LONG}<tr><td>{LONG}</table>"
    assert main_text(page(f"<div>{cells}</div>")) == f"{LONG.strip()}\n{LONG.strip()}"


@pytest.mark.skipif(not os.path.exists(PAGES), reason="supplied tables not present")
def test_supplied_pages(spark):
    rows = spark.read.parquet(PAGES)
    found = {r["page_id"]: r for r in extract(rows).collect()}
    for r in rows.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert found[r["page_id"]]["text"] == want and found[r["page_id"]]["n_chars"] == len(want)


def test_null_rows_and_empty_table(spark):
    schema = "page_id long, url string, html string, text string"
    rows = spark.createDataFrame([(None, None, None, "x"), (1, "u", "<p>a</p>", None), (1, "u", "<p>a</p>", None)], schema)
    assert sorted(map(str, map(tuple, extract(rows).collect()))) == ["(1, 'u', 'a', 1)"] * 2 + ["(None, None, '', 0)"]
    assert extract(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("wrapper", ['<form id="f" action="/x">{}</form>', "<dialog open>{}</dialog>", '<div style="display: none">{}</div>', '<div hidden>{}</div>', '<form><div class="page-with-nav">{}</div></form>'])
@pytest.mark.parametrize("article", ["<article>{}</article>", "<div>{}</div>"])
def test_a_page_within_a_wrapper_is_kept(wrapper, article):
    text = article.format(f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>")
    assert main_text(page(wrapper.format(text))) == f"Title\n{LONG.strip()}\n{LONG.strip()}"
    small = '<form><p>Your name</p><input name="n"><button>Send</button></form><dialog>Sure?</dialog><div hidden>No.</div>'
    assert main_text(page(wrapper.format(text + small))) == f"Title\n{LONG.strip()}\n{LONG.strip()}"


@pytest.mark.parametrize("inner", ["<div>", "<li>", "<ul><li>", "<section><p>", "<span hidden>", "<header>", "<td>", "<p><b><div>", '<div class="ad"><article>'])
def test_deep_pages_take_constant_work_per_tag(inner):
    def seconds(n):
        start = time.perf_counter()
        main_text("<body>" + inner * n + LONG)
        return time.perf_counter() - start

    few = min(seconds(5000) for _ in range(3))
    assert seconds(50000) < 40 * few + 1
