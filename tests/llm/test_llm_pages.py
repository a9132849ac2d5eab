import html
import re
import time

import pytest

from cartpulse.llm import article_text as A

SCHEMA = "page_id long, url string, html string, text string, paths string, host string"


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


AROUND = (
    '<header class="site-header"><a href="/">Home</a> Daily news</header><nav><ul><li><a href="/a">A</a><li>Menu</ul></nav>'
    '<div class="cookie-notice">We use cookies, a lot of them, and say so at length.</div>{}<aside>Side <b>bar</b></aside>'
    '<div id="comments"><article class="comment"><p>First! A long remark of a reader that goes on and on and on.</p></article></div>'
    "<form><label>Mail</label><input></form><footer>&copy; me</footer>"
)
ARTICLE = '<h1>Head&amp;line</h1><p>One <b>bo</b>ld&nbsp; word &eacute;&#233;.<p>Two<br>lines<script>var x = "<p>no</p>";</script></p><ul><li>a<li>b</ul>'
TEXT = "Head&line One bold word éé. Two lines a b"


@pytest.mark.parametrize(
    "body,path",
    [
        (f"<article>{ARTICLE}</article>", "article"),
        (f'<div class="wrap x12"><div class="post-77 entry">{ARTICLE}</div></div>', "div.wrap.x#>div.entry.post-#"),
        (f'<main class="has-sidebar">{ARTICLE}<div class="share-links">Share this</div></main>', "main.has-sidebar"),
        (f'<article><header>{ARTICLE.split("<p>")[0]}</header><p>{ARTICLE.split("<p>", 1)[1]}<div class="ad">Buy</div></article>', "article"),
        (f"<table><tr><td>left</td><td>{ARTICLE}</td></tr></table>", "table>tr>td"),
    ],
)
def test_layouts(body, path):
    source = page(AROUND.format(body))
    assert A.vote(source)[0] == path
    assert A.extract(source, [path]).replace("left ", "") == TEXT
    assert A.extract(source, []).replace("left ", "") == TEXT


def test_broken_markup():
    assert A.extract("<p>a < b && c<p>d<!-- no --><b>e</p>f", []) == "a < b && c de f"
    assert A.extract("<article><p>x <a title='>'>y</a> &am &amp z</article", []) == "x y &am & z"
    assert A.extract("<article>kept<style>p{</article>", []) == "kept"
    assert A.extract('<div class="ad"><article><h1>Left open</h1><p>Body of the text.</article>', []) == "Left open Body of the text."
    assert A.extract("<head><title>t</title><article><p>No end of head.</article>", []) == "No end of head."
    for empty in (None, "", " \n", "<", "<a", "</", "<!--", "<script>", "<title>x</title>", "<nav>only</nav>", page("")):
        assert A.extract(empty, ["article"]) == ("<" if empty == "<" else "")


def test_headers_of_sections_stay():
    body = '<div class="site-header"><p>Daily news</p></div><article><h1>A</h1><div class="section-header"><h2>B</h2></div><p>C</p><div class="share">D</div></article>'
    assert A.extract(page(body), []) == "A B C"


def test_time_grows_with_length_only():
    for bad in ('<a "', "<!--", "<p", "</b>", "<b>", "<div>", "&am", "<a =", "<li>", "<p><b>", "<script>"):
        began = time.perf_counter()
        A.extract(bad * 20_000, ["article"])
        A.vote(bad * 20_000)
        assert time.perf_counter() - began < 10, bad


def test_host_consensus_corrects_a_page(spark):
    """A page whose notice outweighs its article is read where its host's other pages have theirs."""
    shop = "<div class='left7'><p>{}</p></div><div class='right'><p>{}</p></div>"
    rows = [(i, "https://User@Shop.example:80/x", page(shop.format("An article of some length, really. " * 5, "Offers of the day.")), "", "", "") for i in range(9)]
    rows.append((9, "http://shop.example/y?z#u", page(shop.format("Short.", "A very long unmarked block about offers. " * 9)), "", "", ""))
    rows.append((10, "http://other.example/", page(shop.format("Short.", "A long unmarked block, the only one here.")), "", "", ""))
    rows += [(11, None, None, None, None, None), (12, "no url", "plain words", "", "", ""), (12, "no url", "plain words", "", "", ""), (None, "", "", "", "", "")]
    got = {(r.page_id, r.text, r.n_chars) for r in A.main_text(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert {(9, "Short.", 6), (10, "A long unmarked block, the only one here.", 41), (11, "", 0), (12, "plain words", 11), (None, "", 0)} <= got
    assert len(got) == 14 and A.main_text(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)
    assert A.consensus(spark.createDataFrame(rows, SCHEMA)).filter("host = 'shop.example'").first().paths[0] == "div.left#"


def test_empty_table(spark):
    assert A.main_text(spark.createDataFrame([], SCHEMA)).columns == ["page_id", "url", "text", "n_chars"]
    assert A.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equals_plain_reading_of_the_test_pages(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in A.main_text(table).collect()}
    for r in table.collect():
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", re.search(r"<article>(.*)</article>", r.html, re.S)[1]))
        text = " ".join(html.unescape(inner).split())
        assert got[r.page_id] == (r.url, text, len(text))
