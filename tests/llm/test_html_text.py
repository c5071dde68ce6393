import pathlib
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from tiersmith.llm import html_text, queries

SF = "/root/testdata/sf0.01"
PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><a href=/>Home</a></nav><div class="cookie-notice"><p>We, use, cookies, everywhere.</p></div>
<div id="wrap"><div class="post"><h1>A  title</h1><p>First,&nbsp;one &amp; only<br>para&#103;raph.</p>
<div class="ad"><p>Buy, buy, buy, buy, buy now.</p></div><p>Second <b>bold</b>ly, <a href=x>link</a>.
<ul><li>one<li>two</ul><form><p>Mail, please</p><input name=a></form><p hidden>gone</p></div>
<aside><p>Aside, aside, aside, aside.</p></aside><section id="comments"><p>Nice, nice, nice, nice, nice!</p></section></div>
<footer>&copy; 2020</footer><script>var a = "<p>x</p>";</script></body></html>"""


@pytest.mark.parametrize(("html", "text"), [
    (PAGE, "A title\nFirst, one & only paragraph.\nSecond boldly, link.\none\ntwo"),
    ("", ""), ("   ", ""), ("<p></p><script>x()", ""), ("just text", "just text"), ("a < b &amp; c", "a < b & c"),
    ("<article><p>cut off &am", "cut off &am"), ("<article><p>one<p>two<p title='>", "one\ntwo"), ("<!-- never closed <p>x</p>", ""),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("</p></div></b>odd", "odd"), ("<p title='a>b'>q</p>", "q"),
    ("<nav><p>menu, only</p></nav>", ""), ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
])
def test_pages(html, text):
    assert html_text.main_text(html) == text


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 5000 + "<p>deep, text</p>").endswith("deep, text")
    long = "<article>" + "".join(f"<p>Paragraph {i}, with words.</p>" for i in range(20_000)) + "</article>"
    assert html_text.main_text(long).count("\n") == 19_999
    assert html_text.main_text("<p title='" * 2000 + "x") is not None


def test_column(spark):
    rows = [(1, "u", PAGE, 3), (1, "u", PAGE, 3), (2, None, None, 3), (None, "v", "", 3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = frame.select("page_id", html_text.extract_text(F.col("html")).alias("t")).collect()
    assert sorted((r.page_id or 0, r.t.count("\n")) for r in got) == [(0, 0), (1, 4), (1, 4), (2, 0)]
    assert frame.limit(0).select(html_text.extract_text(F.col("html"))).count() == 0


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="driver tables absent")
def test_articles_of_the_driver_pages(spark):
    """The pages' own article element, cut out by patterns."""
    found = queries.QUERIES["op10_html_text"](spark, SF)
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = found.collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", pages[r.page_id], re.S)[1]
        inner = re.sub(r"</?(?:b|a|i|em)\b[^>]*>?", "", body.replace("<br>", " "))
        blocks = [" ".join(unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


INNER = "<div><p>First, a long, winding paragraph, with commas, more commas, and words.</p><p>Second, third, fourth, fifth, sixth.</p></div>"
BESIDE = [
    ("<ul><li>one item<li>two items</ul>", "one item\ntwo items"), ("<ol><li>step</ol>", "step"),
    ("<table><tr><th>Head<td>7</table>", "Head\n7"), ("<dl><dt>term<dd>meaning</dl>", "term\nmeaning"),
    ("<pre>x = 1</pre>", "x = 1"), ("<blockquote>quoted</blockquote>", "quoted"), ("<p>Short one</p>", "Short one"),
    ("<div><ul><li>an item of a list in a box that holds no paragraph at all<li>and one more, to make it long</ul></div>",
     "an item of a list in a box that holds no paragraph at all\nand one more, to make it long"),
    ("<ul><li><a href=a>Home page</a><li><a href=b>About us</a></ul>", ""), ("<p><a href=c>Read more</a></p>", ""),
    ("<table><tr><td><a href=d>Previous</a><td><a href=e>Next</a></table>", ""), ("<ul class=menu><li>menu</ul>", ""),
]


@pytest.mark.parametrize(("part", "text"), BESIDE)
def test_parts_beside_the_container(part, text):
    own = html_text.main_text(f"<html><body>{INNER}</body></html>")
    assert own.count("\n") == 1
    for html in (f"<html><body><div>{INNER}{part}</div></body></html>", f"<html><body>{INNER}{part}</body></html>"):
        assert html_text.main_text(html) == (f"{own}\n{text}" if text else own)
    assert html_text.main_text(f"<body><div>{part}{INNER}</div></body>") == (f"{text}\n{own}" if text else own)


ARTICLE = "<h1>Title</h1><p>First, a long, winding paragraph, with commas, more commas, and words.</p><p>Second, third, fourth, fifth.</p>"
OWN = "Title\nFirst, a long, winding paragraph, with commas, more commas, and words.\nSecond, third, fourth, fifth."


@pytest.mark.parametrize("around", [
    "<form action=x>{}</form>", "<div class='wrapper has-sidebar'>{}</div>", "<div class='content no-sidebar'>{}</div>",
    "<div class='page with-banner'>{}</div>", "<div class=commentary>{}</div>", "<div class='popup'><div>{}</div></div>",
    "<form><div id=outer><div class=banner>{}</div></div></form>",
])
def test_names_and_forms_around_an_article_dont_lose_it(around):
    inner = around.format(ARTICLE + "<form><p>Mail, please</p></form><div class=sidebar><p>Other, things</p></div>")
    assert html_text.main_text(f"<html><body><nav><a href=/>Home</a></nav>{inner}<footer>Foot</footer></body></html>") == OWN


def test_rows_with_an_inner_div_each():
    rows = "".join(f"<section><div><p>Row {i}, with words, and more, and more.</p><p>Its end, at last.</p></div></section>" for i in range(3))
    found = html_text.main_text(f"<body><div class=menu><a href=a>A</a></div><div>{rows}</div><div class=footer><p>Foot, note</p></div></body>")
    assert found == "\n".join(f"Row {i}, with words, and more, and more.\nIts end, at last." for i in range(3))


def test_words_in_ordinary_names():
    more = "<p class=share-price>The share price rose.</p><section id=related-work><h2>Related work</h2><p>Others, too, wrote of it.</p></section>"
    links = "<div class=related-posts><p><a href=a>One more, to read</a></p></div><div class=share><p>Share, like</p></div>"
    want = f"{OWN}\nThe share price rose.\nRelated work\nOthers, too, wrote of it."
    assert html_text.main_text(f"<body><article>{ARTICLE}{more}{links}</article></body>") == want


def test_longer_comments_and_notices_stay_out():
    reader = "<p>Nice, nice, nice, nice, nice, nice, nice, nice, nice!</p>" * 20
    for rest in (f"<section id=comments>{reader}</section>", f"<div class=cookie-notice>{reader}</div>", f"<div>{reader}</div>"):
        assert html_text.main_text(f"<body><article>{ARTICLE * 9}</article>{rest}</body>") == "\n".join([OWN] * 9)
    assert html_text.main_text(f"<body><div>{ARTICLE}</div><div class=commentList>{reader}</div></body>") == OWN
    assert html_text.main_text("<body><div class=cookies><p>We, use, them.</p></div></body>") == ""
