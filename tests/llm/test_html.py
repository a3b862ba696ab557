"""Main text against labelled pages and hand-made ones."""

import re
from html import unescape

from busweave.llm import html

WEIGHTS = dict(html._PRIOR)
BODY = "First words of a story &amp; more. " * 8


def page(content, extra=""):
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<header><h2>Site</h2></header><nav><ul><li><a href='/'>Home</a></li><li><a>News</a></li></ul></nav>"
        f"<div class='cookie-notice'>We use cookies.</div>{content}{extra}<footer>&copy; site words here</footer></body></html>"
    )


def plain(text):
    return " ".join(unescape(text).split())


def test_boilerplate_is_left_out():
    story = f"<h1>Title</h1><p>{BODY}<b>bo</b>ld<br>next</p><div class='ad'>Buy now</div><p>Last\n\tpart&nbsp;x</p>"
    want = plain(f"Title {BODY}bold next Last part x")
    for wrap in ("<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "{}"):
        extra = "<section id='comments'><p>Reader one says many words about it</p></section><aside><p>More links here</p></aside><form>Name<input></form>"
        assert html.main_text(page(wrap.format(story), extra), WEIGHTS) == want


def test_odd_pages():
    for bad in ("", "<", "<p", "<!-- open", "<script>x", "<nav>only menu"):
        assert "only" not in html.main_text(bad, WEIGHTS)
    assert html.main_text("just text & more", WEIGHTS) == "just text & more"
    assert html.main_text("<p>a<p>b<b>c", WEIGHTS) == "a bc"
    assert len(html.main_text("<p>" + "word " * 300_000, WEIGHTS)) == 5 * 300_000 - 1


def test_optional_end_tags_and_foreign_elements():
    story = "The article has many words to read and to keep in full. "
    for barred, want in (
        ("<p class=notice>Read this<p>{}", ""), ("<ul><li class=ad>Buy<ul><li>a<li>b</ul>now<li>{}</ul>", ""),
        ("<table><tr><td class=ad>Buy<td>{}</table>", ""), ("<div><p class=notice>Read <b>this</b></div>{}", ""),
        ("<dl><dt class=ad>Buy<dd>{}</dl>", ""), ("<svg width='1' />{}", ""), ("<svg/>{}", ""), ("<div class=ad>Buy<p>a<p>b</div>{}", ""),
        ("<figure><img><figcaption>A caption</figcaption></figure>{}", "A caption "),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {}", "so x=2 "),
    ):
        assert html.main_text(barred.format(story * 3), WEIGHTS) == plain(want + story * 3), barred


def test_labelled_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = html.extract_main_text(pages.selectExpr("*", "1 AS text"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r for r in out.collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r.html, re.S)[1]
        want = plain(re.sub(r"</?b>", "", article) and re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article)))
        assert found[r.page_id].text == want and found[r.page_id].n_chars == len(want)


def test_nulls_and_empty_table(spark):
    rows = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "<p>x y z")], "page_id long, url string, html string")
    assert sorted(r.text for r in html.extract_main_text(rows).collect()) == ["", "", "x y z"]
    assert html.extract_main_text(rows.filter("false")).count() == 0
