import html
import random
import re

import pytest
from pyspark.sql import types as T

from plumbline.llm import articles, queries
from plumbline.llm.articles import main_text

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
LONG = "A sentence of the article, with a comma and enough words to count as a paragraph. "


def brute(page):
    """The given pages mark their article, so it can be cut out: blocks between paragraph and heading tags."""
    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_given_pages_whole(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.QUERIES["op11_article_text"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == brute(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_containers_without_an_article_element():
    page = f"""<html><body class="has-sidebar no-comments"><div id="header"><h1>Site</h1></div><div class="page-with-sidebar"><div class="main-menu"><a href=a>A</a> menu words</div>
      <div id="content"><h1>Title &amp; more</h1><div class="post-body"><p>{LONG}</p><p>{LONG * 2}<br>after&nbsp;a break<ul><li>one<li>two</ul><blockquote>Quoted.</blockquote><pre>code
      here</pre><table><tr><td>a<td>b</table></div><p>Last words, plain.</p></div><div class="sidebar"><p>{LONG * 5}</p></div></div>
      <section id="comments"><h2>Replies</h2><div class="comment-body"><p>{"I, too, think, so, much. " * 60}</p></div></section>
      <div class="cookie-notice">{LONG}</div><div role="alert">{LONG}</div><div style="display: none">{LONG}</div><form>{LONG}</form></body></html>"""
    assert main_text(page).split("\n") == [
        "Title & more", LONG.strip(), (LONG * 2 + "after a break").strip(), "one", "two", "Quoted.", "code here", "a", "b", "Last words, plain.",
    ]


def test_articles_of_readers_go():
    page = f"<main><h1>T</h1><article><header><h2>Sub</h2></header><p>{LONG}</p><footer>tags</footer></article><article class='comment'><p>{LONG * 9}</p></article></main>"
    assert main_text(page) == f"T\n{LONG.strip()}"
    page = f"<article><header><h1>T</h1><p>by me</p></header><p>{LONG}</p><div class='comments'><p>{LONG * 9}</p></div></article>"
    assert main_text(page) == f"T\nby me\n{LONG.strip()}"


def test_link_lists_lose():
    links = "".join(f"<p><a href='{i}'>{LONG}</a></p>" for i in range(30))
    assert main_text(f"<body><div>{links}</div><div><p>{LONG}</p><p>{LONG}</p></div></body>") == f"{LONG.strip()}\n{LONG.strip()}"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>open <b>bold <i>it", "open bold it"), ("<div>a &lt b &#x41;&amp;amp; x</div>", "a < b A&amp; x"),
    ("<p>one</p></div></p>two", "one\ntwo"), ("<script>if (a<b) x = \"</p>\";</script><p>text</p>", "text"), ("<p>x</p><!-- cut", "x"), ("<p>x<a", "x"),
    ("<p>1 < 2</p>", "1 < 2"), ("<P CLASS=lead>Up</P>", "Up"), ("<title>t</title><p>x", "x"), ("<p>a<span>b</span>c</p>", "abc"), ("<div><p>🙂 é</p></div>", "🙂 é"),
])
def test_faulty_and_small_pages(page, text):
    assert main_text(page) == text


def test_long_and_deep_pages():
    assert main_text("<div>" * 50_000 + "x") == "x"
    assert main_text("<b>" * 20_000 + "<p>x</p>" * 500).split("\n") == ["x"] * 500
    text = main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")
    assert text.count("\n") == 19_999 and len(text) == 20_000 * len(LONG) - 1
    for odd in ("<" * 100_000, "<a '" * 50_000, "<!--" * 50_000, "<script>" * 50_000, "&" * 100_000):
        main_text(odd)


def test_random_markup_never_loses_an_article():
    rng = random.Random(2)
    for _ in range(200):
        blocks = [" ".join(rng.choice(["word", "and,", "other", "text."]) for _ in range(rng.randrange(5, 40))) for _ in range(rng.randrange(1, 6))]
        body = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<p><em>{}</em></p>", "<div>{}</div>", "<h2>{}</h2>"]).format(b) for b in blocks)
        beside = [f"<nav>{LONG}</nav>", f"<aside>{LONG}</aside>", f"<div class='ad-slot'>{LONG}</div>", f"<div id=newsletter>{LONG}</div>", "<ul class=menu><li><a href=x>x</a></ul>"]
        rng.shuffle(beside)
        at = rng.randrange(len(beside) + 1)
        page = f"<html><body>{''.join(beside[:at])}<article>{body}</article>{''.join(beside[at:])}<footer>f</footer></body></html>"
        assert main_text(page).split("\n") == blocks


def test_edges(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS article", "'x' AS text")
    got = articles.extracted(df).select("page_id", "article.text", "article.n_chars").collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert articles.extracted(spark.createDataFrame([], PAGES)).count() == 0
