from pyspark.sql import types as T

from plumbline.llm import queries, urls

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("host", T.StringType())])


def link(href):
    return f'<html><head><LINK rel="canonical" href="{href}"></head></html>'


ROWS = [
    (1, "http://a.org/x#top", link("https://example.com/en/1"), "?"),  # alias of a blocked url that is no page
    (2, "http://b.org/", '<meta http-equiv="refresh" content="0; url=http://a.org/x">', "?"),  # alias of an alias
    (3, "http://c.org/", link("http://shop.com/"), "?"),  # alias of an allowed one
    (4, "http://d.org/", link("http://e.org/") + link("http://www.example.com/en/1") + link("http://f.net/es/1"), "?"),  # both: allow goes first
    (5, "http://www.EXAMPLE.com/en/q?x=1", link("http://z.net/fr/"), "?"),  # own rule
    (6, "https://sub.example.com/en/", None, "?"), (7, None, None, "?"), (8, "no scheme", link("http://example.com/en/"), "?"), (9, "http://com", None, "?"),
    (10, "http://q.net/es/", "", "?"), (10, "http://q.net/es/", "", "?"), (11, "ftp://a.org?x#y", None, "?"), (12, "http://r.org/a/b", link("c"), "?"), (13, "http://r.org/a/c", link("http://net/fr/1"), "?"),
    (14, "http://s.org/", link("/self"), "?"), (15, "http://xcom/", None, "?"), (16, "://h/p?q://r", None, "?"),
]


def test_verdicts(spark):
    rows = urls.url_verdicts(spark.createDataFrame(ROWS, PAGES), queries.RULES).collect()
    assert len(rows) == len(ROWS)
    got = {r.page_id: (r.rule, r.verdict, r.inherited) for r in rows}
    assert got[1] == (None, "block", True) and got[2] == (None, "block", True)
    assert got[3] == (None, "allow", False) and got[4] == (None, "allow", False)
    assert got[5] == ("www.example.com/en/", "allow", False) and got[6] == ("example.com/en/", "block", False)
    assert got[7] == got[8] == got[9] == (None, "allow", False)
    assert got[10] == ("net/es/", "block", False)
    assert got[12] == got[13] == (None, "block", True)
    assert got[14] == got[15] == got[16] == got[11] == (None, "allow", False)
    parts = {r.page_id: (r.host, r.path) for r in rows}
    assert parts[5] == ("www.example.com", "/en/q") and parts[7] == ("", "") and parts[8] == ("", "") and parts[9] == ("com", "")
    assert parts[11] == ("a.org", "") and parts[16] == ("h", "/p")


def test_redirects_and_long_chains(spark):
    n = 40
    pages = spark.createDataFrame([(i, f"http://p{i}.org/", None, "") for i in range(n)], PAGES)
    hops = [(f"http://p{i}.org/", f"http://p{i + 1}.org/") for i in range(n - 1)] + [(f"http://p{n - 1}.org/", "http://x.net/fr/"), (None, "http://p0.org/"), ("http://p0.org/", "http://p0.org/")]
    got = urls.url_verdicts(pages, queries.RULES, spark.createDataFrame(hops, "from_url string, to_url string"))
    assert {r.verdict for r in got.collect()} == {"block"}


def test_empty(spark):
    assert urls.url_verdicts(spark.createDataFrame([], PAGES), queries.RULES).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = urls.url_verdicts(spark.createDataFrame(ROWS, PAGES), queries.RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
