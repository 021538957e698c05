import hashlib
import re
from itertools import zip_longest

from fixtures import documents, empty
from pyspark.sql import functions as F

from plumbline.llm import merkle, queries


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts, reverse=True)
    following = dict(zip(ids, ids[1:] + ids[:1]))
    rows = queries.op8_merkle_fingerprints(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, k = texts[r.doc_id], len(texts[r.doc_id]) // 3
        edited = text[: len(text) - k] + texts[following[r.doc_id]][:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    assert len({r.fingerprint for r in rows}) == len(set(texts.values()))
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)


def test_edges(spark):
    df = documents(spark, extra=True)
    rows = merkle.fingerprinted_with_edits(df).collect()
    assert len(rows) == df.count()
    prints = {}
    for r in rows:
        prints.setdefault(r.fingerprint, set()).add(r.n_chars)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(prints) == len({t or "" for t in [x.text for x in df.collect()]})
    assert merkle.fingerprinted_with_edits(empty(spark)).count() == 0
    one = merkle.fingerprinted_with_edits(documents(spark, [(1, "abcdef", None, None)])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1


def test_branches_locate_edits(spark):
    left = "head one two\nsecond line here\n\nnew section\nits last line"
    pairs = [(left, left), (left, left.replace("second line", "changed line")), (left, left.replace("last", "final")), (left, left + "\n\nadded"), (left, left + " "), ("a b", "a  b")]
    df = merkle.with_fingerprint(merkle.with_fingerprint(spark.createDataFrame(pairs, "x string, y string"), "x", "a"), "y", "b")
    got = df.select("y", merkle.differing(F.col("a"), F.col("b")).alias("d"), (merkle.root(F.col("a")) == merkle.root(F.col("b"))).alias("same")).collect()
    assert [[tuple(p) for p in r.d] for r in got] == [[], [(0, 1)], [(1, 1)], [(2, 0)], [(1, 1)], [(0, 0)]]
    assert [r.same for r in got] == [True] + [False] * 5


def places(spark, left, right):
    df = merkle.with_fingerprint(merkle.with_fingerprint(spark.createDataFrame([(left, right)], "x string, y string"), "x", "a"), "y", "b")
    return [tuple(p) for p in df.select(merkle.differing(F.col("a"), F.col("b")).alias("d")).first().d]


def test_deleted_moved_and_repeated_paragraphs(spark):
    left = "one a\ntwo b\nthree c\n\nfour d\nfive e"
    assert places(spark, left, "one a\ntwo b\n\nfour d\nfive e") == [(0, 2)]
    assert places(spark, left, "one a\nthree c\n\nfour d\nfive e") == [(0, 1), (0, 2)]
    assert places(spark, left, "one a\ntwo b\nthree c") == [(1, 0), (1, 1)]
    assert places(spark, left, "two b\none a\nthree c\n\nfour d\nfive e") == [(0, 0), (0, 1)]
    assert places(spark, left, "one a\ntwo b\n\nfour d\nfive e\nthree c") == [(0, 2), (1, 2)]
    assert places(spark, left, "one a\ntwo b\nthree c\nthree c\n\nfour d\nfive e") == [(0, 3)]
    assert places(spark, "", "x") == [(0, 0)] and places(spark, left, left) == []
    assert places(spark, left, left.replace("\n\n", "\n \n")) == [(None, None)]


def test_the_query_returns_the_places(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts, reverse=True)
    following = dict(zip(ids, ids[1:] + ids[:1]))

    def tree(text):
        return [s.split("\n") for s in re.split(r"\n[ \t\r]*\n", text)]

    for r in queries.op8_merkle_fingerprints(spark, sf).collect():
        text, k = texts[r.doc_id], len(texts[r.doc_id]) // 3
        a, b = tree(text), tree(text[: len(text) - k] + texts[following[r.doc_id]][:k])
        want = [(i, j) for i, (x, y) in enumerate(zip_longest(a, b, fillvalue=[])) for j, (p, q) in enumerate(zip_longest(x, y)) if p != q]
        assert [tuple(p) for p in r.edits] == want


def test_no_python_on_the_main_path(spark):
    plan = merkle.fingerprinted_with_edits(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
