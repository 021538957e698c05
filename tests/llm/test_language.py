from fixtures import documents, empty

from plumbline.llm import language, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_hyperdimensional_language(spark, sf).collect()
    assert len(rows) == len(truth)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in unseen) / len(unseen) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    docs = documents(spark, extra=True)
    out = language.identified(docs, language.fit(docs)).collect()
    assert len(out) == docs.count()
    got = {}
    for r in out:
        assert got.setdefault(r.text, r.language) == r.language
    assert got[None].lang == got[""].lang == got[" \n\t "].lang == "und"
    assert got[docs.where("doc_id = 11").first().text].lang == "de"


def test_nothing_to_learn(spark):
    assert {r.language.lang for r in language.identified(documents(spark), language.fit(empty(spark))).collect()} == {"und"}
    assert language.identified(empty(spark), language.fit(documents(spark))).count() == 0
