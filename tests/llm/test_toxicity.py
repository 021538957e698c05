from collections import Counter
from itertools import islice, product

import pyarrow as pa
from fixtures import documents, empty
from pyspark.sql import functions as F

from plumbline.llm import queries, toxicity


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op2_toxicity_pu(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = got.join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted for r in rows if r.toxic) / sum(1 for r in rows if r.toxic)
    wrong = sum(r.predicted for r in rows if not r.toxic) / sum(1 for r in rows if not r.toxic)
    assert hit > 0.75 and wrong < 0.01
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_edges(spark):
    docs = documents(spark, extra=True)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    out = toxicity.scored(docs, toxicity.fit(docs, labels, settings=toxicity.Settings(least_positives=1))).collect()
    assert len(out) == docs.count() and all(0 <= r.toxicity.score <= 1 for r in out)
    by_text = {}
    for r in out:
        assert by_text.setdefault(r.text, r.toxicity.score) == r.toxicity.score
    assert by_text[None] == by_text[""]


def test_nothing_to_learn(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) is None
    assert {r.toxicity.score for r in toxicity.scored(docs, None).collect()} == {0.0}
    some = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.scored(empty(spark), toxicity.fit(empty(spark), some)).count() == 0


def test_a_rare_feature_is_rated_behind_many_common_ones(spark):
    common = " ".join("".join(x) for x in islice(product("abcdefghijklmnopqrstuvwxyz", repeat=4), 60_000))
    rows = [(i, common + (" zzz" if i < 5 else ""), "en", "a") for i in range(12)]
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(12)], "doc_id long, toxic int")
    model = toxicity.fit(documents(spark, rows).repartition(4), labels, settings=toxicity.Settings(steps=5))
    assert len(model.vocabulary) == 1000 and list(model.vocabulary)[0] == b"zzz"


def test_counts_handed_on_in_parts_are_the_same(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(["one two", "two three", None, ""])], names=["text"])
    monkeypatch.setattr(toxicity, "HELD", 2)
    got = Counter()
    for part in toxicity._count(iter([batch])):
        for f, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            got[f] += n
    assert got == {b"": 4, b"one": 1, b"two": 2, b"three": 1, b"thre-": 1}
