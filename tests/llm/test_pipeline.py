
import corpus_pipeline as pipeline
import pytest
from fixtures import documents, shingle_set

from plumbline.llm import contamination, queries
from plumbline.llm.shared import components

SF = "/root/testdata/sf0.001"


def stage(name):
    return dict(pipeline.STAGES)[name]


def reread(df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}")
    return df.sparkSession.read.parquet(f"{tmp_path}/{name}")


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for i, (name, apply) in enumerate(pipeline.STAGES):
        kept = reread(apply(spark, docs, SF), tmp_path, name)
        if i < len(pipeline.STAGES) - 1:
            assert kept.columns == docs.columns
            rows = {r.doc_id for r in kept.collect()}
            before = docs.collect()
            if name == "near_copies":
                sets = [shingle_set(r.text) for r in kept.collect()]
                assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
                for r in before:
                    if r.doc_id not in rows:
                        own = shingle_set(r.text)
                        assert any(100 * len(own & (s := shingle_set(o.text))) >= 80 * len(own | s) for o in before if o.doc_id < r.doc_id)
            if name == "mixing":
                assert rows == {r.doc_id for r in before}
        docs = kept
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] == sizes[-3]
    rows = sorted(docs.collect(), key=lambda r: r.start)
    assert rows[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))


def test_records_keep_the_mixed_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from plumbline.llm import mixing

    want = [r.doc_id for r in sorted(mixing.mixed(docs, queries.SOURCE_UNITS, queries.BLOCK_DOCS, queries.OTHER_UNITS).collect(), key=lambda r: (r.slot, r.place))]
    mixed = reread(stage("mixing")(spark, docs, SF), tmp_path, "mixed")
    got = sorted(stage("token_records")(spark, mixed, SF).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == want


@pytest.mark.parametrize("name", ["toxicity", "near_copies", "decontamination", "mixing", "token_records"])
def test_awkward_rows(spark, tmp_path, name):
    docs = reread(documents(spark, extra=True), tmp_path, "in")
    out = reread(stage(name)(spark, docs, SF), tmp_path, "out")
    ids = [r.doc_id for r in out.collect()]
    if name == "near_copies":
        assert sorted(-1 if i is None else i for i in ids) == [-1, 1, 4, 4, 5, 6, 7, 8, 10, 12]
    elif name != "toxicity":
        assert len(ids) == docs.count()
    none = reread(documents(spark, []), tmp_path, "none")
    assert stage(name)(spark, none, SF).count() == 0


def test_contaminated_documents_go(spark, tmp_path):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    clean = " ".join(f"clean{i}" for i in range(400))
    docs = reread(documents(spark, [(1, clean, None, None), (2, item, None, None), (3, clean + " " + item, None, None), (4, clean * 9 + " " + " ".join(item.split()[:13]), None, None)]), tmp_path, "in")
    kept = {r.doc_id for r in stage("decontamination")(spark, docs, SF).collect()}
    assert 1 in kept and 2 not in kept and 4 in kept
    n = len(contamination.words_of(item.encode()))
    assert (3 in kept) == (20 * n < 400 + n)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)] + [(300, 300), (None, 5), (7, None), (240, 250)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 100 for i in range(100, 131)} | {i: 200 for i in range(200, 240)} | {300: 300, 240: 240, 250: 240}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
