"""Hand-computed audit values, dirty exports, skew and permutation invariance."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import audit as A
from plumbline.operators import overlaps as O
from plumbline.sources import retrieval as R

HITS = "seq long, query string, pos int, id string, text string, score double"


def hits_of(spark, lists, score=None):
    rows = [(q, f"q{q}", p, i, str(i).lower(), None if score is None else score[q][p - 1]) for q, ids in lists.items() for p, i in enumerate(ids, 1)]
    return spark.createDataFrame(rows, HITS)


TOPICAL = dict(enumerate(["ABCDE", "ABFGH", "IJKLM", "NOPQR", "NOSTU", "NOVWX"], 1))


def test_topicality_values(spark):
    row = A.topicality(hits_of(spark, TOPICAL)).first()
    assert (row.n_pairs, row.k_real) == (5, 3)
    assert row.real == pytest.approx(3 / 5)
    assert row.neutral == pytest.approx(4 / 15)


def test_reference_ignores_order(spark):
    turned = dict(zip(TOPICAL, reversed(list(TOPICAL.values()))))
    a = A.overlap_histogram(A.result_sets(hits_of(spark, TOPICAL), 5)).collect()
    b = A.overlap_histogram(A.result_sets(hits_of(spark, turned), 5)).collect()
    assert sorted(a) == sorted(b)


def brute_histogram(lists):
    out = {}
    for a, b in itertools.combinations(lists.values(), 2):
        key = (min(len(a), len(b)), len(set(a) & set(b)))
        out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize("light, block, columns", [(1, 7, 3), (3, 2048, 8192), (64, 2048, 8192)])
def test_histogram_against_brute_force(spark, monkeypatch, light, block, columns):
    """Few light items leave many groups for the blocks; lists differ in length and contain repeats and equal sets."""
    monkeypatch.setattr(O, "LIGHT", light)
    monkeypatch.setattr(O, "BLOCK", block)
    monkeypatch.setattr(O, "COLUMNS", columns)
    rng = random.Random(light)
    lists = {q: [rng.choice("ABCDEFGHIJ") for _ in range(rng.randint(1, 7))] for q in range(1, 41)}
    lists |= {q: [f"w{rng.randrange(40)}" for _ in range(rng.randint(9, 50))] + ["HOT"] * (q % 3 > 0) for q in range(41, 71)}
    lists |= {q: list("ABC") for q in range(71, 80)}
    got = A.overlap_histogram(A.result_sets(hits_of(spark, lists))).collect()
    assert {(r.k_pair, r.overlap): int(r.n_pairs) for r in got} == brute_histogram(lists)


def test_histogram_with_one_item_in_every_query(spark):
    lists = {q: ["HOT", f"x{q}", f"y{q % 3}"] for q in range(1, 301)}
    got = A.overlap_histogram(A.result_sets(hits_of(spark, lists))).collect()
    assert {(r.k_pair, r.overlap): int(r.n_pairs) for r in got} == brute_histogram(lists)


def test_a_hot_item_in_long_lists_lists_no_pair(spark, monkeypatch):
    lists = {q: ["HOT", *(f"x{q}-{i}" for i in range(9))] for q in range(2000)}
    listed, written = [], O._listed
    monkeypatch.setattr(O, "_listed", lambda *a: listed.append(written(*a)) or listed[-1])
    got = A.overlap_histogram(A.result_sets(hits_of(spark, lists))).collect()
    assert [(r.k_pair, r.overlap, int(r.n_pairs)) for r in got] == [(10, 1, 2000 * 1999 // 2)]
    assert [df.count() for df in listed] == [0] * len(listed)


def test_overlaps_of_empty_and_equal_sets(spark):
    none = spark.createDataFrame([], "items array<string>, k int")
    assert O.pair_overlaps(none).count() == 0
    rows = [([], 2)] * 3 + [(["a"], 2)] * 4 + [(["a"], 5)] * 2
    got = O.pair_overlaps(spark.createDataFrame(rows, "items array<string>, k int")).collect()
    assert {(r.k_pair, r.overlap): int(r.n_pairs) for r in got} == {(2, 0): 3 + 18, (2, 1): 6 + 8, (5, 1): 1}


def test_fewer_than_two_queries(spark):
    row = A.cross_query_repetition(hits_of(spark, {1: "AB"})).first()
    assert row.insufficient and row.ref_binary_rate is None and row.cons_binary_rate is None


def test_duplication_rates_and_null_id_rate(spark):
    rows = [(1, "q1", 1, "a", "x y", 0.9), (1, "q1", 2, "a", "X  Y ", 0.8), (1, "q1", 3, "b", "z", 0.8), (2, "q2", 1, None, "t", None), (2, "q2", 2, None, "u", None)]
    got = {r.seq: r for r in A.intra_query_duplication(spark.createDataFrame(rows, HITS)).collect()}
    assert got[1].dup_id_rate == pytest.approx(1 / 3) and got[1].dup_hash_count == 1
    assert got[2].dup_id_rate is None and got[2].dup_hash_rate == 0


def test_first_query_wins_a_tie(spark):
    rows = [(q, f"q{q}", p, "a", "same", 1.0) for q in (4, 2, 9) for p in (1, 2)]
    s = A.duplication_summary(A.intra_query_duplication(spark.createDataFrame(rows, HITS))).first()
    assert (s.worst_hash_query, s.worst_id_query) == ("q2", "q2")


def test_score_scale_values(spark):
    score = {1: [0.9, 0.9, 0.7], 2: [0.5, 0.4], 3: [0.0, 0.0]}
    row = A.score_scale(hits_of(spark, {1: "ABC", 2: "DE", 3: "FG"}, score)).first()
    assert row.tie_fraction == pytest.approx(2 / 4)
    assert row.median_spread == pytest.approx(0.2) and row.flagged


def test_repeat_rate_monitor(spark):
    row = A.repeat_rate(hits_of(spark, TOPICAL), 5).first()
    assert (row.pairs, row.repeat_rate) == (5, pytest.approx(3 / 5))
    assert row.overlap_frac == pytest.approx((2 + 0 + 0 + 2 + 2) / 25)


def test_dirty_export(spark, tmp_path):
    lines = ['﻿{"query": "ok", "results": [{"texto": "a", "id": "1", "score": 0.5}, {"texto": ""}, 3]}', "{broken", '["list"]', '{"query": " "}', ""]
    (tmp_path / "export.jsonl").write_text("\n".join(lines), encoding="utf-8")
    hits, rejects = R.read_retrieval(spark, str(tmp_path / "export.jsonl"))
    assert [(r.query, r.pos, r.id, r.text, r.score) for r in hits.collect()] == [("ok", 1, "1", "a", 0.5)]
    assert sorted(r.reason for r in rejects.collect()) == ["invalid_json", "not_object", "query_missing"]


def test_export_round_trip(spark, tmp_path):
    R.write_retrieval(hits_of(spark, TOPICAL), str(tmp_path / "out"))
    hits, rejects = R.read_retrieval(spark, str(tmp_path / "out"))
    got = sorted((r.query, r.pos, r.id) for r in hits.collect())
    assert got == sorted((f"q{q}", p, i) for q, ids in TOPICAL.items() for p, i in enumerate(ids, 1))
    assert rejects.count() == 0


def test_whole_lists_are_not_cut(spark):
    from plumbline.catalog import QUERIES
    from plumbline.catalog.inputs import order_hits

    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    got = QUERIES["export_records"](spark, sf).selectExpr("sum(size(split(results, ','))) AS n").first().n
    assert got == lines
    assert A.result_sets(order_hits(spark, sf)).filter("n_items > 8").count() > 0


def test_listed_pairs_meet_once_over_batches():
    import pyarrow as pa

    from plumbline.operators.overlaps import _met

    rows = [(1, 10, [2, 3], [10, 30]), (1, 10, [2], [10]), (1, 10, [3, 4], [30, 10]), (2, 10, [4], [10])]
    schema = pa.schema([("a", pa.int64()), ("ka", pa.int64()), ("b", pa.list_(pa.int64())), ("kb", pa.list_(pa.int64()))])
    for size in (1, 2, 3, 4):
        parts = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[i : i + size]], schema) for i in range(0, len(rows), size)]
        found = {}
        for r in (r for b in _met(iter(parts)) for r in b.to_pylist()):
            key = r["ka"], r["kb"], r["more"]
            found[key] = found.get(key, 0) + r["n"]
        assert found == {(10, 10, 2): 1, (10, 30, 2): 1, (10, 10, 1): 2}


@pytest.mark.parametrize("wide", [0, 2, 5, 32])
def test_pairs_are_counted_in_their_items(spark, monkeypatch, wide):
    """Groups beyond the bound go as lists of ids; all others leave an item's task as counts."""
    monkeypatch.setattr(O, "WIDE", wide)
    rng = random.Random(wide)
    lists = {q: [rng.choice("ABCDEFGHIJ") for _ in range(rng.randint(1, 7))] for q in range(1, 41)}
    lists |= {q: [f"w{rng.randrange(40)}" for _ in range(rng.randint(9, 50))] + ["HOT"] * (q % 3 > 0) for q in range(41, 71)}
    got = A.overlap_histogram(A.result_sets(hits_of(spark, lists))).collect()
    assert {(r.k_pair, r.overlap): int(r.n_pairs) for r in got} == brute_histogram(lists)


def test_pairs_of_an_item_go_on_over_batches():
    import pyarrow as pa

    groups = {10: "ABD", 11: "ABCD", 12: "BD", 13: "E"}
    kinds = {10: 1, 11: 1, 12: 2, 13: 2}
    rows = sorted((x, kinds[g], list(items[i + 1 :])) for g, items in groups.items() for i, x in enumerate(items))
    schema = pa.schema([("item", pa.string()), ("kind", pa.int64()), ("later", pa.list_(pa.string()))])
    for size in (1, 2, 3, 20):
        parts = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[i : i + size]], schema) for i in range(0, len(rows), size)]
        found = {}
        for r in (r for b in O._met_blocks(iter(parts)) for r in b.to_pylist()):
            key = r["ka"], r["kb"], r["more"]
            found[key] = found.get(key, 0) + r["n"]
        assert {k: n for k, n in found.items() if n} == {(1, 1, 3): 1, (1, 2, 2): 2}
