"""Memory, claims, matching, search and clusters against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.claims import negate
from plumbline.operators import claims as C
from plumbline.operators import clusters as G
from plumbline.operators import labels as L
from plumbline.operators import matching as M
from plumbline.operators import memory as Y
from plumbline.operators import search as Q
from plumbline.operators import windows as W


def unit_rows(n, d=6, seed=0, copies=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    for i in range(copies):
        v[-1 - i] = v[0]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def vector_tables(spark, v):
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    return spark.createDataFrame(rows, "seq long, vec array<double>"), spark.createDataFrame(rows, "id long, vec array<double>")


@pytest.mark.parametrize("bound", [100, 0])
def test_cosine_topk_both_ways(spark, bound):
    v = unit_rows(40)
    q, c = vector_tables(spark, v)
    got = {(r.seq, r.pos): r.id for r in Q.cosine_topk(q, c, 3, exclude_self=True, broadcast_queries=bound, block_rows=16).collect()}
    sims = np.round(v @ v.T, 9)
    for i in range(40):
        best = sorted((j for j in range(40) if j != i), key=lambda j: (-sims[i, j], j))[:3]
        assert [got[i, p] for p in (1, 2, 3)] == best


def test_nearest_earlier_over_blocks(spark):
    v = unit_rows(30)
    q, _ = vector_tables(spark, v)
    got = {r.seq: r.best for r in Q.nearest_earlier(q, block_rows=7).collect()}
    sims = np.round(v @ v.T, 9)
    assert got[0] is None
    for i in range(1, 30):
        assert got[i] == pytest.approx(sims[i, :i].max())


def test_mmr_against_brute_force(spark):
    v = unit_rows(12)
    _, c = vector_tables(spark, v)
    score = {i: round(1 - i / 20, 3) for i in range(12)}
    pool = c.withColumns({"seq": F.lit(1).cast("long"), "score": 1 - F.col("id") / 20, "pos": (F.col("id") + 1).cast("int")})
    got = [r.id for r in Q.mmr(pool, 5).orderBy("pos").collect()]
    chosen = []
    while len(chosen) < 5:
        rest = [i for i in range(12) if i not in chosen]
        chosen.append(max(rest, key=lambda i: (round(0.5 * score[i] - 0.5 * max((float(v[i] @ v[j]) for j in chosen), default=0.0), 9), -i)))
    assert got == chosen


def brute_components(v, threshold):
    n, parent = len(v), list(range(len(v)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        if round(float(v[i] @ v[j]), 9) > threshold:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("block_rows", [7, 100])
def test_clusters_against_union_find(spark, block_rows):
    v = unit_rows(50, copies=20)
    rows = [(i, [float(x) for x in r], 1, "not_found" if i % 2 else None) for i, r in enumerate(v)]
    e = spark.createDataFrame(rows, "id long, vec array<double>, acessos long, answer_class string")
    edges = G.similarity_forest(e, 0.8, block_rows)
    got = {r.id: r.merged_from for r in G.merge_clusters(e, 0.8, block_rows=block_rows).collect()}
    want = {}
    for c in brute_components(v, 0.8):
        want[c] = want.get(c, 0) + 1
    assert got == want
    assert edges.count() < 50 * (50 // block_rows + 2)
    kept = {r.id: r.answer_class for r in G.merge_clusters(e, 0.8, keep_class=True, block_rows=block_rows).collect()}
    lost = {r.id: r.answer_class for r in G.merge_clusters(e, 0.8, block_rows=block_rows).collect()}
    assert kept[0] == "not_found" and lost[0] is None


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in G.connected_components(edges).collect()} == {0}


def test_nearest_ties_and_rounding(spark):
    left = spark.createDataFrame([(1, 100.0), (2, 500.0), (3, 1000.0)], "k long, ts double")
    right = spark.createDataFrame([(1, 90.0, "early"), (2, 110.0, "late"), (3, 620.0, "edge"), (4, 621.0, "out"), (5, 90.2, "last of the second")], "s long, ts double, name string")
    got = {r.k: r.near and r.near.name for r in M.nearest_within(left, right, 120, ["name"], seq="s").collect()}
    assert got == {1: "last of the second", 2: "edge", 3: None}


def test_target_table_matches_literal_specs(spark):
    mem = spark.createDataFrame([("a", "um texto com Docker", None), ("b", "kafka e docker", "session_summary"), ("c", "kafka", "x")], "id string, text string, source_type string")
    specs = [{"name": "1", "needle": "docker"}, {"name": "2", "needle": "kafka"}, {"name": "3", "id": "b"}, {"name": "4", "id": "c"}, {"name": "5", "needle": "e"}]
    table = spark.createDataFrame([(s["name"], s.get("id"), s.get("needle")) for s in specs], "spec string, id string, needle string")
    for gram in (2, 8):
        assert sorted(M.resolve_target_table(mem, table, gram).collect(), key=str) == sorted(M.resolve_targets(mem, specs).collect(), key=str)


def test_predecessors_stay_in_their_conversation(spark):
    rows = [(1, 1, "primeira"), (2, 1, "segunda"), (3, 1, " SEGUNDA "), (4, 2, "outra"), (5, 2, "fim")]
    turns = Y.first_occurrences(spark.createDataFrame(rows, "seq long, conv_id long, query string"), "query", "seq")
    assert {r.query: r.predecessor for r in Y.with_predecessor(turns).collect()} == {"segunda": "primeira", "fim": "outra"}


def test_extraction_counts(spark):
    texts = ["Q: um\nA: x", "[session_summary] r", "[session_summary] Q: a A: b", "sem forma", "Q: dois A: y", "  Q: tres\n A: z", "Q: quatro\nA: w"]
    df = spark.createDataFrame([(i, str(i), t, float(9 - i)) for i, t in enumerate(texts)], "seq long, id string, text string, timestamp double")
    assert tuple(Y.turn_cascade(df).first()) == (7, 2, 1, 4)
    assert [r.query for r in Y.ordered_by_time(Y.extract_turns(df)).collect()] == ["quatro", "tres", "dois", "um"]


def test_stamping_is_idempotent(spark):
    df = spark.createDataFrame([("a", "x", None), ("b", "x", "normal"), ("c", "y", None)], "id string, text string, answer_class string").withColumns({"scope": F.lit("s"), "layer": F.lit("l")})
    hit = F.col("text") == "x"
    once, audit = Y.stamp_class(df, hit, "disqualification", "r")
    twice, again = Y.stamp_class(once, hit, "disqualification", "r")
    assert audit.count() == 1 and again.count() == 0 and sorted(once.collect()) == sorted(twice.collect())


@pytest.mark.parametrize("text,stratum", [("coisas importantes", "controle"), ("e ANTES disso", "alvo"), ("última vez", "alvo"), ("", "controle")])
def test_strata_need_whole_words(spark, text, stratum):
    assert spark.createDataFrame([(text,)], "t string").select(T.stratum("t").alias("s")).first().s == stratum


def test_text_predicates(spark):
    row = spark.range(1).select(
        T.negates_memory(F.lit("Não tenho MEMÓRIA disso")).alias("a"), T.denies_record(F.lit("Não há registro")).alias("b"),
        T.disqualification(F.lit("memórias fabricadas por mim"))["any"].alias("c"), T.lacks_context(F.lit("não tenho contexto anterior")).alias("d"),
        T.is_trivial_summary(F.lit("[session_summary] **Tópicos abordados:** nada"), F.lit("session_summary")).alias("e"),
        T.is_trivial_summary(F.lit("[session_summary] Sobre indexação GIN no PostgreSQL:"), F.lit("session_summary")).alias("f"),
        T.reuses_verbatim(F.lit("ele disse: uma frase bem comprida aqui"), F.lit("UMA  frase bem comprida mesmo")).alias("g"),
        T.truncate(F.lit("uma frase longa demais"), 10).alias("h"),
    ).first()
    assert tuple(row) == (True, True, True, True, True, False, True, "uma frase…")


def test_negation(spark):
    rows = spark.createDataFrame([("O sistema usa cache",), ("Cache rapido",)], "t string").select(negate("t").alias("n")).collect()
    assert [tuple(r.n) for r in rows] == [("O sistema usa nao cache", "verbo:usa"), ("Nao e verdade que Cache rapido", "prefixo")]


def test_blind_verifier_cannot_separate_swapped(spark):
    rows = [(i, str(i), f"claim number {'x' * i} alpha", f"text {i} claim alpha") for i in range(1, 6)]
    scored = C.score_pairs(C.claim_pairs(C.claim_universe(spark.createDataFrame(rows, "seq long, id string, claim string, text string"))))
    sep = {(r.verifier, r.below): r.separates for r in C.separations(scored).collect()}
    assert sep["cego", "trocada"] is False
    assert scored.groupBy("stratum").count().count() == 3


def test_divergent_groups_leave_the_matrix(spark):
    rows = [(1, "a", "s1", "o", "Q", "R", "VENENO_X"), (2, "b", "s2", "o", "q ", "r", "LEGITIMO"), (3, "c", "s1", "o", "z", "z", "VENENO_X"), (4, "d", "s3", "o", "Z", " z", "")]
    labels = spark.createDataFrame(rows, "seq long, id string, store string, origem string, query string, resposta string, rotulo string")
    feats = spark.createDataFrame([("a", True), ("c", None)], "id string, flag boolean")
    g = {r.id: r for r in L.label_groups(labels).collect()}
    assert g["a"].divergent and g["a"].label is None and g["c"].stores == "s1|s3"
    m = L.confusion(L.judged_pairs(labels, feats, "not flag")).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (1, 0, 0, 0)
    assert {r.id: r.rotulo for r in L.propagate_labels(labels).collect()}["d"] == "VENENO_X"


def test_window_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "q", None, ["a", "b", "c"], "r1")], "i int, system string, query string, anchors array<string>, retrieval array<string>, recent string")
    out = {r.condition: r for r in W.apply_plan(df, [
        {"rotulo": "n", "formato": "neutra"}, {"rotulo": "m", "formato": "lost_in_middle", "params": {"posicao": "meio"}},
        {"rotulo": "f", "formato": "fato_em_camada", "params": {"mapa": {"system": "9h"}}}, {"rotulo": "z", "formato": "ruido_dominante", "params": {"n": 0}},
    ]).collect()}
    assert out["n"].system == "" and out["n"].recent == ["r1"] and out["n"].anchors == []
    assert out["m"].retrieval == ["b", "a", "c"] and out["f"].system == "[fato do sistema] A reunião é às 9h." and out["z"].retrieval == ["a", "b", "c"]
    empty = W.apply_plan(df.withColumn("retrieval", F.array().cast("array<string>")), [{"rotulo": "x", "formato": "lost_in_middle"}]).first()
    assert empty.retrieval == [] and empty.patch["aplicado"] == "false"
    with pytest.raises(ValueError):
        W.apply_plan(df, [{"rotulo": "x", "formato": "nope"}])


def test_parts_of_a_search_do_not_follow_its_blocks(spark):
    import random

    from plumbline.operators import search as Q

    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)] if i % 10 else [1.0, *[0.0] * 5]) for i in range(220)]
    q, c = spark.createDataFrame(rows, "seq long, vec array<double>"), spark.createDataFrame(rows, "id long, vec array<double>")
    # 220 blocks of one row were 220 copies of every vector.
    assert Q._parts(q, 1) == Q._parts(c, 7) == Q.CELL_PARTS and Q._parts(c, 200) == 2 and Q._parts(c.limit(0), 1) == 1
    one = Q.cosine_topk(q, c, 5, exclude_self=True)
    assert sorted(one.collect()) == sorted(Q.cosine_topk(q, c, 5, exclude_self=True, broadcast_queries=0, block_rows=1).collect())


def test_terms_of_a_text_stay_columns(spark):
    from types import SimpleNamespace

    import pyarrow as pa

    from plumbline.operators import search as Q

    out = pa.schema([("seq", pa.int64()), ("id", pa.int64()), ("bm25", pa.float64())])
    terms = pa.array([[{"term": "a", "g": 1.0}, {"term": "b", "g": 0.5}], [], [{"term": "z", "g": 9.0}], [{"term": "b", "g": 2.0}]], pa.list_(pa.struct([("term", pa.string()), ("g", pa.float64())])))
    batch = pa.RecordBatch.from_arrays([pa.array([4, 3, 2, 1]), terms], ["id", "terms"])
    found = list(Q._bm25_best(SimpleNamespace(value=[(7, ["a", "b"]), (8, ["b"]), (9, ["no"])]), 1, out, iter([batch.slice(0, 2), batch.slice(2, 2)])))
    assert [r for b in found for r in b.to_pylist()] == [{"seq": 7, "id": 1, "bm25": 2.0}, {"seq": 8, "id": 1, "bm25": 2.0}]


def test_dominance_takes_one_exchange_for_hits_and_targets(spark):
    from pyspark.sql import functions as F

    from plumbline.operators import ranking as K

    hits = [(1, "a", 1, True), (1, "b", 2, True), (1, None, 3, True), (1, "b", 6, False), (2, "a", 1, True), (2, None, 2, None), (3, None, 1, False), (None, "a", 1, True)]
    rows = spark.createDataFrame(hits, "seq long, id string, pos int, f boolean").repartition(3)
    targets = spark.createDataFrame([(1, "b"), (1, "b"), (1, "q"), (3, None), (4, "a"), (None, "a")], "seq long, id string")
    out = K.dominance(rows, F.col("f"), targets)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.seq: (r.n_results, r.flag5, r.slots5, r.flag10, r.slots10, r.target_rank, r.resolved, r.target_expelled, r.flagged_above) for r in out.collect()}
    assert got == {
        1: (4, 3, 3, 3, 4, 2, True, False, 1), 2: (2, 1, 2, 1, 2, None, False, False, 1), 3: (1, 0, 1, 0, 1, None, True, True, 0), None: (1, 1, 1, 1, 1, None, False, False, 1),
    }
    assert "target_rank" not in K.dominance(rows.drop("id"), F.col("f")).columns


def test_the_control_moves_whole_field_lists(spark):
    from plumbline.operators import ranking as K

    rows = [(1, 1, 0.5, "red gear", ["red ring"], "tool"), (1, 2, 0.4, "blue pin", [], None), (1, 3, 0.3, "tool ring", ["blue gear", "pin"], "tool"), (2, 1, 0.2, "tool", None, "tool")]
    pool = spark.createDataFrame(rows, "seq long, pos int, score double, query string, concepts array<string>, domain string")
    got = {(r.seq, r.base_pos): r.overlap for r in K.rerank(pool, wrong_field=True).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 0.5, (1, 3): 2 / 3, (2, 1): 1.0}


def test_pools_are_spread_over_tasks(spark):
    from plumbline.catalog.search import pools

    assert pools(spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("p")).distinct().count() > 1
