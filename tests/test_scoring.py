"""Planted run logs, concluded values, verdict cascades."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import values as V
from plumbline.functions.hashing import comparability_hash
from plumbline.functions.stats import separated, within, wilson
from plumbline.operators import scoring as S
from plumbline.plans import studies
from plumbline.plans.cascade import Check, decide, steps_table
from plumbline.sources import runs as R

LAYERS = {
    "base_system": {"kind": "baseline", "layers": {"system": "14h30"}},
    "conflito_A": {"kind": "conflito", "layers": {"system": "14h30", "retrieval": "15h", "recent": "16h"}},
    "ablacao_total": {"kind": "ablacao", "layers": {}},
}


def test_wilson(spark):
    rows = spark.createDataFrame([(0, 0), (3, 5), (5, 5)], "k long, n long").withColumn("ci", wilson("k", "n")).collect()
    assert tuple(rows[0].ci) == (0.0, 0.0)
    assert rows[1].ci.lo == pytest.approx(0.2307, abs=1e-4) and rows[1].ci.hi == pytest.approx(0.8824, abs=1e-4)
    assert rows[2].ci.hi == 1.0


def test_equivalence_and_separation(spark):
    row = spark.range(1).select(within(F.lit(0.95), F.lit(1.05), 0.1).alias("a"), within(F.lit(0.85), F.lit(1.0), 0.1).alias("b"), separated(F.lit(0.3), F.lit(0.2)).alias("c")).first()
    assert tuple(row) == (True, False, True)


@pytest.mark.parametrize(
    "text,value",
    [
        ("nada", None),
        ("A reunião é às 14 h 30.", "14h30"),
        ("Há 14h30 e 16h. A conclusão é 16h.", "16h"),
        ("Diz 15h. Depois 14h30 ou 16h", None),
        ("às 15h30", None),
        ("às 15h00", "15h"),
    ],
)
def test_concluded_value(spark, text, value):
    found = V.detector(V.MEETING_TIMES)
    assert spark.createDataFrame([(text,)], "t string").select(V.concluded_value("t", found).alias("v")).first().v == value


def test_authority_tally(spark):
    rows = [("base_system", "14h30"), ("conflito_A", "são 15h"), ("conflito_A", "14h30"), ("conflito_A", "14h30 ou 16h"), ("ablacao_total", "não sei")]
    r = S.with_condition(spark.createDataFrame(rows, "condition string, text string"), LAYERS)
    got = {(x.section, x.category): x.k for x in S.authority(r, V.detector(V.MEETING_TIMES)).collect()}
    assert got == {
        ("baseline", "system"): 1, ("conflict", "system"): 1, ("conflict", "retrieval"): 1, ("conflict", "recent"): 0, ("conflict", "nenhuma"): 1,
        ("ablation", "any"): 0,
    }


def test_run_log_round_trip(spark, tmp_path):
    runs = spark.createDataFrame(
        [("r1", 1.7e9, "m", "f", ("001", "neutra", "p", False), ["14h30", "x"]), ("r2", 1.71e9, "m", "f", ("001", "neutra", "p", True), ["y"])],
        "run_id string, ts double, modelo string, formato_id string, andaime struct<experimento string, condicao_rotulo string, condicao_papel string, dry_run boolean>, respostas array<string>",
    )
    root = str(tmp_path / "log")
    R.write_runs(runs, root)
    index, blobs = R.read_runs(spark, root), R.read_blobs(spark, root)
    resp = R.responses_of(index, blobs)
    assert resp.count() == 3 and S.real_runs(resp).count() == 2
    assert R.read_runs(spark, root, since_ts=1.705e9).count() == 1
    fid = S.fidelity_by_condition(S.real_runs(resp), V.is_accepted("text")).first()
    assert (fid.n, fid.hits) == (2, 1)


def test_scaffold_hash_ignores_list_order(spark):
    df = spark.createDataFrame([(["a", "b"], "s"), (["b", "a"], "s"), (["a"], "s")], "policy_layers array<string>, code_sha string")
    h = [r.h for r in df.select(comparability_hash(None, df.columns).alias("h")).collect()]
    assert h[0] == h[1] != h[2] and len(h[0]) == 16


def test_first_failure_decides(spark):
    m = spark.createDataFrame([(1, 5, None), (2, 5, True), (3, 0, True)], "i int, n int, ok boolean")
    checks = [Check("size", "n > 1", "SMALL"), Check("flag", "ok", "NO FLAG"), Check("note", "n > 100")]
    out = {r.i: (r.verdict, r.failed_step, len(r.steps)) for r in decide(m, checks, "FINE").collect()}
    assert out == {1: ("NO FLAG", 2, 2), 2: ("FINE", None, 3), 3: ("SMALL", 1, 1)}
    assert steps_table(decide(m, checks, "FINE"), ["i"]).count() == 6


def test_dominant_category_prefers_first_on_ties(spark):
    t = spark.createDataFrame([(0, "a", 0.5, 0.4, 0.6), (1, "b", 0.5, 0.4, 0.6), (2, "c", 0.0, 0.0, 0.1)], "ord int, category string, frac double, lo double, hi double")
    row = S.dominant_category(t).first()
    assert (row.dominant, row.separated) == ("a", False)


def cost(spark, **changes):
    base = dict(missing=0, ctrl_lo=0.97, ctrl_hi=1.03, reload_share=0.0, load_lo=0.98, load_hi=1.02, half_dose=1.5, double_dose=2.0, worst_discard=0.0,
                half_lo=1.2, half_hi=1.3, double_lo=1.4)
    row = {**base, **changes}
    return studies.cost_verdict_equivalence(spark.createDataFrame([tuple(float(v) for v in row.values())], ", ".join(f"{k} double" for k in row))).first().verdict


@pytest.mark.parametrize(
    "change,verdict",
    [
        ({}, "H1 E H2 CONFIRMADAS"),
        ({"missing": 3}, "RODADA INCOMPLETA"),
        ({"ctrl_hi": 1.2}, "INSTRUMENTO INVALIDO"),
        ({"reload_share": 0.2}, "SANIDADE FALHOU (recarga real)"),
        ({"load_hi": 1.3}, "SANIDADE FALHOU (load_duration difere entre condicoes)"),
        ({"half_dose": 1.0}, "SANIDADE FALHOU (carga meio)"),
        ({"double_dose": 3.0}, "SANIDADE FALHOU (carga dobro)"),
        ({"worst_discard": 0.06}, "CONDICAO INSTAVEL"),
        ({"double_lo": 0.9}, "H0 NAO REJEITADA (instrumento nao resolve 2x)"),
        ({"half_hi": 1.5}, "H1 CONFIRMADA, H2 NAO (sem dose-resposta separada)"),
    ],
)
def test_each_sabotage_stops_at_its_step(spark, change, verdict):
    assert cost(spark, **change) == verdict


@pytest.mark.parametrize("gap,label", [(15.0, "H1 — TOPICALIDADE DOMINA"), (5.0, "H0 — PATOLOGIA"), (10.0, "MISTO")])
def test_topicality_cutoffs(spark, gap, label):
    assert studies.topicality_verdict(spark.createDataFrame([(gap, 30)], "gap_pp double, n_pairs long")).first().verdict == label
    assert studies.topicality_verdict(spark.createDataFrame([(gap, 18)], "gap_pp double, n_pairs long")).first().verdict == "SEM PODER"


def promo(spark, **changes):
    rows = {"C5/consolidate": 2, "C5/consolidate_promote_only": 2, "C6/consolidate": 0, "C6/consolidate_promote_only": 0, "C1/consolidate": 4, "C2/consolidate": 4,
            "C3/consolidate_promote_only": 0, "C4/consolidate_promote_only": 4, "C7/consolidate": 0} | {k.replace("__", "/"): v for k, v in changes.items()}
    data = [(k, v, True if k.startswith("C7") else None, True if k.startswith("C7") else None, False if k.startswith("C7") else None) for k, v in rows.items() if v is not None]
    return studies.promotion_verdict(spark.createDataFrame(data, "key string, promoted int, fused boolean, fused_promoted boolean, class_present boolean")).first()


def test_promotion_verdict(spark):
    ok = promo(spark)
    assert (ok.verdict, ok.h1, ok.h2, ok.h3, ok.h0) == ("CLASSIFICADO", True, True, True, False)
    bad = promo(spark, C5__consolidate=0)
    assert (bad.verdict, bad.failed_step, bad.h1) == ("INCONCLUSIVO", 1, None)
    assert promo(spark, C1__consolidate=None).h1 is None


def test_ablation_needs_a_signal(spark):
    schema = "k1 long, n1 long, k2 long, n2 long, without_context long, lo double, hi double"
    verdict = lambda *row: studies.ablation_slice_verdict(spark.createDataFrame([row], schema)).first().verdict
    assert verdict(0, 40, 0, 40, 0, 0.0, 0.0).startswith("SEM SINAL")
    assert verdict(1, 40, 2, 40, 3, 0.0, 0.1).startswith("INVALIDO")
    assert verdict(0, 0, 0, 40, 0, 0.0, 0.0) == "SEM DADO"
    assert verdict(1, 40, 9, 40, 0, 0.1, 0.4).startswith("A ABLACAO MOVE")
