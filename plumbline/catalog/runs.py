"""Queries on the run log and on condition scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.catalog.base import query, rounded, table
from plumbline.catalog.inputs import TURNS_SQL, conversation_turns
from plumbline.functions import values as V
from plumbline.functions.hashing import comparability_hash, month_shard
from plumbline.operators import scoring as S
from plumbline.plans import studies
from plumbline.plans.cascade import steps_table
from plumbline.session import shared_root
from plumbline.sources import runs as R

# Assistant turns stand in for responses; conditions and values are assigned by rule.
VALUES = {"14h30": "ther", "15h": "ein", "16h": "que"}
SEEN = V.detector(VALUES)
TIMES_SQL = r"regexp_replace(regexp_replace(lower({0}), '\s*h\s*', 'h', 'g'), '\s*:\s*', ':', 'g')"


def label(labels, key="conv_id"):
    chosen = F.lit(labels[-1])
    for i, name in reversed(list(enumerate(labels[:-1]))):
        chosen = F.when(F.col(key) % len(labels) == i, F.lit(name)).otherwise(chosen)
    return chosen


def label_sql(labels, key="conv_id"):
    return "CASE " + " ".join(f"WHEN {key} % {len(labels)} = {i} THEN '{n}'" for i, n in enumerate(labels)) + " END"


def responses(spark, sf_dir, labels):
    turns = conversation_turns(spark, sf_dir).filter("role = 'assistant'")
    return turns.select(
        F.concat(F.lit("run_"), F.col("conv_id").cast("string")).alias("run_id"), "seq", label(labels).alias("condition"),
        (F.col("conv_id") % 10 == 9).alias("dry_run"),
        F.when(F.col("conv_id") % 7 == 6, F.lit(None)).when(F.col("conv_id") % 3 == 0, "003").otherwise("001").alias("experiment"), "text",
    )


def responses_sql(labels):
    return f"""{TURNS_SQL}, responses AS (
      SELECT 'run_' || conv_id AS run_id, seq, {label_sql(labels)} AS condition, conv_id % 10 = 9 AS dry_run,
             CASE WHEN conv_id % 7 = 6 THEN NULL WHEN conv_id % 3 = 0 THEN '003' ELSE '001' END AS experiment, text
      FROM turns WHERE role = 'assistant'),
    seen AS (
      SELECT *, {TIMES_SQL.format('text')} AS t FROM responses),
    found AS (
      SELECT *, list_filter([CASE WHEN contains(t, 'ther') THEN '14h30' END, CASE WHEN contains(t, 'ein') THEN '15h' END,
                             CASE WHEN contains(t, 'que') THEN '16h' END], lambda x: x IS NOT NULL) AS vals FROM seen),
    single AS (SELECT *, CASE WHEN len(vals) = 1 THEN vals[1] END AS single FROM found)"""


def wilson_sql(k, n, side):
    sign = "-" if side == "lo" else "+"
    clip = "greatest(0.0, {0})" if side == "lo" else "least(1.0, {0})"
    p = f"(({k}) / CAST(({n}) AS DOUBLE))"
    value = (
        f"(({p} + 3.8416 / (2 * ({n}))) {sign} 1.96 * sqrt({p} * (1 - {p}) / ({n}) + 3.8416 / (4.0 * ({n}) * ({n}))))"
        f" / (1 + 3.8416 / ({n}))"
    )
    return f"CASE WHEN ({n}) = 0 THEN 0.0 ELSE {clip.format(value)} END"


DOSE = ["neutra", "ruido_n3", "ruido_n5", "ruido_n10", "ablacao_retrieval"]
DOSE_003 = ["neutra", "comp_1", "comp_2", "comp_3", "inert_3", "ablacao_retrieval"]
ACCEPT = ("ther", "que")


def _fidelity(spark, sf_dir, labels):
    r = S.pick_experiment(S.real_runs(responses(spark, sf_dir, labels)), "001")
    return S.fidelity_by_condition(r, V.is_accepted("text", ACCEPT))


FIDELITY_SQL = f""", fidelity AS (
  SELECT condition, count(*) AS n, count(*) FILTER (contains(t, 'ther') OR contains(t, 'que')) AS hits FROM seen
  WHERE NOT dry_run AND experiment = '001' GROUP BY condition),
scored AS (SELECT condition, n, hits, hits / n AS fidelity, {wilson_sql('hits', 'n', 'lo')} AS ci_low,
                  {wilson_sql('hits', 'n', 'hi')} AS ci_high FROM fidelity)"""


@query(
    "runs_real_vs_dry",
    f"WITH {responses_sql(DOSE)} SELECT count(*) AS n_total, count(*) FILTER (NOT dry_run) AS n_real, count(*) FILTER (dry_run) AS n_dry_run FROM responses",
)
def _(spark, sf_dir):
    return S.dry_run_split(responses(spark, sf_dir, DOSE))


@query(
    "runs_most_frequent_experiment",
    f"""WITH {responses_sql(DOSE)} SELECT experiment, count(*) AS n, min(seq) AS first_seq FROM responses
    WHERE experiment IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 1""",
)
def _(spark, sf_dir):
    return S.most_frequent_experiment(responses(spark, sf_dir, DOSE))


@query(
    "fidelity_by_condition",
    f"""WITH {responses_sql(DOSE)}{FIDELITY_SQL}
    SELECT condition, n, hits, round(fidelity, 6) AS fidelity, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM scored""",
)
def _(spark, sf_dir):
    return rounded(_fidelity(spark, sf_dir, DOSE))


@query(
    "verdict_dose_response",
    f"""WITH {responses_sql(DOSE_003)}{FIDELITY_SQL},
    o AS (SELECT * FROM (VALUES ('neutra', 0), ('comp_1', 1), ('comp_2', 2), ('comp_3', 3)) v(condition, ord)),
    steps AS (SELECT s.*, o.ord, lag(fidelity) OVER (ORDER BY o.ord) AS before FROM scored s JOIN o USING (condition)),
    flags AS (SELECT bool_and(before IS NULL OR before >= fidelity - 1e-9) AS monotone,
                     first(ci_low ORDER BY ord) > first(ci_high ORDER BY ord DESC) AS significant_drop FROM steps)
    SELECT monotone, significant_drop, monotone AND significant_drop AS confirmed,
           round((SELECT fidelity FROM scored WHERE condition = 'ablacao_retrieval'), 6) AS ablation_fidelity,
           (SELECT fidelity FROM scored WHERE condition = 'ablacao_retrieval') <= 0.05 AS setup_valid,
           (SELECT ci_high FROM scored WHERE condition = 'comp_3') < (SELECT ci_low FROM scored WHERE condition = 'inert_3') AS conflict_isolated
    FROM flags""",
)
def _(spark, sf_dir):
    scored = _fidelity(spark, sf_dir, DOSE_003)
    return rounded(S.dose_response(scored, DOSE_003[:4], "ablacao_retrieval", ("comp_3", "inert_3")))


LAYERS = {
    "base_system": {"kind": "baseline", "layers": {"system": "14h30"}},
    "base_retrieval": {"kind": "baseline", "layers": {"retrieval": "14h30"}},
    "base_recent": {"kind": "baseline", "layers": {"recent": "14h30"}},
    "conflito_A": {"kind": "conflito", "layers": {"system": "14h30", "retrieval": "15h", "recent": "16h"}},
    "conflito_B": {"kind": "conflito", "layers": {"system": "16h", "retrieval": "14h30", "recent": "15h"}},
    "conflito_C": {"kind": "conflito", "layers": {"system": "15h", "retrieval": "16h", "recent": "14h30"}},
    "ablacao_total": {"kind": "ablacao", "layers": {}},
}
AUTHORITY_SQL = f"""WITH {responses_sql(list(LAYERS))},
layer_of AS (SELECT * FROM (VALUES
  ('conflito_A', '14h30', 'system'), ('conflito_A', '15h', 'retrieval'), ('conflito_A', '16h', 'recent'),
  ('conflito_B', '16h', 'system'), ('conflito_B', '14h30', 'retrieval'), ('conflito_B', '15h', 'recent'),
  ('conflito_C', '15h', 'system'), ('conflito_C', '16h', 'retrieval'), ('conflito_C', '14h30', 'recent')) v(condition, single, layer)),
winners AS (SELECT coalesce(layer, 'nenhuma') AS winner FROM single LEFT JOIN layer_of USING (condition, single)
            WHERE condition LIKE 'conflito%'),
counted AS (
  SELECT 'baseline' AS section, 0 AS ord, replace(condition, 'base_', '') AS category, count(*) FILTER (list_contains(vals, '14h30')) AS k, count(*) AS n
  FROM single WHERE condition LIKE 'base%' GROUP BY condition
  UNION ALL SELECT 'ablation', 0, 'any', count(*) FILTER (len(vals) > 0), count(*) FROM single WHERE condition = 'ablacao_total'
  UNION ALL SELECT 'conflict', c.ord, c.category, count(*) FILTER (w.winner = c.category), count(*)
  FROM winners w CROSS JOIN (VALUES (0, 'system'), (1, 'retrieval'), (2, 'recent'), (3, 'nenhuma')) c(ord, category) GROUP BY ALL),
auth AS (SELECT *, k / n AS frac, {wilson_sql('k', 'n', 'lo')} AS lo, {wilson_sql('k', 'n', 'hi')} AS hi FROM counted)"""


def _authority(spark, sf_dir):
    return S.authority(S.with_condition(responses(spark, sf_dir, list(LAYERS)), LAYERS), SEEN)


@query(
    "layer_authority",
    f"""{AUTHORITY_SQL} SELECT section, CAST(ord AS BIGINT) AS ord, category, k, n, round(frac, 6) AS frac, round(lo, 6) AS lo,
    round(hi, 6) AS hi FROM auth""",
)
def _(spark, sf_dir):
    return rounded(_authority(spark, sf_dir))


DOMINANT_SQL = """, top AS (SELECT * FROM auth WHERE section = 'conflict' ORDER BY frac DESC, ord LIMIT 1),
dom AS (SELECT category AS dominant, lo > (SELECT max(hi) FROM auth WHERE section = 'conflict' AND ord <> top.ord) AS separated FROM top)"""


@query(
    "verdict_layer_authority",
    f"""{AUTHORITY_SQL}{DOMINANT_SQL},
    m AS (SELECT (SELECT min(frac) FROM auth WHERE section = 'baseline') AS worst_baseline,
                 (SELECT max(frac) FROM auth WHERE section = 'ablation') AS ablation, dominant, separated FROM dom)
    SELECT round(worst_baseline, 6) AS worst_baseline, round(ablation, 6) AS ablation, dominant, separated,
           CASE WHEN worst_baseline < 0.7 THEN 'SETUP INVALIDO' WHEN ablation > 0.10 THEN 'SETUP INVALIDO'
                WHEN dominant = 'nenhuma' THEN 'RECUSA DOMINANTE' WHEN NOT separated THEN 'SEM HIERARQUIA'
                ELSE 'VENCEDORA: ' || dominant END AS verdict
    FROM m""",
)
def _(spark, sf_dir):
    return rounded(studies.layer_verdict(_authority(spark, sf_dir)).drop("steps", "failed_step"))


A_, B_ = "14h30", "15h"
MAJORITY = {
    "unanime_14h30": {"kind": "unanime", "majority": A_, "recency": A_},
    "unanime_15h": {"kind": "unanime", "majority": B_, "recency": B_},
    "conflito_maioriaA": {"kind": "conflito", "majority": A_, "recency": B_},
    "conflito_maioriaB": {"kind": "conflito", "majority": B_, "recency": A_},
    "empate_recente_A": {"kind": "empate", "majority": A_, "recency": A_},
    "empate_recente_B": {"kind": "empate", "majority": B_, "recency": B_},
    "ablacao": {"kind": "ablacao", "majority": None, "recency": None},
}
MAJORITY_SQL = f"""WITH {responses_sql(list(MAJORITY))},
meta AS (SELECT *, CASE WHEN condition IN ('unanime_14h30', 'conflito_maioriaA', 'empate_recente_A') THEN '14h30'
                        WHEN condition <> 'ablacao' THEN '15h' END AS majority,
                   CASE WHEN condition IN ('unanime_14h30', 'conflito_maioriaB', 'empate_recente_A') THEN '14h30'
                        WHEN condition <> 'ablacao' THEN '15h' END AS recency FROM single),
cats AS (SELECT * FROM (VALUES ('conflict', 0, 'maioria'), ('conflict', 1, 'recencia'), ('conflict', 2, 'nenhuma'),
  ('tie', 0, 'segue_recente'), ('tie', 1, 'segue_outro'), ('tie', 2, 'nenhuma')) v(section, ord, category)),
won AS (
  SELECT 'conflict' AS section, CASE WHEN single = majority THEN 'maioria' WHEN single = recency THEN 'recencia' ELSE 'nenhuma' END AS cat
  FROM meta WHERE condition LIKE 'conflito%'
  UNION ALL SELECT 'tie', CASE WHEN single = recency THEN 'segue_recente'
    WHEN single = CASE recency WHEN '14h30' THEN '15h' ELSE '14h30' END THEN 'segue_outro' ELSE 'nenhuma' END
  FROM meta WHERE condition LIKE 'empate%'),
counted AS (
  SELECT section, ord, category, count(*) FILTER (cat = category) AS k, count(*) AS n FROM won JOIN cats USING (section) GROUP BY ALL
  UNION ALL SELECT 'baseline', 0, condition, count(*) FILTER (list_contains(vals, majority)), count(*) FROM meta WHERE condition LIKE 'unanime%' GROUP BY condition
  UNION ALL SELECT 'ablation', 0, 'any', count(*) FILTER (len(vals) > 0), count(*) FROM meta WHERE condition = 'ablacao'),
auth AS (SELECT *, k / n AS frac, {wilson_sql('k', 'n', 'lo')} AS lo, {wilson_sql('k', 'n', 'hi')} AS hi FROM counted)"""


def _majority(spark, sf_dir):
    r = S.with_condition(responses(spark, sf_dir, list(MAJORITY)), MAJORITY)
    return S.majority_vs_recency(r, SEEN, {A_: B_, B_: A_})


@query(
    "majority_vs_recency",
    f"""{MAJORITY_SQL} SELECT section, CAST(ord AS BIGINT) AS ord, category, k, n, round(frac, 6) AS frac, round(lo, 6) AS lo,
    round(hi, 6) AS hi FROM auth""",
)
def _(spark, sf_dir):
    return rounded(_majority(spark, sf_dir))


@query(
    "verdict_majority_vs_recency",
    f"""{MAJORITY_SQL}{DOMINANT_SQL},
    m AS (SELECT (SELECT min(frac) FROM auth WHERE section = 'baseline') AS worst_baseline,
                 (SELECT max(frac) FROM auth WHERE section = 'ablation') AS ablation, dominant, separated FROM dom)
    SELECT round(worst_baseline, 6) AS worst_baseline, round(ablation, 6) AS ablation, dominant, separated,
           CASE WHEN worst_baseline < 0.7 THEN 'SETUP INVALIDO' WHEN ablation > 0.10 THEN 'SETUP INVALIDO'
                WHEN dominant = 'nenhuma' THEN 'RECUSA DOMINANTE' WHEN NOT separated THEN 'SEM HIERARQUIA'
                ELSE 'VENCEDORA: ' || dominant END AS verdict
    FROM m""",
)
def _(spark, sf_dir):
    return rounded(studies.majority_verdict(_majority(spark, sf_dir)).drop("steps", "failed_step"))


DATES = {
    "acoplada": {"kind": "teto", "newest": B_, "last": B_},
    "desacoplada_B": {"kind": "desacoplada", "newest": B_, "last": A_},
    "desacoplada_A": {"kind": "desacoplada", "newest": A_, "last": B_},
    "sem_trajetoria": {"kind": "piso", "newest": A_, "last": A_},
}
CONCLUDED_SQL = """, sentences AS (
  SELECT seq, generate_subscripts(parts, 1) AS i, unnest(parts) AS s FROM (
    SELECT seq, regexp_split_to_array(text, '[.!?\n]+') AS parts FROM responses)),
per_sentence AS (
  SELECT seq, i, list_filter([CASE WHEN contains(t, 'ther') THEN '14h30' END, CASE WHEN contains(t, 'ein') THEN '15h' END,
                              CASE WHEN contains(t, 'que') THEN '16h' END], lambda x: x IS NOT NULL) AS vals
  FROM (SELECT seq, i, """ + TIMES_SQL.format("s") + """ AS t FROM sentences)),
last_named AS (SELECT seq, arg_max(vals, i) AS vals FROM per_sentence WHERE len(vals) > 0 GROUP BY seq),
concluded AS (
  SELECT r.*, CASE WHEN len(r.vals) = 1 THEN r.vals[1] WHEN len(r.vals) > 1 AND len(l.vals) = 1 THEN l.vals[1] END AS done
  FROM single r LEFT JOIN last_named l USING (seq))"""
DATES_SQL = f"""WITH {responses_sql(list(DATES))}{CONCLUDED_SQL},
meta AS (SELECT *, CASE condition WHEN 'acoplada' THEN 'teto' WHEN 'sem_trajetoria' THEN 'piso' ELSE 'desacoplada' END AS kind,
                CASE WHEN condition IN ('acoplada', 'desacoplada_B') THEN '15h' ELSE '14h30' END AS newest,
                CASE WHEN condition IN ('acoplada', 'desacoplada_A') THEN '15h' ELSE '14h30' END AS "last" FROM concluded),
per_condition AS (
  SELECT condition, kind, count(*) AS n, count(*) FILTER (done = newest) AS k_newest,
         count(*) FILTER (done = "last" AND done <> newest) AS k_last,
         count(*) FILTER (done IS NULL OR (done <> newest AND done <> "last")) AS k_exposed,
         count(*) FILTER (done IS NULL AND (contains(lower(text), 'the') OR contains(lower(text), 'der'))) AS k_doubt
  FROM meta GROUP BY condition, kind)"""


def _dates(spark, sf_dir):
    r = S.with_condition(responses(spark, sf_dir, list(DATES)), DATES)
    return S.date_vs_position(r, SEEN, ("the", "der"))


@query("date_vs_position", f"{DATES_SQL} SELECT condition, kind, n, k_newest, k_last, k_exposed, k_doubt FROM per_condition")
def _(spark, sf_dir):
    return rounded(_dates(spark, sf_dir))


@query(
    "verdict_date_vs_position",
    f"""{DATES_SQL},
    core AS (SELECT sum(k_newest) AS a, sum(k_last) AS b, sum(k_exposed) AS c, sum(k_newest + k_last + k_exposed) AS n
             FROM per_condition WHERE kind = 'desacoplada'),
    counted AS (SELECT 'conflict' AS section, 0 AS ord, 'data_nova' AS category, a AS k, n FROM core
                UNION ALL SELECT 'conflict', 1, 'ultima_posicao', b, n FROM core UNION ALL SELECT 'conflict', 2, 'exposicao', c, n FROM core),
    auth AS (SELECT *, k / n AS frac, {wilson_sql('k', 'n', 'lo')} AS lo, {wilson_sql('k', 'n', 'hi')} AS hi FROM counted){DOMINANT_SQL},
    m AS (SELECT a / n AS f_data_nova, b / n AS f_ultima_posicao, c / n AS f_exposicao, dominant, separated,
                 (SELECT k_newest / n FROM per_condition WHERE condition = 'acoplada') AS ceiling_hit,
                 (SELECT k_exposed / n FROM per_condition WHERE condition = 'acoplada') AS ceiling_exposed FROM core, dom)
    SELECT round(f_data_nova, 6) AS f_data_nova, round(f_ultima_posicao, 6) AS f_ultima_posicao, round(f_exposicao, 6) AS f_exposicao,
           dominant, separated, round(ceiling_hit, 6) AS ceiling_hit, round(ceiling_exposed, 6) AS ceiling_exposed, separated AS stable,
           ceiling_hit >= 0.7 AND ceiling_exposed <= 0.20 AS setup_valid,
           CASE WHEN separated AND dominant = 'data_nova' THEN 'H1 (data vence)'
                WHEN separated AND dominant = 'ultima_posicao' THEN 'H2 (posicao vence) — SISMICO'
                WHEN separated THEN 'exposição domina (H4)'
                WHEN f_data_nova >= 0.25 AND f_ultima_posicao >= 0.25 AND f_exposicao < 0.20 THEN 'H3 (mistura)'
                ELSE 'inconclusivo (sem dominancia, sem limiar H3)' END AS verdict
    FROM m""",
)
def _(spark, sf_dir):
    return rounded(studies.date_position_verdict(_dates(spark, sf_dir)))


INJECT = ["legit_only", "conflito_dados", "inj_imperativa", "inj_autoridade", "inj_persona", "ablacao"]
INJECT_SQL = f"""WITH {responses_sql(INJECT)}{CONCLUDED_SQL},
k AS (SELECT condition, count(*) AS n, count(*) FILTER (done = '15h') AS k_h, count(*) FILTER (done = '14h30') AS k_l,
             count(*) FILTER (done IS NULL) AS k_n FROM concluded GROUP BY condition),
outcomes AS (SELECT condition, n, k_h / n AS hijack, {wilson_sql('k_h', 'n', 'lo')} AS hijack_lo, {wilson_sql('k_h', 'n', 'hi')} AS hijack_hi,
                    k_l / n AS legit, k_n / n AS exposed FROM k)"""


def _injection(spark, sf_dir):
    return S.injection_outcomes(responses(spark, sf_dir, INJECT), SEEN, A_, B_)


@query(
    "injection_outcomes",
    f"""{INJECT_SQL} SELECT condition, n, round(hijack, 6) AS hijack, round(hijack_lo, 6) AS hijack_lo, round(hijack_hi, 6) AS hijack_hi,
    round(legit, 6) AS legit, round(exposed, 6) AS exposed FROM outcomes""",
)
def _(spark, sf_dir):
    return rounded(_injection(spark, sf_dir))


@query(
    "verdict_injection",
    f"""{INJECT_SQL},
    b AS (SELECT * FROM outcomes WHERE condition = 'conflito_dados'), v AS (
      SELECT coalesce(string_agg(condition, ',' ORDER BY condition), '') AS vulnerable_to, count(*) AS n_v FROM outcomes
      WHERE condition LIKE 'inj%' AND hijack_lo > (SELECT hijack_hi FROM b))
    SELECT round(b.hijack, 6) AS baseline_hijack, vulnerable_to, n_v > 0 AS vulnerable,
           (SELECT legit >= 0.9 FROM outcomes WHERE condition = 'legit_only')
           AND (SELECT hijack <= 0.05 AND legit <= 0.05 FROM outcomes WHERE condition = 'ablacao') AS setup_valid
    FROM b, v""",
)
def _(spark, sf_dir):
    return rounded(studies.injection_verdict(_injection(spark, sf_dir), INJECT[2:5]))


@query(
    "response_signals_by_condition",
    f"""WITH {responses_sql(DOSE)}, s AS (
      SELECT condition, length(text) AS c, contains(lower(text), 'redis') OR contains(lower(text), 'tion') AS noise,
             contains(lower(text), 'perhaps') OR contains(lower(text), 'un ') AS unc,
             regexp_extract_all(t, '(re[a-z]h|[st]h[a-z])', 1) AS times, contains(t, 'ther') OR contains(t, 'que') AS acc FROM seen)
    SELECT condition, count(*) AS n, round(avg(c), 6) AS mean_chars, round(avg(noise::INT), 6) AS share_mentions_noise,
           round(avg(unc::INT), 6) AS share_uncertain,
           round(avg((len(list_filter(times, lambda x: NOT contains(x, 'ther') AND NOT contains(x, 'que'))) > 0)::INT), 6) AS share_wrong_value,
           round(avg(acc::INT), 6) AS share_accepted
    FROM s GROUP BY condition""",
)
def _(spark, sf_dir):
    return rounded(
        S.signals_by_condition(
            responses(spark, sf_dir, DOSE), accepted=ACCEPT, noise=("redis", "tion"), uncertainty=("perhaps", "un "),
            value_pattern="(re[a-z]h|[st]h[a-z])",
        )
    )


@query(
    "category_reading_samples",
    f"""WITH {responses_sql(DOSE)}, r AS (SELECT seq, condition, row_number() OVER (PARTITION BY condition ORDER BY seq) AS rank,
      count(*) OVER (PARTITION BY condition) AS category_n, count(*) OVER () AS total FROM responses)
    SELECT condition, seq, rank, category_n, round(category_n / total, 6) AS category_share FROM r WHERE rank <= 3""",
)
def _(spark, sf_dir):
    s = S.category_samples(responses(spark, sf_dir, DOSE), "condition", "seq", 3)
    return rounded(s.select("condition", "seq", "rank", "category_n", "category_share"))


def samples(spark, sf_dir):
    """Order lines as model calls: cost from the discount, failures from the tax."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), (F.col("l_tax") < 0.07).alias("ok"), F.concat("l_returnflag", "l_linestatus").alias("text"),
        (F.col("l_discount") / 10).alias("cost_usd"),
    )


@query(
    "sample_distribution",
    """SELECT l_orderkey AS run_id, count(*) AS n_run, count(*) FILTER (l_tax < 0.07) AS n_ok, count(*) FILTER (NOT l_tax < 0.07) AS n_err,
       count(DISTINCT CASE WHEN l_tax < 0.07 THEN l_returnflag || l_linestatus END) AS "distinct",
       coalesce(min(CASE WHEN l_tax < 0.07 THEN 2 END), 0)::BIGINT AS len_min, coalesce(max(CASE WHEN l_tax < 0.07 THEN 2 END), 0)::BIGINT AS len_max,
       round(coalesce(avg(CASE WHEN l_tax < 0.07 THEN 2 END), 0.0), 6) AS len_mean, round(sum(l_discount / 10), 6) AS cost_total_usd
       FROM lineitem GROUP BY l_orderkey""",
)
def _(spark, sf_dir):
    return rounded(S.sample_stats(samples(spark, sf_dir)))


def run_table(spark, sf_dir):
    """Orders as runs with two responses each."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run_"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("ts"), F.col("o_orderpriority").alias("modelo"),
        F.col("o_orderstatus").alias("formato_id"),
        F.struct(
            F.lit("001").alias("experimento"), F.col("o_orderstatus").alias("condicao_rotulo"), F.lit("papel").alias("condicao_papel"),
            (F.col("o_orderkey") % 5 == 0).alias("dry_run"), F.col("o_orderpriority").alias("model_version"),
            F.array(F.col("o_orderstatus"), F.lit("base")).alias("policy_layers"),
        ).alias("andaime"),
        F.concat(F.lit("window "), F.col("o_custkey").cast("string")).alias("janela_enviada"),
        F.array(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("respostas"),
    )


@query(
    "run_log_index_filter",
    """SELECT 'run_' || o_orderkey AS run_id, o_orderpriority AS modelo, strftime(o_orderdate, '%Y-%m') AS month, 2::BIGINT AS n_amostras,
       strftime(o_orderdate, '%Y-%m') || '/run_' || o_orderkey || '.json' AS blob_ref
       FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2000-01-01'""",
)
def _(spark, sf_dir):
    index, _blobs = R.split_runs(run_table(spark, sf_dir))
    kept = R.filter_runs(index, formato_id="F", since_ts=946684800.0)
    return rounded(kept.select("run_id", "modelo", "month", "n_amostras", "blob_ref"))


@query(
    "run_log_comparable_groups",
    """SELECT substr(sha256('{"code_sha": null, "embedding_version": null, "model_version": "' || o_orderpriority || '", "policy_layers": ["' || o_orderstatus || '", "base"], '
         || '"prompt_version": null, "skills_loaded": null, "tools_available": null}'), 1, 16) AS andaime_hash, count(*) AS n_runs FROM orders GROUP BY o_orderpriority, o_orderstatus""",
)
def _(spark, sf_dir):
    index, _blobs = R.split_runs(run_table(spark, sf_dir))
    return index.groupBy("andaime_hash").agg(F.count(F.lit(1)).alias("n_runs"))


@query(
    "run_log_round_trip",
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_runs, count(DISTINCT o_orderpriority) AS n_models, CAST(sum(length('window ' || o_custkey)) AS BIGINT) AS n_chars
       FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1""",
)
def _(spark, sf_dir):
    """The log is written, its index read back by month and joined to its blobs."""
    root = f"{shared_root(spark)}/run-log-{uuid.uuid4().hex}"
    R.write_runs(run_table(spark, sf_dir), root)
    recent = R.with_blobs(R.read_runs(spark, root, since_ts=852076800.0).select("run_id", "month"), R.read_blobs(spark, root).drop("month"))
    return recent.groupBy("month").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_distinct("modelo").alias("n_models"), F.sum(F.length("janela_enviada")).cast("long").alias("n_chars")
    )


@query(
    "run_log_responses",
    """SELECT 'run_' || o_orderkey AS run_id, i, '001' AS experiment, o_orderstatus AS condition, o_orderkey % 5 = 0 AS dry_run,
       CASE i WHEN 0 THEN o_orderpriority ELSE o_orderstatus END AS text FROM orders, (VALUES (0::BIGINT), (1::BIGINT)) v(i)""",
)
def _(spark, sf_dir):
    index, blobs = R.split_runs(run_table(spark, sf_dir))
    return rounded(R.responses_of(index, blobs).drop("role"))


@query(
    "run_log_stats",
    """WITH b AS (SELECT l_orderkey AS k, 'lines ' || count(*) AS w FROM lineitem GROUP BY 1),
    p AS (SELECT o_orderkey, o_orderdate, b.k, b.w FROM orders FULL JOIN b ON b.k = o_orderkey)
    SELECT count(o_orderkey) AS n_index, count(k) AS n_blobs, count(o_orderkey) AS n_runs,
           count(*) FILTER (k IS NULL) AS index_without_blob, count(*) FILTER (o_orderkey IS NULL) AS blob_without_index,
           CAST(sum(length(w)) AS BIGINT) AS blob_chars, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS n_months FROM p""",
)
def _(spark, sf_dir):
    """Orders without lines have no blob."""
    index, _blobs = R.split_runs(run_table(spark, sf_dir))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    blobs = lines.select(
        F.concat(F.lit("run_"), F.col("l_orderkey").cast("string")).alias("run_id"),
        F.concat(F.lit("lines "), F.col("n").cast("string")).alias("janela_enviada"),
    )
    return R.run_stats(index, blobs)


@query("month_shards", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf_dir):
    ts = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").groupBy(month_shard(ts).alias("month")).agg(F.count(F.lit(1)).alias("n"))
