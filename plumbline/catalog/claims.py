"""Queries on claim support."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, rounded
from plumbline.catalog.inputs import TURNS_SQL, conversation_turns
from plumbline.catalog.runs import wilson_sql
from plumbline.functions import text as T
from plumbline.functions.claims import NEGATABLE_VERBS
from plumbline.functions.text import CLAIM_STOPWORDS
from plumbline.operators import claims as C
from plumbline.operators.memory import with_predecessor
from plumbline.plans import studies
from plumbline.plans.cascade import steps_table
from plumbline.session import checkpointed


def _quoted(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def entries(spark, sf_dir):
    """An assistant turn as the text, the turn before it as the claim."""
    turns = conversation_turns(spark, sf_dir)
    return with_predecessor(turns, text="text").filter("role = 'assistant'").select(
        "seq", F.col("seq").cast("string").alias("id"), F.col("predecessor").alias("claim"), "text"
    )


TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^0-9A-Za-zÀ-ÿ]+'), lambda t: length(t) >= 3 AND NOT list_contains(" + _quoted(
    CLAIM_STOPWORDS
) + ", t)))"
UNIVERSE_SQL = f"""WITH {TURNS_SQL},
prior AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS claim FROM turns),
universe AS (SELECT seq, CAST(seq AS VARCHAR) AS id, trim(claim) AS claim, trim(text) AS text,
                    row_number() OVER (ORDER BY seq) - 1 AS i, count(*) OVER () AS n
             FROM prior WHERE role = 'assistant' AND trim(claim) <> '' AND trim(text) <> ''),
worded AS (SELECT *, list_filter(regexp_split_to_array(claim, '\\s+'), lambda w: w <> '') AS words FROM universe),
bared AS (SELECT *, list_transform(words, lambda w: lower(regexp_replace(w, '[^0-9A-Za-zÀ-ÿ]', '', 'g'))) AS bare FROM worded),
verbed AS (SELECT *, list_filter(bare, lambda w: list_contains({_quoted(NEGATABLE_VERBS)}, w))[1] AS verb FROM bared),
placed AS (SELECT *, list_position(bare, verb) AS p FROM verbed),
negated AS (SELECT *, CASE WHEN verb IS NULL THEN 'Nao e verdade que ' || claim
                      ELSE array_to_string(list_concat(list_concat(words[1:p], ['nao']), words[p + 1:]), ' ') END AS neg,
                   CASE WHEN verb IS NULL THEN 'prefixo' ELSE 'verbo:' || verb END AS neg_rule FROM placed),
pairs AS (
  SELECT seq, 'suportada' AS stratum, claim, text, id AS text_id, true AS truth, '' AS rule FROM negated
  UNION ALL SELECT a.seq, 'trocada', a.claim, b.text, b.id, false, '' FROM negated a JOIN negated b ON b.i = (a.i + 1) % a.n
  UNION ALL SELECT seq, 'negada', neg, text, id, false, neg_rule FROM negated),
tok AS (SELECT *, {TOKENS.format('claim')} AS ct, {TOKENS.format('text')} AS tt FROM pairs),
lex AS (SELECT *, round(len(ct) / 100.0, 6) AS score_cego,
               round(CASE WHEN len(ct) = 0 THEN 0.0 ELSE len(list_intersect(ct, tt)) / len(ct) END, 6) AS score_lexico FROM tok),
scored AS (SELECT *, CASE WHEN regexp_matches(claim, '(?i)\\b(nao|não|not|nicht|no|ne|pas)\\b') <> regexp_matches(text, '(?i)\\b(nao|não|not|nicht|no|ne|pas)\\b')
                          THEN 0.0 ELSE score_lexico END AS score_lexico_negacao FROM lex)"""


def _scored(spark, sf_dir):
    return C.score_pairs(C.claim_pairs(C.claim_universe(entries(spark, sf_dir))))


@query("claim_pairs", f"{UNIVERSE_SQL} SELECT seq, stratum, claim, text_id, truth, rule FROM pairs")
def _(spark, sf_dir):
    return C.claim_pairs(C.claim_universe(entries(spark, sf_dir))).drop("text")


@query("claim_scores", f"{UNIVERSE_SQL} SELECT seq, stratum, score_cego, score_lexico, score_lexico_negacao FROM scored")
def _(spark, sf_dir):
    return _scored(spark, sf_dir).select("seq", "stratum", "score_cego", "score_lexico", "score_lexico_negacao")


SEPARATION_SQL = UNIVERSE_SQL + """, long AS (
  SELECT stratum, 'cego' AS verifier, score_cego AS s FROM scored UNION ALL SELECT stratum, 'lexico', score_lexico FROM scored
  UNION ALL SELECT stratum, 'lexico_negacao', score_lexico_negacao FROM scored),
sep AS (
  SELECT verifier, 'suportada' AS above, below, min(s) FILTER (stratum = 'suportada') AS min_above, max(s) FILTER (stratum = below) AS max_below
  FROM long CROSS JOIN (VALUES ('trocada'), ('negada')) b(below) GROUP BY verifier, below)"""


@query(
    "claim_separation",
    f"""{SEPARATION_SQL} SELECT verifier, above, below, min_above, max_below, min_above > max_below AS separates,
    round(min_above - max_below, 6) AS margin FROM sep""",
)
def _(spark, sf_dir):
    return rounded(C.separations(_scored(spark, sf_dir)))


@query(
    "verdict_claim_support",
    f"""{SEPARATION_SQL}, f AS (SELECT verifier, below, min_above > max_below AS sp FROM sep),
    m AS (SELECT bool_or(sp) FILTER (verifier = 'cego' AND below = 'trocada') AS b_sw, bool_or(sp) FILTER (verifier = 'cego' AND below = 'negada') AS b_ng,
                 bool_or(sp) FILTER (verifier = 'lexico' AND below = 'trocada') AS h1, NOT bool_or(sp) FILTER (verifier = 'lexico' AND below = 'negada') AS h2,
                 NOT bool_or(sp) FILTER (verifier = 'lexico_negacao' AND below = 'negada') AS h3 FROM f)
    SELECT expected, h1, h2, h3, CASE WHEN b_sw THEN 'INSTRUMENTO INVALIDO' WHEN b_ng THEN 'ESTRATO negada CONFUNDIDO'
      WHEN expected = 'published' AND (SELECT count(*) FROM universe) <> 16 THEN 'DATASET INCOMPLETO' WHEN h1 AND h2 AND h3 THEN 'TODAS CONFIRMADAS (H1+H2+H3)'
      ELSE 'PARCIAL — confirmadas: ' || coalesce(nullif(concat_ws(', ', CASE WHEN h1 THEN 'H1' END, CASE WHEN h2 THEN 'H2' END, CASE WHEN h3 THEN 'H3' END), ''), 'nenhuma') END AS verdict
    FROM m CROSS JOIN (VALUES ('published'), ('whole')) e(expected)""",
)
def _(spark, sf_dir):
    """Against the published number of claims, and against that of the table, which lets the hypotheses decide."""
    metrics = checkpointed(C.claim_metrics(_scored(spark, sf_dir)))
    rows = [studies.claim_verdict(metrics, n).select(F.lit(name).alias("expected"), "h1", "h2", "h3", "verdict") for name, n in (("published", 16), ("whole", "n_suportada"))]
    return rows[0].unionByName(rows[1])


@query(
    "claim_verdict_steps",
    f"""{SEPARATION_SQL}, f AS (SELECT verifier, below, min_above > max_below AS sp FROM sep),
    s AS (SELECT 1::BIGINT AS step, 'blind_swapped' AS "check", NOT bool_or(sp) FILTER (verifier = 'cego' AND below = 'trocada') AS ok FROM f
          UNION ALL SELECT 2, 'blind_negated', NOT bool_or(sp) FILTER (verifier = 'cego' AND below = 'negada') FROM f
          UNION ALL SELECT 3, 'complete', (SELECT count(*) FROM universe) = 16),
    cut AS (SELECT coalesce(min(step) FILTER (NOT ok), 99) AS c FROM s)
    SELECT step, "check", ok FROM s, cut WHERE step <= c""",
)
def _(spark, sf_dir):
    decided = studies.claim_verdict(C.claim_metrics(_scored(spark, sf_dir)), 16)
    return rounded(steps_table(decided).select("step", "check", "ok"))


@query(
    "claim_best_threshold",
    f"""{UNIVERSE_SQL}, cuts AS (SELECT DISTINCT score_lexico AS cut FROM scored),
    acc AS (SELECT cut, count(*) FILTER ((score_lexico >= cut) = truth) AS correct, count(*) AS n FROM cuts CROSS JOIN scored GROUP BY cut),
    best AS (SELECT * FROM acc ORDER BY correct DESC, cut LIMIT 1)
    SELECT cut, correct, n, round(correct / n, 6) AS accuracy, round({wilson_sql('correct', 'n', 'lo')}, 6) AS lo,
           round({wilson_sql('correct', 'n', 'hi')}, 6) AS hi FROM best""",
)
def _(spark, sf_dir):
    return rounded(C.best_threshold(_scored(spark, sf_dir), "score_lexico"))


@query(
    "verbatim_reuse",
    f"""WITH {TURNS_SQL}, p AS (SELECT seq, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS a,
      trim(regexp_replace(lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)), '\\s+', ' ', 'g')) AS b FROM turns)
    SELECT seq, length(b) >= 6 AND length(a) > 0 AND list_bool_or(list_transform(range(1, greatest(length(b) - 5, 1) + 1), lambda i: contains(a, substr(b, i, 6)))) AS reused
    FROM p WHERE b IS NOT NULL""",
)
def _(spark, sf_dir):
    """Whole adjacent turns compared at six characters, since the invented prose shares no longer runs."""
    pairs = with_predecessor(conversation_turns(spark, sf_dir), text="text")
    return pairs.select("seq", T.reuses_verbatim("text", "predecessor", 6).alias("reused"))
