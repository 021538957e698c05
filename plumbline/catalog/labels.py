"""Queries on labels, rules and ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, rounded, table
from plumbline.functions import text as T
from plumbline.operators import labels as L
from plumbline.operators import matching as M
from plumbline.sources.tables import coerce


def label_rows(spark, sf_dir):
    """Documents as labelled question/answer rows; documents without a label stay unlabelled."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rotulo = F.when(F.col("toxic") == 1, "AMBIGUO").when(F.col("quality") == 0, "VENENO_NEGACAO").when(
        F.col("quality") == 1, "LEGITIMO_CONTEUDO"
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("store"), F.lit("real").alias("origem"),
        F.col("lang").alias("query"), F.col("text").alias("resposta"), rotulo.alias("rotulo"),
    )


def feature_rows(spark, sf_dir):
    low = F.lower("text")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 4 != 0, F.contains(low, F.lit("und"))).alias("negacao_textual"),
        F.contains(low, F.lit("que")).alias("kw_continuidade"), F.col("n_chars").alias("len_resposta"),
    )


LABELS_SQL = r"""WITH rows AS (
  SELECT d.doc_id AS seq, CAST(d.doc_id AS VARCHAR) AS id, source AS store, lang AS query, text,
         CASE WHEN toxic = 1 THEN 'AMBIGUO' WHEN quality = 0 THEN 'VENENO_NEGACAO' WHEN quality = 1 THEN 'LEGITIMO_CONTEUDO' END AS rotulo,
         sha256(lang || '||' || trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS key
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
groups AS (
  SELECT key, count(*) AS n_rows, string_agg(DISTINCT store, '|' ORDER BY store) AS stores, count(DISTINCT rotulo) > 1 AS divergent,
         CASE WHEN count(DISTINCT rotulo) = 1 THEN min(rotulo) END AS label, arg_min(id, seq) AS id, arg_min(query, seq) AS query
  FROM rows GROUP BY key),
features AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 4 <> 0 THEN contains(lower(text), 'und') END AS negacao_textual,
         contains(lower(text), 'que') AS kw_continuidade, n_chars AS len_resposta FROM documents),
judged AS (
  SELECT g.*, label LIKE 'VENENO%' AS y,
         coalesce(negacao_textual, false) OR coalesce(kw_continuidade, false) AS p
  FROM groups g JOIN features f USING (id) WHERE label IS NOT NULL AND label <> 'AMBIGUO')"""
RULE = "negacao_textual or kw_continuidade"


@query("label_content_groups", f"{LABELS_SQL} SELECT substr(key, 1, 12) AS key, n_rows, stores, divergent, label, id, query FROM groups")
def _(spark, sf_dir):
    return L.label_groups(label_rows(spark, sf_dir)).drop("origem", "content")


@query(
    "label_dedup_summary",
    f"""{LABELS_SQL} SELECT CAST(sum(n_rows) AS BIGINT) AS n_raw, count(*) AS n_groups, count(*) FILTER (NOT divergent) AS n_dedup,
    CAST(coalesce(sum(n_rows) FILTER (divergent), 0) AS BIGINT) AS n_divergent_rows, count(*) FILTER (divergent) AS n_divergent_groups,
    count(*) FILTER (label = 'AMBIGUO') AS n_ambiguous FROM groups""",
)
def _(spark, sf_dir):
    return L.dedup_summary(L.label_groups(label_rows(spark, sf_dir)))


@query(
    "label_propagation",
    f"{LABELS_SQL} SELECT r.id, coalesce(g.label, r.rotulo) AS rotulo FROM rows r JOIN groups g USING (key)",
)
def _(spark, sf_dir):
    return L.propagate_labels(label_rows(spark, sf_dir)).select("id", "rotulo")


@query("label_class_distribution", f"{LABELS_SQL} SELECT label, count(*) AS n_groups FROM groups WHERE label IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    return L.class_distribution(label_rows(spark, sf_dir))


@query(
    "rule_confusion",
    f"""{LABELS_SQL}, c AS (SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn,
      count(*) FILTER (NOT y AND NOT p) AS tn FROM judged),
    pr AS (SELECT *, tp / greatest(tp + fp, 1) AS "precision", tp / greatest(tp + fn, 1) AS recall FROM c)
    SELECT tp, fp, fn, tn, round("precision", 6) AS "precision", round(recall, 6) AS recall,
           round(2 * "precision" * recall / greatest("precision" + recall, 1e-9), 6) AS f1 FROM pr""",
)
def _(spark, sf_dir):
    return rounded(L.confusion(L.judged_pairs(label_rows(spark, sf_dir), feature_rows(spark, sf_dir), RULE)))


@query(
    "rule_confusion_by_class",
    f"""{LABELS_SQL} SELECT label, 'real' AS origem, count(*) FILTER (p = y) AS ok, count(*) FILTER (p <> y) AS err FROM judged GROUP BY label""",
)
def _(spark, sf_dir):
    return L.confusion_by_class(L.judged_pairs(label_rows(spark, sf_dir), feature_rows(spark, sf_dir), RULE))


@query(
    "rule_misjudged",
    f"{LABELS_SQL} SELECT CASE WHEN p THEN 'FP' ELSE 'FN' END AS error, id, stores, query FROM judged WHERE p <> y",
)
def _(spark, sf_dir):
    return L.misjudged(L.judged_pairs(label_rows(spark, sf_dir), feature_rows(spark, sf_dir), RULE))


@query(
    "rule_discordance",
    f"""{LABELS_SQL} SELECT g.id, coalesce(negacao_textual, false) AS p1, NOT coalesce(negacao_textual, false) AND len_resposta > 200 AS p2, label
    FROM groups g JOIN features f USING (id)
    WHERE NOT divergent AND coalesce(negacao_textual, false) <> (NOT coalesce(negacao_textual, false) AND len_resposta > 200)""",
)
def _(spark, sf_dir):
    return L.discordant(
        label_rows(spark, sf_dir), feature_rows(spark, sf_dir), "negacao_textual", "NOT negacao_textual AND len_resposta > 200"
    )


@query(
    "rule_unevaluable",
    "SELECT count(*) AS n, 0::BIGINT AS n_true FROM documents",
)
def _(spark, sf_dir):
    judged = L.with_rule(feature_rows(spark, sf_dir), "no_such_feature > 3", "p")
    return judged.agg(F.count(F.lit(1)).alias("n"), F.count_if("p").alias("n_true"))


@query(
    "feature_coercion",
    """SELECT event_type, count(v) FILTER (v IN ('True', 'False')) AS n_flag,
       count(try_cast(v AS DOUBLE)) AS n_number, round(sum(try_cast(v AS DOUBLE)), 4) AS total,
       count(*) FILTER (v NOT IN ('', 'AUSENTE', 'True', 'False') AND try_cast(v AS DOUBLE) IS NULL) AS n_text
    FROM (SELECT event_type, CASE WHEN event_id % 5 = 0 THEN 'True' WHEN event_id % 5 = 1 THEN 'AUSENTE' WHEN event_id % 5 = 2 THEN ''
                 WHEN event_id % 5 = 3 THEN event_type ELSE CAST(value AS VARCHAR) END AS v FROM events) GROUP BY 1""",
)
def _(spark, sf_dir):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "True").when(k == 1, "AUSENTE").when(k == 2, "").when(k == 3, F.col("event_type")).otherwise(
        F.col("value").cast("string")
    )
    c = table(spark, sf_dir, "events").select("event_type", coerce(raw).alias("c"))
    return c.groupBy("event_type").agg(
        F.count("c.flag").alias("n_flag"), F.count("c.number").alias("n_number"), F.round(F.sum("c.number"), 4).alias("total"),
        F.count("c.text").alias("n_text"),
    )


KEYWORDS, NEEDLES, IDS = ("die ", "der erst", "ouen"), ("heed", "quell"), ("17", "23")


def qa_entries(spark, sf_dir):
    """Documents in question/answer form, the source as the question; empty texts cannot form one."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("store"),
        F.concat(F.lit("Q: "), "lang", F.lit(" "), F.col("text"), F.lit("\nA: "), "source", F.lit(" "), "text").alias("text"), "lang",
        F.col("text").alias("body"),
    )


FLAGS_SQL = """WITH f AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, source AS store, contains(lower(text), 'tion') AND contains(lower(text), 'que') AS g_neg,
         concat_ws('|', CASE WHEN contains(lower(text), 'die ') THEN 'die ' END, CASE WHEN contains(lower(text), 'der erst') THEN 'der erst' END,
                   CASE WHEN contains(lower(text), 'ouen') THEN 'ouen' END) AS kws,
         substr(CAST(doc_id AS VARCHAR), 1, 8) IN ('17', '23') OR contains(lower(text), 'heed') OR contains(lower(text), 'quell') AS g_id
  FROM documents),
flags AS (SELECT *, kws <> '' AS g_kw, g_neg OR kws <> '' OR g_id AS hit FROM f)"""


def _flags(spark, sf_dir):
    low = F.lower("body")
    denial = F.contains(low, F.lit("tion")) & F.contains(low, F.lit("que"))
    return L.trigger_flags(qa_entries(spark, sf_dir), IDS, NEEDLES, KEYWORDS, denial)


@query(
    "ground_truth_census",
    f"""{FLAGS_SQL} SELECT store, count(*) AS qa_total, count(*) FILTER (hit) AS candidates, least(count(*) FILTER (NOT hit), 5) AS controls,
    count(*) FILTER (g_neg) AS neg, count(*) FILTER (g_kw) AS kw, count(*) FILTER (g_id) AS by_id FROM flags GROUP BY store""",
)
def _(spark, sf_dir):
    return rounded(L.trigger_census(_flags(spark, sf_dir), 5))


@query(
    "ground_truth_rows",
    f"""{FLAGS_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY md5('42:' || id), id) AS r FROM flags WHERE NOT hit)
    SELECT id, store, kws AS kw_acionadas, 'candidate' AS kind FROM flags WHERE hit
    UNION ALL SELECT id, store, kws, 'control' FROM c WHERE r <= 5""",
)
def _(spark, sf_dir):
    return L.ground_truth(_flags(spark, sf_dir), 5).select("id", "store", "kw_acionadas", "kind")


@query(
    "text_predicates",
    """SELECT conv_id, turn,
       contains(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'ereth') OR
       contains(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'eau de') AS negates,
       CASE WHEN regexp_matches(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '\\b(that|und|le)\\b') THEN 'alvo' ELSE 'controle' END AS stratum,
       regexp_matches(text, '(?i)en\\s+la') AS d0, regexp_matches(text, '(?i)[dt]er\\s+(a|b)') AS d1,
       concat_ws('|', CASE WHEN contains(lower(text), 'ther') THEN 'ther' END, CASE WHEN contains(lower(text), 'que') THEN 'que' END) AS kws
    FROM conversations""",
)
def _(spark, sf_dir):
    d = T.disqualification("text", (r"(?i)en\s+la", r"(?i)[dt]er\s+(a|b)"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.negates_memory("text", ("ereth", "eau de")).alias("negates"), T.stratum("text", ("that", "und", "le")).alias("stratum"),
        d["p0"].alias("d0"), d["p1"].alias("d1"), F.array_join(T.continuity_keywords("text", ("ther", "que")), "|").alias("kws"),
    )


@query(
    "stratified_sample",
    """WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || c_custkey), c_custkey) AS r FROM customer)
    SELECT c_custkey, c_mktsegment FROM r WHERE r <= 10""",
)
def _(spark, sf_dir):
    return L.seeded_sample(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), 10, 7, "c_custkey", ["c_mktsegment"])


@query(
    "nearest_event_within_tolerance",
    """WITH e AS (SELECT *, epoch(ts)::DOUBLE + (microsecond(ts) % 1000000) / 1e6 - floor((microsecond(ts) % 1000000) / 1e6) AS t FROM events),
    ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS t FROM events),
    r AS (SELECT user_id, CAST(round_even(t, 0) AS BIGINT) AS at, arg_max(event_id, event_id) AS rid FROM ev WHERE event_type = 'error' GROUP BY ALL),
    l AS (SELECT event_id, user_id, t FROM ev WHERE event_type = 'purchase'),
    m AS (SELECT l.event_id, first(rid ORDER BY abs(r.at - l.t), r.at) AS near_id, min(abs(r.at - l.t)) AS distance
          FROM l JOIN r ON r.user_id = l.user_id AND abs(r.at - l.t) <= 7200 GROUP BY l.event_id)
    SELECT l.event_id, near_id, round(distance, 6) AS distance FROM l LEFT JOIN m USING (event_id)""",
)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts")
    )
    out = M.nearest_within(
        e.filter("event_type = 'purchase'"), e.filter("event_type = 'error'"), 7200, ["event_id"], ["user_id"], seq="event_id"
    )
    return rounded(out.select("event_id", F.col("near.event_id").alias("near_id"), "distance"))


@query(
    "switch_overlap_flags",
    """WITH ev AS (SELECT event_id, user_id, event_type, epoch_ms(ts) AS t, value FROM events),
    s AS (SELECT event_id, user_id, t AS s, t + CAST(floor(value * 60000) AS BIGINT) AS e FROM ev WHERE event_type = 'purchase'),
    sw AS (SELECT user_id, t FROM ev WHERE event_type = 'signup')
    SELECT event_id, EXISTS (SELECT 1 FROM sw WHERE sw.user_id = s.user_id AND sw.t BETWEEN s.s AND s.e) AS suspect FROM s""",
)
def _(spark, sf_dir):
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", t.alias("t"), "value")
    samples = e.filter("event_type = 'purchase'").select(
        "event_id", "user_id", F.col("t").alias("s"), (F.col("t") + F.floor(F.col("value") * 60000).cast("long")).alias("e")
    )
    switches = e.filter("event_type = 'signup'").select("user_id", "t")
    return M.flag_overlaps(samples, switches, "s", "e", "t", ["user_id"], cell=3600).select("event_id", "suspect")
