"""Queries on context windows, cost limits, exports, snapshots and parsed answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, rounded, table
from plumbline.catalog.inputs import ORDER_HITS_SQL, TURNS_SQL, conversation_turns, order_hits
from plumbline.functions import text as T
from plumbline.functions.decisions import parse_decision
from plumbline.functions.hashing import regime_hash
from plumbline.operators import budget as B
from plumbline.operators import clusters as C
from plumbline.operators import windows as W
from plumbline.sources import memory as SM
from plumbline.sources import retrieval as SR
from plumbline.sources import tables as ST


def windows(spark, sf_dir):
    """A turn as a window: its lines as retrieval, dated anchors, role and text as recent turns."""
    t = conversation_turns(spark, sf_dir)
    return t.select(
        "seq", F.col("role").alias("system"), F.col("text").alias("query"),
        F.array(F.concat(F.lit("Momento atual: 2024-05-0"), (F.col("turn") + 1).cast("string")), F.lit("plain 2024-01-01")).alias("anchors"),
        F.split("text", "\n").alias("retrieval"), F.array("role", "text").alias("recent"),
    )


PLAN = [
    {"rotulo": "neutra", "formato": "neutra", "papel": "controle"},
    {"rotulo": "ablacao_retrieval", "formato": "ablacao", "params": {"alvo": "retrieval"}},
    {"rotulo": "fim", "formato": "lost_in_middle", "params": {"posicao": "fim"}},
    {"rotulo": "meio", "formato": "lost_in_middle", "params": {"posicao": "meio", "needle": "AGULHA"}},
    {"rotulo": "ruido_n8", "formato": "ruido_dominante", "params": {"n": 8, "ruido": ["n1", "n2", "n3"]}},
    {"rotulo": "corte", "formato": "historico_cortado", "params": {"manter": 1}},
    {"rotulo": "veneno", "formato": "ancora_envenenada", "params": {"data_falsa": "2019-01-01"}},
    {"rotulo": "fato", "formato": "fato_em_camada", "params": {"mapa": {"system": "14h30", "retrieval": "15h"}}},
    {"rotulo": "lista", "formato": "lista_retrieval", "params": {"itens": ["x", "y"]}},
]
BASE_SQL = f"""WITH {TURNS_SQL}, w AS (SELECT seq, role AS system, text AS query, ['Momento atual: 2024-05-0' || (turn + 1), 'plain 2024-01-01'] AS anchors,
  string_split(text, chr(10)) AS retrieval, [role, text] AS recent FROM turns)"""
PLAN_SQL = BASE_SQL + """, p AS (
  SELECT seq, 'neutra' AS condition, 'neutra' AS format_id, system, anchors, retrieval, recent FROM w
  UNION ALL SELECT seq, 'ablacao_retrieval', 'ablacao_retrieval', system, anchors, [], recent FROM w
  UNION ALL SELECT seq, 'fim', 'lost_in_middle_fim', system, anchors, list_concat(retrieval[2:], retrieval[1:1]), recent FROM w
  UNION ALL SELECT seq, 'meio', 'lost_in_middle_meio', system, anchors, list_concat(list_concat(retrieval[1:len(retrieval) // 2], ['AGULHA']), retrieval[len(retrieval) // 2 + 1:]), recent FROM w
  UNION ALL SELECT seq, 'ruido_n8', 'ruido_dominante_n8', system, anchors, list_concat(['n1', 'n2', 'n3', 'n1', 'n2', 'n3', 'n1', 'n2'], retrieval), recent FROM w
  UNION ALL SELECT seq, 'corte', 'historico_cortado_keep1', system, anchors, retrieval, recent[1:1] FROM w
  UNION ALL SELECT seq, 'veneno', 'ancora_envenenada', system, ['Momento atual: 2019-01-01', 'plain 2024-01-01'], retrieval, recent FROM w
  UNION ALL SELECT seq, 'fato', 'fato_em_camada(retrieval=15h,system=14h30)', system || chr(10) || '[fato do sistema] A reunião é às 14h30.', anchors, list_concat(['[memória] A reunião é às 15h.'], retrieval), recent FROM w
  UNION ALL SELECT seq, 'lista', 'lista_retrieval(n=2)', system, anchors, ['x', 'y'], recent FROM w)"""


@query(
    "window_condition_matrix",
    f"""{PLAN_SQL} SELECT seq, condition, format_id, system, array_to_string(anchors, '|') AS anchors, len(retrieval) AS n_retrieval, md5(array_to_string(retrieval, '|')) AS retrieval_md5,
    array_to_string(recent, '|') AS recent FROM p""",
)
def _(spark, sf_dir):
    p = W.apply_plan(windows(spark, sf_dir), PLAN)
    return rounded(
        p.select(
            "seq", "condition", "format_id", "system", F.array_join("anchors", "|").alias("anchors"), F.size("retrieval").alias("n_retrieval"),
            F.md5(F.array_join("retrieval", "|")).alias("retrieval_md5"), F.array_join("recent", "|").alias("recent"),
        )
    )


@query(
    "window_patches",
    f"""{BASE_SQL} SELECT seq, CAST(len(retrieval) AS VARCHAR) AS removed, CAST(len(retrieval) - 1 AS VARCHAR) AS idx_end, '1' AS recent_removed, 'true' AS poisoned FROM w""",
)
def _(spark, sf_dir):
    p = W.apply_plan(windows(spark, sf_dir), [PLAN[1], PLAN[2], PLAN[5], PLAN[6]])
    pick = lambda c, k, out: F.max(F.when(F.col("condition") == c, F.col("patch")[k])).alias(out)
    return p.groupBy("seq").agg(
        pick("ablacao_retrieval", "itens_removidos", "removed"), pick("fim", "idx", "idx_end"), pick("corte", "recent_removidos", "recent_removed"), pick("veneno", "aplicado", "poisoned")
    )


@query(
    "window_needle_depth",
    f"""{PLAN_SQL} SELECT seq, condition, list_position(retrieval, 'AGULHA') - 1 AS depth, len(list_filter(retrieval, lambda x: x IN ('n1', 'n2'))) AS competitors FROM p""",
)
def _(spark, sf_dir):
    p = W.apply_plan(windows(spark, sf_dir), PLAN)
    return rounded(p.select("seq", "condition", W.needle_depth("retrieval", "AGULHA").alias("depth"), W.count_competitors("retrieval", ["n1", "n2"]).alias("competitors")))


@query(
    "window_rendering",
    f"""{BASE_SQL} SELECT seq, md5(system || chr(10) || chr(10) || '=== HISTÓRICO ANTERIOR (início da sessão) ===' || chr(10) || array_to_string(anchors, chr(10)) || chr(10) || chr(10) ||
    '=== PERGUNTA ATUAL ===' || chr(10) || 'Que horas?' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'fim') AS prompt_md5 FROM w""",
)
def _(spark, sf_dir):
    probe = W.build_probe(windows(spark, sf_dir), "Que horas?")
    return W.render(probe, closing_text="fim").select("seq", F.md5("prompt").alias("prompt_md5"))


def calls(spark, sf_dir):
    """Lines of an order as model calls in line order."""
    return order_hits(spark, sf_dir).select(F.col("seq").alias("run_id"), (F.col("pos") - 1).cast("long").alias("i"), F.col("score").alias("cost_usd"))


@query(
    "cost_ceiling_report",
    f"""WITH {ORDER_HITS_SQL}, p AS (SELECT seq AS run_id, pos, score, coalesce(sum(score) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM order_hits WHERE pos <= 6)
    SELECT run_id, count(*) FILTER (before <= 0.145) AS n_run, round(coalesce(sum(score) FILTER (before <= 0.145), 0), 6) AS cost_usd,
    CASE WHEN count(*) FILTER (before > 0.145) > 0 THEN 'cost_ceiling' ELSE 'completo' END AS stopped_reason FROM p GROUP BY run_id""",
)
def _(spark, sf_dir):
    return rounded(B.ceiling_report(calls(spark, sf_dir), 0.145, 6))


@query(
    "cost_ceiling_samples",
    f"""WITH {ORDER_HITS_SQL}, p AS (SELECT seq AS run_id, pos - 1 AS i, coalesce(sum(score) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM order_hits WHERE pos <= 6)
    SELECT run_id, i FROM p WHERE before <= 0.145""",
)
def _(spark, sf_dir):
    return B.cost_ceiling(calls(spark, sf_dir), 0.145, 6).select("run_id", "i")


@query(
    "budget_brake",
    """WITH c AS (SELECT c_nationkey AS plan_id, c_custkey AS ord, abs(c_acctbal) / 10000 AS cost_usd, 5 AS n_ok FROM customer),
    p AS (SELECT *, coalesce(sum(cost_usd) OVER w, 0) AS spent_before, coalesce(sum(n_ok) OVER w, 0) AS seen FROM c WINDOW w AS (PARTITION BY plan_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    e AS (SELECT *, 5 * CASE WHEN seen > 0 THEN spent_before / seen ELSE 0.008 END AS estimate FROM p),
    f AS (SELECT *, max(CASE WHEN spent_before + estimate > 6.015 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id ORDER BY ord) AS stopped FROM e)
    SELECT CAST(plan_id AS BIGINT) AS plan_id, ord, round(spent_before, 6) AS spent_before, stopped = 0 AS started FROM f""",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("plan_id"), F.col("c_custkey").alias("ord"), (F.abs("c_acctbal") / 10000).alias("cost_usd"), F.lit(5).alias("n_ok")
    )
    return rounded(B.budget_brake(c, 6.015, 5).select("plan_id", "ord", "spent_before", "started"))


def export_lines(spark, sf_dir):
    """Orders as export lines; every kind of defect is set by rule on some of them."""
    k = F.col("o_orderkey") % 9
    good = F.format_string(
        '{"query": "order %d", "results": [{"id": "%d", "texto": "%s", "score": %s}, {"texto": " "}, 5, {"id": 3, "texto": "x", "score": "0.5"}, {"id": " ", "texto": "y", "score": true}]}',
        "o_orderkey", "o_custkey", "o_orderpriority", F.col("o_totalprice").cast("string"),
    )
    bad = (
        F.when(k == 0, "{broken").when(k == 1, "[1, 2]").when(k == 2, '{"query": "  ", "results": []}').when(k == 3, '{"query": 5, "results": []}')
        .when(k == 4, '{"query": "q", "results": "x"}').when(k == 5, "   ").when(k == 6, '{"query": "only"}')
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.coalesce(bad, good).alias("value"))


@query(
    "export_parse_hits",
    """SELECT o_orderkey AS seq, 'order ' || o_orderkey AS query, p.pos, CASE p.pos WHEN 1 THEN CAST(o_custkey AS VARCHAR) END AS id,
    CASE p.pos WHEN 1 THEN o_orderpriority WHEN 2 THEN 'x' ELSE 'y' END AS text, CASE p.pos WHEN 1 THEN round(o_totalprice, 6) WHEN 3 THEN 1.0::DOUBLE END AS score
    FROM orders, (VALUES (1::BIGINT), (2::BIGINT), (3::BIGINT)) p(pos) WHERE o_orderkey % 9 > 6""",
)
def _(spark, sf_dir):
    return rounded(SR.explode_hits(SR.parse_retrieval(export_lines(spark, sf_dir))))


@query(
    "export_parse_rejects",
    """SELECT o_orderkey AS seq, CASE o_orderkey % 9 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'not_object' WHEN 2 THEN 'query_missing' WHEN 3 THEN 'query_missing' ELSE 'results_not_list' END AS reason
    FROM orders WHERE o_orderkey % 9 <= 4""",
)
def _(spark, sf_dir):
    return SR.rejects(SR.parse_retrieval(export_lines(spark, sf_dir)))


@query(
    "export_parse_counts",
    """SELECT count(*) FILTER (o_orderkey % 9 <= 4) AS n_malformed, count(*) FILTER (o_orderkey % 9 > 5) AS n_records, CAST(coalesce(sum(2) FILTER (o_orderkey % 9 > 6), 0) AS BIGINT) AS n_dropped FROM orders""",
)
def _(spark, sf_dir):
    p = SR.parse_retrieval(export_lines(spark, sf_dir))
    return p.agg(
        F.count("reason").alias("n_malformed"), F.count_if(F.col("reason").isNull()).alias("n_records"), F.sum("n_dropped").alias("n_dropped")
    )


def exported(hits):
    rec = SR.to_retrieval_export(hits)
    flat = F.array_join(F.transform("results", lambda r: F.concat(F.coalesce(r.id, F.lit("-")), F.lit(":"), r.texto)), ",")
    return rec.select("seq", "query", flat.alias("results"))


@query(
    "export_records",
    f"""WITH {ORDER_HITS_SQL} SELECT seq, query, string_agg(coalesce(id, '-') || ':' || text, ',' ORDER BY pos) AS results FROM order_hits GROUP BY ALL""",
)
def _(spark, sf_dir):
    return exported(order_hits(spark, sf_dir))


def snapshot_texts(spark, sf_dir):
    """Each document as a snapshot file with its whole text: lists with a stray number, wrapped lists, and every seventh one faulty."""
    d = F.col("doc_id")
    entry = F.concat(
        F.lit('{"id": "'), d.cast("string"), F.lit('", "text": '), F.expr("substring(json, 7, length(json) - 8)"),
        F.lit(', "acessos": '), F.col("n_chars").cast("string"), F.lit(', "cognitive_decisions": {"domain": "'), F.col("source"), F.lit('"}'),
    )
    whole = F.when(d % 2 == 0, F.concat(F.lit("[7, "), entry, F.lit(', "answer_class": null}]'))).otherwise(F.concat(F.lit('{"entries": ['), entry, F.lit("}]}")))
    body = F.when(d % 7 == 3, F.expr("substring(body, 1, length(body) - 2)")).when(d % 7 == 5, F.lit('{"items": []}')).otherwise(F.col("body"))
    # {"t":["…"]} without its first six and last two characters is the text as a JSON string
    docs = table(spark, sf_dir, "documents").withColumn("json", F.to_json(F.struct(F.array("text").alias("t")))).withColumn("body", whole)
    return docs.select("doc_id", F.col("lang").alias("scope"), F.when(d % 2 == 0, "episodic").otherwise("semantic").alias("layer"), body.alias("value"))


@query(
    "memory_snapshot_parse",
    """SELECT lang AS scope, CASE WHEN doc_id % 2 = 0 THEN 'episodic' ELSE 'semantic' END AS layer, CAST(doc_id AS VARCHAR) AS id, text, n_chars AS acessos, source AS domain,
    doc_id % 2 = 0 AS has_answer_class FROM documents WHERE doc_id % 7 NOT IN (3, 5)""",
)
def _(spark, sf_dir):
    parsed = SM.parse_snapshots(snapshot_texts(spark, sf_dir))
    return parsed.select("scope", "layer", "id", "text", "acessos", F.col("cognitive_decisions.domain").alias("domain"), "has_answer_class")


@query(
    "memory_snapshot_rejects",
    """SELECT doc_id, NULL::BIGINT AS position, CASE doc_id % 7 WHEN 3 THEN 'invalid_json' ELSE 'no_entries' END AS reason FROM documents WHERE doc_id % 7 IN (3, 5)
    UNION ALL SELECT doc_id, 0, 'entry_not_object' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 7 NOT IN (3, 5)""",
)
def _(spark, sf_dir):
    return rounded(SM.snapshot_rejects(snapshot_texts(spark, sf_dir), ["doc_id"]).select("doc_id", "position", "reason"))


@query("latest_windows", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 3")
def _(spark, sf_dir):
    return SM.latest_windows(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 3)


@query(
    "keyed_results_upsert",
    """SELECT p_brand, max(p_size)::BIGINT AS size, bool_or(p_size > 25) AS is_new FROM (SELECT p_brand, max(p_size) AS p_size FROM part GROUP BY 1) GROUP BY p_brand""",
)
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    best = part.groupBy("p_brand").agg(F.max("p_size").alias("size"))
    base = part.groupBy("p_brand").agg(F.min("p_size").alias("size"), F.lit(False).alias("is_new")).join(best.filter("size <= 25").select("p_brand", F.col("size").alias("_s")), "p_brand", "left")
    base = base.select("p_brand", F.coalesce("_s", "size").alias("size"), "is_new")
    return rounded(ST.upsert_by_key(base, best.filter("size > 25").withColumn("is_new", F.lit(True)), ["p_brand"]))


@query(
    "query_truncation",
    """WITH t AS (SELECT conv_id, turn, trim(text) AS t FROM conversations), c AS (SELECT *, substr(t, 1, 80) AS h, regexp_extract(substr(t, 1, 80), '(?s)^(.+) [^ ]*$', 1) AS w FROM t)
    SELECT conv_id, turn, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(CASE WHEN w <> '' THEN w ELSE h END) || '…' END AS short FROM c""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.truncate("text").alias("short"))


@query(
    "format_regime_groups",
    """SELECT substr(sha256('[{"key":"cap","value":"' || o_orderstatus || '"},{"key":"mode","value":"' || o_orderpriority || '"}]'), 1, 16) AS regime, count(*) AS n
    FROM orders GROUP BY o_orderpriority, o_orderstatus""",
)
def _(spark, sf_dir):
    """One hash per regime, whatever the order in which its fields were written."""
    k = F.col("o_orderkey") % 2 == 0
    state = F.when(k, F.create_map(F.lit("mode"), "o_orderpriority", F.lit("cap"), "o_orderstatus")).otherwise(F.create_map(F.lit("cap"), "o_orderstatus", F.lit("mode"), "o_orderpriority"))
    return table(spark, sf_dir, "orders").groupBy(regime_hash(state).alias("regime")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "decision_parsing",
    """SELECT p_partkey, CASE WHEN p_size % 4 IN (0, 1) THEN p_name END AS key_assertion, CASE WHEN p_size % 4 IN (0, 1) THEN p_brand || '|' || p_type END AS concepts, CASE WHEN p_size % 4 IN (0, 1) THEN p_type END AS domain FROM part""",
)
def _(spark, sf_dir):
    """Parts as model answers: plain, fenced, without concepts, and broken."""
    k = F.col("p_size") % 4
    body = F.format_string('{"key_assertion": " %s ", "concepts": ["%s", 4, " ", "%s"], "domain": "%s"}', "p_name", "p_brand", "p_type", "p_type")
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, '{"key_assertion": "a", "concepts": [], "domain": "b"}').otherwise("no json")
    d = table(spark, sf_dir, "part").select("p_partkey", parse_decision(raw).alias("d"))
    return d.select("p_partkey", "d.key_assertion", F.array_join("d.concepts", "|").alias("concepts"), "d.domain")


@query(
    "memory_cluster_merge",
    """WITH RECURSIVE edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
      AND round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) > 0.40),
    reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM reached r JOIN edges e ON e.a = r.b),
    placed AS (SELECT a AS vec_id, min(b) AS component FROM reached GROUP BY a)
    SELECT component AS id, CAST(sum(coalesce(label, 0)) AS BIGINT) AS acessos,
           CASE WHEN count(*) = 1 AND min(label) = 1 THEN 'not_found' END AS answer_class, count(*) AS merged_from
    FROM placed JOIN embeddings USING (vec_id) GROUP BY component""",
)
def _(spark, sf_dir):
    """Components of the similarity graph."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("acessos"), F.when(F.col("label") == 1, "not_found").alias("answer_class")
    )
    return C.merge_clusters(e, threshold=0.40)
