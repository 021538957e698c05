"""Queries on memory tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, rounded, table
from plumbline.catalog.inputs import TURNS_SQL, conversation_turns, norm_sql
from plumbline.functions import text as T
from plumbline.functions.hashing import table_fingerprint
from plumbline.operators import matching as M
from plumbline.operators import memory as Y
from plumbline.operators import scoring as S
from plumbline.plans import studies


def memory(spark, sf_dir):
    """Documents as memory entries; types, layers and accesses are set by rule."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("seq"), (d - d % 3).cast("string").alias("id"), "text", F.col("lang").alias("scope"), F.when(d % 3 == 0, "semantic").otherwise("episodic").alias("layer"),
        F.when(d % 5 == 0, "session_summary").when(d % 5 == 1, "llm_response").when(d % 5 == 2, "camara_response").when(d % 5 == 3, "meta_conversation").alias("source_type"),
        (F.col("n_chars") % 7).alias("acessos"), F.lit("alta").alias("prioridade"), F.lit("fact").alias("epistemic_status"),
        F.when(d % 8 == 0, "not_found").when(d % 8 == 1, "disqualification").when(d % 8 == 2, "").alias("answer_class"),
        F.when(d % 4 == 0, "m1").when(d % 4 == 1, "m2").alias("session_marker"), (1 + d % 2).alias("merged_from"),
        F.col("source").alias("domain"), F.array("lang", "source").alias("concepts"), F.col("source").alias("key_assertion"),
        F.when(d % 6 != 0, F.array(F.lit(1.0))).alias("embedding"), (d % 9 != 0).alias("has_answer_class"),
    )


MEMORY_SQL = """WITH mem AS (SELECT doc_id AS seq, CAST(doc_id - doc_id % 3 AS VARCHAR) AS id, text, lang AS scope, CASE WHEN doc_id % 3 = 0 THEN 'semantic' ELSE 'episodic' END AS layer,
  CASE doc_id % 5 WHEN 0 THEN 'session_summary' WHEN 1 THEN 'llm_response' WHEN 2 THEN 'camara_response' WHEN 3 THEN 'meta_conversation' END AS source_type,
  n_chars % 7 AS acessos, CASE doc_id % 8 WHEN 0 THEN 'not_found' WHEN 1 THEN 'disqualification' WHEN 2 THEN '' END AS answer_class,
  CASE doc_id % 4 WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' END AS session_marker, 1 + doc_id % 2 AS merged_from, source AS domain, doc_id % 6 <> 0 AS embedded, doc_id % 9 <> 0 AS has_class
  FROM documents)"""


@query(
    "memory_inventory",
    f"""{MEMORY_SQL} SELECT coalesce(source_type, '<none>') AS source_type, count(*) AS n, round(avg(acessos), 6) AS acessos_mean, max(acessos) AS acessos_max FROM mem GROUP BY 1""",
)
def _(spark, sf_dir):
    return rounded(Y.memory_inventory(memory(spark, sf_dir)))


@query(
    "memory_summary_access",
    f"""{MEMORY_SQL}, m AS (SELECT *, coalesce(source_type = 'session_summary', false) AS ss FROM mem)
    SELECT count(*) AS total, count(*) FILTER (ss) AS n_summaries, round(avg(acessos) FILTER (ss), 6) AS summary_mean, max(acessos) FILTER (ss) AS summary_max,
    round(avg(acessos) FILTER (NOT ss), 6) AS normal_mean, max(acessos) FILTER (NOT ss) AS normal_max FROM m""",
)
def _(spark, sf_dir):
    return rounded(Y.summary_access(memory(spark, sf_dir)))


@query(
    "memory_copy_census",
    f"""{MEMORY_SQL}, g AS (SELECT layer, {norm_sql('text')} AS norm, count(*) AS n FROM mem GROUP BY ALL)
    SELECT layer, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n > 1) AS clusters, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS in_clusters,
    CAST(sum(n - 1) AS BIGINT) AS excess, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS share_in_clusters, round(sum(n - 1) / sum(n), 6) AS share_excess FROM g GROUP BY layer""",
)
def _(spark, sf_dir):
    return rounded(Y.copy_census(memory(spark, sf_dir)))


@query(
    "memory_largest_copies",
    f"""{MEMORY_SQL} SELECT {norm_sql('text')} AS norm, count(*) AS n FROM mem GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(spark, sf_dir):
    return Y.largest_copy_groups(memory(spark, sf_dir), 10)


@query("memory_cross_layer_ids", f"{MEMORY_SQL} SELECT id FROM mem GROUP BY id HAVING count(DISTINCT layer) > 1")
def _(spark, sf_dir):
    return Y.cross_layer_ids(memory(spark, sf_dir))


@query(
    "memory_marker_distribution",
    f"""{MEMORY_SQL} SELECT CASE WHEN layer <> 'episodic' THEN 'semantic_na' WHEN session_marker = 'm1' THEN 'x1.60_atual' WHEN session_marker <> '' THEN 'x0.85_antiga' ELSE 'x1.00_legacy' END AS kind,
    count(*) AS n FROM mem WHERE source_type = 'session_summary' GROUP BY 1""",
)
def _(spark, sf_dir):
    return Y.marker_distribution(memory(spark, sf_dir), "m1")


@query(
    "memory_promotable",
    f"""{MEMORY_SQL} SELECT seq, answer_class FROM mem WHERE acessos >= 3 AND coalesce(answer_class NOT IN ('not_found', 'disqualification'), true)""",
)
def _(spark, sf_dir):
    return Y.promotable(memory(spark, sf_dir)).select("seq", "answer_class")


PROMOTION_SQL = MEMORY_SQL + """, planted AS (SELECT CAST(seq AS VARCHAR) AS id, coalesce(nullif(answer_class, ''), 'normal') AS class FROM mem),
semantic AS (SELECT CAST(seq AS VARCHAR) AS id, has_class FROM mem WHERE acessos >= 3)"""


def _planted(spark, sf_dir):
    return memory(spark, sf_dir).withColumn("id", F.col("seq").cast("string"))


@query("promotion_counts_by_class", f"{PROMOTION_SQL} SELECT class, count(*) AS n FROM planted JOIN semantic USING (id) GROUP BY class")
def _(spark, sf_dir):
    m = _planted(spark, sf_dir)
    return Y.promotion_counts(m, Y.promotable(m, guard=False))


@query(
    "promotion_fusion_audit",
    f"""{PROMOTION_SQL} SELECT CAST(seq AS VARCHAR) AS id, merged_from, s.id IS NOT NULL AS promoted, s.has_class AS class_present
    FROM mem m LEFT JOIN semantic s ON s.id = CAST(m.seq AS VARCHAR) WHERE merged_from = 2""",
)
def _(spark, sf_dir):
    m = _planted(spark, sf_dir)
    return Y.fusion_audit(m, Y.promotable(m, guard=False))


@query(
    "promotion_class_divergence",
    f"""{MEMORY_SQL}, c AS (SELECT scope AS key, count(*) FILTER (answer_class = 'not_found') AS not_found, count(*) FILTER (answer_class = 'disqualification') AS disqualification
      FROM mem WHERE acessos >= 3 GROUP BY 1) SELECT * FROM c WHERE not_found <> disqualification""",
)
def _(spark, sf_dir):
    by_class = Y.promotable(memory(spark, sf_dir), guard=False).groupBy(F.col("scope").alias("key"), F.col("answer_class").alias("class")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return studies.class_divergence(by_class)


@query(
    "verdict_promotion",
    """WITH r AS (SELECT p_size % 9 AS i, count(*) FILTER (p_retailprice > 950 AND p_size % 9 NOT IN (2, 3)) AS promoted, bool_or(p_retailprice > 950) AS fused FROM part GROUP BY 1),
    p AS (SELECT max(promoted) FILTER (i = 0) AS c5, max(promoted) FILTER (i = 1) AS c5p, max(promoted) FILTER (i = 2) AS c6, max(promoted) FILTER (i = 3) AS c6p,
      max(promoted) FILTER (i = 4) AS c1, max(promoted) FILTER (i = 5) AS c2, max(promoted) FILTER (i = 6) AS c3, max(promoted) FILTER (i = 7) AS c4, bool_or(fused) FILTER (i = 8) AS fused FROM r),
    v AS (SELECT *, CASE WHEN c5 >= 1 AND c5p >= 1 AND c6 = 0 AND c6p = 0 AND fused THEN 'CLASSIFICADO' ELSE 'INCONCLUSIVO' END AS verdict FROM p)
    SELECT verdict, CASE WHEN verdict = 'CLASSIFICADO' THEN c1 > 0 OR c2 > 0 END AS h1, CASE WHEN verdict = 'CLASSIFICADO' THEN c3 = 0 AND c4 >= 1 END AS h2,
           CASE WHEN verdict = 'CLASSIFICADO' THEN true END AS h3, CASE WHEN verdict = 'CLASSIFICADO' THEN c1 = 0 AND c2 = 0 AND c3 = 0 AND c4 = 0 AND c5 >= 1 END AS h0
    FROM v""",
)
def _(spark, sf_dir):
    """Parts as planted entries in nine keyed results; dear parts count as promoted."""
    keys = ["C5/consolidate", "C5/consolidate_promote_only", "C6/consolidate", "C6/consolidate_promote_only", "C1/consolidate", "C2/consolidate",
            "C3/consolidate_promote_only", "C4/consolidate_promote_only", "C7/consolidate"]
    i = F.col("p_size") % 9
    key = F.element_at(F.array(*[F.lit(k) for k in keys]), i + 1)
    dear = F.col("p_retailprice") > 950
    r = table(spark, sf_dir, "part").groupBy(key.alias("key")).agg(
        F.count_if(dear & ~i.isin(2, 3)).alias("promoted"), F.bool_or(dear).alias("fused"), F.bool_or(dear).alias("fused_promoted"),
        F.lit(False).alias("class_present"),
    )
    return studies.promotion_verdict(r).drop("failed_step")


@query(
    "memory_treated_conditions",
    f"""{MEMORY_SQL}, m AS (SELECT *, coalesce(source_type = 'session_summary', false) AS ss FROM mem),
    c AS (SELECT * FROM (VALUES ('baseline', false, false), ('trat_gravador', true, false), ('trat_trivial', false, true), ('trat_combinado', true, true)) v(condition, rw, dt))
    SELECT condition, CASE WHEN rw AND ss THEN 'media' ELSE 'alta' END AS prioridade, CASE WHEN rw AND ss THEN 'hypothesis' ELSE 'fact' END AS epistemic_status, count(*) AS n
    FROM m, c WHERE NOT (dt AND ss AND seq % 10 = 0) GROUP BY ALL""",
)
def _(spark, sf_dir):
    """Every second summary says next to nothing, so conditions that leave empty ones out have fewer entries."""
    text = F.when(F.col("seq") % 10 == 0, "[session_summary] **ab:**").otherwise(F.concat(F.lit("alpha beta gamma "), "text"))
    t = Y.treated_conditions(memory(spark, sf_dir).withColumn("text", text))
    return t.groupBy("condition", "prioridade", "epistemic_status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "trivial_summaries",
    """WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '([0-9a-z]+)', 1) AS w FROM part)
    SELECT p_partkey, len(list_filter(w, lambda x: length(x) >= 2)) < 3 AS trivial FROM t""",
)
def _(spark, sf_dir):
    text = F.concat(F.lit("[session_summary] **"), "p_name", F.lit(":**"))
    return table(spark, sf_dir, "part").select("p_partkey", T.is_trivial_summary(text, F.lit("session_summary")).alias("trivial"))


@query(
    "class_stamping",
    f"""{MEMORY_SQL}, h AS (SELECT *, contains(lower(text), 'que') AS hit FROM mem) SELECT seq, CASE WHEN hit AND coalesce(answer_class, '') = '' THEN 'disqualification' ELSE answer_class END AS answer_class FROM h""",
)
def _(spark, sf_dir):
    stamped, _audit = Y.stamp_class(memory(spark, sf_dir), F.contains(F.lower("text"), F.lit("que")), "disqualification", "DISQ-v1-backfill")
    return stamped.select("seq", "answer_class")


@query(
    "class_stamping_counts",
    f"""{MEMORY_SQL}, h AS (SELECT *, contains(lower(text), 'que') AS hit FROM mem) SELECT count(*) AS seen, count(*) FILTER (hit) AS candidates,
    count(*) FILTER (hit AND coalesce(answer_class, '') = '') AS stamped, count(*) FILTER (hit AND coalesce(answer_class, '') <> '') AS skipped FROM h""",
)
def _(spark, sf_dir):
    return Y.stamp_counts(memory(spark, sf_dir), F.contains(F.lower("text"), F.lit("que")))


@query(
    "class_stamping_audit",
    f"""{MEMORY_SQL} SELECT id, scope, layer, 'DISQ-v1-backfill' AS rule, 'disqualification' AS answer_class FROM mem
    WHERE contains(lower(text), 'que') AND coalesce(answer_class, '') = ''""",
)
def _(spark, sf_dir):
    return Y.stamp_class(memory(spark, sf_dir), F.contains(F.lower("text"), F.lit("que")), "disqualification", "DISQ-v1-backfill")[1]


@query(
    "probe_pairs",
    f"""{MEMORY_SQL}, u AS (SELECT * FROM mem WHERE embedded AND trim(domain) <> ''),
    p AS (SELECT lower(trim(domain)) AS d, arg_min(trim(domain), id) AS domain, min(id) AS target_id FROM u GROUP BY 1)
    SELECT 'continuando nossa conversa sobre ' || domain || ', o que tínhamos concluído?' AS query, target_id, domain, domain AS key_assertion FROM p ORDER BY target_id LIMIT 20""",
)
def _(spark, sf_dir):
    return Y.probe_pairs(Y.probe_universe(memory(spark, sf_dir)))


def qa_memory(spark, sf_dir):
    """User and assistant turns folded to question/answer entries; system turns become summaries."""
    from plumbline.catalog.claims import entries

    qa = entries(spark, sf_dir).select(
        "seq", "id", F.concat(F.lit("Q: "), "claim", F.lit("\nA: "), "text").alias("text"), (F.col("seq") % 100).cast("double").alias("timestamp")
    )
    system = conversation_turns(spark, sf_dir).filter("role = 'system'").select(
        "seq", F.col("seq").cast("string").alias("id"), F.concat(F.lit("[session_summary] "), "text").alias("text"), F.lit(None).cast("double").alias("timestamp")
    )
    user = conversation_turns(spark, sf_dir).filter("role = 'user'").select(
        "seq", F.col("seq").cast("string").alias("id"), "text", F.lit(None).cast("double").alias("timestamp")
    )
    return qa.unionByName(system).unionByName(user)


QA_SQL = f"""WITH {TURNS_SQL}, prior AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS claim FROM turns),
qa AS (SELECT seq, CAST(seq AS VARCHAR) AS id, 'Q: ' || claim || chr(10) || 'A: ' || text AS text, CAST(seq % 100 AS DOUBLE) AS timestamp FROM prior WHERE role = 'assistant' AND claim IS NOT NULL
  UNION ALL SELECT seq, CAST(seq AS VARCHAR), '[session_summary] ' || text, NULL FROM turns WHERE role = 'system' UNION ALL SELECT seq, CAST(seq AS VARCHAR), text, NULL FROM turns WHERE role = 'user'),
formed AS (SELECT *, starts_with(text, '[session_summary]') AS summary, regexp_matches(text, '(?s)^\\s*Q:\\s*.+\\bA:\\s*') AS ok FROM qa)"""


@query(
    "turn_extraction",
    f"""{QA_SQL} SELECT trim(regexp_extract(text, '(?s)Q:\\s*(.*?)\\s*A:', 1)) AS query, id, timestamp, seq FROM formed WHERE NOT summary AND ok""",
)
def _(spark, sf_dir):
    return Y.extract_turns(qa_memory(spark, sf_dir))


@query(
    "turn_extraction_cascade",
    f"""{QA_SQL} SELECT count(*) AS n_total, count(*) FILTER (summary) AS n_summary, count(*) FILTER (NOT summary AND NOT ok) AS n_form, count(*) FILTER (NOT summary AND ok) AS n_final FROM formed""",
)
def _(spark, sf_dir):
    return Y.turn_cascade(qa_memory(spark, sf_dir))


@query(
    "turn_predecessors",
    f"""WITH {TURNS_SQL}, u AS (SELECT * FROM turns WHERE role = 'user'), d AS (SELECT arg_min(seq, seq) AS seq FROM u GROUP BY {norm_sql('text')}),
    p AS (SELECT u.seq, conv_id, text AS query, lag(text) OVER (PARTITION BY conv_id ORDER BY seq) AS predecessor FROM u JOIN d USING (seq))
    SELECT seq, query, predecessor FROM p WHERE predecessor IS NOT NULL""",
)
def _(spark, sf_dir):
    u = conversation_turns(spark, sf_dir).filter("role = 'user'").select("seq", "conv_id", F.col("text").alias("query"))
    return Y.with_predecessor(Y.first_occurrences(u, "query", "seq")).select("seq", "query", "predecessor")


@query(
    "target_resolution",
    f"""{MEMORY_SQL}, specs AS (SELECT * FROM (VALUES ('a', '30', NULL), ('b', NULL, 'heed'), ('c', NULL, 'no such text'), ('d', NULL, 'ciónue')) v(spec, sid, needle)),
    plain AS (SELECT * FROM mem WHERE coalesce(source_type <> 'session_summary', true))
    SELECT spec, p.id FROM specs LEFT JOIN plain p ON p.id = sid OR contains(lower(p.text), needle)""",
)
def _(spark, sf_dir):
    specs = [{"name": "a", "id": "30"}, {"name": "b", "needle": "Heed "}, {"name": "c", "needle": "no such text"}, {"name": "d", "needle": "ciónue"}]
    return M.resolve_targets(memory(spark, sf_dir), specs)


@query(
    "target_resolution_by_table",
    """SELECT CAST(item_id AS VARCHAR) AS spec, CAST(doc_id AS VARCHAR) AS id FROM benchmark b LEFT JOIN documents d ON contains(lower(d.text), lower(trim(b.text)))""",
)
def _(spark, sf_dir):
    """Every benchmark passage as a needle in every document."""
    specs = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("spec"), F.lit(None).cast("string").alias("id"), F.col("text").alias("needle")
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.lit(None).cast("string").alias("source_type"))
    return M.resolve_target_table(docs, specs, gram=16)


@query("sentinel_leak", "SELECT count(*) FILTER (contains(html, 'track(') OR contains(html, 'heedheed')) AS n_rows, count(*) FILTER (contains(html, 'track(')) > 0 AS leaked FROM pages")
def _(spark, sf_dir):
    return M.leaked(table(spark, sf_dir, "pages"), ["track(", "heedheed"], "html")


@query(
    "table_fingerprint",
    """WITH d AS (SELECT CAST('0x' || substr(sha256(length(n_name) || ':' || n_name || length(n_nationkey::VARCHAR) || ':' || n_nationkey || length(n_regionkey::VARCHAR) || ':' || n_regionkey), 1, 15) AS BIGINT) AS x FROM nation)
    SELECT count(*) AS n_rows, CAST(sum(x) AS VARCHAR) AS digest FROM d""",
)
def _(spark, sf_dir):
    return table_fingerprint(table(spark, sf_dir, "nation"))


@query("store_unchanged", "SELECT true AS unchanged")
def _(spark, sf_dir):
    """The customers, and the same customers repartitioned, have one fingerprint."""
    c = table(spark, sf_dir, "customer")
    return M.unchanged(table_fingerprint(c), table_fingerprint(c.repartition(5)))


@query(
    "store_row_changes",
    """SELECT c_custkey, c_mktsegment, 'before' AS side, 1::BIGINT AS n FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT c_custkey, 'SHIPS', 'after', 1 FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    after = c.withColumn("c_mktsegment", F.when(F.col("c_mktsegment") == "BUILDING", "SHIPS").otherwise(F.col("c_mktsegment")))
    return M.changed_rows(c, after)


@query("lab_sessions", "SELECT CASE WHEN role = 'system' THEN '__lab__' ELSE 'prod_' END || conv_id AS session_id, turn FROM conversations WHERE role = 'system'")
def _(spark, sf_dir):
    session = F.concat(F.when(F.col("role") == "system", "__lab__").otherwise("prod_"), F.col("conv_id").cast("string"))
    return Y.lab_only(table(spark, sf_dir, "conversations").select(session.alias("session_id"), "turn"))


@query(
    "layer_union_without_summaries",
    f"{MEMORY_SQL} SELECT layer, count(*) AS n FROM mem WHERE coalesce(source_type, '') <> 'session_summary' GROUP BY layer",
)
def _(spark, sf_dir):
    m = memory(spark, sf_dir)
    both = m.filter("layer = 'episodic'").unionByName(m.filter("layer = 'semantic'").drop("domain"), allowMissingColumns=True)
    return Y.drop_summaries(both).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
