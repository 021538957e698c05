"""Queries on retrieval, ranking and repetition of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, rounded, table
from plumbline.catalog.inputs import ORDER_HITS_SQL, norm_sql, order_hits
from plumbline.catalog.runs import wilson_sql
from plumbline.functions import text as T
from plumbline.operators import ranking as K
from plumbline.operators import search as Q
from plumbline.operators.audit import rank_hits
from plumbline.plans import studies
from plumbline.session import fan_out


def vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("seq"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


KNN_SQL = """knn AS (SELECT * FROM (SELECT q.vec_id AS seq, c.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) DESC, c.vec_id) AS pos
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id) WHERE pos <= 10 AND score >= 0.20)"""


@query("cosine_topk", f"WITH {KNN_SQL} SELECT seq, id, round(score, 6) AS score, pos FROM knn")
def _(spark, sf_dir):
    q, c = vectors(spark, sf_dir)
    return rounded(Q.cosine_topk(q, c, 10, min_score=0.20, exclude_self=True))


@query("cosine_topk_blocks", f"WITH {KNN_SQL} SELECT seq, id, round(score, 6) AS score, pos FROM knn")
def _(spark, sf_dir):
    """The same search with the query vectors cut into blocks instead of broadcast."""
    q, c = vectors(spark, sf_dir)
    return rounded(Q.cosine_topk(q, c, 10, min_score=0.20, exclude_self=True, broadcast_queries=0, block_rows=256))


@query(
    "cosine_pairs_by_label",
    """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    return rounded(a.join(b, "a").select("a", "b", Q.cosine("va", "vb").alias("cosine")))


def hybrid_inputs(spark, sf_dir):
    """Passages as queries and documents as the corpus, all of them; a vector where there is one."""
    q_vec, c_vec = vectors(spark, sf_dir)
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq"), "text")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return b.join(q_vec, "seq", "left"), d.join(c_vec, "id", "left")


HYBRID_SQL = r"""q AS (SELECT item_id AS seq, text, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
c AS (SELECT doc_id AS id, text, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
qt AS (SELECT DISTINCT seq, term FROM (SELECT seq, unnest(regexp_split_to_array(lower(text), '[^0-9\p{L}]+')) AS term FROM q) WHERE term <> ''),
cw AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^0-9\p{L}]+'), lambda w: w <> '') AS words FROM c),
n AS (SELECT count(*) AS n_docs, avg(len(words)) AS avg_words FROM cw),
tf AS (SELECT id, n_words, term, count(*) AS tf FROM (SELECT id, len(words) AS n_words, unnest(words) AS term FROM cw) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT seq, id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_words / avg_words))), 9) AS bm25
  FROM tf JOIN dfq USING (term) JOIN qt USING (term), n GROUP BY seq, id),
bm_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY bm25 DESC, id) AS pos FROM bm) WHERE pos <= 50),
vv AS (SELECT q.seq, c.id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score FROM q, c WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL),
v_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, id) AS pos FROM vv) WHERE pos <= 50)"""


def _bm(spark, sf_dir):
    q, c = hybrid_inputs(spark, sf_dir)
    return Q.bm25_topk(q, c, 50)


def _vec(spark, sf_dir):
    q, c = hybrid_inputs(spark, sf_dir)
    return Q.cosine_topk(q.filter("vec IS NOT NULL"), c.filter("vec IS NOT NULL"), 50)


@query("bm25_topk", f"WITH {HYBRID_SQL} SELECT seq, id, round(bm25, 6) AS bm25, pos FROM bm_top")
def _(spark, sf_dir):
    return rounded(_bm(spark, sf_dir))


@query(
    "hybrid_rrf",
    f"""WITH {HYBRID_SQL}, f AS (SELECT seq, id, round(coalesce(1.0 / (60 + v.pos), 0.0) + coalesce(1.0 / (60 + b.pos), 0.0), 9)::DOUBLE AS score FROM v_top v FULL JOIN bm_top b USING (seq, id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, id) AS pos FROM f) SELECT seq, id, round(score, 6) AS score, pos FROM r WHERE pos <= 10""",
)
def _(spark, sf_dir):
    return rounded(Q.fuse_rrf(_vec(spark, sf_dir), _bm(spark, sf_dir), 10))


@query(
    "hybrid_weighted",
    f"""WITH {HYBRID_SQL}, m AS (SELECT seq, max(bm25) AS top FROM bm_top GROUP BY 1),
    f AS (SELECT seq, id, round(0.5 * coalesce(score, 0.0) + 0.5 * coalesce(bm25 / top, 0.0), 9) AS score FROM v_top FULL JOIN (SELECT b.*, top FROM bm_top b JOIN m USING (seq)) USING (seq, id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, id) AS pos FROM f) SELECT seq, id, round(score, 6) AS score, pos FROM r WHERE pos <= 10""",
)
def _(spark, sf_dir):
    return rounded(Q.fuse_weighted(_vec(spark, sf_dir), _bm(spark, sf_dir), 10))


@query(
    "hybrid_mmr",
    f"""WITH RECURSIVE {HYBRID_SQL}, fused AS (SELECT seq, id, round(coalesce(1.0 / (60 + v.pos), 0.0) + coalesce(1.0 / (60 + b.pos), 0.0), 9)::DOUBLE AS score FROM v_top v FULL JOIN bm_top b USING (seq, id)),
    pool AS (SELECT seq, f.id, score, pos, embedding::DOUBLE[] AS v FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, id) AS pos FROM fused) f JOIN c ON c.id = f.id WHERE pos <= 50),
    walk AS (SELECT seq, id, score, pos, v, 0.0::DOUBLE AS nearest, 0 AS taken, 0 AS n FROM pool
      UNION ALL
      SELECT w.seq, w.id, w.score, w.pos, w.v,
             CASE WHEN w.n = 0 THEN coalesce(round(list_cosine_similarity(w.v, b.v), 9), 0.0) ELSE greatest(w.nearest, coalesce(round(list_cosine_similarity(w.v, b.v), 9), 0.0)) END,
             CASE WHEN w.id = b.id THEN w.n + 1 ELSE w.taken END, w.n + 1
      FROM walk w JOIN (SELECT seq, id, v FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY round(0.5 * score - 0.5 * nearest, 9) DESC, pos) AS best FROM walk WHERE taken = 0) WHERE best = 1) b
        ON b.seq = w.seq WHERE w.n < 10)
    SELECT seq, id, round(score, 6) AS score, CAST(taken AS BIGINT) AS pos FROM (SELECT *, max(n) OVER (PARTITION BY seq) AS last FROM walk) WHERE n = last AND taken > 0""",
)
def _(spark, sf_dir):
    """Greedy choice per query."""
    q, c = hybrid_inputs(spark, sf_dir)
    fused = Q.fuse_rrf(_vec(spark, sf_dir), _bm(spark, sf_dir), 50)
    return rounded(Q.mmr(fused.join(c.select("id", "vec"), "id", "left"), 10))


@query(
    "dedup_refill",
    f"""WITH {ORDER_HITS_SQL}, a AS (SELECT *, {norm_sql('text')} AS h FROM order_hits),
    b AS (SELECT *, row_number() OVER (PARTITION BY seq, id, CASE WHEN id IS NULL THEN pos END ORDER BY pos) AS i FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY seq, h ORDER BY pos) AS j FROM b WHERE i = 1),
    d AS (SELECT seq, id, h, pos AS base_pos, row_number() OVER (PARTITION BY seq ORDER BY pos) AS pos FROM c WHERE j = 1) SELECT seq, id, h, base_pos, pos FROM d WHERE pos <= 3""",
)
def _(spark, sf_dir):
    pool = order_hits(spark, sf_dir).withColumn("h", T.normalize("text"))
    return rounded(K.dedup_refill(pool, 3).select("seq", "id", "h", "base_pos", "pos"))


def two_arms(spark, sf_dir, k=10):
    """An order's lines in line order and by discount, as two retrieval conditions."""
    base = order_hits(spark, sf_dir, k).withColumn("condition", F.lit("baseline"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("seq"), F.lit("").alias("query"),
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), F.lit(None)).otherwise(F.col("l_partkey").cast("string")).alias("id"),
        F.concat("l_returnflag", F.lit("  "), "l_linestatus", F.lit(" ")).alias("text"), F.col("l_discount").alias("score"), "l_partkey", "l_suppkey", "l_extendedprice",
    )
    treat = rank_hits(lines, [F.desc("score"), "l_partkey", "l_suppkey", "l_extendedprice"], k).withColumn("condition", F.lit("tratamento"))
    return base, treat.select(base.columns)


def targets(spark, sf_dir):
    """The dearest part of each order is what the query looks for."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(
        F.max_by(F.col("l_partkey").cast("string"), F.struct("l_extendedprice", "l_partkey")).alias("id")
    )


ARMS_SQL = ORDER_HITS_SQL + """, treat AS (SELECT l_orderkey AS seq, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS id, l_returnflag || '  ' || l_linestatus || ' ' AS text,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem),
arms AS (SELECT 'baseline' AS condition, seq, id, text, pos FROM order_hits UNION ALL SELECT 'tratamento', seq, id, text, pos FROM treat),
targets AS (SELECT l_orderkey AS seq, CAST(arg_max(l_partkey, (l_extendedprice, l_partkey)) AS VARCHAR) AS id FROM lineitem GROUP BY 1),
ranks AS (SELECT condition, t.seq, min(pos) FILTER (a.id = t.id AND pos <= 5) AS target_rank FROM targets t JOIN arms a USING (seq) GROUP BY ALL),
metrics AS (SELECT *, CASE WHEN target_rank <= 3 THEN 1 ELSE 0 END AS r3, CASE WHEN target_rank <= 5 THEN 1 ELSE 0 END AS r5, coalesce(1.0 / target_rank, 0.0)::DOUBLE AS rr FROM ranks)"""


def _metrics(spark, sf_dir):
    base, treat = two_arms(spark, sf_dir)
    t = targets(spark, sf_dir)
    out = [K.rank_metrics(arm, t).withColumn("condition", F.lit(c)) for c, arm in (("baseline", base), ("tratamento", treat))]
    return out[0].unionByName(out[1])


@query("rank_metrics", f"WITH {ARMS_SQL} SELECT condition, seq, target_rank, r3::BIGINT AS recall_at_3, r5::BIGINT AS recall_at_5, round(rr, 6) AS reciprocal_rank FROM metrics")
def _(spark, sf_dir):
    return rounded(_metrics(spark, sf_dir))


SCORES_SQL = ARMS_SQL + f""", s AS (SELECT condition, count(*) AS n, sum(r3) AS r3, sum(r5) AS r5, avg(rr) AS mrr FROM metrics GROUP BY 1),
scores AS (SELECT condition, n, CAST(r3 AS BIGINT) AS r3, CAST(r5 AS BIGINT) AS r5, r3 / n AS recall_3, {wilson_sql('r3', 'n', 'lo')} AS r3_lo, {wilson_sql('r3', 'n', 'hi')} AS r3_hi,
  r5 / n AS recall_5, {wilson_sql('r5', 'n', 'lo')} AS r5_lo, {wilson_sql('r5', 'n', 'hi')} AS r5_hi, mrr FROM s),
paired AS (SELECT seq, coalesce(min(target_rank) FILTER (condition = 'baseline'), 6) AS b, coalesce(min(target_rank) FILTER (condition = 'tratamento'), 6) AS t FROM metrics GROUP BY 1),
shift AS (SELECT count(*) FILTER (t < b) AS moved_up, count(*) FILTER (t > b) AS moved_down, count(*) FILTER (t = b) AS unchanged FROM paired)"""


@query(
    "retrieval_scores",
    f"""WITH {SCORES_SQL} SELECT condition, n, r3, r5, round(recall_3, 6) AS recall_3, round(r3_lo, 6) AS r3_lo, round(r3_hi, 6) AS r3_hi, round(recall_5, 6) AS recall_5,
    round(r5_lo, 6) AS r5_lo, round(r5_hi, 6) AS r5_hi, round(mrr, 6) AS mrr FROM scores""",
)
def _(spark, sf_dir):
    return rounded(K.retrieval_scores(_metrics(spark, sf_dir)))


@query("paired_rank_shift", f"WITH {SCORES_SQL} SELECT * FROM shift")
def _(spark, sf_dir):
    return K.paired_rank_shift(_metrics(spark, sf_dir), "baseline", "tratamento")


@query(
    "verdict_rerank",
    f"""WITH {SCORES_SQL}, b AS (SELECT * FROM scores WHERE condition = 'baseline'), t AS (SELECT * FROM scores WHERE condition = 'tratamento')
    SELECT true AS setup_valid, t.r5_lo > b.r5_hi AS h1_confirmed, t.mrr > b.mrr AND moved_up > moved_down AS mrr_and_paired_support FROM b, t, shift""",
)
def _(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return studies.rerank_verdict(K.retrieval_scores(m), K.paired_rank_shift(m, "baseline", "tratamento"))


DOMINANCE_SQL = ARMS_SQL + """, flagged AS (SELECT a.*, starts_with(text, 'R') AS f, a.id = t.id AS is_t FROM arms a JOIN targets t USING (seq)),
fr AS (SELECT condition, seq, min(pos) FILTER (is_t) AS target_rank FROM flagged GROUP BY ALL),
dom AS (SELECT condition, seq, count(*) AS n_results, count(*) FILTER (f AND pos <= 5) AS flag5, count(*) FILTER (pos <= 5) AS slots5, count(*) FILTER (f AND pos <= 10) AS flag10,
  count(*) FILTER (pos <= 10) AS slots10, any_value(target_rank) AS target_rank, count(*) FILTER (f AND (target_rank IS NULL OR pos < target_rank)) AS flagged_above
  FROM flagged JOIN fr USING (condition, seq) GROUP BY condition, seq)"""


def _dominance(spark, sf_dir):
    base, treat = two_arms(spark, sf_dir, None)
    t = targets(spark, sf_dir)
    out = [K.dominance(arm, F.startswith("text", F.lit("R")), t).withColumn("condition", F.lit(c)) for c, arm in (("baseline", base), ("tratamento", treat))]
    return out[0].unionByName(out[1])


@query(
    "summary_dominance",
    f"""WITH {DOMINANCE_SQL} SELECT condition, seq, n_results, flag5, slots5, flag10, slots10, target_rank, round(flag5 / greatest(slots5, 1), 6) AS frac5, round(flag10 / greatest(slots10, 1), 6) AS frac10,
    true AS resolved, coalesce(target_rank <= 5, false) AS target_in_top5, NOT coalesce(target_rank <= 5, false) AS target_expelled, round(coalesce(1.0 / target_rank, 0.0)::DOUBLE, 6) AS reciprocal_rank, flagged_above FROM dom""",
)
def _(spark, sf_dir):
    return rounded(_dominance(spark, sf_dir))


def _grouped(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "vaga").when(F.col("o_orderpriority") == "2-HIGH", "redis").when(F.col("o_orderpriority") == "3-MEDIUM", "guarda").otherwise("especifica").alias("grupo"),
    )
    return K.group_scores(_dominance(spark, sf_dir).join(o, "seq"))


GROUPED_SQL = DOMINANCE_SQL + f""", g AS (SELECT d.*, coalesce(1.0 / target_rank, 0.0)::DOUBLE AS rr, CASE o_orderpriority WHEN '1-URGENT' THEN 'vaga' WHEN '2-HIGH' THEN 'redis' WHEN '3-MEDIUM' THEN 'guarda' ELSE 'especifica' END AS grupo
  FROM dom d JOIN orders ON o_orderkey = seq),
k AS (SELECT condition, count(*) AS n_queries, sum(flag5) FILTER (grupo = 'vaga') AS v5, sum(slots5) FILTER (grupo = 'vaga') AS vn5, sum(flag10) FILTER (grupo = 'vaga') AS v10, sum(slots10) FILTER (grupo = 'vaga') AS vn10,
  sum(flag5) FILTER (grupo IN ('redis', 'especifica')) AS s5, sum(slots5) FILTER (grupo IN ('redis', 'especifica')) AS sn5, count(*) FILTER (grupo IN ('redis', 'especifica')) AS resolved,
  count(*) FILTER (grupo IN ('redis', 'especifica') AND target_rank <= 3) AS hit3, count(*) FILTER (grupo IN ('redis', 'especifica') AND target_rank <= 5) AS hit5,
  sum(rr) FILTER (grupo IN ('redis', 'especifica')) AS rr, count(*) FILTER (grupo = 'redis') AS named_n, count(*) FILTER (grupo = 'redis' AND target_rank <= 5) AS named_hit5,
  count(*) FILTER (grupo = 'guarda') AS guard_n, count(*) FILTER (grupo = 'guarda' AND flag5 >= 1) AS guard_hits FROM g GROUP BY condition)"""


@query(
    "group_retrieval_scores",
    f"""WITH {GROUPED_SQL} SELECT condition, n_queries, round(v5 / vn5, 6) AS vague_share5, round({wilson_sql('v5', 'vn5', 'lo')}, 6) AS vague_lo, round({wilson_sql('v5', 'vn5', 'hi')}, 6) AS vague_hi,
    round(v10 / vn10, 6) AS vague_share10, round(s5 / sn5, 6) AS specific_share5, resolved, round(hit3 / resolved, 6) AS recall3, round(hit5 / resolved, 6) AS recall5,
    round({wilson_sql('hit5', 'resolved', 'lo')}, 6) AS recall5_lo, round({wilson_sql('hit5', 'resolved', 'hi')}, 6) AS recall5_hi, round(rr / resolved, 6) AS mrr, named_hit5, named_n, guard_hits, guard_n FROM k""",
)
def _(spark, sf_dir):
    return rounded(_grouped(spark, sf_dir))


@query(
    "verdict_depriority",
    f"""WITH {GROUPED_SQL} SELECT condition, CASE WHEN v5 / vn5 < 0.40 AND named_hit5 / named_n >= 2.0 / 3 AND guard_hits >= 1 THEN 'H1' ELSE 'H1 NAO' END AS verdict,
    v5 / vn5 >= 0.40 OR named_hit5 / named_n < 2.0 / 3 AS dominance_persists FROM k""",
)
def _(spark, sf_dir):
    return studies.depriority_verdict(_grouped(spark, sf_dir), ("baseline", "tratamento")).select("condition", "verdict", "dominance_persists")


@query(
    "verdict_hybrid",
    f"""WITH {GROUPED_SQL}, b AS (SELECT * FROM k WHERE condition = 'baseline'), t AS (SELECT * FROM k WHERE condition = 'tratamento'),
    h AS (SELECT t.guard_hits >= 1 AND t.hit5 / t.resolved > b.hit5 / b.resolved AND t.rr / t.resolved > b.rr / b.resolved AS c, t.v5 / t.vn5 > b.v5 / b.vn5 + 0.10 AS red FROM b, t)
    SELECT c AS h1_content, CASE WHEN c THEN 'tratamento' END AS h1_content_condition, CAST(NULL AS BOOLEAN) AS h1_repetition, c AS h1, CASE WHEN red THEN 'tratamento' ELSE '' END AS red_flags FROM h""",
)
def _(spark, sf_dir):
    """Two arms only; without a diversified arm the repetition hypothesis stays open."""
    g = _grouped(spark, sf_dir).withColumn("repeat_rate", F.lit(0.0))
    return studies.hybrid_verdict(g, "baseline", "tratamento", "-", "-")


@query(
    "top5_examples",
    f"""WITH {ARMS_SQL} SELECT h.seq, pos, h.id, round(score, 6) AS score, starts_with(text, 'R') AS flagged, coalesce(h.id = t.id, false) AS is_target, text AS preview FROM order_hits h LEFT JOIN targets t USING (seq) WHERE pos <= 5""",
)
def _(spark, sf_dir):
    base, _t = two_arms(spark, sf_dir, 5)
    return rounded(K.top_examples(base, F.startswith("text", F.lit("R")), targets(spark, sf_dir)))


@query(
    "support_recall",
    f"""WITH {ARMS_SQL}, want AS (SELECT DISTINCT l_orderkey AS seq, CAST(l_partkey AS VARCHAR) AS id FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT seq, count(*) AS n_support FROM want GROUP BY 1),
    got AS (SELECT condition, seq, count(DISTINCT a.id) AS n_found FROM arms a JOIN want USING (seq, id) WHERE pos <= 3 GROUP BY ALL)
    SELECT condition, seq, n_support, coalesce(n_found, 0) AS n_found, round(coalesce(n_found, 0) / n_support, 6) AS recall
    FROM (SELECT DISTINCT condition, seq FROM arms) JOIN n USING (seq) LEFT JOIN got USING (condition, seq)""",
)
def _(spark, sf_dir):
    base, treat = two_arms(spark, sf_dir, 3)
    want = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("seq"), F.col("l_partkey").cast("string").alias("id"))
    return rounded(K.support_recall(base.unionByName(treat), want))


def pools(spark, sf_dir):
    """Lines of an order as candidates whose concepts are the part's name."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("seq"), F.col("l_partkey"), "l_linenumber", "l_suppkey", "l_extendedprice", F.col("l_discount").alias("score"), F.lit("blue ring and red gear").alias("query")
    )
    # A pool gets wider after its exchange, which adaptive execution would not see.
    ranked = rank_hits(fan_out(lines, "seq"), [F.desc("score"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], None)
    return ranked.join(part, ranked.l_partkey == part.p_partkey).select(
        "seq", "pos", F.col("l_partkey").alias("id"), "score", "query", F.array("p_name").alias("concepts"), F.col("p_type").alias("domain")
    )


POOL_SQL = """pool AS (SELECT l_orderkey AS seq, l_partkey AS id, l_discount AS score, p_name, p_type, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos
  FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT *, list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda w: length(w) >= 3)) AS terms FROM pool)"""


@query(
    "rerank_by_concepts",
    f"""WITH {POOL_SQL}, o AS (SELECT *, CASE WHEN len(terms) > 0 THEN len(list_intersect(terms, ['blue', 'ring', 'red', 'gear'])) / len(terms) ELSE 0.0 END AS overlap FROM c),
    s AS (SELECT *, score + 0.25 * overlap AS treatment_score FROM o)
    SELECT seq, id, pos AS base_pos, round(overlap, 6) AS overlap, row_number() OVER (PARTITION BY seq ORDER BY treatment_score DESC, score DESC, pos) AS pos FROM s""",
)
def _(spark, sf_dir):
    return rounded(K.rerank(pools(spark, sf_dir)).select("seq", "id", "base_pos", "overlap", "pos"))


@query(
    "rerank_wrong_field_control",
    f"""WITH {POOL_SQL}, n AS (SELECT *, coalesce(lead(terms) OVER w, first_value(terms) OVER w) AS shifted FROM c WINDOW w AS (PARTITION BY seq ORDER BY pos)),
    o AS (SELECT *, CASE WHEN len(shifted) > 0 THEN len(list_intersect(shifted, ['blue', 'ring', 'red', 'gear'])) / len(shifted) ELSE 0.0 END AS overlap FROM n),
    s AS (SELECT *, score + 0.25 * overlap AS treatment_score FROM o)
    SELECT seq, id, pos AS base_pos, round(overlap, 6) AS overlap, row_number() OVER (PARTITION BY seq ORDER BY treatment_score DESC, score DESC, pos) AS pos FROM s""",
)
def _(spark, sf_dir):
    return rounded(K.rerank(pools(spark, sf_dir), wrong_field=True).select("seq", "id", "base_pos", "overlap", "pos"))


def turns_with_vectors(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text")
    return d.join(vectors(spark, sf_dir)[0], "seq", "left")


REPEAT_SQL = """t AS (SELECT doc_id AS seq, text, embedding::DOUBLE[] AS v FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
kept AS (SELECT * FROM t WHERE v IS NOT NULL AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 5 AND length(text) <= 2000),
best AS (SELECT a.seq, max(round(list_cosine_similarity(a.v, b.v), 9)) AS best FROM kept a LEFT JOIN kept b ON b.seq < a.seq GROUP BY a.seq),
rates AS (SELECT count(*) AS n, avg(CASE WHEN best >= 0.80 THEN 1.0::DOUBLE ELSE 0 END) AS rate_080, avg(CASE WHEN best >= 0.85 THEN 1.0::DOUBLE ELSE 0 END) AS rate_085, avg(CASE WHEN best >= 0.90 THEN 1.0::DOUBLE ELSE 0 END) AS rate_090,
  (SELECT count(*) FROM t) AS n_turns FROM best)"""


@query("nearest_earlier_turn", f"WITH {REPEAT_SQL} SELECT seq, round(best, 6) AS best FROM best")
def _(spark, sf_dir):
    return rounded(Q.nearest_earlier(Q.comparable_turns(turns_with_vectors(spark, sf_dir)).filter("vec IS NOT NULL")))


@query(
    "verdict_question_repetition",
    f"""WITH {REPEAT_SQL} SELECT n, round(rate_080, 6) AS rate_080, round(rate_085, 6) AS rate_085, round(rate_090, 6) AS rate_090, n_turns, round((n_turns - n) / n_turns, 6) AS discarded_share,
    CASE WHEN n < 100 THEN 'AMOSTRA INSUFICIENTE' WHEN rate_085 < 0.10 THEN 'H0a — ABANDONAR' ELSE 'H1a — EXECUTAR FASE B' END AS verdict FROM rates""",
)
def _(spark, sf_dir):
    rates = Q.repetition_rate(turns_with_vectors(spark, sf_dir))
    return rounded(studies.repetition_ceiling_verdict(rates).drop("steps", "failed_step"))


@query(
    "query_specificity",
    r"""WITH qt AS (SELECT item_id AS seq, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS term FROM benchmark),
    ct AS (SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS term FROM documents),
    d AS (SELECT term, count(*) AS df FROM ct GROUP BY term), n AS (SELECT count(*) AS n_docs FROM documents),
    s AS (SELECT seq, term, df, CASE WHEN df IS NULL THEN 0.0 ELSE ln((n_docs + 1) / (df + 1)) END AS idf, ln((n_docs + 1) / (coalesce(df, 0) + 1)) AS idf_max FROM qt LEFT JOIN d USING (term), n)
    SELECT seq, count(*) AS n_tokens, round(avg(CASE WHEN df IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS oov_share, round(list_avg(list_reverse_sort(list(idf))[1:3]), 6) AS specificity, round(max(idf), 6) AS max_idf,
           round(list_avg(list_reverse_sort(list(idf_max))[1:3]), 6) AS specificity_oov_max FROM s GROUP BY seq""",
)
def _(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq"), "text")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return rounded(Q.specificity(q, d))
