"""Queries on copies, repetition and score collapse."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, rounded
from plumbline.catalog.inputs import ORDER_HITS_SQL, language_hits, norm_sql, order_hits
from plumbline.operators import audit as A
from plumbline.plans.studies import topicality_verdict

PER_LANG_SQL = f"""per_query AS (
  SELECT lang AS query, ascii(lang) AS seq, count(*) AS k,
         count(*) - count(DISTINCT sha256({norm_sql('text')})) AS dup_hash_count,
         (count(*) - count(DISTINCT sha256({norm_sql('text')}))) / count(*) AS dup_hash_rate
  FROM documents GROUP BY lang)"""

TOP5_SQL = ORDER_HITS_SQL + f""", hits AS (
  SELECT seq, query, pos, id, text, score, sha256({norm_sql('text')}) AS h FROM order_hits WHERE pos <= 5),
per_query AS (
  SELECT seq, query, count(*) AS k, count(*) - count(DISTINCT h) AS dup_hash_count,
         (count(*) - count(DISTINCT h)) / count(*) AS dup_hash_rate,
         CASE WHEN count(id) > 0 THEN count(id) - count(DISTINCT id) END AS dup_id_count,
         CASE WHEN count(id) > 0 THEN (count(id) - count(DISTINCT id)) / count(id) END AS dup_id_rate
  FROM hits GROUP BY seq, query),
items AS (SELECT DISTINCT seq, coalesce(id, h) AS item FROM hits),
sets AS (SELECT seq, count(*) AS k FROM hits GROUP BY seq),
shared AS (
  SELECT a.seq AS sa, b.seq AS sb, count(*) AS overlap
  FROM items a JOIN items b ON a.item = b.item AND a.seq < b.seq GROUP BY ALL),
pairs AS (
  SELECT sa, sb, overlap, least(x.k, y.k) AS k_pair
  FROM shared JOIN sets x ON x.seq = sa JOIN sets y ON y.seq = sb),
slot_counts AS (SELECT k, count(*) AS n FROM sets GROUP BY k),
all_pairs AS (
  SELECT least(x.k, y.k) AS k_pair,
         sum(CASE WHEN x.k = y.k THEN x.n * (x.n - 1) / 2 ELSE x.n * y.n END) AS n_pairs
  FROM slot_counts x JOIN slot_counts y ON x.k <= y.k GROUP BY 1),
histogram AS (
  SELECT k_pair, overlap, count(*) AS n_pairs FROM pairs GROUP BY ALL
  UNION ALL
  SELECT a.k_pair, 0, a.n_pairs - coalesce(p.n, 0)
  FROM all_pairs a LEFT JOIN (SELECT k_pair, count(*) AS n FROM pairs GROUP BY 1) p USING (k_pair)
  WHERE a.n_pairs > coalesce(p.n, 0)),
dense AS (SELECT seq, k, row_number() OVER (ORDER BY seq) AS idx FROM sets),
neighbours AS (
  SELECT a.idx - 1 AS idx, a.seq AS seq_a, b.seq AS seq_b, coalesce(s.overlap, 0) AS overlap, least(a.k, b.k) AS k_pair
  FROM dense a JOIN dense b ON b.idx = a.idx + 1 LEFT JOIN shared s ON s.sa = a.seq AND s.sb = b.seq)"""

# The same over whole lists.
LISTS_SQL = TOP5_SQL.replace(" WHERE pos <= 5", "")


@query(
    "audit_copies_per_language",
    f"""WITH {PER_LANG_SQL}
    SELECT query, k, dup_hash_count, round(dup_hash_rate, 6) AS dup_hash_rate FROM per_query""",
)
def _(spark, sf_dir):
    rows = A.intra_query_duplication(language_hits(spark, sf_dir))
    return rounded(rows.select("query", "k", "dup_hash_count", "dup_hash_rate"))


@query(
    "audit_duplication_top5",
    f"""WITH {TOP5_SQL}
    SELECT seq, query, k, dup_hash_count, round(dup_hash_rate, 6) AS dup_hash_rate, dup_id_count,
           round(dup_id_rate, 6) AS dup_id_rate FROM per_query""",
)
def _(spark, sf_dir):
    return rounded(A.intra_query_duplication(order_hits(spark, sf_dir, 5), 5))


@query(
    "audit_duplication_summary",
    f"""WITH {LISTS_SQL}
    SELECT count(*) AS n_queries, round(avg(dup_hash_rate), 6) AS avg_dup_hash_rate,
           round(avg(dup_id_rate), 6) AS avg_dup_id_rate,
           first(query ORDER BY dup_hash_rate DESC, seq) AS worst_hash_query,
           round(max(dup_hash_rate), 6) AS worst_hash_rate,
           first(query ORDER BY dup_id_rate DESC NULLS LAST, seq) AS worst_id_query,
           round(max(dup_id_rate), 6) AS worst_id_rate,
           count(*) FILTER (dup_id_rate IS NULL) AS n_without_id
    FROM per_query""",
)
def _(spark, sf_dir):
    return rounded(A.duplication_summary(A.intra_query_duplication(order_hits(spark, sf_dir))))


@query(
    "audit_duplicate_examples",
    f"""WITH {LISTS_SQL},
    firsts AS (SELECT seq, h, min(pos) AS first_pos FROM hits GROUP BY ALL)
    SELECT seq, pos, trim(text) AS snippet, query FROM hits JOIN firsts USING (seq, h)
    WHERE pos > first_pos ORDER BY seq, pos LIMIT 5""",
)
def _(spark, sf_dir):
    return rounded(A.duplicate_examples(order_hits(spark, sf_dir), n=5))


@query(
    "audit_overlap_histogram",
    f"WITH {LISTS_SQL} SELECT k_pair, overlap, CAST(n_pairs AS BIGINT) AS n_pairs FROM histogram",
)
def _(spark, sf_dir):
    h = A.overlap_histogram(A.result_sets(order_hits(spark, sf_dir)))
    return rounded(h.withColumn("n_pairs", F.col("n_pairs").cast("long")))


@query(
    "audit_cross_query_repetition",
    f"""WITH {LISTS_SQL},
    obs AS (SELECT count(*) AS n_pairs, count(*) FILTER (overlap >= least(2, k_pair)) AS k_bin,
                   avg(overlap / k_pair) AS cons_continuous_mean FROM neighbours),
    ref AS (SELECT CAST(sum(n_pairs) AS BIGINT) AS total_pairs,
                   sum(CASE WHEN overlap >= least(2, k_pair) THEN n_pairs ELSE 0 END) / sum(n_pairs) AS ref_binary_rate,
                   sum(overlap / k_pair * n_pairs) / sum(n_pairs) AS ref_continuous_mean,
                   min(overlap / k_pair) AS off_diag_min, max(overlap / k_pair) AS off_diag_max FROM histogram)
    SELECT (SELECT count(*) FROM sets) AS n_queries, n_pairs, k_bin, round(k_bin / n_pairs, 6) AS cons_binary_rate,
           round(cons_continuous_mean, 6) AS cons_continuous_mean, total_pairs, round(ref_binary_rate, 6) AS ref_binary_rate,
           round(ref_continuous_mean, 6) AS ref_continuous_mean, round(off_diag_min, 6) AS off_diag_min,
           round(off_diag_max, 6) AS off_diag_max
    FROM obs, ref""",
)
def _(spark, sf_dir):
    return rounded(A.cross_query_repetition(order_hits(spark, sf_dir)).drop("ci_low", "ci_high", "insufficient"))


@query(
    "audit_consecutive_pairs",
    f"""WITH {LISTS_SQL}
    SELECT seq_a, seq_b, overlap, k_pair, round(overlap / k_pair, 6) AS frac, overlap >= least(2, k_pair) AS "binary"
    FROM neighbours""",
)
def _(spark, sf_dir):
    pairs = A.consecutive_pairs(A.result_sets(order_hits(spark, sf_dir)))
    return rounded(pairs)


@query(
    "audit_repeat_rate_monitor",
    f"""WITH {TOP5_SQL},
    ids AS (SELECT DISTINCT seq, id FROM hits WHERE id IS NOT NULL),
    n_ids AS (SELECT d.seq, d.idx, count(i.id) AS n FROM dense d LEFT JOIN ids i USING (seq) GROUP BY ALL),
    step AS (SELECT a.seq AS sa, b.seq AS sb, b.n FROM n_ids a JOIN n_ids b ON b.idx = a.idx + 1 WHERE b.n > 0),
    common AS (SELECT sa, sb, count(*) AS inter FROM step JOIN ids x ON x.seq = sa JOIN ids y ON y.seq = sb AND y.id = x.id
               GROUP BY ALL)
    SELECT count(*) AS pairs, round(avg(CASE WHEN coalesce(inter, 0) >= least(2, n) THEN 1 ELSE 0 END), 6) AS repeat_rate,
           round(avg(coalesce(inter, 0) / 5), 6) AS overlap_frac
    FROM step LEFT JOIN common USING (sa, sb)""",
)
def _(spark, sf_dir):
    return rounded(A.repeat_rate(order_hits(spark, sf_dir, 5), 5))


SCORE_SQL = LISTS_SQL + """, stepped AS (
  SELECT *, lag(score) OVER (PARTITION BY seq ORDER BY pos) = score AS tied FROM hits WHERE score IS NOT NULL),
score_rows AS (
  SELECT seq, query, count(*) AS k,
         CASE WHEN max(score) <> 0 THEN (max(score) - min(score)) / max(score) ELSE 0 END AS spread,
         count(*) FILTER (tied) AS tied_adjacent, count(*) - 1 AS adjacent_pairs
  FROM stepped GROUP BY seq, query HAVING count(*) >= 2)"""


@query(
    "audit_score_rows",
    f"WITH {SCORE_SQL} SELECT seq, query, k, round(spread, 6) AS spread, tied_adjacent, adjacent_pairs FROM score_rows",
)
def _(spark, sf_dir):
    return rounded(A.score_rows(order_hits(spark, sf_dir)))


@query(
    "audit_score_scale",
    f"""WITH {SCORE_SQL}
    SELECT round(median(spread), 6) AS median_spread, round(avg(spread), 6) AS avg_spread,
           round(sum(tied_adjacent) / sum(adjacent_pairs), 6) AS tie_fraction,
           sum(tied_adjacent) / sum(adjacent_pairs) > 0.20 OR median(spread) < 0.10 AS flagged,
           (SELECT count(*) FROM (SELECT seq FROM hits GROUP BY seq HAVING count(score) = 0)) AS n_without_score
    FROM score_rows""",
)
def _(spark, sf_dir):
    return rounded(A.score_scale(order_hits(spark, sf_dir)))


REPORTED = (
    "avg_dup_hash_rate", "avg_dup_id_rate", "n_without_id", "k_bin", "cons_continuous_mean", "total_pairs",
    "ref_binary_rate", "ref_continuous_mean", "median_spread", "tie_fraction",
)


@query(
    "audit_report",
    f"""WITH {SCORE_SQL},
    obs AS (SELECT count(*) AS n_pairs, count(*) FILTER (overlap >= least(2, k_pair)) AS k_bin,
                   avg(overlap / k_pair) AS cons_continuous_mean FROM neighbours),
    ref AS (SELECT sum(n_pairs) AS total_pairs,
                   sum(CASE WHEN overlap >= least(2, k_pair) THEN n_pairs ELSE 0 END) / sum(n_pairs) AS ref_binary_rate,
                   sum(overlap / k_pair * n_pairs) / sum(n_pairs) AS ref_continuous_mean FROM histogram),
    long AS (
      SELECT 'duplication' AS family, 'avg_dup_hash_rate' AS metric, avg(dup_hash_rate) AS value FROM per_query
      UNION ALL SELECT 'duplication', 'avg_dup_id_rate', avg(dup_id_rate) FROM per_query
      UNION ALL SELECT 'duplication', 'n_without_id', count(*) FILTER (dup_id_rate IS NULL) FROM per_query
      UNION ALL SELECT 'repetition', 'k_bin', k_bin FROM obs
      UNION ALL SELECT 'repetition', 'cons_continuous_mean', cons_continuous_mean FROM obs
      UNION ALL SELECT 'repetition', 'total_pairs', total_pairs FROM ref
      UNION ALL SELECT 'repetition', 'ref_binary_rate', ref_binary_rate FROM ref
      UNION ALL SELECT 'repetition', 'ref_continuous_mean', ref_continuous_mean FROM ref
      UNION ALL SELECT 'score_scale', 'median_spread', median(spread) FROM score_rows
      UNION ALL SELECT 'score_scale', 'tie_fraction', sum(tied_adjacent) / sum(adjacent_pairs) FROM score_rows)
    SELECT family, metric, round(CAST(value AS DOUBLE), 6) AS value FROM long""",
)
def _(spark, sf_dir):
    return rounded(A.audit_metrics(order_hits(spark, sf_dir)).filter(F.col("metric").isin(*REPORTED)))


TOPICALITY_SQL = TOP5_SQL + """, shuffled AS (
  SELECT seq, k, row_number() OVER (
    ORDER BY CAST('0x' || substr(md5('20260728:' || seq), 1, 11) AS BIGINT), seq) AS idx FROM sets),
permuted AS (
  SELECT least(a.seq, b.seq) AS sa, greatest(a.seq, b.seq) AS sb, least(a.k, b.k) AS k_pair
  FROM shuffled a JOIN shuffled b ON b.idx = a.idx + 1),
gap AS (
  SELECT (SELECT count(*) FROM neighbours) AS n_pairs,
         (SELECT count(*) FILTER (overlap >= least(2, k_pair)) FROM neighbours) AS k_real,
         (SELECT count(*) FILTER (coalesce(overlap, 0) >= least(2, k_pair)) FROM permuted LEFT JOIN shared USING (sa, sb)) AS k_shuffled,
         (SELECT sum(CASE WHEN overlap >= least(2, k_pair) THEN n_pairs ELSE 0 END) / sum(n_pairs) FROM histogram) AS neutral)"""


@query(
    "topicality_gap",
    f"""WITH {TOPICALITY_SQL}
    SELECT n_pairs, k_real, round(k_real / n_pairs, 6) AS "real", k_shuffled, round(k_shuffled / n_pairs, 6) AS shuffled,
           round(neutral, 6) AS neutral, round((k_real - k_shuffled) / n_pairs * 100, 6) AS gap_pp,
           neutral BETWEEN least(k_real, k_shuffled) / n_pairs AND greatest(k_real, k_shuffled) / n_pairs AS valid
    FROM gap""",
)
def _(spark, sf_dir):
    return rounded(A.topicality(order_hits(spark, sf_dir, 5)).drop("real_lo", "real_hi"))


@query(
    "verdict_topicality",
    f"""WITH {TOPICALITY_SQL}, g AS (SELECT n_pairs, (k_real - k_shuffled) / n_pairs * 100 AS gap_pp FROM gap)
    SELECT n_pairs, round(gap_pp, 6) AS gap_pp, CASE WHEN n_pairs + 1 < 20 THEN 'SEM PODER' WHEN gap_pp >= 15 THEN 'H1 — TOPICALIDADE DOMINA'
           WHEN gap_pp <= 5 THEN 'H0 — PATOLOGIA' ELSE 'MISTO' END AS verdict FROM g""",
)
def _(spark, sf_dir):
    return rounded(topicality_verdict(A.topicality(order_hits(spark, sf_dir, 5))).select("n_pairs", "gap_pp", "verdict"))
