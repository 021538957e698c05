"""Audit of retrieval results: copies, repetition across queries, score collapse.

Input is the long form ``hits(seq, query, pos, id, text, score)``: ``seq`` orders the queries,
``pos`` (1-based) the results of one query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.stats import share, wilson
from plumbline.operators.ordering import with_next, with_previous
from plumbline.operators.overlaps import pair_overlaps
from plumbline.operators.quantiles import medians
from plumbline.session import checkpointed

# When the score scale counts as collapsed.
TIE_LIMIT = 0.20
SPREAD_LIMIT = 0.10


def slice_top_k(hits: DataFrame, k: int | None) -> DataFrame:
    return hits if k is None else hits.filter(F.col("pos") <= k)


def rank_hits(hits: DataFrame, order: Sequence[Column | str], k: int | None = None) -> DataFrame:
    """Assign ``pos`` within each query; with ``k`` only the best k rows of a task are shuffled."""
    ranked = hits.withColumn("pos", F.row_number().over(Window.partitionBy("seq").orderBy(*order)))
    return slice_top_k(ranked, k)


def intra_query_duplication(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Per query: slots, copies by text and by id, and their rates.

    The id rate is null (not zero) for a query without ids. Lists cut to ``k`` are at most k long,
    so their sets are built in place; lists of any length are counted over (query, text) and
    (query, id) groups, which combine map-side.
    """
    rows = slice_top_k(hits, k).select(
        "seq", "query", T.text_hash("text").alias("h"), F.nullif(F.col("id"), F.lit("")).alias("id")
    )

    def distinct(c: str) -> Column:
        return F.size(F.collect_set(c)).cast("long") if k else F.count_distinct(c)

    return (
        rows.groupBy("seq", "query")
        .agg(F.count(F.lit(1)).alias("k"), F.count("id").alias("k_id"), distinct("h").alias("d_h"), distinct("id").alias("d_id"))
        .select(
            "seq", "query", "k",
            (F.col("k") - F.col("d_h")).alias("dup_hash_count"),
            ((F.col("k") - F.col("d_h")) / F.col("k")).alias("dup_hash_rate"),
            F.when(F.col("k_id") > 0, F.col("k_id") - F.col("d_id")).alias("dup_id_count"),
            F.when(F.col("k_id") > 0, (F.col("k_id") - F.col("d_id")) / F.col("k_id")).alias("dup_id_rate"),
        )
    )


def duplication_summary(per_query: DataFrame) -> DataFrame:
    """Averages and the worst query of each kind; the first query wins a tie."""

    def worst(rate: str, what: str) -> Column:
        return F.max_by(what, F.struct(F.col(rate), -F.col("seq")))

    return per_query.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg("dup_hash_rate").alias("avg_dup_hash_rate"),
        F.avg("dup_id_rate").alias("avg_dup_id_rate"),
        worst("dup_hash_rate", "query").alias("worst_hash_query"),
        F.max("dup_hash_rate").alias("worst_hash_rate"),
        F.max_by("query", F.when(F.col("dup_id_rate").isNotNull(), F.struct(F.col("dup_id_rate"), -F.col("seq")))).alias(
            "worst_id_query"
        ),
        F.max("dup_id_rate").alias("worst_id_rate"),
        F.count_if(F.col("dup_id_rate").isNull()).alias("n_without_id"),
    )


def duplicate_examples(hits: DataFrame, k: int | None = None, n: int = 5) -> DataFrame:
    """The first ``n`` repeated results in reading order, each after its first occurrence."""
    rows = slice_top_k(hits, k).withColumn("h", T.text_hash("text"))
    first = rows.groupBy("seq", "h").agg(F.min("pos").alias("first_pos"))
    return (
        rows.join(first, ["seq", "h"])
        .filter(F.col("pos") > F.col("first_pos"))
        .orderBy("seq", "pos")
        .limit(n)
        .select(
            "seq", "pos",
            F.substring(F.translate(T.strip("text"), "\n", " "), 1, 80).alias("snippet"),
            T.truncate("query").alias("query"),
        )
    )


def result_sets(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Per query: distinct identities ``items``, ``n_items`` and the slot count ``k``."""
    return (
        slice_top_k(hits, k)
        .select("seq", "query", T.identity("id", "text").alias("item"))
        .groupBy("seq", "query")
        .agg(F.sort_array(F.collect_set("item")).alias("items"), F.count(F.lit(1)).alias("k"))
        .withColumn("n_items", F.size("items"))
    )


def overlap_histogram(sets: DataFrame) -> DataFrame:
    """How many query pairs have slot minimum ``k_pair`` and share ``overlap`` items, for lists of any length."""
    return pair_overlaps(sets.select("items", "k")).withColumn("overlap", F.col("overlap").cast("int"))


def reference_repetition(histogram: DataFrame) -> DataFrame:
    """Order-free reference over all pairs: binary rate, mean share, extremes."""
    frac = F.col("overlap") / F.col("k_pair")
    binary = F.col("overlap") >= F.least(F.lit(2), F.col("k_pair"))
    total = F.sum("n_pairs").cast("double")
    return histogram.agg(
        F.sum("n_pairs").cast("long").alias("total_pairs"),
        (F.sum(F.when(binary, F.col("n_pairs")).otherwise(F.lit(0))).cast("double") / total).alias("ref_binary_rate"),
        (F.sum(frac * F.col("n_pairs").cast("double")) / total).alias("ref_continuous_mean"),
        F.min(frac).alias("off_diag_min"),
        F.max(frac).alias("off_diag_max"),
    )


def consecutive_pairs(sets: DataFrame, order: str = "seq", tie: Sequence[str] = ()) -> DataFrame:
    """Overlap of each query's set with the next query's, in order; empty lists never appear in ``sets``."""
    columns = dict.fromkeys([order, *tie, "seq", "items", "k"])
    paired = with_next(sets.select(*columns), order, ["seq", "items", "k"], out="_n", tie=tie).filter(F.col("_n").isNotNull())
    overlap, k_pair = F.size(F.array_intersect("items", "_n.items")), F.least(F.col("k"), F.col("_n.k"))
    return paired.select(
        F.col("seq").alias("seq_a"), F.col("_n.seq").alias("seq_b"),
        overlap.alias("overlap"), k_pair.alias("k_pair"), (overlap / k_pair).alias("frac"),
        (overlap >= F.least(F.lit(2), k_pair)).alias("binary"),
    )


def observed_repetition(pairs: DataFrame) -> DataFrame:
    ci = wilson("k_bin", "n_pairs")
    return (
        pairs.agg(
            F.count(F.lit(1)).alias("n_pairs"), F.count_if("binary").alias("k_bin"), F.avg("frac").alias("cons_continuous_mean")
        )
        .withColumn("cons_binary_rate", F.when(F.col("n_pairs") > 0, F.col("k_bin") / F.col("n_pairs")))
        .withColumn("ci", ci)
        .select("n_pairs", "k_bin", "cons_binary_rate", "cons_continuous_mean", F.col("ci.lo").alias("ci_low"),
                F.col("ci.hi").alias("ci_high"))
    )


def cross_query_repetition(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Observed repetition of neighbours next to the all-pairs reference; one row.

    With fewer than two non-empty queries every rate is null and ``insufficient`` is true.
    """
    sets = checkpointed(result_sets(hits, k))
    n = sets.agg(F.count(F.lit(1)).alias("n_queries"))
    return (
        n.crossJoin(observed_repetition(consecutive_pairs(sets)))
        .crossJoin(reference_repetition(overlap_histogram(sets)))
        .withColumn("insufficient", F.col("n_queries") < 2)
    )


def pairwise_overlap(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Pairs of queries (a < b) that share something, for inspecting a small selection.

    Output grows with the number of co-occurring pairs; the rates above do not need it.
    """
    sets = result_sets(hits, k)
    flat = sets.select("seq", "k", F.explode("items").alias("item"))
    a = flat.select(F.col("seq").alias("seq_a"), F.col("k").alias("ka"), "item")
    b = flat.select(F.col("seq").alias("seq_b"), F.col("k").alias("kb"), "item")
    return (
        a.join(b, "item")
        .filter("seq_a < seq_b")
        .groupBy("seq_a", "seq_b")
        .agg(F.count(F.lit(1)).alias("overlap"), F.min(F.least("ka", "kb")).alias("k_pair"))
        .withColumn("frac", F.col("overlap") / F.col("k_pair"))
        .withColumn("binary", F.col("overlap") >= F.least(F.lit(2), F.col("k_pair")))
    )


def repeat_rate(hits: DataFrame, k: int = 5, by_current: bool = False) -> DataFrame:
    """Monitor variant: a result list repeats its predecessor if it shares min(2, |current|) ids.

    ``by_current`` divides the overlap by the size of the current set instead of ``k``.
    Lists without ids are not counted as current, but stay in the order.
    """
    sets = (
        slice_top_k(hits, k)
        .groupBy("seq")
        .agg(F.collect_set(F.nullif(F.col("id"), F.lit(""))).alias("ids"))
    )
    inter = F.size(F.array_intersect("ids", "_p.ids"))
    size = F.size("ids")
    return (
        with_previous(sets, "seq", ["ids"], out="_p")
        .filter(F.col("_p").isNotNull() & (size > 0))
        .select((inter >= F.least(F.lit(2), size)).alias("rep"), (inter / (size if by_current else F.lit(float(k)))).alias("ov"))
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            F.coalesce(F.avg(F.col("rep").cast("double")), F.lit(0.0)).alias("repeat_rate"),
            F.coalesce(F.avg("ov"), F.lit(0.0)).alias("overlap_frac"),
        )
    )


def score_rows(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Per query with at least two scores: relative spread and exact ties between neighbours."""
    scored = slice_top_k(hits, k).filter(F.col("score").isNotNull())
    tied = F.lag("score").over(Window.partitionBy("seq").orderBy("pos")) == F.col("score")
    return (
        scored.withColumn("tied", tied)
        .groupBy("seq", "query")
        .agg(
            F.count(F.lit(1)).alias("k"), F.max("score").alias("mx"), F.min("score").alias("mn"),
            F.count_if("tied").alias("tied_adjacent"),
        )
        .filter("k >= 2")
        .select(
            "seq", "query", "k",
            F.when(F.col("mx") != 0, (F.col("mx") - F.col("mn")) / F.col("mx")).otherwise(F.lit(0.0)).alias("spread"),
            "tied_adjacent", (F.col("k") - 1).alias("adjacent_pairs"),
        )
    )


def score_scale(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Median and mean spread, tie fraction and the collapse flag; one row."""
    rows = score_rows(hits, k)
    totals = rows.agg(
        F.avg("spread").alias("avg_spread"), F.sum("tied_adjacent").alias("tied"), F.sum("adjacent_pairs").alias("pairs")
    )
    unscored = (
        slice_top_k(hits, k).groupBy("seq").agg(F.count("score").alias("n")).agg(F.count_if(F.col("n") == 0).alias("n_without_score"))
    )
    middle = medians(rows, "spread")
    fraction = F.when(F.col("pairs") > 0, F.col("tied") / F.col("pairs"))
    return (
        totals.crossJoin(unscored)
        .join(middle.select("median"), how="left")
        .select(
            F.col("median").alias("median_spread"), "avg_spread", fraction.alias("tie_fraction"),
            (F.coalesce(fraction > TIE_LIMIT, F.lit(False)) | F.coalesce(F.col("median") < SPREAD_LIMIT, F.lit(False))).alias("flagged"),
            "n_without_score",
        )
    )


def audit_metrics(hits: DataFrame, k: int | None = None, rejects: DataFrame | None = None) -> DataFrame:
    """The whole audit as one long table ``(family, metric, value)``."""

    def melt(one_row: DataFrame, family: str) -> DataFrame:
        numeric = [c for c, t in one_row.dtypes if t not in ("string",)]
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric])
        return one_row.select(F.explode(pairs).alias("p")).select(F.lit(family).alias("family"), "p.metric", "p.value")

    out = (
        melt(duplication_summary(intra_query_duplication(hits, k)), "duplication")
        .unionByName(melt(cross_query_repetition(hits, k), "repetition"))
        .unionByName(melt(score_scale(hits, k), "score_scale"))
    )
    if rejects is not None:
        counts = rejects.groupBy("reason").agg(F.count(F.lit(1)).cast("double").alias("value"))
        out = out.unionByName(counts.select(F.lit("rejects").alias("family"), F.col("reason").alias("metric"), "value"))
    return out


def topicality(hits: DataFrame, k: int = 5, seed: int = 20260728) -> DataFrame:
    """Observed minus shuffled-order repetition in percentage points; one row.

    The shuffled order permutes the collected result sets; nothing is retrieved again. The
    neutral reference is the same for both orders and must lie between them.
    """
    from plumbline.functions.hashing import shuffle_rank

    sets = checkpointed(result_sets(hits, k))
    # 44 bits of the digest give the LONG order, seq settles equal digests.
    permuted = sets.withColumn("shuffled", F.conv(F.substring(shuffle_rank(seed, "seq"), 1, 11), 16, 10).cast("long"))
    real = observed_repetition(consecutive_pairs(sets)).select(
        "n_pairs", F.col("k_bin").alias("k_real"), F.col("cons_binary_rate").alias("real"), F.col("ci_low").alias("real_lo"),
        F.col("ci_high").alias("real_hi"),
    )
    shuf = observed_repetition(consecutive_pairs(permuted, "shuffled", ["seq"])).select(
        F.col("k_bin").alias("k_shuffled"), F.col("cons_binary_rate").alias("shuffled")
    )
    ref = reference_repetition(overlap_histogram(sets)).select(F.col("ref_binary_rate").alias("neutral"))
    return real.crossJoin(shuf).crossJoin(ref).withColumn("gap_pp", (F.col("real") - F.col("shuffled")) * 100).withColumn(
        "valid",
        (F.col("neutral") >= F.least("real", "shuffled")) & (F.col("neutral") <= F.greatest("real", "shuffled")),
    )
