"""Rank metrics of retrieval lists against known targets, and re-ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import share, wilson
from plumbline.functions.text import overlap_share, rerank_tokens

# Weight of the concept overlap and the size of a candidate pool.
RERANK_WEIGHT = 0.25


def target_ranks(hits: DataFrame, targets: DataFrame, cutoff: int | None = None) -> DataFrame:
    """Best 1-based position of any target per query of ``targets(seq, id)``; null if not in the list."""
    rows = hits if cutoff is None else hits.filter(F.col("pos") <= cutoff)
    found = rows.select("seq", "id", "pos").join(targets.select("seq", "id").distinct(), ["seq", "id"])
    best = found.groupBy("seq").agg(F.min("pos").alias("target_rank"))
    return targets.select("seq").distinct().join(best, "seq", "left")


def rank_metrics(hits: DataFrame, targets: DataFrame, ks: Sequence[int] = (3, 5), cutoff: int | None = 5) -> DataFrame:
    """Target rank, recall@k flags and reciprocal rank per query.

    ``cutoff`` limits what counts as found, for the reciprocal rank too; None uses the whole list.
    """
    ranks = target_ranks(hits, targets, cutoff)
    found = [F.coalesce(F.col("target_rank") <= k, F.lit(False)).cast("int").alias(f"recall_at_{k}") for k in ks]
    return ranks.select("seq", "target_rank", *found, F.coalesce(1.0 / F.col("target_rank"), F.lit(0.0)).alias("reciprocal_rank"))


def retrieval_scores(metrics: DataFrame, by: str = "condition") -> DataFrame:
    """Recall@3, recall@5 with intervals and the mean reciprocal rank per condition."""
    return (
        metrics.groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("recall_at_3").alias("r3"), F.sum("recall_at_5").alias("r5"),
            F.avg("reciprocal_rank").alias("mrr"),
        )
        .withColumns({"_c3": wilson("r3", "n"), "_c5": wilson("r5", "n")})
        .select(
            by, "n", "r3", "r5", share("r3", "n").alias("recall_3"), F.col("_c3.lo").alias("r3_lo"), F.col("_c3.hi").alias("r3_hi"),
            share("r5", "n").alias("recall_5"), F.col("_c5.lo").alias("r5_lo"), F.col("_c5.hi").alias("r5_hi"), "mrr",
        )
    )


def group_scores(metrics: DataFrame, by: str = "condition", grp: str = "grupo") -> DataFrame:
    """Sums by query group: vague share of summaries, recall of specific queries, named target, guard.

    ``metrics`` has ``flag5, slots5, flag10, slots10, resolved, target_rank, reciprocal_rank``.
    """
    vague, named, guard = F.col(grp) == "vaga", F.col(grp) == "redis", F.col(grp) == "guarda"
    specific = F.col(grp).isin("redis", "especifica")
    top = lambda k: F.coalesce(F.col("target_rank") <= k, F.lit(False))
    solved = specific & F.coalesce("resolved", F.lit(False))

    def total(cond: Column, x: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(x))), F.lit(0))

    return (
        metrics.groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n_queries"), total(vague, "flag5").alias("v5"), total(vague, "slots5").alias("vn5"),
            total(vague, "flag10").alias("v10"), total(vague, "slots10").alias("vn10"), total(specific, "flag5").alias("s5"),
            total(specific, "slots5").alias("sn5"), F.count_if(solved).alias("resolved"), F.count_if(solved & top(3)).alias("hit3"),
            F.count_if(solved & top(5)).alias("hit5"), total(solved, "reciprocal_rank").alias("rr"), F.count_if(named).alias("named_n"),
            F.count_if(named & top(5)).alias("named_hit5"), F.count_if(guard).alias("guard_n"),
            F.count_if(guard & (F.col("flag5") >= 1)).alias("guard_hits"),
        )
        .withColumns({"_v": wilson("v5", "vn5"), "_r": wilson("hit5", "resolved")})
        .select(
            by, "n_queries", share("v5", "vn5").alias("vague_share5"), F.col("_v.lo").alias("vague_lo"), F.col("_v.hi").alias("vague_hi"),
            share("v10", "vn10").alias("vague_share10"), share("s5", "sn5").alias("specific_share5"), "resolved",
            share("hit3", "resolved").alias("recall3"), share("hit5", "resolved").alias("recall5"), F.col("_r.lo").alias("recall5_lo"),
            F.col("_r.hi").alias("recall5_hi"), share("rr", "resolved").alias("mrr"), "named_hit5", "named_n", "guard_hits", "guard_n",
        )
    )


def paired_rank_shift(metrics: DataFrame, baseline: str, treatment: str, worst: int = 6) -> DataFrame:
    """How many queries moved up, down or stayed; outside the cut-off counts as rank ``worst``."""

    def rank(label: str) -> Column:
        return F.coalesce(F.min(F.when(F.col("condition") == label, F.col("target_rank"))), F.lit(worst))

    per_query = metrics.groupBy("seq").agg(rank(baseline).alias("b"), rank(treatment).alias("t"))
    return per_query.agg(
        F.count_if(F.col("t") < F.col("b")).alias("moved_up"), F.count_if(F.col("t") > F.col("b")).alias("moved_down"),
        F.count_if(F.col("t") == F.col("b")).alias("unchanged"),
    )


def dominance(hits: DataFrame, flag: Column, targets: DataFrame | None = None) -> DataFrame:
    """Share of flagged results in the top 5 and top 10 per query; with targets also their fate.

    ``flagged_above`` counts flagged results before the target, or all of them without one.
    """
    rows = hits.select("seq", *(["id"] if targets is not None else []), "pos", F.coalesce(flag, F.lit(False)).alias("_f"), F.lit(True).alias("_hit"))
    pos, hit = F.col("pos"), F.coalesce("_hit", F.lit(False))
    shares = [
        F.count_if(hit).alias("n_results"), F.count_if(F.col("_f") & (pos <= 5)).alias("flag5"), F.count_if(hit & (pos <= 5)).alias("slots5"),
        F.count_if(F.col("_f") & (pos <= 10)).alias("flag10"), F.count_if(hit & (pos <= 10)).alias("slots10"),
    ]
    fractions = {"frac5": F.col("flag5") / F.greatest("slots5", F.lit(1)), "frac10": F.col("flag10") / F.greatest("slots10", F.lit(1))}
    if targets is None:
        return rows.groupBy("seq").agg(*shares).withColumns(fractions)
    # Targets go along as rows of their own, so that one exchange by query serves their match, the rank and the counts.
    both = rows.unionByName(targets.select("seq", "id", F.lit(True).alias("_target")), allowMissingColumns=True)
    placed = both.repartition("seq")
    matched = F.col("seq").isNotNull() & F.col("id").isNotNull() & F.max("_target").over(Window.partitionBy("seq", "id"))
    found = placed.withColumn("_t", hit & F.coalesce(matched, F.lit(False)))
    ranked = found.withColumn("target_rank", F.min(F.when(F.col("_t"), pos)).over(Window.partitionBy("seq")))
    above = F.col("_f") & (F.col("target_rank").isNull() | (pos < F.col("target_rank")))
    per = ranked.groupBy("seq").agg(
        *shares, F.min("target_rank").alias("target_rank"), F.count_if(above).alias("flagged_above"),
        (F.col("seq").isNotNull() & F.coalesce(F.max("_target"), F.lit(False))).alias("resolved"),
    ).filter("n_results > 0")
    in5 = F.coalesce(F.col("target_rank") <= 5, F.lit(False))
    return per.withColumns(fractions).select(
        "seq", "n_results", "flag5", "slots5", "flag10", "slots10", "target_rank", "frac5", "frac10", "resolved", in5.alias("target_in_top5"),
        (F.col("resolved") & ~in5).alias("target_expelled"), F.coalesce(1.0 / F.col("target_rank"), F.lit(0.0)).alias("reciprocal_rank"), "flagged_above",
    )


def top_examples(hits: DataFrame, flag: Column, targets: DataFrame, n: int = 5, preview: int = 110) -> DataFrame:
    """The first results of each query with flags and a preview."""
    known = targets.select("seq", "id").distinct().withColumn("_t", F.lit(True))
    return hits.filter(F.col("pos") <= n).join(known, ["seq", "id"], "left").select(
        "seq", "pos", "id", "score", F.coalesce(flag, F.lit(False)).alias("flagged"), F.coalesce("_t", F.lit(False)).alias("is_target"),
        F.substring(F.translate(F.coalesce("text", F.lit("")), "\n", " "), 1, preview).alias("preview"),
    )


def support_recall(hits: DataFrame, support: DataFrame, by: str = "condition") -> DataFrame:
    """Share of each query's supporting ids that an arm's list contains."""
    want = support.select("seq", "id").distinct()
    sizes = want.groupBy("seq").agg(F.count(F.lit(1)).alias("n_support"))
    arms = hits.select(by, "seq").distinct()
    got = hits.select(by, "seq", "id").distinct().join(want, ["seq", "id"]).groupBy(by, "seq").agg(F.count(F.lit(1)).alias("n_found"))
    return (
        arms.join(sizes, "seq")
        .join(got, [by, "seq"], "left")
        .select(by, "seq", "n_support", F.coalesce("n_found", F.lit(0)).alias("n_found"))
        .withColumn("recall", F.col("n_found") / F.col("n_support"))
    )


def rerank(pool: DataFrame, weight: float = RERANK_WEIGHT, wrong_field: bool = False) -> DataFrame:
    """Re-order each pool by ``score + weight * overlap`` of query tokens with concepts and domain.

    Ties go to the higher base score, then to the earlier position. ``wrong_field`` takes the
    fields of the next candidate (the first for the last one): the negative control. Windows
    run over one candidate pool, whose size is the retrieval depth.
    """
    fields = F.array_distinct(F.array_union(rerank_tokens("domain"), F.array_distinct(F.flatten(F.transform("concepts", rerank_tokens)))))
    rows = pool.withColumn("_c", F.coalesce(fields, rerank_tokens("domain")))
    if wrong_field:
        # Tokens hold no space, so they are sorted and moved as one string, which takes a fraction of an array's room.
        w = Window.partitionBy("seq").orderBy("pos")
        told = rows.withColumn("_c", F.array_join("_c", " "))
        moved = told.withColumn("_c", F.coalesce(F.lead("_c").over(w), F.first("_c").over(w)))
        rows = moved.withColumn("_c", F.filter(F.split("_c", " "), lambda t: t != ""))
    overlap = overlap_share(F.col("_c"), rerank_tokens("query"))
    scored = rows.withColumn("overlap", overlap).withColumn("treatment_score", F.col("score") + weight * F.col("overlap"))
    order = Window.partitionBy("seq").orderBy(F.desc("treatment_score"), F.desc("score"), "pos")
    return scored.withColumn("base_pos", F.col("pos")).withColumn("pos", F.row_number().over(order)).drop("_c")


def dedup_refill(pool: DataFrame, k: int, text_hash: str = "h") -> DataFrame:
    """Collapse a ranked over-fetched pool by id, then by text hash, and fill up to ``k`` again.

    A result without an id is its own id group.
    """
    by_id = Window.partitionBy("seq", "id", F.when(F.col("id").isNull(), F.col("pos"))).orderBy("pos")
    by_hash = Window.partitionBy("seq", text_hash).orderBy("pos")
    once = pool.withColumn("_i", F.row_number().over(by_id)).filter("_i = 1").drop("_i")
    twice = once.withColumn("_h", F.row_number().over(by_hash)).filter("_h = 1").drop("_h")
    ranked = twice.withColumn("base_pos", F.col("pos")).withColumn("pos", F.row_number().over(Window.partitionBy("seq").orderBy("base_pos")))
    return ranked.filter(F.col("pos") <= k)
