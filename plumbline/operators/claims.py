"""Claim-support pairs: three strata per claim, verifier scores, separation and best cut-off."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.bits import order_bits
from plumbline.functions.claims import VERIFIERS, Verifier, negate
from plumbline.functions.stats import wilson
from plumbline.operators.ordering import shift_neighbour, with_prior_sums
from plumbline.session import checkpointed

STRATA = ("suportada", "trocada", "negada")


def claim_universe(entries: DataFrame) -> DataFrame:
    """``(seq, id, claim, text)`` of entries with a non-blank id, claim and text."""
    filled = [T.strip(F.coalesce(c, F.lit(""))) for c in ("id", "claim", "text")]
    return entries.filter((filled[0] != "") & (filled[1] != "") & (filled[2] != "")).select(
        "seq", "id", T.strip("claim").alias("claim"), T.strip("text").alias("text")
    )


def claim_pairs(universe: DataFrame, order: str = "seq") -> DataFrame:
    """Each claim with its own text, with its neighbour's text, and negated with its own text."""
    near = shift_neighbour(universe, order, ["id", "text"], out="n")
    negated = negate("claim")
    rows = F.array(
        F.struct(F.lit("suportada").alias("stratum"), F.col("claim").alias("claim"), F.col("text").alias("text"), F.col("id").alias("text_id"),
                 F.lit(True).alias("truth"), F.lit("").alias("rule")),
        F.struct(F.lit("trocada").alias("stratum"), F.col("claim").alias("claim"), F.col("n.text").alias("text"), F.col("n.id").alias("text_id"),
                 F.lit(False).alias("truth"), F.lit("").alias("rule")),
        F.struct(F.lit("negada").alias("stratum"), negated["text"].alias("claim"), F.col("text").alias("text"), F.col("id").alias("text_id"),
                 F.lit(False).alias("truth"), negated["rule"].alias("rule")),
    )
    return near.select("seq", F.explode(rows).alias("p")).select("seq", "p.*")


def score_pairs(pairs: DataFrame, verifiers: Mapping[str, Verifier] = VERIFIERS) -> DataFrame:
    """One ``score_<name>`` column per verifier."""
    return pairs.withColumns({f"score_{n}": F.round(fn(F.col("claim"), F.col("text")), 6) for n, fn in verifiers.items()})


def separations(scored: DataFrame, names: Sequence[str] = tuple(VERIFIERS), pairs=(("suportada", "trocada"), ("suportada", "negada"))) -> DataFrame:
    """Complete separation min(A) > max(B) per verifier and pair of strata, with the margin.

    An empty stratum separates nothing. All minima and maxima come from one aggregate.
    """
    aggs, rows = [], []
    for n in names:
        for a, b in pairs:
            lo, hi = f"_{n}_{a}_{b}_min", f"_{n}_{a}_{b}_max"
            aggs += [
                F.min(F.when(F.col("stratum") == a, F.col(f"score_{n}"))).alias(lo),
                F.max(F.when(F.col("stratum") == b, F.col(f"score_{n}"))).alias(hi),
            ]
            rows.append(
                F.struct(
                    F.lit(n).alias("verifier"), F.lit(a).alias("above"), F.lit(b).alias("below"), F.col(lo).alias("min_above"),
                    F.col(hi).alias("max_below"), F.coalesce(F.col(lo) > F.col(hi), F.lit(False)).alias("separates"),
                    F.round(F.col(lo) - F.col(hi), 6).alias("margin"),
                )
            )
    return scored.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def claim_metrics(scored: DataFrame) -> DataFrame:
    """The one-row input of the claim verdict."""
    s = separations(scored)
    pick = {"cego": "cego", "lexico": "lexico", "lexneg": "lexico_negacao"}
    flags = [
        F.bool_or(F.when((F.col("verifier") == v) & (F.col("below") == b), F.col("separates"))).alias(f"{short}_{b}")
        for short, v in pick.items() for b in ("trocada", "negada")
    ]
    sizes = scored.agg(*[F.count_if(F.col("stratum") == x).alias(f"n_{x}") for x in STRATA])
    return s.agg(*flags).crossJoin(sizes)


def best_threshold(scored: DataFrame, score: str, truth: str = "truth") -> DataFrame:
    """The cut-off with most correct calls (score >= cut-off means true), the smallest on a tie.

    Rows are first merged by distinct score, once; the sums below each score come from cells of the
    scores' order-preserving bits, so neither step gathers the data or merges different scores.
    """
    per_score = checkpointed(
        scored.groupBy(order_bits(score).alias("k")).agg(
            F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"), F.min(score).alias("cut")
        )
    )
    totals = per_score.agg(F.sum("pos").alias("all_pos"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
    below = with_prior_sums(per_score, "k", ["pos", "neg"], levels=3)
    correct = F.col("all_pos") - F.col("prior_pos") + F.col("prior_neg")
    best = (
        below.crossJoin(totals)
        .withColumn("correct", correct)
        .agg(F.max_by(F.struct("cut", "correct", "n"), F.struct(F.col("correct"), -F.col("k"))).alias("b"))
        .select("b.*")
        .withColumn("ci", wilson("correct", "n"))
    )
    return best.select("cut", "correct", "n", (F.col("correct") / F.col("n")).alias("accuracy"), F.col("ci.lo").alias("lo"), F.col("ci.hi").alias("hi"))
