"""Label tables: content groups, propagation, rule evaluation and ground-truth extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.hashing import shuffle_rank

# The class prefix that counts as positive and the class left out of the matrix.
POSITIVE_PREFIX = "VENENO"
AMBIGUOUS = "AMBIGUO"


def label_groups(labels: DataFrame) -> DataFrame:
    """One row per content group of ``labels(seq, id, store, origem, query, resposta, rotulo)``.

    ``content`` is the digest that groups, ``key`` its first 12 digits.

    ``label`` is the group's only label (null if none or several), ``divergent`` marks several.
    The first row represents the group. Everything is a combinable aggregate, so a group that
    holds a large share of the rows is merged map-side.
    """
    lab = F.nullif(T.strip(F.coalesce("rotulo", F.lit(""))), F.lit(""))
    first = F.min_by(F.struct("id", "store", "origem", "query"), "seq")
    return (
        labels.withColumn("key", T.content_key("query", "resposta"))
        .groupBy("key")
        .agg(
            F.min(lab).alias("_a"), F.max(lab).alias("_b"), F.count(F.lit(1)).alias("n_rows"), first.alias("_first"),
            F.array_join(F.sort_array(F.collect_set("store")), "|").alias("stores"),
        )
        .select(
            T.short_key("key").alias("key"), F.col("key").alias("content"), "n_rows", "stores", F.coalesce(F.col("_a") != F.col("_b"), F.lit(False)).alias("divergent"),
            F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias("label"),
            F.col("_first.id").alias("id"), F.col("_first.origem").alias("origem"), F.col("_first.query").alias("query"),
        )
    )


def dedup_summary(groups: DataFrame) -> DataFrame:
    """Raw and deduplicated sizes, rows lost to divergent labels, ambiguous representatives."""
    return groups.agg(
        F.sum("n_rows").alias("n_raw"), F.count(F.lit(1)).alias("n_groups"), F.count_if(~F.col("divergent")).alias("n_dedup"),
        F.coalesce(F.sum(F.when(F.col("divergent"), F.col("n_rows"))), F.lit(0)).alias("n_divergent_rows"),
        F.count_if("divergent").alias("n_divergent_groups"), F.count_if(F.col("label") == AMBIGUOUS).alias("n_ambiguous"),
    )


def propagate_labels(labels: DataFrame) -> DataFrame:
    """Give every member the single label of its content group.

    A join on the key, not a window over it: a hot group can be split by adaptive execution.
    """
    single = label_groups(labels).filter("label IS NOT NULL").select(F.col("content").alias("key"), F.col("label").alias("group_label"))
    return (
        labels.withColumn("key", T.content_key("query", "resposta"))
        .join(single, "key", "left")
        .withColumn("rotulo", F.coalesce("group_label", "rotulo"))
        .drop("key", "group_label")
    )


def class_distribution(labels: DataFrame) -> DataFrame:
    return label_groups(labels).filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n_groups"))


def with_rule(features: DataFrame, rule: str, out: str) -> DataFrame:
    """Evaluate a boolean rule over feature columns; a rule over a column that is not there is false.

    Any other fault of a rule is an error.

    Absent flags count as false before the rule sees them, so ``NOT flag`` holds for them.
    """
    flags = [c for c, t in features.dtypes if t == "boolean"]
    kept = [c for c in features.columns if c not in flags]
    view = features.select(*kept, *[F.coalesce(c, F.lit(False)).alias(c) for c in flags], F.struct(*features.columns).alias("_row"))
    try:
        judged = view.select("_row.*", F.coalesce(F.expr(rule).cast("boolean"), F.lit(False)).alias(out))
    except AnalysisException as fault:
        if not (fault.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            raise
        judged = view.select("_row.*", F.lit(False).alias(out))
    return judged


def judged_pairs(labels: DataFrame, features: DataFrame, rule: str) -> DataFrame:
    """Representatives with a usable label, their features joined by id, truth ``y`` and prediction ``p``."""
    reps = label_groups(labels).filter(F.col("label").isNotNull() & (F.col("label") != AMBIGUOUS))
    facts = with_rule(features, rule, "p").select("id", "p")
    return reps.join(facts, "id").withColumn("y", F.startswith("label", F.lit(POSITIVE_PREFIX)))


def confusion(judged: DataFrame) -> DataFrame:
    """tp, fp, fn, tn with precision, recall and F1 over guarded denominators."""
    y, p = F.col("y"), F.col("p")
    m = judged.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")
    )
    precision = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return (
        m.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9)))
    )


def confusion_by_class(judged: DataFrame) -> DataFrame:
    return judged.groupBy("label", "origem").agg(
        F.count_if(F.col("p") == F.col("y")).alias("ok"), F.count_if(F.col("p") != F.col("y")).alias("err")
    )


def misjudged(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("p") != F.col("y")).select(
        F.when(F.col("p"), "FP").otherwise("FN").alias("error"), "id", "stores", F.substring("query", 1, 55).alias("query")
    )


def discordant(labels: DataFrame, features: DataFrame, rule_a: str, rule_b: str) -> DataFrame:
    """Representatives on which two rules differ."""
    both = with_rule(with_rule(features, rule_a, "p1"), rule_b, "p2").filter(F.col("p1") != F.col("p2")).select("id", "p1", "p2")
    return label_groups(labels).filter("NOT divergent").join(both, "id").select("id", "p1", "p2", "label")


def seeded_sample(df: DataFrame, n: int, seed: int, key: str, by: Sequence[str] = ()) -> DataFrame:
    """``n`` rows per group in seeded order, all rows of a smaller group; only n per task are shuffled."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(shuffle_rank(seed, key), key)))
    return ranked.filter(F.col("_r") <= n).drop("_r")


def trigger_flags(entries: DataFrame, ids: Sequence[str], needles: Sequence[str], keywords: Sequence[str] = T.CONTINUITY_KEYWORDS,
                  denial: Column | None = None) -> DataFrame:
    """Split ``entries(id, store, text)`` of question/answer form and flag the extraction triggers."""
    qa = entries.filter(T.is_qa("text")).withColumns({"query": T.qa_question("text"), "resposta": T.qa_answer("text")})
    fired = T.continuity_keywords("query", keywords)
    by_id = F.substring(F.col("id"), 1, 8).isin(*ids) if ids else F.lit(False)
    return qa.withColumns(
        {
            "g_neg": T.denies_record("resposta") if denial is None else denial, "g_kw": F.size(fired) > 0,
            "kw_acionadas": F.array_join(fired, "|"), "g_id": by_id | T.contains_any(F.lower("text"), needles),
        }
    )


def ground_truth(flagged: DataFrame, n_controls: int = 20, seed: int = 42) -> DataFrame:
    """All triggered entries plus up to ``n_controls`` seeded controls per store."""
    hit = F.col("g_neg") | F.col("g_kw") | F.col("g_id")
    controls = seeded_sample(flagged.filter(~hit), n_controls, seed, "id", ["store"])
    return flagged.filter(hit).withColumn("kind", F.lit("candidate")).unionByName(controls.withColumn("kind", F.lit("control")))


def trigger_census(flagged: DataFrame, n_controls: int = 20) -> DataFrame:
    hit = F.col("g_neg") | F.col("g_kw") | F.col("g_id")
    return flagged.groupBy("store").agg(
        F.count(F.lit(1)).alias("qa_total"), F.count_if(hit).alias("candidates"),
        F.least(F.count_if(~hit), F.lit(n_controls)).alias("controls"), F.count_if("g_neg").alias("neg"), F.count_if("g_kw").alias("kw"),
        F.count_if("g_id").alias("by_id"),
    )
