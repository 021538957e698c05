"""Memory tables: turns, inventory, treatment, class stamping, copies, promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.ordering import with_previous

# Priority and status given to summaries, limits of the probe set, promotion rule.
SUMMARY_PRIORITY, SUMMARY_STATUS = "media", "hypothesis"
MAX_PROBES, MIN_CONCEPTS = 20, 2
PROBE_QUERY = "continuando nossa conversa sobre {domain}, o que tínhamos concluído?"
PROMOTE_ACCESSES = 3
TOXIC_CLASSES = ("not_found", "disqualification")
QUESTION_SOURCES = ("llm_response", "camara_response")
LAB_PREFIX = "__lab__"
FORM_CHECK = r"(?s)^\s*Q:\s*.+\bA:\s*"


def is_summary(prefix: str = T.SUMMARY_PREFIX) -> Column:
    return F.startswith(F.coalesce("text", F.lit("")), F.lit(prefix))


def drop_summaries(df: DataFrame, by_prefix: bool = False) -> DataFrame:
    return df.filter(~is_summary()) if by_prefix else df.filter(F.coalesce("source_type", F.lit("")) != T.SUMMARY_SOURCE)


def lab_only(df: DataFrame) -> DataFrame:
    return df.filter(F.startswith("session_id", F.lit(LAB_PREFIX)))


def extract_turns(df: DataFrame, form: str = FORM_CHECK) -> DataFrame:
    """``(query, id, timestamp, seq)`` of entries in question/answer form, summaries left out."""
    good = ~is_summary() & F.coalesce("text", F.lit("")).rlike(form)
    return df.filter(good).select(T.question_of_turn("text").alias("query"), "id", "timestamp", "seq").filter("query IS NOT NULL")


def turn_cascade(df: DataFrame, form: str = FORM_CHECK) -> DataFrame:
    """Counts of each exclusion step in one aggregate."""
    summary = is_summary()
    formed = F.coalesce("text", F.lit("")).rlike(form) & T.question_of_turn("text").isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(summary).alias("n_summary"), F.count_if(~summary & ~formed).alias("n_form"),
        F.count_if(~summary & formed).alias("n_final"),
    )


def ordered_by_time(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Sort key columns ``(ts or 0, seq)`` applied as a total order."""
    return df.orderBy(F.coalesce(ts, F.lit(0)), "seq")


def first_occurrences(df: DataFrame, text: str, order: str) -> DataFrame:
    """One row per normalised text, the earliest; combinable, so copies meet map-side."""
    row = F.struct(*df.columns)
    return df.groupBy(T.normalize(text).alias("_norm")).agg(F.min_by(row, F.col(order)).alias("_row")).select("_row.*")


def with_predecessor(turns: DataFrame, group: str = "conv_id", order: str = "seq", text: str = "query") -> DataFrame:
    """Pair each turn with the one before it in its conversation; first turns are left out.

    The neighbour is found inside the conversation, cell by cell of ``order``, so conversations may
    interleave and a very long one is never one window.
    """
    prior = with_previous(turns, order, [text], by=[group], out="_p")
    return prior.filter(F.col("_p").isNotNull()).withColumn("predecessor", F.col(f"_p.{text}")).drop("_p")


def memory_inventory(df: DataFrame) -> DataFrame:
    """Counts by source type, and accesses of summaries against the rest."""
    return df.groupBy(F.coalesce("source_type", F.lit("<none>")).alias("source_type")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("acessos").alias("acessos_mean"), F.max("acessos").alias("acessos_max")
    )


def summary_access(df: DataFrame) -> DataFrame:
    ss = F.coalesce(F.col("source_type") == T.SUMMARY_SOURCE, F.lit(False))
    acc = F.coalesce("acessos", F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ss).alias("n_summaries"),
        F.coalesce(F.avg(F.when(ss, acc)), F.lit(0.0)).alias("summary_mean"), F.coalesce(F.max(F.when(ss, acc)), F.lit(0)).alias("summary_max"),
        F.coalesce(F.avg(F.when(~ss, acc)), F.lit(0.0)).alias("normal_mean"), F.coalesce(F.max(F.when(~ss, acc)), F.lit(0)).alias("normal_max"),
    )


def apply_treatment(df: DataFrame, rewrite: bool, drop_trivial: bool) -> DataFrame:
    """Lower the rank of summaries, leave out empty ones, or both."""
    ss = F.coalesce(F.col("source_type") == T.SUMMARY_SOURCE, F.lit(False))
    out = df.filter(~T.is_trivial_summary("text", "source_type")) if drop_trivial else df
    if rewrite:
        out = out.withColumns(
            {
                "prioridade": F.when(ss, SUMMARY_PRIORITY).otherwise(F.col("prioridade")),
                "epistemic_status": F.when(ss, SUMMARY_STATUS).otherwise(F.col("epistemic_status")),
            }
        )
    return out


def treated_conditions(df: DataFrame) -> DataFrame:
    """All treatments at once: one copy of each entry per condition that keeps it."""
    plan = (("baseline", False, False), ("trat_gravador", True, False), ("trat_trivial", False, True), ("trat_combinado", True, True))
    conditions = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(w).alias("rw"), F.lit(d).alias("dt")) for c, w, d in plan])
    ss = F.coalesce(F.col("source_type") == T.SUMMARY_SOURCE, F.lit(False))
    rows = df.withColumn("_trivial", T.is_trivial_summary("text", "source_type")).withColumn("_c", F.explode(conditions))
    low = F.col("_c.rw") & ss
    return (
        rows.filter(~(F.col("_c.dt") & F.col("_trivial")))
        .withColumns(
            {
                "condition": F.col("_c.condition"), "prioridade": F.when(low, SUMMARY_PRIORITY).otherwise(F.col("prioridade")),
                "epistemic_status": F.when(low, SUMMARY_STATUS).otherwise(F.col("epistemic_status")),
            }
        )
        .drop("_c", "_trivial")
    )


def stamp_class(df: DataFrame, hit: Column, label: str, rule: str) -> tuple[DataFrame, DataFrame]:
    """Write ``label`` where ``hit`` and no class is set yet; returns the table and the audit rows.

    Stamping twice changes nothing and audits nothing the second time.
    """
    open_ = (F.coalesce("answer_class", F.lit("")) == "") & F.coalesce(hit, F.lit(False))
    stamped = df.withColumn("answer_class", F.when(open_, F.lit(label)).otherwise(F.col("answer_class")))
    audit = df.filter(open_).select("id", "scope", "layer", F.lit(rule).alias("rule"), F.lit(label).alias("answer_class"))
    return stamped, audit


def stamp_counts(df: DataFrame, hit: Column) -> DataFrame:
    free = F.coalesce("answer_class", F.lit("")) == ""
    h = F.coalesce(hit, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("seen"), F.count_if(h).alias("candidates"), F.count_if(h & free).alias("stamped"),
                  F.count_if(h & ~free).alias("skipped"))


def probe_universe(df: DataFrame) -> DataFrame:
    """Entries usable as probes: id, embedding, non-blank domain and at least two concepts."""
    concepts = F.filter(F.coalesce("concepts", F.array().cast("array<string>")), lambda c: T.strip(c) != "")
    return df.filter(
        (F.coalesce("id", F.lit("")) != "") & F.col("embedding").isNotNull() & (T.strip(F.coalesce("domain", F.lit(""))) != "")
        & (F.size(concepts) >= MIN_CONCEPTS)
    )


def probe_pairs(universe: DataFrame, n: int = MAX_PROBES) -> DataFrame:
    """One probe per domain (smallest id), the first ``n`` by id, with its query text."""
    before, after = PROBE_QUERY.split("{domain}")
    per_domain = universe.groupBy(F.lower(T.strip("domain")).alias("_d")).agg(
        F.min_by(F.struct("id", T.strip("domain").alias("domain"), "key_assertion"), "id").alias("p")
    )
    return per_domain.select("p.*").orderBy("id").limit(n).select(
        F.concat(F.lit(before), "domain", F.lit(after)).alias("query"), F.col("id").alias("target_id"), "domain", "key_assertion"
    )


def copy_groups(df: DataFrame, by: Sequence[str] = ("layer",)) -> DataFrame:
    """Texts that occur more than once, with their size."""
    return df.groupBy(*by, T.normalize("text").alias("norm")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def copy_census(df: DataFrame, by: Sequence[str] = ("layer",)) -> DataFrame:
    """Per group: rows, rows inside clusters of copies, excess copies, and both as shares."""
    sizes = df.groupBy(*by, T.normalize("text").alias("norm")).agg(F.count(F.lit(1)).alias("n"))
    return (
        sizes.groupBy(*by)
        .agg(
            F.sum("n").alias("total"), F.count_if(F.col("n") > 1).alias("clusters"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("in_clusters"),
            F.sum(F.col("n") - 1).alias("excess"),
        )
        .withColumn("share_in_clusters", F.col("in_clusters") / F.col("total"))
        .withColumn("share_excess", F.col("excess") / F.col("total"))
    )


def largest_copy_groups(df: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    return copy_groups(df, by).orderBy(F.desc("n"), "norm").limit(n)


def cross_layer_ids(df: DataFrame) -> DataFrame:
    """Ids present in more than one layer."""
    per_id = df.groupBy("id").agg(F.min("layer").alias("a"), F.max("layer").alias("b"))
    return per_id.filter(F.col("a") != F.col("b")).select("id")


def marker_distribution(df: DataFrame, current: str) -> DataFrame:
    """Which session boost summaries would get: current, older, no marker, other layer."""
    ss = df.filter(F.col("source_type") == T.SUMMARY_SOURCE)
    kind = (
        F.when(F.col("layer") != "episodic", "semantic_na")
        .when(F.col("session_marker") == current, "x1.60_atual")
        .when(F.coalesce("session_marker", F.lit("")) != "", "x0.85_antiga")
        .otherwise("x1.00_legacy")
    )
    return ss.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def promotable(df: DataFrame, guard: bool = True, accesses: int = PROMOTE_ACCESSES) -> DataFrame:
    """Entries accessed often enough; with ``guard`` the toxic classes stay out."""
    out = df.filter(F.coalesce("acessos", F.lit(0)) >= accesses)
    return out.filter(~F.coalesce(F.col("answer_class").isin(*TOXIC_CLASSES), F.lit(False))) if guard else out


def promotion_counts(planted: DataFrame, semantic: DataFrame) -> DataFrame:
    """Planted entries found in the semantic layer, by the class they were planted with."""
    kinds = planted.select("id", F.coalesce(F.nullif(F.col("answer_class"), F.lit("")), F.lit("normal")).alias("class"))
    return semantic.select("id").join(kinds, "id").groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def fusion_audit(episodic: DataFrame, semantic: DataFrame, merged: int = 2) -> DataFrame:
    """Fused entries (``merged_from``), whether each was promoted and kept its class.

    ``class_present`` is null for an entry that was not promoted.
    """
    fused = episodic.filter(F.col("merged_from") == merged).select("id", "merged_from")
    found = semantic.select("id", F.col("has_answer_class").alias("class_present"), F.lit(True).alias("_in"))
    return fused.join(found, "id", "left").select("id", "merged_from", F.coalesce("_in", F.lit(False)).alias("promoted"), "class_present")
