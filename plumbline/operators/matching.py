"""Joins that are not plain equality: nearest in time, overlapping in time, substring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import SUMMARY_SOURCE, char_grams, contains_any, strip


def nearest_within(
    left: DataFrame, right: DataFrame, tol: int, payload: Sequence[str], by: Sequence[str] = (), ts: str = "ts", seq: str = "seq"
) -> DataFrame:
    """Attach ``near``: the right row nearest in time within ``tol`` seconds, null if none.

    Right times are rounded to the second and the last row of a second (by ``seq``) counts; of two
    equally near rows the earlier wins. Right rows are packed into one array per group and time
    cell covering the neighbouring cells too, so a left row meets exactly one array. An array
    holds at most one entry per second, hence at most ``3 * tol``, however dense the data.
    """
    # Half to even, as the times are rounded where the log is written.
    second = F.bround(F.col(ts), 0).cast("long")
    last = (
        right.withColumn("_at", second)
        .groupBy(*by, "_at")
        .agg(F.max_by(F.struct(*payload), F.col(seq)).alias("_row"))
    )
    home = F.floor(F.col("_at") / tol)
    packed = (
        last.withColumn("_cell", F.explode(F.sequence(home - 1, home + 1)))
        .groupBy(*by, "_cell")
        .agg(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("_row").alias("row"))).alias("_near"))
    )
    keyed = left.withColumn("_cell", F.floor(F.col(ts) / tol))
    distance = F.transform(
        "_near", lambda x: F.struct(F.abs(x["at"] - F.col(ts)).alias("d"), x["at"].alias("at"), x["row"].alias("row"))
    )
    best = F.array_min(F.filter(distance, lambda x: x.d <= tol))
    return (
        keyed.join(packed, [*by, "_cell"], "left")
        .withColumn("_best", best)
        .withColumn("near", F.col("_best.row"))
        .withColumn("distance", F.col("_best.d"))
        .drop("_cell", "_near", "_best")
    )


def flag_overlaps(
    samples: DataFrame, switches: DataFrame, start: str, end: str, at: str, by: Sequence[str] = (), cell: int = 60
) -> DataFrame:
    """Mark samples whose interval contains a switch as ``suspect``; none is removed.

    Times are LONG milliseconds. Each different interval is written once per time cell it touches
    and meets that cell's distinct switch times (at most ``1000 * cell``); samples then look up
    their interval. Equal samples stay apart, and an interval with a null end is not suspect.
    """
    width = cell * 1000
    marks = (
        switches.withColumn("_cell", F.floor(F.col(at) / width)).groupBy(*by, "_cell").agg(F.collect_set(at).alias("_marks"))
    )
    spans = samples.select(*by, F.col(start).alias("_s"), F.col(end).alias("_e")).filter("_s <= _e").distinct()
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width))))
    met = cells.join(marks, [*by, "_cell"]).filter(F.exists("_marks", lambda m: (m >= F.col("_s")) & (m <= F.col("_e"))))
    hit = met.select(*by, F.col("_s").alias(start), F.col("_e").alias(end)).distinct().withColumn("_hit", F.lit(True))
    return samples.join(hit, [*by, start, end], "left").select(*samples.columns, F.coalesce("_hit", F.lit(False)).alias("suspect"))


def resolve_targets(memory: DataFrame, specs: Sequence[Mapping[str, str]]) -> DataFrame:
    """``(spec, id)`` rows: entries named by id or holding the needle, summaries excluded.

    Specs are a literal list ``{"name", "id"?, "needle"?}``; they become one expression evaluated
    in a single scan. A spec that resolves to nothing keeps a row with a null id.
    """
    plain = F.coalesce(F.col("source_type") != SUMMARY_SOURCE, F.lit(True)) & F.col("id").isNotNull()
    hits = []
    for spec in specs:
        needle = (spec.get("needle") or "").strip().lower()
        if spec.get("id"):
            cond = F.col("id") == spec["id"]
        else:
            cond = F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(needle)) if needle else F.lit(False)
        hits.append(F.when(cond & plain, F.lit(spec["name"])))
    found = memory.select("id", F.explode(F.array_compact(F.array(*hits))).alias("spec"))
    names = memory.sparkSession.createDataFrame([(s["name"],) for s in specs], "spec string")
    return names.join(found, "spec", "left").select("spec", "id")


def resolve_target_table(memory: DataFrame, specs: DataFrame, gram: int = 8) -> DataFrame:
    """:func:`resolve_targets` for a table ``specs(spec, id, needle)`` of any size.

    A needle can only occur in a text that contains its first ``gram`` characters (or all of it,
    if shorter), so texts and needles meet by equality on those characters and the substring test
    runs on the survivors. Only prefix lengths that some needle has are cut from the texts.
    """
    plain = memory.filter((F.coalesce("source_type", F.lit("")) != SUMMARY_SOURCE) & F.col("id").isNotNull())
    by_id = specs.filter("id IS NOT NULL").select("spec", "id").join(plain.select("id"), "id", "left_semi").select("spec", "id")
    needles = specs.filter("id IS NULL").select("spec", F.lower(strip("needle")).alias("needle")).filter("needle <> ''")
    keyed = needles.withColumn("g", F.substring("needle", 1, gram))
    low = plain.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    # At most ``gram`` rows: the prefix lengths in use.
    lengths = keyed.select(F.length("g").alias("n")).distinct()
    grams = low.join(F.broadcast(lengths), F.length("low") >= F.col("n")).select(
        "id", F.explode(F.array_distinct(char_grams("low", F.col("n")))).alias("g")
    )
    candidates = grams.join(keyed, "g").select("spec", "needle", "id").distinct()
    by_needle = candidates.join(low, "id").filter(F.contains("low", "needle")).select("spec", "id").distinct()
    return specs.select("spec").join(by_id.unionByName(by_needle), "spec", "left")


def contains_sentinel(df: DataFrame, sentinels: Sequence[str], text: str = "text") -> DataFrame:
    """Rows in which planted text shows up."""
    return df.filter(contains_any(text, sentinels))


def leaked(df: DataFrame, sentinels: Sequence[str], text: str = "text") -> DataFrame:
    """One row: how many rows hold a sentinel, and whether any does."""
    return df.agg(F.count_if(contains_any(text, sentinels)).alias("n_rows")).withColumn("leaked", F.col("n_rows") > 0)


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Compare two one-row fingerprints (digest and counts)."""
    a = before.select(F.struct(*sorted(before.columns)).alias("a"))
    b = after.select(F.struct(*sorted(after.columns)).alias("b"))
    return a.crossJoin(b).select((F.col("a") == F.col("b")).alias("unchanged"))


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows on one side only, duplicates counted, with ``side`` telling which."""
    columns = before.columns
    both = before.withColumn("_d", F.lit(1)).unionByName(after.withColumn("_d", F.lit(-1)))
    net = both.groupBy(*columns).agg(F.sum("_d").alias("_net")).filter("_net <> 0")
    return net.select(*columns, F.when(F.col("_net") > 0, "before").otherwise("after").alias("side"), F.abs("_net").alias("n"))
