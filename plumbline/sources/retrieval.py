"""Retrieval exports: one JSON object per line, ``{"query": …, "results": [{"texto", "id"?, "score"?}]}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.text import strip

# The field names of an export line.
QUERY, RESULTS, TEXT, ID, SCORE = "query", "results", "texto", "id", "score"


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _usable_text(v: Column) -> Column:
    """The variant's string if it is one and is not blank, else null."""
    s = F.when(_type(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.when(s.rlike(r"(?U)\S"), s)


def _number(v: Column) -> Column:
    kind = _type(v)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(v, "$", "double"))


def parse_retrieval(lines: DataFrame, value: str = "value", seq: str = "seq") -> DataFrame:
    """Per non-blank line: ``seq, reason, query, results, n_dropped``.

    ``reason`` is null for a usable line, else ``invalid_json``, ``not_object``,
    ``query_missing`` or ``results_not_list``. A result without usable text is dropped and
    counted, it does not cost its line; an id that is no string and a score that is no number
    (booleans count as numbers) become null.
    """
    parsed = lines.filter(F.col(value).rlike(r"(?U)\S")).select(
        F.col(seq).alias("seq"), F.try_parse_json(strip(F.col(value))).alias("v")
    )
    kinds = parsed.select(
        "seq", "v", _type(F.col("v")).alias("kind"), _usable_text(_field(F.col("v"), QUERY)).alias("query"),
        _field(F.col("v"), RESULTS).alias("r"),
    )
    listed = _type(F.col("r")).startswith("ARRAY")
    reason = (
        F.when(F.col("v").isNull(), "invalid_json")
        .when(~F.col("kind").startswith("OBJECT"), "not_object")
        .when(F.col("query").isNull(), "query_missing")
        .when(F.col("r").isNotNull() & ~listed, "results_not_list")
    )
    raw = F.coalesce(F.try_variant_get(F.col("r"), "$", "array<variant>"), F.array().cast("array<variant>"))

    def item(v: Column) -> Column:
        return F.struct(
            _usable_text(_field(v, ID)).alias("id"), _usable_text(_field(v, TEXT)).alias("text"), _number(_field(v, SCORE)).alias("score")
        )

    kept = F.filter(F.transform(F.filter(F.col("raw"), lambda v: _type(v).startswith("OBJECT")), item), lambda x: x.text.isNotNull())
    return (
        kinds.select("seq", reason.alias("reason"), "query", raw.alias("raw"))
        .select("seq", "reason", "query", F.size("raw").alias("n_raw"), kept.alias("results"))
        .select(
            "seq", "reason", "query",
            F.when(F.col("reason").isNull(), F.col("results")).alias("results"),
            F.when(F.col("reason").isNull(), F.col("n_raw") - F.size("results")).otherwise(0).alias("n_dropped"),
        )
    )


def explode_hits(parsed: DataFrame) -> DataFrame:
    """``hits(seq, query, pos, id, text, score)`` with ``pos`` counted over the kept results."""
    return (
        parsed.filter("reason IS NULL")
        .select("seq", "query", F.posexplode("results").alias("p", "r"))
        .select("seq", "query", (F.col("p") + 1).alias("pos"), "r.id", "r.text", "r.score")
    )


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason IS NOT NULL").select("seq", "reason")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, seq)``: every line with its dense 0-based place by file path, split and row.

    The rows of a split are read in order by one task, so their row ids are consecutive: a row's place is its distance from
    the split's first id, and splits are linked by one count each. That table has one row per split and is broadcast; lines
    stay where they are read.
    """
    at = ["_file", "_block"]
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")
    )
    before = Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    starts = splits.select(*at, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return lines.join(F.broadcast(starts), at).select("value", (F.col("_start") + F.col("_row") - F.col("_first")).alias("seq"))


def read_retrieval(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(hits, rejects)`` of an export of any number of files, which may be split.

    The reader strips a byte-order mark. ``seq`` numbers the lines along the files in order of their paths.
    """
    parsed = parse_retrieval(ordered_lines(spark, path))
    return explode_hits(parsed), rejects(parsed)


def to_retrieval_export(hits: DataFrame) -> DataFrame:
    """One row per query with its results in rank order, in the field names of an export line."""
    item = F.struct("pos", F.col("text").alias(TEXT), F.col("id").alias(ID), F.col("score").alias(SCORE))
    ordered = F.transform(
        F.sort_array(F.collect_list(item)), lambda x: F.struct(x[TEXT].alias(TEXT), x[ID].alias(ID), x[SCORE].alias(SCORE))
    )
    return hits.groupBy("seq", "query").agg(ordered.alias(RESULTS))


def write_retrieval(hits: DataFrame, path: str) -> None:
    to_retrieval_export(hits).select(F.to_json(F.struct(QUERY, RESULTS)).alias("value")).write.mode("errorifexists").text(path)
