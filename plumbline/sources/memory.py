"""Memory snapshots: one JSON file per scope and layer, a list or ``{"entries": [...]}``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REJECT_CHARS = 200  # of a rejected text that its row shows

ENTRY_SCHEMA = (
    "struct<id string, text string, timestamp double, acessos bigint, prioridade string, epistemic_status string,"
    " source_type string, answer_class string, session_marker string, merged_from bigint, embedding array<float>,"
    " cognitive_decisions struct<key_assertion string, concepts array<string>, domain string>,"
    " ctx_provenance struct<n_mem_prompt bigint>>"
)


def parse_snapshots(files: DataFrame, schema: str = ENTRY_SCHEMA) -> DataFrame:
    """``files(scope, layer, value)`` to one row per entry; entries that are no objects, and files without any, are left out.

    ``has_answer_class`` tells a missing key from a null class. :func:`snapshot_rejects` lists what is left out.
    """
    e = F.col("e")
    return (
        _items(files, ["scope", "layer"])
        .filter(F.schema_of_variant(e).startswith("OBJECT"))
        .select(
            "scope", "layer", F.try_variant_get(e, "$", schema).alias("x"),
            F.try_variant_get(e, "$.answer_class", "variant").isNotNull().alias("has_answer_class"),
        )
        .select("scope", "layer", "x.*", "has_answer_class")
    )


def snapshot_rejects(files: DataFrame, keys: Sequence[str] = ("scope", "layer")) -> DataFrame:
    """``keys, position, reason, value``: what :func:`parse_snapshots` leaves out.

    A file that is no JSON (cut off, say), or neither a list nor an object with a list of entries, is one row without a
    position and with the beginning of its text; an entry that is no object is a row with its 0-based position.
    """
    items = _items(files, [*keys, "value"])
    kind = F.schema_of_variant("e")
    reason = (
        F.when(F.col("v").isNull(), "invalid_json").when(F.col("entries").isNull(), "no_entries")
        .when(F.col("position").isNotNull() & (F.col("e").isNull() | ~kind.startswith("OBJECT")), "entry_not_object")
    )
    shown = F.when(F.col("position").isNull(), F.substring("value", 1, REJECT_CHARS)).otherwise(F.substring(F.to_json("e"), 1, REJECT_CHARS))
    return items.withColumn("reason", reason).filter("reason IS NOT NULL").select(*keys, "position", "reason", shown.alias("value"))


def _items(files: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per item of a file's list, and one without an item for a file that has none."""
    v = F.col("v")
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    entries = F.when(is_list, F.try_variant_get(v, "$", "array<variant>")).otherwise(F.try_variant_get(v, "$.entries", "array<variant>"))
    parsed = files.select(*keep, F.try_parse_json("value").alias("v")).withColumn("entries", entries)
    return parsed.select(*keep, "v", "entries", F.posexplode_outer("entries").alias("position", "e"))


def snapshot_files(spark: SparkSession, root: str) -> DataFrame:
    """``scope, layer, path, value`` of all ``<session>_<scope>/<layer>.json`` files below ``root``."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root)
    path = F.col("_metadata.file_path")
    return files.select(
        F.regexp_extract(path, r"_([^_/]+)/[^/]+\.json$", 1).alias("scope"), F.regexp_extract(path, r"/([^/]+)\.json$", 1).alias("layer"), path.alias("path"), "value"
    )


def read_memory(spark: SparkSession, root: str, schema: str = ENTRY_SCHEMA) -> DataFrame:
    """All ``<session>_<scope>/<layer>.json`` files below ``root``; the path gives scope and layer."""
    return parse_snapshots(snapshot_files(spark, root), schema)


def latest_windows(windows: DataFrame, order: str, n: int = 1) -> DataFrame:
    """The last ``n`` captured windows."""
    return windows.orderBy(F.col(order).desc()).limit(n)
