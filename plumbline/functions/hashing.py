"""Stable digests of rows, scaffolds and format regimes; month shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import _col

# The fields that decide whether two runs may be compared.
COMPARABLE_SCALARS = ("code_sha", "embedding_version", "prompt_version", "model_version")
COMPARABLE_LISTS = ("policy_layers", "skills_loaded", "tools_available")


def _json(value: Column) -> Column:
    """A value as JSON; null where it is null."""
    inside = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substr(inside, F.lit(2), F.length(inside) - 2)


def comparability_hash(scaffold: str | None, columns: Sequence[str]) -> Column:
    """16 hex digits over the comparability fields; list order is irrelevant, missing is null.

    The text that is hashed is a JSON object with sorted names, ", " and ": " between its parts and lists
    sorted as strings, so that a digest equals those kept in older logs. ``scaffold`` names a struct column
    (or None for top-level columns) and ``columns`` the fields it really has.
    """

    def field(name: str) -> Column:
        path = F.col(f"{scaffold}.{name}" if scaffold else name)
        if name not in columns:
            return F.lit("null")
        if name not in COMPARABLE_LISTS:
            return _json(path)
        items = F.array_sort(F.transform(path, lambda x: F.coalesce(x.cast("string"), F.lit("None"))))
        listed = F.concat(F.lit("["), F.array_join(F.transform(items, _json), ", "), F.lit("]"))
        return F.coalesce(listed, F.lit("null"))

    parts = []
    for name in sorted(COMPARABLE_SCALARS + COMPARABLE_LISTS):
        parts += [F.lit(f'{", " if parts else "{"}"{name}": '), field(name)]
    return F.substring(F.sha2(F.concat(*parts, F.lit("}")), 256), 1, 16)


def regime_hash(state: Column | str) -> Column:
    """16 hex digits over a map's entries, independent of entry order."""
    entries = F.array_sort(F.map_entries(_col(state)))
    return F.substring(F.sha2(F.to_json(entries), 256), 1, 16)


def month_shard(ts_seconds: Column | str) -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(_col(ts_seconds)), "yyyy-MM"), F.lit("0000-00"))


def row_digest(columns: Sequence[str]) -> Column:
    """60 bits of a row's sha-256 as a decimal, so that digests can be summed in any order.

    Every value stands behind its length, null has none, so no two rows share the text that is digested.
    """
    value = lambda c: F.col(c).cast("string")
    whole = F.concat(*[F.coalesce(F.concat(F.length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-")) for c in sorted(columns)])
    return F.conv(F.substring(F.sha2(whole, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def table_fingerprint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row count and order-insensitive digest sum, optionally per group."""
    columns = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(row_digest(columns)), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"),
    )


def shuffle_rank(seed: int, *keys: str) -> Column:
    """An ordering key that permutes rows the same way on every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
