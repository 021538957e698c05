"""Label and feature tables, ordered sequences, sample logs and keyed results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.hashing import table_fingerprint
from plumbline.functions.text import _col


def read_labels(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A CSV with a header after one or more ``#`` lines; every value stays a string.

    Quoted line breaks need ``multiline``, which reads a file in one task; without it files are split.
    """
    return spark.read.csv(path, header=True, comment="#", multiLine=multiline, escape='"')


def blank_to_null(x: Column | str) -> Column:
    """Empty and ``AUSENTE`` mean absent."""
    return F.when(~_col(x).isin("", "AUSENTE"), _col(x))


def coerce(x: Column | str) -> Column:
    """Struct(flag, number, text) of a raw feature value; exactly one field is set, none if absent."""
    v = blank_to_null(x)
    flag = F.when(v == "True", F.lit(True)).when(v == "False", F.lit(False))
    number = F.when(v.rlike(r"^\s*[+-]?(\d+|\d*\.\d+|\d+\.)([eE][+-]?\d+)?\s*$"), v.try_cast("double"))
    return F.struct(
        flag.alias("flag"), F.when(flag.isNull(), number).alias("number"),
        F.when(flag.isNull() & number.isNull(), v).alias("text"),
    )


def typed_features(raw: DataFrame, flags: Sequence[str] = (), numbers: Sequence[str] = ()) -> DataFrame:
    """Coerce named string columns; a value of the wrong kind becomes null."""
    casts = {c: coerce(c)["flag"] for c in flags} | {c: coerce(c)["number"] for c in numbers}
    rest = [c for c in raw.columns if c not in casts]
    return raw.select(*[blank_to_null(c).alias(c) for c in rest], *[x.alias(c) for c, x in casts.items()])


def read_features(spark: SparkSession, path: str, flags: Sequence[str] = (), numbers: Sequence[str] = ()) -> DataFrame:
    return typed_features(read_labels(spark, path), flags, numbers)


def write_sequence(turns: DataFrame, path: str) -> DataFrame:
    """Write ``query, id, timestamp`` rows in order as JSON lines and return their fingerprint."""
    rows = turns.select("query", "id", "timestamp", "seq")
    rows.orderBy("seq").write.mode("errorifexists").json(path)
    return table_fingerprint(rows)


def upsert_by_key(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keyed results accumulated over invocations: a key in ``new`` replaces its row in ``base``."""
    both = base.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_batch")]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row")).select(*keys, "_row.*")


def append_samples(samples: DataFrame, path: str) -> None:
    """Add samples to the log; scoring is a pure function of the log."""
    samples.write.mode("append").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
