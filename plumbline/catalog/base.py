"""Registry of named queries, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(str(Path(sf_dir) / f"{name}.parquet"))


def r6(x: Column | str) -> Column:
    """Doubles leave a query rounded, so that the order of a sum does not show."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column and widen every integer one."""
    wide = {"int": "long", "smallint": "long", "tinyint": "long"}
    return df.select(
        *[
            F.round(F.col(c), 6).alias(c) if t in ("double", "float")
            else F.col(c).cast(wide[t]).alias(c) if t in wide
            else F.col(c)
            for c, t in df.dtypes
        ]
    )
