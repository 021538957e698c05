"""Verdicts by ordered checks: the first check that fails decides."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """``ok`` is a SQL condition over the metrics row; null counts as a failure.

    A check without ``verdict`` is reported but never decides.
    """

    name: str
    ok: str
    verdict: str | None = None
    detail: str = "''"


def decide(metrics: DataFrame, checks: Sequence[Check], final: Column | str) -> DataFrame:
    """Add ``verdict``, ``failed_step`` and ``steps`` to each metrics row.

    ``steps`` lists the checks up to and including the deciding one. Everything is computed
    row by row, so a table with one row per study or stratum is judged without a shuffle.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("step"), F.lit(c.name).alias("check"), F.expr(c.ok).cast("boolean").alias("ok"),
                F.expr(c.detail).cast("string").alias("detail"), F.lit(c.verdict).alias("verdict"),
            )
            for i, c in enumerate(checks, 1)
        ]
    )
    failing = F.try_element_at(
        F.filter(entries, lambda e: e.verdict.isNotNull() & ~F.coalesce(e.ok, F.lit(False))), F.lit(1)
    )
    closing = F.lit(final) if isinstance(final, str) else final
    return (
        metrics.withColumn("_fail", failing)
        .withColumn("failed_step", F.col("_fail.step"))
        .withColumn("verdict", F.coalesce(F.col("_fail.verdict"), closing))
        .withColumn("steps", F.filter(entries, lambda e: F.col("failed_step").isNull() | (e.step <= F.col("failed_step"))))
        .drop("_fail")
    )


def steps_table(decided: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per check that was reached."""
    return decided.select(*by, F.explode("steps").alias("s"), F.col("verdict").alias("final_verdict")).select(
        *by, "s.step", "s.check", "s.ok", "s.detail", "final_verdict"
    )
