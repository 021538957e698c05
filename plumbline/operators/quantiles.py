"""Exact order statistics by radix selection.

A double's order-preserving bits are a key of four 16-bit digits. Four rounds of counting find a wanted rank: each counts the
rows of a group that share the digits found so far by their next digit, and the running counts name the digit the rank falls
into. A window never holds more than 2^16 counters, only counters are shuffled, and the plan is the same for every size and
distribution.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.bits import order_bits
from plumbline.session import checkpointed

DIGIT = 16
DIGITS = 4

#: The 0-based position of a statistic as a function of the group size.
Rank = Callable[[Column], Column]


def order_statistics(df: DataFrame, value: str, ranks: Mapping[str, Rank], by: Sequence[str] = ()) -> DataFrame:
    """One row per group: ``n`` and a column per label of ``ranks``. Nulls are left out; a group of nulls has no row."""
    groups = list(by) or ["_all"]
    rows = (df if by else df.withColumn("_all", F.lit(0))).select(*groups, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    # read once, however much lies behind it: the rounds go over a table of the groups and two numbers a row
    rows = checkpointed(rows.withColumn("_k", order_bits("_v")))
    labels = list(ranks)
    least = F.min("_v").alias("_v")
    # (group, digits found so far, n, the ranks that are wanted there, counted from the first row with these digits)
    shift = DIGIT * (DIGITS - 1)
    counts = rows.groupBy(*groups, F.shiftright("_k", shift).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*groups)
    counts = counts.withColumn("n", F.sum("_c").over(whole)).withColumn("_end", F.sum("_c").over(whole.orderBy("_p")))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), ranks[label](F.col("n")).cast("long").alias("at")) for i, label in enumerate(labels)])
    found = _narrowed(counts.withColumn("_w", wanted), [*groups, "_p", "n"])
    for left in range(DIGITS - 2, -1, -1):
        shift = DIGIT * left
        narrow = found.select(*[F.col(g).alias(f"_o_{g}") for g in groups], F.col("_p").alias("_o"), "n", "_w")
        met = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_o_{g}")) for g in groups], F.shiftright("_k", shift + DIGIT) == F.col("_o"))
        counts = (
            rows.join(narrow.drop("n", "_w"), met)
            .groupBy(*groups, "_o", F.shiftright("_k", shift).alias("_p"))
            .agg(F.count(F.lit(1)).alias("_c"), *([least] if not left else []))
        )
        inside = Window.partitionBy(*groups, "_o").orderBy("_p")
        counts = counts.withColumn("_end", F.sum("_c").over(inside)).withColumnRenamed("_o", "_before")
        met = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_o_{g}")) for g in groups], F.col("_before") == F.col("_o"))
        found = _narrowed(counts.join(narrow, met), [*groups, "_p", "n", *([] if left else ["_v"])])
    picked = [F.max(F.when(F.array_contains("_w.i", i), F.col("_v"))).alias(label) for i, label in enumerate(labels)]
    return found.groupBy(*groups).agg(*picked, F.max("n").alias("n")).drop("_all")


def _narrowed(counts: DataFrame, keep: list[str]) -> DataFrame:
    """The digits that a wanted rank falls into, with these ranks counted from there."""
    start = F.col("_end") - F.col("_c")
    here = F.transform(F.filter("_w", lambda w: (w.at >= start) & (w.at < F.col("_end"))), lambda w: F.struct(w.i.alias("i"), (w.at - start).alias("at")))
    return counts.select(*keep, here.alias("_w")).filter(F.size("_w") > 0)


def interpolated(df: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated percentiles: one row per group with a column per label and ``n``."""

    def place(s: float) -> Rank:
        return lambda n: F.lit(s) * (n - 1)

    ranks: dict[str, Rank] = {}
    for label, s in shares.items():
        ranks[f"_lo_{label}"] = lambda n, s=s: F.floor(place(s)(n))
        ranks[f"_hi_{label}"] = lambda n, s=s: F.ceil(place(s)(n))
    found = order_statistics(df, value, ranks, by)
    out = []
    for label, s in shares.items():
        lo, hi, x = F.col(f"_lo_{label}"), F.col(f"_hi_{label}"), place(s)(F.col("n"))
        out.append((lo + (hi - lo) * (x - F.floor(x))).alias(label))
    return found.select(*by, *out, "n")


def medians(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact ``median`` per group (mean of the two middle values for even sizes) and ``n``."""
    return interpolated(df, value, {"median": 0.5}, by)
