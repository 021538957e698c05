"""Neighbours, dense positions and running sums over a global order.

A Spark table has no file order, so each operator takes a LONG key that is unique within its
group. Windows never span the whole order: keys are cut into cells of ``2 ** bits`` values, a
window runs inside each cell, and the cells themselves are linked by the same operation one
level up. With the defaults no window partition can hold more than 65 536 rows for keys below
2 ** 48, whatever share of the data one group has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
LEVELS = 2


def _cell(order: str, bits: int) -> Column:
    return F.shiftright(F.col(order).cast("long"), bits)


def _adjacent(
    df: DataFrame, order: str, payload: Sequence[str], by: Sequence[str], out: str, bits: int, levels: int, ahead: bool,
    tie: Sequence[str],
) -> DataFrame:
    item = F.struct(*dict.fromkeys([order, *payload]))
    step = F.lead if ahead else F.lag
    if levels == 0:
        whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        return df.withColumn(out, step(item).over(whole.orderBy(order, *tie)))
    cell = f"_cell{levels}"
    inside = Window.partitionBy(*by, cell).orderBy(order, *tie)
    back = F.lag(F.lit(1)) if ahead else F.lead(F.lit(1))
    near = df.withColumn(cell, _cell(order, bits)).withColumn("_near", step(item).over(inside)).withColumn(
        "_inner", back.over(inside)
    )
    # The one row of each cell that its neighbouring cell has to see.
    edge = f"_edge{levels}"
    edges = near.filter(F.col("_inner").isNull()).select(*by, cell, item.alias(edge))
    linked = _adjacent(edges, cell, [edge], by, "_link", bits, levels - 1, ahead, ()).select(
        *by, cell, F.col(f"_link.{edge}").alias(edge)
    )
    return near.join(linked, [*by, cell], "left").withColumn(out, F.coalesce("_near", edge)).drop(cell, "_near", "_inner", edge)


def with_next(df, order, payload, by=(), out="next", bits=BITS, levels=LEVELS, tie=()) -> DataFrame:
    """Attach the following row (struct of ``order`` and ``payload``), null at the end."""
    return _adjacent(df, order, payload, by, out, bits, levels, True, tie)


def with_previous(df, order, payload, by=(), out="previous", bits=BITS, levels=LEVELS, tie=()) -> DataFrame:
    """Attach the preceding row (struct of ``order`` and ``payload``), null at the start."""
    return _adjacent(df, order, payload, by, out, bits, levels, False, tie)


def with_prior_sums(
    df: DataFrame, order: str, columns: Sequence[str], by: Sequence[str] = (), bits: int = BITS, levels: int = LEVELS,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Attach ``prior_<column>``: the sum over all rows before this one, zero at the start.

    ``tie`` lists further columns that settle equal keys.
    """
    before = (Window.unboundedPreceding, -1)
    if levels == 0:
        whole = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order, *tie).rowsBetween(*before)
        return df.withColumns({f"prior_{c}": F.coalesce(F.sum(c).over(whole), F.lit(0)) for c in columns})
    cell = f"_cell{levels}"
    celled = df.withColumn(cell, _cell(order, bits))
    totals = celled.groupBy(*by, cell).agg(*[F.sum(c).alias(c) for c in columns])
    offsets = with_prior_sums(totals, cell, columns, by, bits, levels - 1).select(
        *by, cell, *[F.col(f"prior_{c}").alias(f"_off_{c}") for c in columns]
    )
    inside = Window.partitionBy(*by, cell).orderBy(order, *tie).rowsBetween(*before)
    return (
        celled.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
        .join(offsets, [*by, cell], "left")
        .withColumns({f"prior_{c}": F.col(f"_in_{c}") + F.coalesce(F.col(f"_off_{c}"), F.lit(0)) for c in columns})
        .drop(cell, *[f"_in_{c}" for c in columns], *[f"_off_{c}" for c in columns])
    )


def with_dense_index(df, order, by=(), out="idx", bits=BITS, levels=LEVELS, tie=()) -> DataFrame:
    """Attach the 0-based position in the order."""
    return with_prior_sums(df.withColumn("_one", F.lit(1).cast("long")), order, ["_one"], by, bits, levels, tie).withColumnRenamed(
        "prior__one", out
    ).drop("_one")


def shift_neighbour(
    df: DataFrame, order: str, payload: Sequence[str], by: Sequence[str] = (), out: str = "neighbour", levels: int = LEVELS
) -> DataFrame:
    """Attach row ``(i + 1) mod N``: the following row, and the first row for the last one."""
    item = F.struct(order, *[c for c in payload if c != order])
    groups = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    first = rows.groupBy(*groups).agg(F.min_by(item, F.col(order)).alias("_first"))
    return (
        with_next(rows, order, payload, groups, "_next", levels=levels)
        .join(first, groups, "left")
        .withColumn(out, F.coalesce("_next", "_first"))
        .drop("_next", "_first", "_all")
    )
