"""Interval expressions and reproducible per-row random draws."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import _col

Z95 = 1.96
DRAW_BITS = 60  # fifteen hex digits of a digest, which fit a long
SHORT_BITS, SHORT_DRAWS = 20, 6  # draws that share one digest


def wilson(k: Column | str, n: Column | str, z: float = Z95) -> Column:
    """Struct(lo, hi) of the Wilson score interval; (0, 0) for an empty sample."""
    n_ = _col(n).cast("double")
    p = _col(k).cast("double") / F.nullif(n_, F.lit(0.0))
    denom = 1 + z * z / n_
    centre = (p + z * z / (2 * n_)) / denom
    half = z * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_)) / denom
    empty = F.coalesce(n_, F.lit(0.0)) == 0
    return F.struct(
        F.when(empty, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - half)).alias("lo"),
        F.when(empty, F.lit(0.0)).otherwise(F.least(F.lit(1.0), centre + half)).alias("hi"),
    )


def share(k: Column | str, n: Column | str) -> Column:
    """k / n, zero for an empty sample."""
    n_ = _col(n)
    return F.when(n_ != 0, _col(k) / n_).otherwise(F.lit(0.0))


def within(lo: Column | str, hi: Column | str, delta: float) -> Column:
    """Equivalence: the interval lies inside [1 - delta, 1 + delta]."""
    return (_col(lo) >= 1.0 - delta) & (_col(hi) <= 1.0 + delta)


def separated(lo_above: Column | str, hi_below: Column | str) -> Column:
    return _col(lo_above) > _col(hi_below)


def with_draw(df: DataFrame, key: str, replicate: str | int, seed: int, out: str = "u") -> DataFrame:
    """Attach a pseudo-random long below 2 ** DRAW_BITS fixed by (seed, key, replicate).

    The draw is the head of a digest of the three, so replicates are independent streams, no two keys
    share one, and the value is the same on every executor, after any retry and in any engine. The key
    may be of any type that has a text form.
    """
    rep = F.lit(replicate) if isinstance(replicate, int) else F.col(replicate)
    whole = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), rep.cast("string")))
    return df.withColumn(out, F.conv(F.substring(whole, 1, DRAW_BITS // 4), 16, 10).cast("long"))


def with_short_draws(df: DataFrame, key: str, block: str, seed: int, names: Sequence[str]) -> DataFrame:
    """Attach up to ``SHORT_DRAWS`` longs below 2 ** SHORT_BITS fixed by (seed, key, block).

    One digest serves them all: its first and next fifteen hex digits are two integers, and the draws are their parts of
    twenty bits, lowest first.
    """
    whole = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col(block).cast("string")))
    halves = [F.conv(F.substring(F.col("_md5"), at, DRAW_BITS // 4), 16, 10).cast("long") for at in (1, 1 + DRAW_BITS // 4)]
    held = df.withColumn("_md5", whole).withColumns({f"_half{i}": h for i, h in enumerate(halves)})
    each = DRAW_BITS // SHORT_BITS
    parts = {n: F.shiftright(f"_half{i // each}", SHORT_BITS * (i % each)).bitwiseAND((1 << SHORT_BITS) - 1) for i, n in enumerate(names)}
    return held.withColumns(parts).drop("_md5", "_half0", "_half1")


def poisson_limits(bits: int = DRAW_BITS, max_count: int = 20) -> list[int]:
    """Limits of the Poisson(1) distribution in steps of 2 ** -bits: a draw below limit i means a count <= i.

    Beyond 20 the rest of the distribution is smaller than one step of 60 bits, beyond 10 than one of 20 bits.
    """
    total, out = 0.0, []
    for i in range(max_count):
        total += exp(-1.0) / factorial(i)
        out.append(int(min(total, 1.0) * (1 << bits)))
    return out


def poisson_weight(draw: Column, bits: int = DRAW_BITS) -> Column:
    """How often a row enters one bootstrap replicate, by a draw below 2 ** bits."""
    limits = poisson_limits(bits)
    weight = F.lit(len(limits))
    for count, limit in reversed(list(enumerate(limits))):
        weight = F.when(draw < limit, F.lit(count)).otherwise(weight)
    return weight


def with_digest(df: DataFrame, key: str, replicate: Column, seed: int, out: str) -> DataFrame:
    """Attach the head of the digest that ``with_draw`` reads as a number: fifteen hex digits, which order as the numbers do."""
    whole = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), replicate.cast("string")))
    return df.withColumn(out, F.substring(whole, 1, DRAW_BITS // 4))


def digest_weight(digest: Column) -> Column:
    """``poisson_weight`` of a draw that is still text."""
    limits = [limit for limit in poisson_limits() if limit < 1 << DRAW_BITS]
    weight = F.lit(len(limits))
    for count, limit in reversed(list(enumerate(limits))):
        weight = F.when(digest < F.lit(f"{limit:0{DRAW_BITS // 4}x}"), F.lit(count)).otherwise(weight)
    return weight
