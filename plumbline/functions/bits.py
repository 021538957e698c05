"""Doubles as integers of the same order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRACTION = 52
LEAST, MOST = -1022, 1023  # exponents of normal numbers


def order_bits(value: Column | str) -> Column:
    """A LONG that is smaller, equal or larger exactly where the double is: its IEEE 754 bits, negated for negative numbers.

    Both zeros are 0, infinities are beyond all finite numbers and NaN is above infinity, as Spark orders them.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    size = F.abs(v)
    # the logarithm is off by one at most, next to a power of two
    near = F.greatest(F.least(F.floor(F.log2(size)), F.lit(MOST)), F.lit(LEAST))
    exponent = F.when(F.pow(F.lit(2.0), near) > size, near - 1).when(F.pow(F.lit(2.0), near + 1) <= size, near + 1).otherwise(near)
    exponent = F.greatest(F.least(exponent, F.lit(MOST)), F.lit(LEAST))
    # scaled in two steps that are both exact; below the least exponent the leading bit is missing
    fraction = (size / F.pow(F.lit(2.0), exponent) * F.lit(float(1 << FRACTION))).cast("long")
    bits = (exponent - LEAST) * F.lit(1 << FRACTION) + fraction
    special = F.lit((MOST - LEAST + 2) << FRACTION)
    bits = F.when(F.isnan(v), special + 1).when(size == float("inf"), special).when(size == 0, F.lit(0)).otherwise(bits)
    return F.when(v < 0, -bits).otherwise(bits).cast("long")
