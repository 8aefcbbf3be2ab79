"""Number helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Text of a non-negative double with ``digits`` decimals, ties decided on its exact binary value.

    ``format_string`` rounds the shortest decimal form half up, which turns 0.485 (really a hair
    below) into 0.49.  Splitting the double into a float part and a rest keeps both products with
    the power of ten exact, so the comparison with one half is exact too.
    """
    scale = F.lit(float(10**digits))
    high = value.cast("float").cast("double")
    low = value - high
    down = F.floor(value * scale)
    rest = ((high * scale - down.cast("double")) - F.lit(0.5)) + low * scale
    up = (rest > 0) | ((rest == 0) & (down % 2 == 1))
    n = down + F.when(up, F.lit(1)).otherwise(F.lit(0))
    unit = F.lit(10**digits)
    return F.concat(
        F.floor(n / unit).cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), digits, "0")
    )


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double, 0 where the denominator is 0 (ANSI mode would raise)."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def python_list(arr: Column) -> Column:
    """An array of plain strings in Python's list notation, as used in report texts."""
    return F.when(F.size(arr) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("['"), F.array_join(arr, "', '"), F.lit("']"))
    )
