"""Rounding that agrees with decimal printing of the exact double, half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fmt(x: Column, pattern: str) -> Column:
    """A number as text by a pattern such as 0.00 or #,##0.00."""
    return F.call_function("format_number", x, F.lit(pattern))


def q(x: Column, digits: int) -> Column:
    """x rounded to `digits` decimals, as a double; null stays null."""
    return fmt(x.cast("double"), "0." + "0" * digits).cast("double")


def rate(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole rounded; null when whole is 0."""
    return F.when(whole > 0, q(part.cast("double") / whole.cast("double"), digits))


def plain(x: Column, digits: int = 6) -> Column:
    """A number with `digits` decimals, without trailing zeros and without a trailing point."""
    return F.regexp_replace(fmt(x, "0." + "0" * digits), r"\.?0+$", "")
