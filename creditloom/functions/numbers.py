"""Guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """An amount with two decimals as a whole number of hundredths.

    Doubles hold whole numbers exactly, so a quotient of cents is the double nearest to the
    true quotient and rounds as the decimal would; 2198.54 / 80 does not.
    """
    return F.round(amount * 100)


def ratio(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """Rounded quotient of whole numbers, NULL unless the denominator is positive."""
    quotient = numerator.cast("double") / denominator.cast("double")
    return F.when(denominator > 0, F.round(quotient, digits))


def clamp(value: Column, low: float, high: float) -> Column:
    """Value limited to [low, high].

    ``least``/``greatest`` skip NULLs, so a missing value comes out as ``high``; the bureau
    model relies on that.
    """
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def round_binary(value: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even, as C and Python do.

    ``F.round`` works on the shortest decimal form and rounds its ties up.
    """
    number, scale = value.cast("double"), float(10**digits)
    scaled = number * F.lit(scale)
    # the product is off by half a unit in its last place at most, so away from ties it rounds as
    # the exact value does, and a quotient of whole numbers is the double nearest to the decimal
    slack = F.abs(scaled) * F.lit(2.0**-50)
    is_clear = F.abs(scaled - F.rint(scaled)) + slack < F.lit(0.5)
    pattern = F.lit("0." + "0" * digits)
    formatted = F.call_function("format_number", number, pattern).cast("double")
    return F.when(is_clear, F.rint(scaled) / F.lit(scale)).otherwise(formatted)
