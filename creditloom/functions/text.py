"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Heading pattern of a policy document and the name of an unnamed section.
SECTION_PATTERN = r"SECTION\s+\d+[:\s]+([^\n]+)"
DEFAULT_SECTION = "general"


def strip(text: Column) -> Column:
    """Remove all surrounding white space, line ends included (SQL ``trim`` only drops blanks)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def short_hash(text: Column, length: int = 16) -> Column:
    """Leading hex digits of the SHA-256 of a string."""
    return F.substring(F.sha2(text, 256), 1, length)


def section_name(text: Column) -> Column:
    found = F.lower(strip(F.regexp_extract(text, SECTION_PATTERN, 1)))
    return F.when(found != "", found).otherwise(F.lit(DEFAULT_SECTION))


def _decimals(value: Column, pattern: str) -> Column:
    """Formatted from the exact binary value, ties to even, like C and Python do.

    ``format_string`` would round the shortest decimal form half up: 0.735 becomes 0.74
    although the stored number lies just below 0.735.
    """
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def percent(value: Column, digits: int = 1) -> Column:
    return F.concat(_decimals(value * 100, "0." + "0" * digits), F.lit("%"))


def fixed(value: Column, digits: int) -> Column:
    return _decimals(value, "0." + "0" * digits if digits else "0")


def signed(value: Column, digits: int = 4) -> Column:
    places = "0." + "0" * digits
    return _decimals(value, f"+{places};-{places}")


def words(identifier: Column) -> Column:
    return F.replace(identifier, F.lit("_"), F.lit(" "))
