"""Labels: binary and strict mappings, domains, encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The domain of the humour label.
HUMOUR = {"not_funny": 0, "funny": 1, "very_funny": 1, "hilarious": 1}


def binary_label(humour: Column) -> Column:
    """not_funny is 0, null stays null, any other value is 1."""
    return F.when(humour.isNull(), F.lit(None)).when(humour == "not_funny", 0).otherwise(1).cast("int")


def tidy_label(label: Column) -> Column:
    """A label in the spelling of its domain: trimmed, lower-cased, blanks as underscores."""
    return F.regexp_replace(F.lower(F.trim(label)), r"\s+", "_")


def strict_label(humour: Column) -> Column:
    """The mapped class of a known label; null for unknown ones and null."""
    out = F.lit(None).cast("int")
    for value, to in HUMOUR.items():
        out = F.when(humour == value, F.lit(to)).otherwise(out)
    return out


def flag(column: Column, negative: str) -> Column:
    return F.when(column == negative, "0").otherwise("1")


def level(column: Column, zero: str, one: str, two: str) -> Column:
    """Intensity as 0, 1 or 2; any other value, null too, is 3."""
    return F.when(column == zero, "0").when(column == one, "1").when(column == two, "2").otherwise("3")
