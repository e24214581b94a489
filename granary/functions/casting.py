"""Forgiving casts for text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TOKENS = ("NULL", "null", "")


def blank_to_null(col: Column) -> Column:
    """Turn the null spellings of the text files into real nulls."""
    return F.when(col.isin(*NULL_TOKENS), None).otherwise(col)


def try_number(col: Column, declared: str = "decimal(38,0)", numeric: str = "scale0") -> Column:
    """Text to number, null when it does not parse.

    ``scale0`` first rounds to a whole number, half away from zero, whatever
    scale the target declares; ``declared`` keeps the target's own scale.
    """
    if numeric == "declared":
        return col.try_cast(declared)
    if numeric != "scale0":
        raise ValueError(f"numeric must be 'scale0' or 'declared', not {numeric!r}")
    return col.try_cast("decimal(38,0)").try_cast(declared)


def try_date(col: Column) -> Column:
    """ISO text to date, null when it does not parse."""
    return col.try_cast("date")


def try_boolean(col: Column) -> Column:
    """Text to boolean; besides Spark's spellings also ``on`` and ``off``."""
    word = F.lower(F.trim(col))
    return F.when(word == "on", True).when(word == "off", False).otherwise(col.try_cast("boolean"))


def try_typed(col: Column, declared: str, numeric: str = "scale0") -> Column:
    """Cast a text column to its declared type under the table's numeric rule."""
    if declared == "string":
        return col
    if declared == "date":
        return try_date(col)
    if declared == "boolean":
        return try_boolean(col)
    return try_number(col, declared, numeric)
