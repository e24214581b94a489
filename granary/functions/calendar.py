"""Fiscal calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.constants import FISCAL_MONTHS, QUARTER_MONTHS


def fiscal_month_ordinal(month: Column) -> Column:
    """July = 1 ... December = 6, null for any other text."""
    names = F.array(*[F.lit(name) for name in FISCAL_MONTHS])
    return F.nullif(F.array_position(names, month), F.lit(0))


def fiscal_month_name(ordinal: Column) -> Column:
    """The inverse of :func:`fiscal_month_ordinal`; null outside 1..6."""
    names = F.array(*[F.lit(name) for name in FISCAL_MONTHS])
    return F.try_element_at(names, ordinal.cast("int"))


def fiscal_quarter(ordinal: Column) -> Column:
    """Q3 for the first three fiscal months, Q4 for the rest."""
    return F.when(ordinal <= 3, "Q3").otherwise("Q4")


def first_of_month(year: int, ordinal: Column) -> Column:
    """First day of a fiscal month (ordinal 1 is calendar month 7)."""
    return F.make_date(F.lit(year), (ordinal + 6).cast("int"), F.lit(1))


def in_quarter(date: Column, quarter: str) -> Column:
    """Whether a date lies in the calendar months of a fiscal quarter."""
    return F.month(date).isin(*QUARTER_MONTHS[quarter])
