"""Exact arithmetic expressions shared by the marts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.constants import (
    DANGER_PCT,
    STORAGE_DAYS,
    UNITS_PER_PALLET,
    WARNING_PCT,
)


def dec(text: str, declared: str = "decimal(18,4)") -> Column:
    """An exact decimal literal."""
    return F.lit(text).cast(declared)


def storage_cost(
    quantity: Column,
    rate: Column,
    days: int = STORAGE_DAYS,
    units_per_pallet: int = UNITS_PER_PALLET,
) -> Column:
    """Cost of storing a quantity for a number of days, rounded to cents.

    Whole ``days / units_per_pallet`` folds into the rate, so the product keeps
    all eight decimals and is rounded exactly once.
    """
    if days % units_per_pallet == 0:
        per_unit = (rate * F.lit(days // units_per_pallet)).cast("decimal(18,4)")
        return F.round(quantity * per_unit, 2)
    per_pallet = (rate * F.lit(days)).cast("decimal(18,4)")
    return F.round(quantity * per_pallet / F.lit(units_per_pallet), 2)


def percent_of(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole`` in percent, null when the whole is zero.

    The operands are narrowed first so that the quotient keeps ten digits.
    """
    top = part.cast("decimal(26,6)") * 100
    return F.round(top / F.nullif(whole.cast("decimal(24,4)"), F.lit(0)), digits)


def safe_number(value: Column, default: float = 0.0) -> Column:
    """Replace null, NaN and infinite doubles by a default."""
    unusable = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(unusable, F.lit(default)).otherwise(value)


def utilisation_band(pct: Column) -> Column:
    """danger from 90 %, warning from 80 %, ok below (also for null)."""
    return F.when(pct >= DANGER_PCT, "danger").when(pct >= WARNING_PCT, "warning").otherwise("ok")


def present(df):
    """Decimals as doubles, rounded first where they have over four digits."""
    shown = []
    for field in df.schema.fields:
        name = value = f"`{field.name}`"
        if field.dataType.typeName() == "decimal":
            if field.dataType.scale > 4:
                value = f"round({value}, 4)"
            value = f"CAST({value} AS DOUBLE)"
        shown.append(f"{value} AS {name}")
    return df.selectExpr(*shown)
