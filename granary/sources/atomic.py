"""Typed, validated tables from the raw layer (the ATOMIC layer)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.casting import try_number, try_typed
from granary.schemas import ATOMIC, PRIMARY_KEY, SCD_TABLES, columns_of
from granary.sources.tables import PlanningTables, write_table


def to_atomic(
    raw: DataFrame,
    table: str,
    as_of: Column,
    numeric: str = "scale0",
    user: str = "system",
) -> DataFrame:
    """Type the raw text, drop rows without a numeric key, stamp defaults.

    A value that does not parse becomes null; only the key decides whether the
    row is kept. Column defaults are explicit arguments, so the result depends
    on nothing but the input.
    """
    declared = columns_of(table)
    typed = {
        name: try_typed(F.col(name), kind, numeric) for name, kind in ATOMIC[table].items()
    }
    defaults: dict[str, Column] = {
        "created_by_user": F.lit(user),
        "created_timestamp": as_of,
    }
    if table in SCD_TABLES:
        defaults |= {"valid_from_timestamp": as_of, "is_current_flag": F.lit(True)}
    if table == "scenario_definition":
        defaults |= {"version_number": F.lit(1)}
    if table == "demand_forecast_versions":
        defaults |= {
            "total_revenue": typed["forecast_quantity"] * typed["unit_revenue"],
            "version_timestamp": as_of,
            "is_current_version": F.lit(True),
        }
    values = {**defaults, **typed}
    key = PRIMARY_KEY[table]
    return raw.where(try_number(F.col(key)).isNotNull()).select(
        *[values.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in declared.items()]
    )


def transform_raw_to_atomic(
    spark: SparkSession,
    raw_root: str,
    root: str,
    as_of: Column,
    numeric: str = "scale0",
    user: str = "system",
) -> None:
    """Reload all nine atomic tables from the stored raw layer."""
    for table in PlanningTables.names():
        raw = spark.read.parquet(f"{raw_root}/{table}_stage")
        write_table(to_atomic(raw, table, as_of, numeric, user), root, table)
