"""Data-quality reports: profiles, expectations, constraints, golden checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.schemas import ALLOWED_VALUES, FOREIGN_KEYS, PRIMARY_KEY, SCD_TABLES
from granary.sources.tables import PlanningTables


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _counted(df: DataFrame, **labels: Column) -> DataFrame:
    return df.agg(F.count("*").alias("row_count")).select(
        *[value.alias(name) for name, value in labels.items()], "row_count"
    )


def table_profile(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every table; each count is a map-side partial sum."""
    return _union([_counted(df, table_name=F.lit(name)) for name, df in frames.items()])


@dataclass(frozen=True)
class CatalogEntry:
    """A described object of the metric layer."""

    name: str
    object_type: str
    description: str


# What the metric layer lists about the tables it reads.
CATALOG = (
    CatalogEntry("SCENARIO_COMPARISON_V", "VIEW", "Main fact table for scenario analysis"),
    CatalogEntry("DT_SCENARIO_KPI_SUMMARY", "DYNAMIC TABLE", "Aggregated KPIs by scenario"),
    CatalogEntry("WAREHOUSE_UTILIZATION_PROJECTION", "VIEW", "Warehouse capacity projections"),
    CatalogEntry("INVENTORY_BUILDUP_CURVE", "VIEW", "Time-series inventory positions"),
)


def catalog_profile(frames: Mapping[str, DataFrame], schema: str = "MART") -> DataFrame:
    """Row counts and descriptions of the metric layer's tables."""
    return _union(
        [
            _counted(
                frames[entry.name],
                table_name=F.lit(entry.name),
                schema_name=F.lit(schema),
                object_type=F.lit(entry.object_type),
                description=F.lit(entry.description),
            )
            for entry in CATALOG
        ]
    )


@dataclass(frozen=True)
class Expectation:
    """A named result and the least number of rows it must have."""

    name: str
    build: Callable[[PlanningTables], DataFrame]
    description: str = ""
    min_rows: int = 0


def expect(df: DataFrame, name: str, min_rows: int = 0, description: str = "") -> DataFrame:
    """One report row: does the frame have at least ``min_rows`` rows?"""
    return _counted(
        df,
        query_name=F.lit(name),
        description=F.lit(description),
        min_rows=F.lit(min_rows).cast("bigint"),
    ).withColumn("passed", F.col("row_count") >= F.col("min_rows"))


def run_expectations(t: PlanningTables, expectations: list[Expectation]) -> DataFrame:
    """The report over all expectations as one lazy frame."""
    return _union([expect(e.build(t), e.name, e.min_rows, e.description) for e in expectations])


#: Slots of :func:`key_usage`: a key of a current row, or of an earlier version.
_CURRENT, _EARLIER = 0, -1


def _references_to(parent: str) -> list[tuple[str, str]]:
    """The referring tables and columns of a parent; their place is their slot, from 1."""
    return [(table, c) for table, c, name, _ in FOREIGN_KEYS if name == parent]


def _lists_of(table: str) -> dict[str, tuple[str, ...]]:
    return {c: allowed for (name, c), allowed in ALLOWED_VALUES.items() if name == table}


_MOST_REFERENCES = max(len(_references_to(table)) for table in PRIMARY_KEY)
_MOST_LISTS = max(len(_lists_of(table)) for table in PRIMARY_KEY)


def _uses(t: PlanningTables, table: str) -> DataFrame:
    """What each row of one table says about keys: ``owner, value, slot``.

    ``owner`` is the table whose key ``value`` is. A null key keeps its slot; a value
    outside its list is a null value of the row's own table in a slot after the
    references. One scan, and one row for each key, reference and breach.
    """
    key = PRIMARY_KEY[table]
    current = F.col("is_current_flag") if table in SCD_TABLES else F.lit(True)
    slots = [(table, F.col(key), F.when(current, _CURRENT).otherwise(_EARLIER))]
    for name, c, parent, _ in FOREIGN_KEYS:
        if name == table:
            slot = _references_to(parent).index((table, c)) + 1
            slots.append((parent, F.col(c), F.when(F.col(c).isNotNull(), slot)))
    for place, (c, allowed) in enumerate(_lists_of(table).items(), _MOST_REFERENCES + 1):
        slots.append((table, F.lit(None), F.when(~F.col(c).isin(*allowed), place)))
    entries = [
        F.struct(F.lit(owner).alias("owner"), value.cast("bigint").alias("value"), slot.alias("slot"))
        for owner, value, slot in slots
    ]
    return getattr(t, table).select(F.inline(F.array(*entries))).where("slot IS NOT NULL")


def key_usage(t: PlanningTables) -> DataFrame:
    """Per table and key value: its rows, and how many rows refer to it.

    ``owner, value, stored, rows, reference_1..`` with ``stored`` the rows of any
    version, ``rows`` the current ones, and a count per referring column in the order
    of :data:`FOREIGN_KEYS`; ``list_1..`` count breaches of value lists under the null
    value. Every table is scanned once, and one aggregate brings keys and references
    together; a value shared by many rows is counted before it is shuffled.
    """
    slot = F.col("slot")
    return (
        _union([_uses(t, table) for table in PRIMARY_KEY])
        .groupBy("owner", "value")
        .agg(
            F.count_if(slot <= _CURRENT).alias("stored"),
            F.count_if(slot == _CURRENT).alias("rows"),
            *[F.count_if(slot == k).alias(f"reference_{k}") for k in range(1, _MOST_REFERENCES + 1)],
            *[F.count_if(slot == _MOST_REFERENCES + k).alias(f"list_{k}") for k in range(1, _MOST_LISTS + 1)],
        )
    )


def constraint_report(t: PlanningTables) -> DataFrame:
    """Violations of every declared key, reference and value list.

    Surplus rows per key (current rows of a versioned table), rows without a key, rows
    whose reference no row of any version has, and values outside their list; null
    references and null values break nothing. One scan per table and one shuffle, of
    distinct keys and references (:func:`key_usage`).
    """
    real, lost = F.col("value").isNotNull(), F.col("stored") == 0
    references = [f"reference_{k}" for k in range(1, _MOST_REFERENCES + 1)]
    lists = [f"list_{k}" for k in range(1, _MOST_LISTS + 1)]
    by_table = key_usage(t).groupBy("owner").agg(
        F.sum(F.when(real, F.greatest(F.col("rows") - 1, F.lit(0)))).alias("surplus"),
        F.sum(F.when(~real, F.col("stored"))).alias("missing"),
        *[F.sum(F.when(lost, F.col(c))).alias(c) for c in references],
        *[F.sum(c).alias(c) for c in lists],
    )
    found = []
    for table, key in PRIMARY_KEY.items():
        found += [("PRIMARY KEY", table, key, table, "surplus"), ("NOT NULL", table, key, table, "missing")]
        found += [("ALLOWED VALUES", table, c, table, at) for c, at in zip(_lists_of(table), lists)]
        found += [("FOREIGN KEY", child, c, table, at) for (child, c), at in zip(_references_to(table), references)]
    # One row, also of empty tables, as an aggregate without keys always has one.
    row = by_table.agg(
        *[
            F.coalesce(F.max(F.when(F.col("owner") == owner, F.col(count))), F.lit(0)).alias(f"_{k}")
            for k, (*_, owner, count) in enumerate(found)
        ]
    )
    entries = [
        F.struct(
            F.lit(kind).alias("constraint_type"),
            F.lit(table).alias("table_name"),
            F.lit(column).alias("column_name"),
            F.col(f"_{k}").cast("bigint").alias("violations"),
        )
        for k, (kind, table, column, *_) in enumerate(found)
    ]
    return row.select(F.inline(F.array(*entries)))


def too_long(df: DataFrame, lengths: Mapping[str, int]) -> DataFrame:
    """Per text column, the rows whose value exceeds its declared length."""
    row = df.agg(
        *[
            F.count_if(F.length(F.col(c)) > limit).cast("bigint").alias(c)
            for c, limit in lengths.items()
        ]
    )
    return row.unpivot([], list(lengths), "column_name", "violations")


def row_differences(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that occur more often on one side, nulls equal to nulls.

    One grouped sum of +1 and -1 over both sides replaces two multiset
    differences; ``surplus`` is positive where the actual result has more.
    """
    columns = expected.columns
    tagged = actual.select(*columns).withColumn("_side", F.lit(1)).unionByName(
        expected.withColumn("_side", F.lit(-1))
    )
    return (
        tagged.groupBy(*columns)
        .agg(F.sum("_side").alias("surplus"))
        .where(F.col("surplus") != 0)
    )


def golden_check(name: str, actual: DataFrame, expected: DataFrame | None) -> DataFrame:
    """One report row: PASSED, FAILED, or NOT_RUN without expected rows."""
    spark = actual.sparkSession
    if expected is None:
        return spark.range(1).select(
            F.lit(name).alias("query_name"),
            F.lit("NOT_RUN").alias("status"),
            F.lit(0).cast("bigint").alias("missing_rows"),
            F.lit(0).cast("bigint").alias("unexpected_rows"),
        )
    surplus = F.col("surplus")
    missing = F.coalesce(F.sum(F.when(surplus < 0, -surplus)), F.lit(0))
    unexpected = F.coalesce(F.sum(F.when(surplus > 0, surplus)), F.lit(0))
    return row_differences(actual, expected).agg(
        missing.alias("missing_rows"), unexpected.alias("unexpected_rows")
    ).select(
        F.lit(name).alias("query_name"),
        F.when((F.col("missing_rows") == 0) & (F.col("unexpected_rows") == 0), "PASSED")
        .otherwise("FAILED")
        .alias("status"),
        "missing_rows",
        "unexpected_rows",
    )
