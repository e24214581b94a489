"""Forecast lines joined to their dimensions, the base of every aggregate.

A warehouse site has one cost row per zone, and the comparison view joins costs
on the site alone, so a forecast row counts once per zone. Aggregates do not
need those repeated rows: :func:`forecast_lines` keeps one row per distinct
cost combination and says in ``copies`` how often it counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.current import current_rows, current_versions
from granary.sources.tables import PlanningTables

COST_COLUMNS = (
    "storage_cost_per_pallet_per_day",
    "overflow_penalty_rate",
    "overflow_penalty_threshold_pct",
)
LEAF_LEVEL = 3


def _check_grain(cost_grain: str) -> None:
    if cost_grain not in ("zone", "site_avg"):
        raise ValueError(f"cost_grain must be 'zone' or 'site_avg', not {cost_grain!r}")


def site_costs(costs: DataFrame, cost_grain: str = "zone") -> DataFrame:
    """Current cost rows by site: one per zone, or one average per site."""
    _check_grain(cost_grain)
    live = current_rows(costs).select("site_id", *COST_COLUMNS)
    if cost_grain == "zone":
        return live
    return live.groupBy("site_id").agg(
        *[
            F.avg(c).cast("decimal(5,2)" if c.endswith("_pct") else "decimal(18,4)").alias(c)
            for c in COST_COLUMNS
        ]
    )


def cost_profile(
    costs: DataFrame, columns: Sequence[str] = (), cost_grain: str = "zone"
) -> DataFrame:
    """Distinct combinations of the named cost columns per site, with counts."""
    return (
        site_costs(costs, cost_grain)
        .groupBy("site_id", *columns)
        .agg(F.count("*").alias("copies"))
    )


def category_names(categories: DataFrame, level: int | None = None) -> DataFrame:
    """Category id to family name: its own, or that of its ancestor at a level.

    The hierarchy is three levels deep, so the walk is a fixed number of small
    self joins. A category above the wanted level keeps its own name.
    """
    live = current_rows(categories)
    names = live.select(
        "product_category_id",
        F.col("category_name").alias("product_family"),
        F.col("parent_category_id").alias("_up"),
        F.col("category_level").alias("_level"),
    )
    if level is not None:
        parents = live.select(
            F.col("product_category_id").alias("_up"),
            F.col("category_name").alias("_name"),
            F.col("parent_category_id").alias("_next"),
            F.col("category_level").alias("_next_level"),
        )
        for _ in range(LEAF_LEVEL - level):
            climb = (F.col("_level") > level) & F.col("_next_level").isNotNull()
            names = names.join(parents, "_up", "left").select(
                "product_category_id",
                F.when(climb, F.col("_name")).otherwise(F.col("product_family")).alias(
                    "product_family"
                ),
                F.when(climb, F.col("_next")).otherwise(F.col("_up")).alias("_up"),
                F.when(climb, F.col("_next_level")).otherwise(F.col("_level")).alias("_level"),
            )
    return names.select("product_category_id", "product_family")


def dimension_lines(t: PlanningTables, family_level: int | None = None) -> DataFrame:
    """Current forecasts with scenario, product, category and site columns.

    A left-deep star join over the stored dimensions: Spark broadcasts each one
    whose size statistics allow it and otherwise sort-merges with runtime skew
    splitting. Columns nobody selects are pruned from the scans.
    """
    scenario = t.scenario_definition.select(
        "scenario_id", "scenario_code", "scenario_name", "scenario_type", "is_official_baseline"
    )
    product = current_rows(t.product).select(
        "product_id", "product_code", "product_name", "product_category_id", "unit_cost"
    )
    site = current_rows(t.site).select("site_id", "site_code", "site_name", "site_type", "region")
    return (
        current_versions(t.demand_forecast_versions)
        .join(scenario, "scenario_id")
        .join(product, "product_id")
        .join(category_names(t.product_category, family_level), "product_category_id", "left")
        .join(site, "site_id")
        .withColumn("total_cost", F.col("forecast_quantity") * F.col("unit_cost"))
        .withColumn("gross_margin", F.col("total_revenue") - F.col("total_cost"))
    )


def forecast_lines(
    t: PlanningTables,
    cost_columns: Sequence[str] = (),
    cost_grain: str = "zone",
    family_level: int | None = None,
) -> DataFrame:
    """Forecast lines with the named cost columns and a ``copies`` weight."""
    profile = cost_profile(t.logistics_cost_fact, cost_columns, cost_grain)
    return (
        dimension_lines(t, family_level)
        .join(profile, "site_id", "left")
        .withColumn("copies", F.coalesce(F.col("copies"), F.lit(1)))
    )


def weighted_sum(value: Column) -> Column:
    """Sum over the view's rows, from weighted lines."""
    return F.sum(value * F.col("copies"))


def weighted_avg(value: Column) -> Column:
    """Average over the view's rows, nulls ignored, as a double."""
    known = F.sum(F.when(value.isNotNull(), F.col("copies")))
    return weighted_sum(value).cast("double") / known
