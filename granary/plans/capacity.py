"""Capacity views: production, warehouse zones, demand against capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.constants import WARNING_PCT
from granary.functions.calendar import fiscal_month_ordinal
from granary.functions.numbers import percent_of, utilisation_band
from granary.operators.current import current_rows
from granary.plans.dashboards import monthly_demand
from granary.plans.lines import COST_COLUMNS
from granary.plans.mart import production_capacity, zone_costs
from granary.sources.tables import PlanningTables


def capacity_by_line(t: PlanningTables) -> DataFrame:
    """Production capacity of every work center under its site."""
    return production_capacity(t).select(
        "site_name",
        "work_center_name",
        "max_daily_capacity",
        "max_monthly_capacity",
        "hours_per_day",
        "efficiency_factor",
    )


def zone_status(t: PlanningTables) -> DataFrame:
    """Occupancy, cost terms and utilisation band of every zone."""
    pct = percent_of(F.col("current_occupancy_pallets"), F.col("max_capacity_pallets"), 1)
    return zone_costs(t, COST_COLUMNS).select(
        "site_name",
        "zone_name",
        "max_capacity_pallets",
        "current_occupancy_pallets",
        "zone_type",
        F.col("storage_cost_per_pallet_per_day").alias("storage_cost"),
        F.col("overflow_penalty_threshold_pct").alias("capacity_threshold_percent"),
        F.col("overflow_penalty_rate").alias("overflow_cost_factor"),
        pct.alias("utilization_pct"),
        utilisation_band(pct).alias("band"),
    )


def zones_at_risk(t: PlanningTables, pct: int = WARNING_PCT) -> DataFrame:
    """Zones filled to the warning level or beyond."""
    return zone_status(t).where(F.col("utilization_pct") >= pct)


def site_capacity(t: PlanningTables) -> DataFrame:
    """Production capacity summed per site."""
    return (
        production_capacity(t)
        .groupBy("site_name")
        .agg(
            F.sum("max_monthly_capacity").alias("max_monthly_capacity"),
            F.sum("max_daily_capacity").alias("max_daily_capacity"),
        )
    )


def total_capacity(t: PlanningTables) -> DataFrame:
    """One row: production capacity of all work centers."""
    return production_capacity(t).agg(
        F.sum("max_daily_capacity").alias("daily_capacity"),
        F.sum("max_monthly_capacity").alias("monthly_capacity"),
    )


def warehouse_totals(t: PlanningTables) -> DataFrame:
    """One row: pallets held and possible at warehouse sites."""
    sites = current_rows(t.site).where(F.col("site_type") == "WAREHOUSE").select("site_id")
    return (
        current_rows(t.warehouse_zone)
        .join(sites, "site_id")
        .agg(
            F.sum("max_capacity_pallets").alias("total_capacity_pallets"),
            F.sum("current_occupancy_pallets").alias("current_occupancy_pallets"),
        )
    )


def capacity_overview(t: PlanningTables, pct: int = WARNING_PCT) -> DataFrame:
    """One row: capacity totals, overall fill, sites with a zone over the level."""
    zones = zone_status(t).agg(
        F.sum("max_capacity_pallets").alias("total_capacity_pallets"),
        F.sum("current_occupancy_pallets").alias("occupied_pallets"),
        F.countDistinct(F.when(F.col("utilization_pct") > pct, F.col("site_name"))).alias(
            "sites_at_risk"
        ),
    )
    return zones.select(
        total_capacity(t).select("monthly_capacity").scalar().alias("monthly_production_capacity"),
        "total_capacity_pallets",
        "occupied_pallets",
        F.coalesce(
            percent_of(F.col("occupied_pallets"), F.col("total_capacity_pallets"), 1), F.lit(0)
        )
        .cast("decimal(18,1)")
        .alias("utilization_pct"),
        "sites_at_risk",
    )


def demand_vs_capacity(t: PlanningTables, cost_grain: str = "zone") -> DataFrame:
    """Monthly demand per scenario against the total monthly capacity."""
    capacity = total_capacity(t).select("monthly_capacity").scalar()
    rows = monthly_demand(t, cost_grain).select(
        "fiscal_month",
        "fiscal_quarter",
        "scenario_code",
        "month_order",
        "total_demand",
        capacity.alias("total_capacity"),
    )
    gap = F.col("total_capacity") - F.col("total_demand")
    return rows.withColumn("gap", gap).withColumn(
        "gap_pct", percent_of(gap, F.col("total_capacity"))
    )


def capacity_shortfalls(
    t: PlanningTables, scenario: str, cost_grain: str = "zone"
) -> DataFrame:
    """Months in which a scenario's demand exceeds capacity."""
    return demand_vs_capacity(t, cost_grain).where(
        (F.col("scenario_code") == scenario) & (F.col("gap") < 0)
    )


def build_plan_view(plan: DataFrame, scenario_definition: DataFrame) -> DataFrame:
    """A stored build plan with scenario names, in fiscal order."""
    names = scenario_definition.select("scenario_id", "scenario_name")
    return (
        plan.join(names, "scenario_id")
        .select(
            "fiscal_month",
            "fiscal_quarter",
            "recommended_quantity",
            "current_capacity_available",
            "capacity_utilization_pct",
            "projected_inventory",
            "warehouse_utilization_pct",
            "projected_production_cost",
            "projected_storage_cost",
            "projected_total_cost",
            "model_version",
            "model_confidence",
            "scenario_name",
        )
        .orderBy(fiscal_month_ordinal(F.col("fiscal_month")).asc_nulls_last())
    )
