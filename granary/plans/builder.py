"""Reference lists and forecast detail for editing a scenario."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.calendar import fiscal_month_ordinal
from granary.operators.current import current_rows, current_versions
from granary.plans.lines import dimension_lines, site_costs
from granary.sources.tables import PlanningTables


def scenarios(t: PlanningTables) -> DataFrame:
    """Every scenario with its description."""
    return t.scenario_definition.select(
        "scenario_id",
        "scenario_code",
        "scenario_name",
        "scenario_description",
        "is_official_baseline",
    )


def scenarios_in_order(t: PlanningTables) -> DataFrame:
    """Scenarios, the baseline first, then by name."""
    return scenarios(t).orderBy(
        F.col("is_official_baseline").desc_nulls_first(), F.col("scenario_name").asc_nulls_last()
    )


def products(t: PlanningTables) -> DataFrame:
    """Current products with their category name."""
    category = current_rows(t.product_category).select("product_category_id", "category_name")
    return (
        current_rows(t.product)
        .join(category, "product_category_id")
        .select("product_id", "product_name", "category_name")
        .distinct()
    )


def sites(t: PlanningTables) -> DataFrame:
    """Current sites."""
    return current_rows(t.site).select("site_id", "site_name", "site_code").distinct()


def forecast_detail(t: PlanningTables) -> DataFrame:
    """Every current forecast with product, site and scenario names."""
    return (
        current_versions(t.demand_forecast_versions)
        .join(current_rows(t.product).select("product_id", "product_name"), "product_id")
        .join(current_rows(t.site).select("site_id", "site_name"), "site_id")
        .join(t.scenario_definition.select("scenario_id", "scenario_code"), "scenario_id")
        .select(
            "demand_forecast_id",
            "product_id",
            "product_name",
            "site_id",
            "site_name",
            "forecast_date",
            "forecast_quantity",
            "scenario_id",
            "scenario_code",
        )
    )


def scenario_detail(
    t: PlanningTables, scenario_id: int, cost_grain: str = "zone"
) -> DataFrame:
    """The comparison rows of one scenario."""
    lines = dimension_lines(t).where(F.col("scenario_id") == scenario_id)
    return lines.join(
        site_costs(t.logistics_cost_fact, cost_grain).select("site_id"), "site_id", "left"
    ).select(
        "product_name",
        "site_name",
        "fiscal_month",
        "fiscal_quarter",
        "forecast_quantity",
        "total_revenue",
    )


def month_totals(detail: DataFrame) -> DataFrame:
    """Quantity and revenue of a scenario's detail rows per month."""
    return (
        detail.groupBy("fiscal_month", "fiscal_quarter")
        .agg(
            F.sum("forecast_quantity").alias("forecast_quantity"),
            F.sum("total_revenue").alias("total_revenue"),
        )
        .withColumn("month_order", fiscal_month_ordinal(F.col("fiscal_month")))
    )
