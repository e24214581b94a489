"""Executive views: scenario summaries, warehouse cost, headline figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.constants import (
    BASELINE,
    COST_ALERT_PCT,
    PENALTY_DAYS,
    Q4_PUSH,
    SITE_CAPACITY_UNITS,
    UNITS_PER_PALLET,
)
from granary.functions.calendar import fiscal_month_ordinal
from granary.functions.numbers import storage_cost
from granary.plans.lines import COST_COLUMNS, forecast_lines, weighted_avg, weighted_sum
from granary.sources.tables import PlanningTables

REPORT_QUARTERS = ("Q3", "Q4")


def planning_stats(t: PlanningTables, cost_grain: str = "zone") -> DataFrame:
    """One row: how many scenarios, products and sites, and the total forecast."""
    return forecast_lines(t, cost_grain=cost_grain).agg(
        F.countDistinct("scenario_code").alias("scenarios"),
        F.countDistinct("product_id").alias("products"),
        F.countDistinct("site_id").alias("sites"),
        weighted_sum(F.col("forecast_quantity")).alias("total_forecast"),
    )


def scenario_summary(t: PlanningTables, cost_grain: str = "zone") -> DataFrame:
    """Demand, revenue and breadth per scenario and quarter."""
    return (
        forecast_lines(t, cost_grain=cost_grain)
        .groupBy("scenario_code", "scenario_name", "fiscal_quarter")
        .agg(
            weighted_sum(F.col("forecast_quantity")).alias("total_demand"),
            weighted_sum(F.col("total_revenue")).alias("total_revenue"),
            F.countDistinct("product_id").alias("product_count"),
            F.countDistinct("site_id").alias("site_count"),
        )
    )


def _site_costs(
    lines: DataFrame, site_capacity: int, inside: Column, *extra: Column
) -> DataFrame:
    """Storage cost and overflow fee per scenario and site over ``inside`` lines."""

    def only(name: str) -> Column:
        return F.when(inside, F.col(name))

    stored = storage_cost(
        F.col("forecast_quantity"), F.col("storage_cost_per_pallet_per_day")
    )
    rows = lines.groupBy("scenario_code", "scenario_name", "site_name").agg(
        weighted_sum(only("forecast_quantity")).alias("demand"),
        weighted_sum(F.when(inside, stored)).alias("storage_cost"),
        weighted_avg(only("overflow_penalty_threshold_pct")).alias("capacity_threshold"),
        weighted_avg(only("overflow_penalty_rate")).alias("overflow_rate"),
        *extra,
    )
    limit = F.lit(float(site_capacity)) * F.col("capacity_threshold") / 100
    surplus = F.col("demand").cast("double") - limit
    fee = surplus / UNITS_PER_PALLET * F.col("overflow_rate") * PENALTY_DAYS
    return rows.withColumn(
        "overflow_cost", F.when(surplus > 0, F.round(fee, 2)).otherwise(F.lit(0.0))
    )


def warehouse_cost(
    t: PlanningTables,
    cost_grain: str = "zone",
    quarters: Sequence[str] = REPORT_QUARTERS,
    site_capacity: int = SITE_CAPACITY_UNITS,
) -> DataFrame:
    """Storage cost and estimated overflow fee per scenario and site."""
    lines = forecast_lines(t, COST_COLUMNS, cost_grain).where(
        F.col("fiscal_quarter").isin(*quarters)
    )
    return _site_costs(lines, site_capacity, F.lit(True))


def monthly_demand(t: PlanningTables, cost_grain: str = "zone") -> DataFrame:
    """Demand and revenue per scenario and month, with the month's fiscal place."""
    return (
        forecast_lines(t, cost_grain=cost_grain)
        .groupBy("scenario_code", "fiscal_month", "fiscal_quarter")
        .agg(
            weighted_sum(F.col("forecast_quantity")).alias("total_demand"),
            weighted_sum(F.col("total_revenue")).alias("total_revenue"),
        )
        .withColumn("month_order", fiscal_month_ordinal(F.col("fiscal_month")))
    )


def in_report_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """Sort a report; call it last, on aggregated rows.

    Text keys sort ascending with nulls last, the reference's default.
    """
    return df.orderBy(*[F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order])


def available_scenarios(t: PlanningTables) -> DataFrame:
    """Scenarios that have at least one line in the comparison view."""
    used = forecast_lines(t).select("scenario_code").distinct()
    return t.scenario_definition.join(used, "scenario_code", "left_semi").select(
        "scenario_id", "scenario_code", "scenario_name", "is_official_baseline"
    ).distinct()


def _total(value: str, scenario: str) -> Column:
    return F.coalesce(
        F.sum(F.when(F.col("scenario_code") == scenario, F.col(value))), F.lit(0)
    ).cast("double")


def _delta_pct(new: Column, old: Column) -> Column:
    return F.when(old > 0, F.round((new - old) / old * 100, 2)).otherwise(F.lit(0.0))


def headline_kpis(
    t: PlanningTables,
    cost_grain: str = "zone",
    base: str = BASELINE,
    other: str = Q4_PUSH,
    alert_pct: float = COST_ALERT_PCT,
    site_capacity: int = SITE_CAPACITY_UNITS,
) -> DataFrame:
    """One row comparing demand and warehouse cost of two scenarios.

    Demand covers every quarter, cost only the quarters of the cost report, as
    the dashboard's two queries do; one pass over the lines serves both.
    """
    lines = forecast_lines(t, COST_COLUMNS, cost_grain).where(
        F.col("scenario_code").isin(base, other)
    )
    inside = F.col("fiscal_quarter").isin(*REPORT_QUARTERS)
    both = _site_costs(
        lines, site_capacity, inside, weighted_sum(F.col("forecast_quantity")).alias("all_demand")
    ).agg(
        _total("all_demand", base).alias("base_demand"),
        _total("all_demand", other).alias("other_demand"),
        _total("storage_cost", base).alias("_base_storage"),
        _total("storage_cost", other).alias("_other_storage"),
        F.round(_total("overflow_cost", base), 2).alias("base_overflow"),
        F.round(_total("overflow_cost", other), 2).alias("other_overflow"),
    )
    base_cost = F.round(F.col("_base_storage") + F.col("base_overflow"), 2)
    other_cost = F.round(F.col("_other_storage") + F.col("other_overflow"), 2)
    cost_delta = _delta_pct(other_cost, base_cost)
    return both.select(
        "base_demand",
        "other_demand",
        _delta_pct(F.col("other_demand"), F.col("base_demand")).alias("demand_delta_pct"),
        base_cost.alias("base_cost"),
        other_cost.alias("other_cost"),
        "other_overflow",
        cost_delta.alias("cost_delta_pct"),
        (cost_delta > alert_pct).alias("cost_alert"),
    )


def cost_matrix(
    t: PlanningTables,
    scenarios: Sequence[str],
    cost_grain: str = "zone",
    site_capacity: int = SITE_CAPACITY_UNITS,
) -> DataFrame:
    """One row per site with the costs of each scenario side by side.

    Missing scenarios of a site read 0; ``all_scenarios`` ranks the sites.
    """
    costs = warehouse_cost(t, cost_grain, site_capacity=site_capacity).withColumn(
        "total_warehouse_cost", F.col("storage_cost").cast("double") + F.col("overflow_cost")
    )
    measures = ("storage_cost", "overflow_cost", "total_warehouse_cost")
    cells = [
        F.round(
            F.coalesce(
                F.sum(F.when(F.col("scenario_code") == s, F.col(m).cast("double"))), F.lit(0.0)
            ),
            0,
        ).alias(f"{s.lower()}_{m}")
        for s in scenarios
        for m in measures
    ]
    overall = F.sum(
        F.when(F.col("scenario_code").isin(*scenarios), F.col("total_warehouse_cost"))
    )
    return costs.groupBy("site_name").agg(*cells, F.round(overall, 0).alias("all_scenarios"))


def demand_matrix(
    t: PlanningTables, scenarios: Sequence[str], cost_grain: str = "zone"
) -> DataFrame:
    """One row per month with the demand of each scenario in a column."""
    return (
        monthly_demand(t, cost_grain)
        .groupBy("fiscal_month", "month_order")
        .pivot("scenario_code", list(scenarios))
        .agg(F.sum("total_demand"))
    )


def demand_increase(
    t: PlanningTables, cost_grain: str = "zone", base: str = BASELINE, other: str = Q4_PUSH
) -> DataFrame:
    """Monthly demand increase in percent and its mean over the last quarter."""
    table = demand_matrix(t, (base, other), cost_grain)
    old, new = F.col(base).cast("double"), F.col(other).cast("double")
    increase = (new - old) / F.nullif(old, F.lit(0.0)) * 100
    late = Window.partitionBy(F.col("month_order") > 3)
    return table.select(
        "fiscal_month",
        "month_order",
        F.round(increase, 4).alias("increase_pct"),
        F.when(F.col("month_order") > 3, F.round(F.avg(increase).over(late), 4)).alias(
            "q4_mean_increase_pct"
        ),
    )


def bottleneck_site(
    t: PlanningTables, scenario: str = Q4_PUSH, cost_grain: str = "zone",
    site_capacity: int = SITE_CAPACITY_UNITS,
) -> DataFrame:
    """The site with the highest overflow fee; ties go to the first name."""
    costs = warehouse_cost(t, cost_grain, site_capacity=site_capacity)
    return (
        costs.where(F.col("scenario_code") == scenario)
        .orderBy(F.col("overflow_cost").desc(), F.col("site_name").asc_nulls_last())
        .limit(1)
        .select("site_name", "overflow_cost")
    )


def cost_verdict(
    kpis: DataFrame, base: str = BASELINE, other: str = Q4_PUSH
) -> DataFrame:
    """Whether one scenario's warehousing costs more than another's.

    ``kpis`` is the scenario KPI table; the two totals come from one aggregate
    instead of a self join.
    """

    def total(code: str) -> Column:
        return F.sum(F.when(F.col("scenario_code") == code, F.col("total_warehousing_cost")))

    return (
        kpis.agg(total(base).alias("base_cost"), total(other).alias("other_cost"))
        .where(F.col("base_cost").isNotNull() & F.col("other_cost").isNotNull())
        .select(
            "base_cost",
            "other_cost",
            F.when(F.col("other_cost") > F.col("base_cost"), "HIGHER")
            .otherwise("LOWER")
            .alias("verdict"),
        )
    )
