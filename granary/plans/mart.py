"""The analytical marts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.constants import (
    CARRY_COST_PER_UNIT,
    DEFAULT_STORAGE_RATE,
    PENALTY_DAYS,
    UNITS_PER_PALLET,
    WORKING_DAYS,
)
from granary.functions.calendar import fiscal_month_ordinal
from granary.functions.numbers import dec, percent_of, storage_cost
from granary.operators.current import current_rows, current_versions
from granary.operators.pairs import every_pair
from granary.plans.lines import (
    COST_COLUMNS,
    cost_profile,
    dimension_lines,
    site_costs,
    weighted_sum,
)
from granary.sources.tables import PlanningTables

_RATE = "storage_cost_per_pallet_per_day"
#: Rates of a site that the KPI table prices in one line.
RATES_IN_ROW = 4

COMPARISON_COLUMNS = (
    "scenario_id",
    "scenario_code",
    "scenario_name",
    "scenario_type",
    "is_official_baseline",
    "product_id",
    "product_code",
    "product_name",
    "product_family",
    "site_id",
    "site_code",
    "site_name",
    "site_type",
    "region",
    "forecast_date",
    "fiscal_period",
    "fiscal_month",
    "fiscal_quarter",
    "fiscal_year",
    "forecast_quantity",
    "confidence_level",
    "forecast_type",
    "unit_revenue",
    "total_revenue",
    "unit_cost",
    "total_cost",
    "gross_margin",
    *COST_COLUMNS,
    "projected_warehousing_cost",
    "version_timestamp",
    "is_current_version",
)


def scenario_comparison(
    t: PlanningTables, cost_grain: str = "zone", family_level: int | None = None
) -> DataFrame:
    """One row per current forecast and cost row of its site (33 columns).

    ``cost_grain="zone"`` repeats a forecast once per zone of its site;
    ``"site_avg"`` keeps it single with the site's average rates.
    """
    rows = dimension_lines(t, family_level).join(
        site_costs(t.logistics_cost_fact, cost_grain), "site_id", "left"
    )
    cost = storage_cost(F.col("forecast_quantity"), F.col(_RATE))
    return rows.withColumn("projected_warehousing_cost", cost).select(*COMPARISON_COLUMNS)


KPI_KEYS = (
    "scenario_id", "scenario_code", "scenario_name", "scenario_type", "is_official_baseline"
)


def scenario_kpis(
    t: PlanningTables, cost_grain: str = "zone", as_of: Column | None = None
) -> DataFrame:
    """Headline figures per scenario, in one pass over the forecasts.

    The rates of a site lie side by side in a row, and the storage cost is summed
    inside the line, so that a line repeats only once per ``RATES_IN_ROW`` rates.
    """
    default = dec(DEFAULT_STORAGE_RATE)
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(_RATE)) - 1
    rates = (
        cost_profile(t.logistics_cost_fact, (_RATE,), cost_grain)
        .withColumns({_RATE: F.coalesce(F.col(_RATE), default), "_row": F.floor(place / RATES_IN_ROW)})
        .groupBy("site_id", "_row")
        .agg(
            F.collect_list(F.struct(F.col(_RATE).alias("rate"), "copies")).alias("_rates"),
            F.sum("copies").alias("copies"),
        )
        .drop("_row")
    )
    quantity = F.col("forecast_quantity")

    def cost(k: int) -> Column:
        """Of the row's rate at a place; the default where a site has none."""
        r = F.get("_rates", F.lit(k))
        absent = F.lit(0) if k else storage_cost(quantity, default)
        known = storage_cost(quantity, r["rate"]) * r["copies"]
        return F.when(r.isNull(), absent.cast("decimal(38,2)")).otherwise(known.cast("decimal(38,2)"))

    # Written out, for a lambda over the array would not be compiled.
    stored = reduce(lambda x, y: (x + y).cast("decimal(38,2)"), map(cost, range(RATES_IN_ROW)))
    sums = (
        dimension_lines(t)
        .join(rates, "site_id", "left")
        .withColumns({"copies": F.coalesce(F.col("copies"), F.lit(1)), "_stored": stored})
        .groupBy(*KPI_KEYS)
        .agg(
            F.countDistinct("product_id").alias("product_count"),
            F.countDistinct("site_id").alias("site_count"),
            weighted_sum(quantity).alias("total_forecast_quantity"),
            weighted_sum(F.col("total_revenue")).alias("total_forecasted_revenue"),
            weighted_sum(F.col("total_cost")).alias("total_forecasted_cost"),
            F.sum("_stored").alias("total_warehousing_cost"),
        )
    )
    return kpi_columns(sums, as_of)


def kpi_columns(sums: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The KPI table's columns from the counts and sums of each scenario."""
    margin = F.col("total_forecasted_revenue") - F.col("total_forecasted_cost")
    return sums.select(
        *KPI_KEYS,
        "product_count",
        "site_count",
        "total_forecast_quantity",
        "total_forecasted_revenue",
        "total_forecasted_cost",
        margin.alias("total_gross_margin"),
        percent_of(margin, F.col("total_forecasted_revenue")).alias("gross_margin_pct"),
        "total_warehousing_cost",
        (margin - F.col("total_warehousing_cost")).alias("net_margin_after_storage"),
        (F.current_timestamp() if as_of is None else as_of)
        .cast("timestamp_ntz")
        .alias("_refreshed_timestamp"),
    )


def production_capacity(t: PlanningTables) -> DataFrame:
    """Daily and monthly output limit of every work center."""
    site = current_rows(t.site).select("site_id", "site_code", "site_name", "region")
    efficiency = F.coalesce(F.col("efficiency_factor"), dec("1.0", "decimal(5,4)"))
    daily = (
        F.col("capacity_per_hour").cast("decimal(14,4)")
        * F.col("hours_per_day").cast("decimal(6,2)")
        * F.col("available_shifts").cast("decimal(4,0)")
        * efficiency
    )
    return (
        current_rows(t.work_center)
        .join(site, "site_id")
        .select(
            "work_center_id",
            "work_center_code",
            "work_center_name",
            "work_center_type",
            "site_id",
            "site_code",
            "site_name",
            "region",
            "capacity_per_hour",
            "hours_per_day",
            "available_shifts",
            "efficiency_factor",
            F.round(daily, 2).alias("max_daily_capacity"),
            F.round(daily * WORKING_DAYS, 2).alias("max_monthly_capacity"),
        )
    )


_ZONE_COLUMNS = (
    "warehouse_zone_id",
    "zone_code",
    "zone_name",
    "zone_type",
    "site_id",
    "site_code",
    "site_name",
    "region",
    "max_capacity_pallets",
    "current_occupancy_pallets",
)
_PENALTY_COLUMNS = ("overflow_penalty_rate", "overflow_penalty_threshold_pct")


def zone_costs(t: PlanningTables, columns: tuple[str, ...]) -> DataFrame:
    """Current zones with their site and their own cost row, if any."""
    site = current_rows(t.site).select("site_id", "site_code", "site_name", "region")
    cost = current_rows(t.logistics_cost_fact).select("warehouse_zone_id", *columns)
    zone = current_rows(t.warehouse_zone).select(*[c for c in _ZONE_COLUMNS if c not in site.columns[1:]])
    return zone.join(site, "site_id").join(cost, "warehouse_zone_id", "left")


def monthly_site_demand(t: PlanningTables) -> DataFrame:
    """Current forecast units per site, scenario and fiscal month."""
    return (
        current_versions(t.demand_forecast_versions)
        .groupBy("site_id", "scenario_id", "fiscal_month", "fiscal_quarter")
        .agg(F.sum("forecast_quantity").alias("units"))
    )


def warehouse_utilization(t: PlanningTables, allocation: str = "full") -> DataFrame:
    """Projected fill and overflow penalty per zone, scenario and month.

    The forecasts are summed to site, scenario and month before they meet the
    zones; equal zone rows and equal scenario rows become a count, so the
    joined rows are already the groups of the result. A zone without demand in
    a scenario keeps one row with a null month.

    ``allocation="full"`` gives every zone the whole demand of its site;
    ``"capacity_share"`` splits it by the zones' capacity.
    """
    if allocation not in ("full", "capacity_share"):
        raise ValueError(f"allocation must be 'full' or 'capacity_share', not {allocation!r}")
    zone_keys = (*_ZONE_COLUMNS, *_PENALTY_COLUMNS)
    zones = (
        zone_costs(t, _PENALTY_COLUMNS).groupBy(*zone_keys).agg(F.count("*").alias("_zones"))
    )
    scenarios = t.scenario_definition.groupBy(
        "scenario_id", "scenario_code", "scenario_name"
    ).agg(F.count("*").alias("_scenarios"))
    if allocation == "capacity_share":
        site_total = F.sum("max_capacity_pallets").over(Window.partitionBy("site_id"))
        zones = zones.withColumn("_site_capacity", F.nullif(site_total, F.lit(0)))

    rows = every_pair(zones, scenarios).join(
        monthly_site_demand(t), ["site_id", "scenario_id"], "left"
    )
    units = F.col("units") * F.col("_zones") * F.col("_scenarios")
    if allocation == "capacity_share":
        # narrow operands leave the quotient twelve digits
        units = (
            units.cast("decimal(20,4)")
            * F.col("max_capacity_pallets").cast("decimal(9,0)")
            / F.col("_site_capacity").cast("decimal(10,0)")
        )
    rows = rows.withColumn("projected_units", units.cast("decimal(28,4)"))

    # Everything below counts tenths of a pallet (units), so no digit is lost.
    capacity = F.col("max_capacity_pallets") * UNITS_PER_PALLET
    filled = F.col("current_occupancy_pallets") * UNITS_PER_PALLET + F.col("projected_units")
    threshold = F.col("overflow_penalty_threshold_pct")
    over = filled * 100 > capacity * threshold
    # (pallets over the threshold) x rate x days, with the percentage multiplied out
    excess = (filled * 100 - capacity * threshold).cast("decimal(28,4)")
    penalty = F.round(
        excess * (F.col("overflow_penalty_rate") * PENALTY_DAYS).cast("decimal(10,4)")
        / (UNITS_PER_PALLET * 100),
        2,
    )
    return rows.select(
        *_ZONE_COLUMNS,
        "scenario_id",
        "scenario_code",
        "scenario_name",
        "fiscal_month",
        "fiscal_quarter",
        "projected_units",
        (F.col("projected_units") / UNITS_PER_PALLET).cast("decimal(30,5)").alias(
            "projected_pallets"
        ),
        percent_of(filled, capacity).alias("projected_utilization_pct"),
        F.coalesce(filled > capacity, F.lit(False)).alias("is_overflow_risk"),
        *_PENALTY_COLUMNS,
        F.when(over & (capacity != 0), penalty)
        .otherwise(F.lit(0))
        .cast("decimal(38,2)")
        .alias("projected_overflow_penalty"),
    )


def inventory_buildup(t: PlanningTables, month_order: str = "lexical") -> DataFrame:
    """Cumulative demand against the demand of the month before, by scenario.

    ``month_order="lexical"`` walks the month names alphabetically, as the
    reference curve does; ``"fiscal"`` walks July to December. The window sees
    one row per scenario and month.
    """
    if month_order == "lexical":
        step = F.col("fiscal_month")
    elif month_order == "fiscal":
        step = fiscal_month_ordinal(F.col("fiscal_month"))
    else:
        raise ValueError(f"month_order must be 'lexical' or 'fiscal', not {month_order!r}")
    keys = ("scenario_id", "scenario_code", "scenario_name", "fiscal_month", "fiscal_quarter")
    periods = (
        current_versions(t.demand_forecast_versions)
        .join(
            t.scenario_definition.select("scenario_id", "scenario_code", "scenario_name"),
            "scenario_id",
        )
        .groupBy(*keys)
        .agg(
            F.sum("forecast_quantity").alias("period_demand"),
            F.sum("total_revenue").alias("period_revenue"),
        )
    )
    along = Window.partitionBy("scenario_id").orderBy(
        step.asc_nulls_last(), F.col("fiscal_quarter").asc_nulls_last()
    )
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    demand = F.col("period_demand")
    position = F.col("cumulative_demand") - F.col("prior_production")
    return (
        periods.withColumn("prior_production", F.lag(demand, 1, 0).over(along))
        .withColumn("cumulative_demand", F.sum(demand).over(so_far))
        .select(
            *keys,
            "period_demand",
            "period_revenue",
            "prior_production",
            "cumulative_demand",
            position.alias("inventory_position"),
            (position * dec(CARRY_COST_PER_UNIT, "decimal(3,2)")).alias("cost_of_carry"),
        )
    )
