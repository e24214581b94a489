"""From the marts to a stored production plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.constants import (
    FISCAL_MONTHS,
    MODEL_CONFIDENCE,
    MODEL_NAME,
    OVERFLOW_THRESHOLD,
    PLAN_YEAR,
    UNITS_PER_PALLET,
)
from granary.functions.calendar import (
    first_of_month,
    fiscal_month_name,
    fiscal_month_ordinal,
    fiscal_quarter,
)
from granary.functions.numbers import dec, percent_of
from granary.operators.current import current_rows
from granary.operators.keys import dense_ids
from granary.operators.prebuild import OPTIMAL, monthly_grid, prebuild_plan
from granary.plans.capacity import total_capacity, warehouse_totals
from granary.plans.lines import forecast_lines
from granary.plans.mart import production_capacity
from granary.schemas import BUILD_PLAN, struct_of
from granary.sources.tables import PlanningTables


def _units(pallets: Column) -> Column:
    return (pallets * UNITS_PER_PALLET).cast("bigint")


def _safe_units(pallets: Column) -> Column:
    return F.floor(_units(pallets) * dec(OVERFLOW_THRESHOLD, "decimal(9,4)")).cast("bigint")


def plan_demand(
    t: PlanningTables,
    keys: Sequence[str],
    scenarios: Sequence[str],
    cost_grain: str = "zone",
) -> DataFrame:
    """Whole units per key and fiscal month, zero where nothing is forecast."""
    lines = (
        forecast_lines(t, cost_grain=cost_grain)
        .where(F.col("scenario_code").isin(*scenarios))
        .withColumn("_units", F.col("forecast_quantity") * F.col("copies"))
        .withColumn("_month", fiscal_month_ordinal(F.col("fiscal_month")))
    )
    return monthly_grid(lines, keys, "_month", "_units", len(FISCAL_MONTHS))


def plan_limits(t: PlanningTables) -> DataFrame:
    """One row: monthly capacity, storage limit and opening stock of the network."""
    stock = warehouse_totals(t)
    return stock.select(
        total_capacity(t)
        .select(F.col("monthly_capacity").cast("bigint"))
        .scalar()
        .alias("capacity"),
        _safe_units(F.col("total_capacity_pallets")).alias("max_inventory"),
        _units(F.col("current_occupancy_pallets")).alias("initial_inventory"),
    )


def site_limits(t: PlanningTables) -> DataFrame:
    """Monthly capacity, storage limit and opening stock of every site."""
    made = production_capacity(t).groupBy("site_id").agg(
        F.sum("max_monthly_capacity").cast("bigint").alias("capacity")
    )
    zones = current_rows(t.warehouse_zone).groupBy("site_id").agg(
        F.sum("max_capacity_pallets").alias("_most"),
        F.sum("current_occupancy_pallets").alias("_held"),
    )
    none = F.lit(0).cast("bigint")
    return (
        current_rows(t.site)
        .select("site_id")
        .join(made, "site_id", "left")
        .join(zones, "site_id", "left")
        .select(
            "site_id",
            F.coalesce("capacity", none).alias("capacity"),
            F.coalesce(_safe_units(F.col("_most")), none).alias("max_inventory"),
            F.coalesce(_units(F.col("_held")), none).alias("initial_inventory"),
        )
    )


def network_plan(
    t: PlanningTables, scenarios: Sequence[str], cost_grain: str = "zone", **costs: str
) -> DataFrame:
    """One plan per scenario for the whole network, as the reference solves it."""
    keys = ("scenario_id", "scenario_code")
    limit = plan_limits(t)
    demand = plan_demand(t, keys, scenarios, cost_grain).select(
        "*",
        *[
            limit.select(c).scalar().alias(c)
            for c in ("capacity", "max_inventory", "initial_inventory")
        ],
    )
    return prebuild_plan(demand, keys, **costs)


def site_plans(
    t: PlanningTables, scenarios: Sequence[str], cost_grain: str = "zone", **costs: str
) -> DataFrame:
    """One plan per scenario and site, each under the site's own limits."""
    keys = ("scenario_id", "scenario_code", "site_id")
    demand = plan_demand(t, keys, scenarios, cost_grain).join(site_limits(t), "site_id")
    return prebuild_plan(demand, keys, **costs)


def product_plans(
    t: PlanningTables, scenarios: Sequence[str], cost_grain: str = "zone", **costs: str
) -> DataFrame:
    """One plan per scenario and product, with limits set by its own demand.

    A product may be made at 110 % of its mean monthly demand, stored up to
    twice that mean, and starts with half a month in stock.
    """
    keys = ("scenario_id", "scenario_code", "product_id")
    grid = plan_demand(t, keys, scenarios, cost_grain)
    total = F.sum("demand").over(Window.partitionBy(*keys))
    months = len(FISCAL_MONTHS)
    limited = grid.withColumns(
        {
            "capacity": F.floor(total * 11 / (10 * months)).cast("bigint"),
            "max_inventory": F.floor(total * 2 / months).cast("bigint"),
            "initial_inventory": F.floor(total / (2 * months)).cast("bigint"),
        }
    )
    return prebuild_plan(limited, keys, **costs)


def schedule(plan: DataFrame) -> DataFrame:
    """The feasible plans with month names, utilisation and running cost."""
    keys = [c for c in plan.columns if c.endswith("_id") or c == "scenario_code"]
    along = (
        Window.partitionBy(*keys)
        .orderBy("period")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    spent = F.col("production_cost") + F.col("storage_cost")

    def share(part: str, whole: str) -> Column:
        used = percent_of(F.col(part), F.col(whole), 1)
        return F.coalesce(used, F.lit(0)).cast("decimal(18,1)")

    return plan.where(F.col("status") == OPTIMAL).select(
        *keys,
        "period",
        fiscal_month_name(F.col("period")).alias("fiscal_month"),
        fiscal_quarter(F.col("period")).alias("fiscal_quarter"),
        "demand",
        F.col("production").alias("recommended_production"),
        "ending_inventory",
        "capacity",
        share("production", "capacity").alias("capacity_utilization_pct"),
        share("ending_inventory", "max_inventory").alias("warehouse_utilization_pct"),
        "production_cost",
        "storage_cost",
        F.sum(spent).over(along).alias("cumulative_cost"),
    )


def plan_summary(scheduled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals and peaks of every plan; the earliest month wins a tie."""

    def first_peak(value: str) -> Column:
        best = F.max_by("fiscal_month", F.struct(F.col(value), -F.col("period")))
        return best

    return scheduled.groupBy(*keys).agg(
        F.sum(F.col("production_cost") + F.col("storage_cost")).alias("total_cost"),
        F.max("ending_inventory").alias("peak_inventory"),
        F.round(F.avg(F.col("capacity_utilization_pct").cast("double")), 4).alias(
            "mean_capacity_utilization_pct"
        ),
        first_peak("recommended_production").alias("peak_production_month"),
        first_peak("ending_inventory").alias("peak_inventory_month"),
        (F.max("warehouse_utilization_pct") < 100).alias("overflow_avoided"),
    )


def build_plan_rows(
    t: PlanningTables, scheduled: DataFrame, as_of: Column, year: int = PLAN_YEAR
) -> DataFrame:
    """The schedule as rows of the build-plan table, without plan ids.

    A product or work center that the schedule has is kept. Where it has none,
    the plan covers the whole network and the lowest current id stands in.
    """
    stand_ins = {
        "product_id": current_rows(t.product).agg(F.min("product_id")).scalar(),
        "work_center_id": current_rows(t.work_center).agg(F.min("work_center_id")).scalar(),
    }
    version = F.concat(F.lit(f"{MODEL_NAME}_"), F.date_format(as_of, "yyyyMMdd"))
    values = {
        **{k: v for k, v in stand_ins.items() if k not in scheduled.columns},
        "production_week": first_of_month(year, F.col("period")),
        "recommended_quantity": F.col("recommended_production"),
        "current_capacity_available": F.col("capacity"),
        "projected_inventory": F.col("ending_inventory"),
        "projected_production_cost": F.col("production_cost"),
        "projected_storage_cost": F.col("storage_cost"),
        "projected_total_cost": F.col("production_cost") + F.col("storage_cost"),
        "model_version": version,
        "model_confidence": dec(MODEL_CONFIDENCE),
        "created_timestamp": as_of,
    }
    return scheduled.select(
        *[
            values.get(n, F.col(n) if n in scheduled.columns else F.lit(None)).cast(kind).alias(n)
            for n, kind in BUILD_PLAN.items()
            if n != "plan_id"
        ]
    )


def _last_plan_id(spark: SparkSession, path: str) -> int:
    """Highest plan id stored so far, 0 when there is no table yet."""
    try:
        return read_build_plan(spark, path).agg(F.coalesce(F.max("plan_id"), F.lit(0))).first()[0]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return 0
        raise


def write_build_plan(
    rows: DataFrame, path: str, scenarios: DataFrame | None = None
) -> DataFrame:
    """Replace the plans of the asked scenarios and return the stored table.

    ``scenarios`` names them in ``scenario_id``; without it they are those of
    ``rows``. The table is partitioned by scenario and only their partitions are
    overwritten, which is the delete-then-insert of the reference without touching
    others. An asked scenario without rows, as after an infeasible plan, gets a
    marker row that readers skip, so its old plan goes. Ids follow all columns,
    so they are the same in every run. A scenario that holds another number of
    rows than was written raises.
    """
    spark = rows.sparkSession
    order = [n for n in ("scenario_id", "production_week", "product_id") if n in rows.columns]
    order += [n for n in BUILD_PLAN if n not in (*order, "plan_id")]
    numbered = dense_ids(rows, order, "plan_id", _last_plan_id(spark, path)).select(*BUILD_PLAN)
    placed = numbered
    if scenarios is not None:
        missing = scenarios.select(F.col("scenario_id").cast("bigint")).distinct().join(
            numbered.select("scenario_id").distinct(), "scenario_id", "left_anti"
        )
        placed = numbered.unionByName(missing, allowMissingColumns=True)
    (
        placed.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("scenario_id")
        .parquet(path)
    )
    stored = read_build_plan(spark, path)
    written = numbered.groupBy("scenario_id").agg(F.count("*").alias("written"))
    found = stored.groupBy("scenario_id").agg(F.count("*").alias("found"))
    lost = written.join(found, "scenario_id", "left").where("found IS NULL OR found <> written")
    if not lost.isEmpty():
        raise RuntimeError(f"plan rows written and found differ: {lost.first()}")
    return stored


def read_build_plan(spark: SparkSession, path: str) -> DataFrame:
    """The stored build-plan table."""
    stored = spark.read.schema(struct_of(BUILD_PLAN)).parquet(path)
    return stored.select(*BUILD_PLAN).where(F.col("plan_id").isNotNull())


