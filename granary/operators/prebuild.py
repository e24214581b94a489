"""Least-cost pre-build production plans for many key groups at once.

Per group and period: produce P in 0..capacity and end with inventory I in
0..limit, where I = previous I + P - demand and I covers the safety stock, a
share of the next period's demand. With unit costs that do not change over time
every plan that keeps inventory as low as possible is optimal, and the lowest
feasible inventory follows from running sums and maxima:

* a period must hold enough for its own safety stock and for later periods whose
  demand exceeds capacity (a running maximum from the end);
* it cannot hold less than what earlier requirements, or the opening stock,
  leave over (a running maximum from the start).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.constants import PRODUCTION_COST, SAFETY_RATIO, STORAGE_COST
from granary.functions.numbers import dec

OPTIMAL, INFEASIBLE = "Optimal", "Infeasible"


def monthly_grid(
    demand: DataFrame, keys: Sequence[str], ordinal: str, value: str, periods: int
) -> DataFrame:
    """One row per key and period, with 0 where a period has no demand.

    The periods become columns of one aggregate and rows again afterwards, so
    filling the gaps costs no join and keeps the partitioning by key.
    """
    cells = [
        F.coalesce(F.sum(F.when(F.col(ordinal) == p, F.col(value))), F.lit(0))
        .cast("bigint")
        .alias(f"_p{p}")
        for p in range(1, periods + 1)
    ]
    grid = F.array(
        *[
            F.struct(F.lit(p).alias("period"), F.col(f"_p{p}").alias("demand"))
            for p in range(1, periods + 1)
        ]
    )
    return (
        demand.groupBy(*keys)
        .agg(*cells)
        .select(*keys, F.explode(grid).alias("_cell"))
        .select(*keys, "_cell.*")
    )


def prebuild_plan(
    demand: DataFrame,
    keys: Sequence[str],
    production_cost: str = PRODUCTION_COST,
    storage_cost: str = STORAGE_COST,
    safety_ratio: str = SAFETY_RATIO,
) -> DataFrame:
    """The optimal plan of every key group.

    ``demand`` has one row per key and period with whole-number ``demand``,
    ``capacity``, ``max_inventory`` and ``initial_inventory``. All windows share
    the key partitioning, so the input is shuffled at most once. Groups without
    a feasible plan keep their rows with status ``Infeasible`` and null results.
    """
    period = Window.partitionBy(*keys).orderBy("period")
    so_far = period.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    still_to_come = period.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    group = Window.partitionBy(*keys)
    need = F.col("demand")

    safety = F.floor(F.lead(need).over(period) * dec(safety_ratio, "decimal(9,4)"))
    planned = (
        demand.withColumn("safety_stock", F.coalesce(safety.cast("bigint"), F.lit(0)))
        .withColumn("_sold", F.sum(need).over(so_far))
        .withColumn("_short", F.sum(need - F.col("capacity")).over(so_far))
        .withColumn(
            "_floor",
            F.max(F.col("safety_stock") + F.col("_short")).over(still_to_come) - F.col("_short"),
        )
        .withColumn(
            "ending_inventory",
            F.greatest(F.col("initial_inventory"), F.max(F.col("_floor") + F.col("_sold")).over(so_far))
            - F.col("_sold"),
        )
        .withColumn(
            "production",
            F.col("ending_inventory")
            - F.coalesce(F.lag("ending_inventory").over(period), F.col("initial_inventory"))
            + need,
        )
    )
    fits = (
        F.col("production").between(0, F.col("capacity"))
        & (F.col("ending_inventory") >= F.col("safety_stock"))
        & F.col("ending_inventory").between(0, F.col("max_inventory"))
    )
    ok = F.min(fits).over(group)
    made = F.when(ok, F.col("production"))
    held = F.when(ok, F.col("ending_inventory"))
    unit_cost, unit_storage = dec(production_cost, "decimal(9,4)"), dec(storage_cost, "decimal(9,4)")
    return planned.select(
        *keys,
        "period",
        "demand",
        "capacity",
        "max_inventory",
        "initial_inventory",
        "safety_stock",
        F.when(ok, OPTIMAL).otherwise(INFEASIBLE).alias("status"),
        made.alias("production"),
        held.alias("ending_inventory"),
        F.round(made * unit_cost, 2).cast("decimal(18,2)").alias("production_cost"),
        F.round(held * unit_storage, 2).cast("decimal(18,2)").alias("storage_cost"),
    )
