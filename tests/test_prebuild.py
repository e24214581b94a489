"""The plan operator against exhaustive search and hand-made cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from granary.operators.prebuild import monthly_grid, prebuild_plan
from granary.plans import build_plan

COLUMNS = (
    "key bigint, period int, demand bigint, capacity bigint, max_inventory bigint, "
    "initial_inventory bigint"
)
PRODUCE, STORE = 100, 22  # cents


def cheapest(demand, capacity, limit, opening):
    """Least total cost in cents over all whole-number plans, or None."""
    costs = {opening: 0}
    for t, need in enumerate(demand):
        safety = demand[t + 1] * 15 // 100 if t + 1 < len(demand) else 0
        after = {}
        for held, spent in costs.items():
            for made in range(capacity + 1):
                left = held + made - need
                if safety <= left <= limit:
                    total = spent + PRODUCE * made + STORE * left
                    if total < after.get(left, 10**9):
                        after[left] = total
        costs = after
    return min(costs.values()) if costs else None


def test_plans_are_optimal(spark):
    rng = random.Random(7)
    cases = []
    for _ in range(400):
        periods = rng.randint(1, 6)
        demand = [rng.randint(0, 14) for _ in range(periods)]
        cases.append((demand, rng.randint(0, 14), rng.randint(0, 20), rng.randint(0, 20)))
    data = [
        (key, t + 1, need, capacity, limit, opening)
        for key, (demand, capacity, limit, opening) in enumerate(cases)
        for t, need in enumerate(demand)
    ]
    plan = prebuild_plan(spark.createDataFrame(data, COLUMNS), ["key"])
    found = {
        r["key"]: (r["status"], r["cost"])
        for r in plan.groupBy("key", "status")
        .agg((F.sum(F.col("production_cost") + F.col("storage_cost")) * 100).alias("cost"))
        .collect()
    }
    feasible = 0
    for key, case in enumerate(cases):
        best = cheapest(*case)
        status, cost = found[key]
        if best is None:
            assert (status, cost) == ("Infeasible", None), case
        else:
            feasible += 1
            assert status == "Optimal" and int(cost) == best, case
    assert 100 < feasible < 380


def test_plan_respects_every_constraint(spark):
    data = [(1, t, d, 10, 30, 4) for t, d in enumerate([2, 3, 8, 14, 15, 9], start=1)]
    rows = prebuild_plan(spark.createDataFrame(data, COLUMNS), ["key"]).orderBy("period").collect()
    held = 4
    for row in rows:
        held += row["production"] - row["demand"]
        assert held == row["ending_inventory"] >= row["safety_stock"]
        assert 0 <= row["production"] <= 10 and held <= 30
    assert [r["safety_stock"] for r in rows] == [0, 1, 2, 2, 1, 0]


def test_stock_above_demand_needs_no_production(spark):
    data = [(1, t, 5, 10, 100, 60) for t in (1, 2, 3)]
    rows = prebuild_plan(spark.createDataFrame(data, COLUMNS), ["key"]).collect()
    assert {r["production"] for r in rows} == {0}
    assert {r["status"] for r in rows} == {"Optimal"}


def test_grid_fills_missing_months(spark):
    df = spark.createDataFrame([(1, 2, 5.9), (1, 2, 1.0), (2, 6, 3.0)], "key int, m int, v double")
    cells = {
        (r["key"], r["period"]): r["demand"]
        for r in monthly_grid(df, ["key"], "m", "v", 6).collect()
    }
    assert len(cells) == 12 and cells[1, 2] == 6 and cells[2, 6] == 3 and cells[1, 1] == 0


def test_one_shuffle_for_grid_and_plan(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame([(1, 2, 5)], "key int, m int, v int")
        grid = monthly_grid(df, ["key"], "m", "v", 6).select(
            "*",
            *[
                F.lit(v).cast("bigint").alias(c)
                for c, v in (("capacity", 9), ("max_inventory", 9), ("initial_inventory", 0))
            ],
        )
        plan = prebuild_plan(grid, ["key"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert "SinglePartition" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_written_plan_replaces_only_its_scenarios(spark, tables, tmp_path):
    from granary.sources.driver_tables import as_of

    scheduled = build_plan.schedule(build_plan.network_plan(tables, ("BASELINE", "Q4_PUSH")))
    rows = build_plan.build_plan_rows(tables, scheduled, as_of())
    path = str(tmp_path / "plan")
    first = build_plan.write_build_plan(rows, path)
    assert first.count() == 12
    again = build_plan.write_build_plan(rows.where("scenario_id = 2"), path)
    ids = {r["plan_id"]: r["scenario_id"] for r in again.collect()}
    assert sorted(ids) == [*range(1, 7), *range(13, 19)]
    row = again.where("scenario_id = 1 AND fiscal_month = 'July'").first()
    assert str(row["production_week"]) == "2024-07-01"
    assert row["model_version"] == "LP_v1.0_20240901"
    assert (row["product_id"], row["work_center_id"]) == (10, 101)
    assert row["projected_total_cost"] == (
        row["projected_production_cost"] + row["projected_storage_cost"]
    )
