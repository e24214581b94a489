"""Marts on the reference's sample master data, checked by hand."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from conftest import COSTS, FORECASTS, SCENARIOS, WORK_CENTERS, ZONES, make_tables, rows
from pyspark.sql import functions as F

from granary.plans import build_plan, capacity, dashboards, mart
from granary.plans.lines import COST_COLUMNS, forecast_lines
from granary.sources.driver_tables import as_of


def test_comparison_repeats_a_forecast_per_zone(tables):
    df = mart.scenario_comparison(tables)
    assert df.columns == list(mart.COMPARISON_COLUMNS) and len(df.columns) == 33
    counts = {r["product_id"] * 100 + r["site_id"]: r["count"] for r in
              df.where("scenario_id = 1").groupBy("product_id", "site_id").count().collect()}
    # five zones at site 5, none at the plant, four at site 3; unknown product 99 is gone
    assert counts == {1005: 5, 5001: 1, 5003: 4}


def test_comparison_values(tables):
    row = (
        mart.scenario_comparison(tables)
        .where("scenario_id = 2 AND fiscal_month = 'October' AND storage_cost_per_pallet_per_day = 3.75")
        .first()
    )
    assert row["total_cost"] == D("234000")
    assert row["gross_margin"] == D("155987")
    assert row["projected_warehousing_cost"] == D("14625.00")
    assert row["product_family"] == "Televisions"
    plant = mart.scenario_comparison(tables).where("site_id = 1").first()
    assert plant["projected_warehousing_cost"] is None


def test_comparison_site_average(tables):
    df = mart.scenario_comparison(tables, cost_grain="site_avg", family_level=2)
    october = df.where("scenario_id = 2 AND fiscal_month = 'October'").collect()
    assert len(october) == 1
    assert october[0]["storage_cost_per_pallet_per_day"] == D("2.65")
    assert october[0]["projected_warehousing_cost"] == D("10335.00")
    assert october[0]["product_family"] == "Electronics"


def test_family_level_one_is_the_root(tables):
    df = mart.scenario_comparison(tables, family_level=1)
    assert {r[0] for r in df.select("product_family").distinct().collect()} == {"All Products"}


def test_bad_options_raise(tables):
    for call in (
        lambda: mart.scenario_comparison(tables, cost_grain="row"),
        lambda: mart.warehouse_utilization(tables, allocation="half"),
        lambda: mart.inventory_buildup(tables, month_order="random"),
    ):
        with pytest.raises(ValueError):
            call()


def test_weighted_lines_equal_the_view(tables):
    view = mart.scenario_comparison(tables).agg(
        F.sum("forecast_quantity"), F.sum("total_revenue"), F.count("*")
    ).first()
    for columns in ((), COST_COLUMNS):
        lines = forecast_lines(tables, columns).agg(
            F.sum(F.col("forecast_quantity") * F.col("copies")),
            F.sum(F.col("total_revenue") * F.col("copies")),
            F.sum("copies"),
        ).first()
        assert tuple(lines) == tuple(view)


def test_kpis(tables):
    row = mart.scenario_kpis(tables).where("scenario_id = 1").first()
    assert (row["product_count"], row["site_count"]) == (2, 3)
    assert row["total_forecast_quantity"] == D("5622")
    revenue = 5 * D("299990") + D("19996") + 4 * D("2774.45")
    cost = 5 * D("180000") + D("10000") + 4 * D("1387.5")
    assert row["total_forecasted_revenue"] == revenue
    assert row["total_gross_margin"] == revenue - cost
    # 1000 units at five rates, 400 at the default rate, 55.5 at four rates
    storage = D("39750") + D("600") + D("333") + D("333") + D("499.5") + D("266.4")
    assert row["total_warehousing_cost"] == storage
    assert row["net_margin_after_storage"] == revenue - cost - storage
    assert mart.scenario_kpis(tables).count() == 2


def test_kpi_margin_of_zero_revenue_is_null(spark):
    free = [{**FORECASTS[0], "total_revenue": "0", "unit_revenue": "0"}]
    row = mart.scenario_kpis(make_tables(spark, demand_forecast_versions=free)).first()
    assert row["gross_margin_pct"] is None and row["total_gross_margin"] == D("-900000")


def test_production_capacity_declared_scale(tables):
    total = capacity.total_capacity(tables).first()
    assert tuple(total) == (D("87779.20"), D("1931142.40"))


def test_production_capacity_whole_numbers(spark):
    whole = [{**w, "efficiency_factor": "1"} for w in WORK_CENTERS]
    total = capacity.total_capacity(make_tables(spark, work_center=whole)).first()
    assert tuple(total) == (D("94640.00"), D("2082080.00"))


def test_missing_efficiency_counts_as_one(spark):
    one = [{**WORK_CENTERS[0], "efficiency_factor": None}]
    row = mart.production_capacity(make_tables(spark, work_center=one)).first()
    assert row["max_daily_capacity"] == D("4800.00") and row["efficiency_factor"] is None


def test_zone_status_and_overview(tables):
    pct = {
        (r["site_name"].split()[0], r["zone_name"]): (r["utilization_pct"], r["band"])
        for r in capacity.zone_status(tables).collect()
    }
    assert pct["Western", "Staging Area"] == (D("52.5"), "ok")
    assert pct["Northeast", "General Storage A"] == (D("90.0"), "danger")
    assert pct["Northeast", "Overflow Area"] == (D("80.0"), "warning")
    assert capacity.zones_at_risk(tables).count() == 5
    row = capacity.capacity_overview(tables).first()
    assert row["sites_at_risk"] == 2
    assert (row["total_capacity_pallets"], row["occupied_pallets"]) == (75000, 54200)


def test_plan_limits(tables):
    assert tuple(build_plan.plan_limits(tables).first()) == (1931142, 652500, 542000)


def test_utilization_uses_whole_site_demand(tables):
    df = mart.warehouse_utilization(tables)
    row = df.where("warehouse_zone_id = 501 AND scenario_id = 1").first()
    # the unknown product counts here: this mart never joins products
    assert row["projected_units"] == D("1005")
    assert row["projected_utilization_pct"] == D("91.68")
    assert row["is_overflow_risk"] is False
    # (5400 + 100.5 - 5100) pallets x 5.0 x 30 days
    assert row["projected_overflow_penalty"] == D("60075.00")


def test_utilization_keeps_zones_without_demand(tables):
    df = mart.warehouse_utilization(tables)
    idle = df.where("warehouse_zone_id = 401").collect()
    assert len(idle) == 3
    for row in idle:
        assert row["fiscal_month"] is None and row["projected_units"] is None
        assert row["projected_utilization_pct"] is None
        assert row["is_overflow_risk"] is False
        assert row["projected_overflow_penalty"] == 0


def test_utilization_capacity_share(tables):
    df = mart.warehouse_utilization(tables, allocation="capacity_share")
    shares = df.where("site_id = 5 AND scenario_id = 1").agg(F.sum("projected_units")).first()[0]
    assert shares == D("1005")


def test_utilization_zero_capacity(spark):
    zones = [{**ZONES[9], "max_capacity_pallets": "0"}]
    row = mart.warehouse_utilization(make_tables(spark, warehouse_zone=zones)).where(
        "scenario_id = 1"
    ).first()
    assert row["projected_utilization_pct"] is None
    assert row["is_overflow_risk"] is True and row["projected_overflow_penalty"] == 0


def test_utilization_of_doubled_rows_doubles(spark, tables):
    twice = make_tables(spark, logistics_cost_fact=COSTS * 2, scenario_definition=SCENARIOS * 2)
    row = mart.warehouse_utilization(twice).where(
        "warehouse_zone_id = 501 AND scenario_id = 1"
    ).collect()
    assert len(row) == 1 and row[0]["projected_units"] == D("4020")


def test_buildup_orders(spark):
    months = rows(
        "demand_forecast_id,scenario_id,forecast_quantity,total_revenue,fiscal_month,fiscal_quarter",
        """1,1,10,1,July,Q3
        2,1,20,1,August,Q3
        3,1,30,1,December,Q4""",
    )
    t = make_tables(spark, demand_forecast_versions=months)

    def curve(order):
        return {
            r["fiscal_month"]: (int(r["prior_production"]), int(r["cumulative_demand"]))
            for r in mart.inventory_buildup(t, order).collect()
        }

    assert curve("lexical") == {"August": (0, 20), "December": (20, 50), "July": (30, 60)}
    assert curve("fiscal") == {"July": (0, 10), "August": (10, 30), "December": (20, 60)}
    december = mart.inventory_buildup(t).where("fiscal_month = 'December'").first()
    assert december["inventory_position"] == 30 and december["cost_of_carry"] == 15


def test_warehouse_cost_overflow(tables):
    row = dashboards.warehouse_cost(tables, site_capacity=1000).where(
        "scenario_code = 'Q4_PUSH'"
    ).first()
    # five zones: demand (1300 + 7) x 5 against 85 % of 1000
    assert row["demand"] == D("6535")
    assert row["capacity_threshold"] == 85.0
    assert row["overflow_cost"] == round((6535 - 850) / 10 * 5 * 30, 2)
    below = dashboards.warehouse_cost(tables).where("scenario_code = 'Q4_PUSH'").first()
    assert below["overflow_cost"] == 0.0


def test_headline_and_verdict(tables):
    row = dashboards.headline_kpis(tables, site_capacity=1000).first()
    assert row["base_demand"] == 5622.0 and row["other_demand"] == 6535.0
    assert row["demand_delta_pct"] == 16.24 and row["cost_alert"] is True
    verdict = dashboards.cost_verdict(mart.scenario_kpis(tables)).first()
    assert verdict["verdict"] == "HIGHER"
    same = dashboards.cost_verdict(mart.scenario_kpis(tables), "Q4_PUSH", "Q4_PUSH").first()
    assert same["verdict"] == "LOWER"


def test_headline_without_the_scenarios(spark):
    t = make_tables(spark, demand_forecast_versions=[])
    row = dashboards.headline_kpis(t).first()
    assert row["base_demand"] == 0.0 and row["cost_delta_pct"] == 0.0
    assert dashboards.planning_stats(t).first()["total_forecast"] is None
    assert mart.scenario_kpis(t).count() == 0


def test_report_order_puts_nulls_last(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "x string")
    assert [r[0] for r in dashboards.in_report_order(df, "x").collect()] == ["a", "b", None]


def test_kpis_read_the_forecasts_once(spark, tmp_path, tables):
    path = str(tmp_path / "forecasts")
    tables.demand_forecast_versions.write.parquet(path)
    stored = tables.with_(demand_forecast_versions=spark.read.parquet(path))
    plan = mart.scenario_kpis(stored, as_of=as_of())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
