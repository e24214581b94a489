"""Versions, copies, adjustments, slowly changing rows, surrogate keys."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal as D

import pytest
from py4j.protocol import Py4JJavaError
from conftest import PRODUCTS, SCENARIOS, make_tables, table
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granary.operators.current import current_rows, current_versions, scd2_upsert
from granary.operators.keys import dense_ids, next_id
from granary.operators.pairs import every_pair
from granary.plans import writeback
from granary.sources.driver_tables import as_of

PAYLOAD = json.dumps(
    [
        {
            "PRODUCT_ID": 50,
            "SITE_ID": 3,
            "FORECAST_DATE": "2024-11-01",
            "FORECAST_QUANTITY": 10.5,
            "UNIT_REVENUE": 2.25,
            "FISCAL_MONTH": "November",
            "CONFIDENCE_LEVEL": "0.85",
            "FORECAST_TYPE": None,
        },
        {"PRODUCT_ID": "10", "SITE_ID": 5, "FORECAST_QUANTITY": 4, "FORECAST_METHOD": "GUESS"},
    ]
)


def parsed(spark, text):
    return writeback.parse_updates(spark.createDataFrame([(text,)], "payload string"))


def test_parse_updates(spark):
    first, second = parsed(spark, PAYLOAD).orderBy("product_id", ascending=False).collect()
    assert first["forecast_quantity"] == D("10.5") and first["confidence_level"] == D("0.85")
    assert first["forecast_date"] == dt.date(2024, 11, 1) and first["forecast_type"] is None
    assert second["product_id"] == 10 and second["unit_revenue"] is None
    for bad in ('[{"PRODUCT_ID": "ten"}]', "[{"):
        with pytest.raises((PySparkException, Py4JJavaError)):
            parsed(spark, bad).collect()


@pytest.mark.parametrize(("numeric", "revenue"), [("scale0", D("24.75")), ("declared", D("23.63"))])
def test_submit_version(spark, tables, numeric, revenue):
    before = tables.demand_forecast_versions
    change = writeback.submit_forecast_version(
        before, parsed(spark, PAYLOAD), 2, "ana", as_of(), numeric
    )
    after = change.forecasts
    assert after.columns == before.columns
    assert after.count() == before.count() + 2
    assert after.select("demand_forecast_id").distinct().count() == after.count()
    live = {r["demand_forecast_id"]: r for r in
            current_versions(after).where("scenario_id = 2").collect()}
    assert sorted(live) == [8, 9]
    # ids follow product order; defaults fill what the payload leaves out
    assert live[8]["product_id"] == 10 and live[8]["forecast_method"] == "GUESS"
    assert live[9]["forecast_type"] == "DEMAND"
    assert live[9]["forecast_method"] == "MANUAL_ADJUSTMENT"
    assert live[9]["total_revenue"] == revenue
    assert live[9]["forecast_creation_date"] == dt.date(2024, 9, 1)
    retired = after.where("scenario_id = 2 AND NOT is_current_version")
    assert retired.count() == 3
    assert retired.where("updated_by_user = 'ana'").count() == 2
    untouched = after.where("scenario_id = 1").exceptAll(before.where("scenario_id = 1"))
    assert untouched.isEmpty()
    receipt = json.loads(writeback.receipt_json(change.receipt).first()[0])
    assert receipt["rows_superseded"] == 2 and receipt["rows_inserted"] == 2
    assert receipt["scenario_id"] == 2 and receipt["submitted_by"] == "ana"
    with pytest.raises(ValueError):
        writeback.submit_forecast_version(before, before, 2, "ana", as_of(), "scale2")


def test_copy_full(spark, tables):
    copy = writeback.create_scenario_copy(
        tables.scenario_definition, tables.demand_forecast_versions, 2, "NEW", "New", "ana", as_of()
    )
    made = copy.scenarios.where("scenario_id = 4").first()
    assert made["scenario_description"] == "Copy of Q4 Marketing Push"
    assert (made["parent_scenario_id"], made["version_number"]) == (2, 1)
    assert made["scenario_type"] == "CUSTOM" and made["is_official_baseline"] is False
    rows = copy.forecasts.where("scenario_id = 4").orderBy("demand_forecast_id").collect()
    assert [r["demand_forecast_id"] for r in rows] == [8, 9]
    assert [r["forecast_quantity"] for r in rows] == [D("1300"), D("7")]
    assert rows[0]["fiscal_month"] == "October" and rows[0]["total_revenue"] == D("389987")
    assert copy.receipt.first()["forecasts_copied"] == 2


def test_copy_minimal(tables):
    copy = writeback.create_scenario_copy(
        tables.scenario_definition,
        tables.demand_forecast_versions,
        1,
        "NEW",
        "New",
        "ana",
        as_of(),
        "mine",
        mode="ui_minimal",
    )
    made = copy.scenarios.where("scenario_id = 4").first()
    assert made["parent_scenario_id"] is None and made["scenario_description"] == "mine"
    rows = copy.forecasts.where("scenario_id = 4").collect()
    assert len(rows) == 4
    for row in rows:
        assert row["forecast_type"] == "Copied" and row["fiscal_month"] is None
        assert row["total_revenue"] is None and row["is_current_version"] is True


def test_copy_of_missing_source_adds_nothing(tables):
    copy = writeback.create_scenario_copy(
        tables.scenario_definition, tables.demand_forecast_versions, 77, "N", "n", "ana", as_of()
    )
    assert copy.scenarios.count() == 3
    assert copy.forecasts.count() == tables.demand_forecast_versions.count()
    with pytest.raises(ValueError):
        writeback.create_scenario_copy(
            tables.scenario_definition, tables.demand_forecast_versions, 1, "N", "n", "a", as_of(),
            mode="deep",
        )


def _changed(tables, **options):
    after = writeback.adjust_forecast(tables, 2, "ana", as_of(), **options)
    return {
        r["demand_forecast_id"]: (r["forecast_quantity"], r["total_revenue"], r["updated_by_user"])
        for r in after.where("scenario_id = 2").collect()
    }


def test_adjustments(tables):
    by_pct = _changed(tables, pct=5)
    assert by_pct[2] == (D("1365"), D("389987.00"), "ana")
    assert by_pct[5] == (D("7.35"), D("2099.93"), "ana")
    assert by_pct[6] == (D("9999"), D("1.00"), None)
    quarter = _changed(tables, units=100, quarter="Q4", recompute_revenue=True)
    assert quarter[2] == (D("1400"), D("419986.00"), "ana")
    assert quarter[5] == (D("7"), D("2099.93"), None)
    family = _changed(tables, pct=100, category="Audio Systems")
    assert family[2][0] == D("1300")
    there = _changed(tables, pct=100, category="Televisions", site_id=5)
    assert there[2][0] == D("2600")
    assert _changed(tables, pct=100, site_id=4)[2][0] == D("1300")


def test_adjustment_limits(tables):
    for options in ({}, {"pct": 1, "units": 1}, {"pct": -51}, {"pct": 101}, {"units": 10001}):
        with pytest.raises(ValueError):
            writeback.adjust_forecast(tables, 2, "ana", as_of(), **options)
    with pytest.raises(ValueError, match="read-only"):
        writeback.adjust_forecast(tables, 1, "ana", as_of(), pct=5)


def test_preview_follows_the_view(tables):
    rows = {r["fiscal_quarter"]: r for r in
            writeback.preview_adjustment(tables, 2, units=100).collect()}
    # one forecast per quarter, five zones each; the units are added once
    assert rows["Q4"]["affected_rows"] == 5
    assert rows["Q4"]["projected_total"] == D("6600")
    per_row = writeback.preview_adjustment(tables, 2, units=100, quarter="Q4", per_row=True).first()
    assert per_row["projected_total"] == D("7000")
    totals = writeback.preview_totals(writeback.preview_adjustment(tables, 2, pct=15)).first()
    assert totals["change_pct"] == 15.0
    none = writeback.preview_totals(writeback.preview_adjustment(tables, 3, pct=15)).first()
    assert none["change_pct"] == 0.0


def test_scd2_upsert(spark, tables):
    changes = table(
        spark,
        "product",
        [
            {**PRODUCTS[0], "unit_cost": "200"},
            PRODUCTS[1],
            {"product_id": "60", "product_code": "NEW"},
        ],
    ).drop("is_current_flag")
    merged = scd2_upsert(tables.product, changes, ["product_id"], as_of(), "ana")
    assert merged.columns == tables.product.columns
    rows = {(r["product_id"], r["is_current_flag"]): r for r in merged.collect()}
    assert sorted(rows) == [(10, False), (10, True), (50, True), (60, True)]
    assert rows[10, False]["unit_cost"] == D("180")
    assert rows[10, False]["valid_to_timestamp"] == dt.datetime(2024, 9, 1)
    assert rows[10, True]["unit_cost"] == D("200") and rows[10, True]["created_by_user"] == "ana"
    assert rows[50, True]["updated_by_user"] is None
    again = scd2_upsert(merged, changes, ["product_id"], as_of(), "ana")
    assert again.exceptAll(merged).isEmpty() and again.count() == 4
    assert current_rows(again).count() == 3


def test_scd2_takes_one_change_per_key(spark, tables):
    two = [{**PRODUCTS[0], "unit_cost": "200"}, {**PRODUCTS[0], "unit_cost": "210"}]
    changes = table(spark, "product", two).drop("is_current_flag")
    with pytest.raises((PySparkException, Py4JJavaError)):
        scd2_upsert(tables.product, changes, ["product_id"], as_of()).collect()
    dated = changes.withColumn("sent", -F.col("unit_cost"))
    merged = scd2_upsert(tables.product, dated, ["product_id"], as_of(), latest_by=["sent"])
    costs = {r["is_current_flag"]: r["unit_cost"] for r in merged.where("product_id = 10").collect()}
    assert costs == {False: D("180"), True: D("200")} and merged.count() == 3


def test_null_elements_are_rows_of_nulls(spark):
    found = parsed(spark, '[null, {"PRODUCT_ID": 1}]').collect()
    assert sorted((r["product_id"] is None, r["site_id"]) for r in found) == [(False, None), (True, None)]
    assert parsed(spark, "[]").isEmpty() and parsed(spark, None).isEmpty()


def test_scd2_null_to_value_is_a_change(spark):
    target = table(spark, "site", [{"site_id": "1", "site_name": "a"}])
    changes = table(spark, "site", [{"site_id": "1", "site_name": "a", "region": "West"}])
    assert scd2_upsert(target, changes, ["site_id"], as_of()).count() == 2


def test_dense_ids_with_a_hot_key(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("product"),
        F.col("id").alias("line"),
    )
    numbered = dense_ids(df, ("product", "line"), "key", 100).orderBy("product", "line").collect()
    assert [r["key"] for r in numbered] == list(range(101, 20_101))


def test_dense_ids_store_keys_alone_and_come_again(spark):
    df = spark.range(3000).selectExpr(
        "id % 700 AS a", "IF(id % 5 = 0, NULL, id % 3) AS b", "id AS line", "repeat('wide', 50) AS text"
    ).repartition(7)
    numbered = dense_ids(df, ("a", "b"), "key", 10, "keys")
    rows = [(r.key, r.a, r.b, r.line) for r in numbered.select("key", "a", "b", "line").collect()]
    assert sorted(k for k, *_ in rows) == list(range(11, 3011))
    order = [(a, b is not None, b or 0) for _, a, b, _ in sorted(rows)]
    assert order == sorted(order)
    # Any task may run again: a part of the result has the numbers of the whole.
    part = numbered.where("a = 123").select("key", "a", "b", "line").collect()
    assert {tuple(r) for r in part} == {r for r in rows if r[1] == 123}
    kept = [line for line in numbered._jdf.queryExecution().analyzed().toString().splitlines() if "LogicalRDD" in line]
    assert kept and not any("text" in line for line in kept)


def test_dense_ids_of_nothing(spark):
    for store in ("rows", "keys"):
        assert dense_ids(spark.range(0), ("id",), "key", 0, store).count() == 0
    empty = spark.range(0)
    assert spark.range(1).select(next_id(empty, "id")).first()[0] == 0


def test_every_pair(spark):
    left = spark.range(50).withColumnRenamed("id", "a")
    right = spark.range(4).withColumnRenamed("id", "b")
    pairs = every_pair(left, right)
    assert pairs.count() == 200 == pairs.distinct().count()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert every_pair(left, right.where("b > 9")).count() == 0


def test_new_scenario_ids_grow(spark):
    t = make_tables(spark, scenario_definition=SCENARIOS[:1])
    copy = writeback.create_scenario_copy(
        t.scenario_definition, t.demand_forecast_versions, 1, "N", "n", "ana", as_of()
    )
    assert copy.receipt.first()["new_scenario_id"] == 2
