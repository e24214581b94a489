"""Work that is spread over tasks by the size of its input."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from conftest import SF_DIR, table

from granary import registry
from granary.constants import DEFAULT_STORAGE_RATE
from granary.functions.numbers import dec, storage_cost
from granary.plans import mart, quality
from granary.sources import driver_tables as driver
from granary.sources import raw_csv
from granary.sources.tables import PlanningTables


def test_arriving_documents_are_many_files_in_three_batches(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("document_id"), F.lit("a text").alias("text"))
    stream = registry._arriving(rows, 4, str(tmp_path / "incoming"), "document_id")
    assert len(list((tmp_path / "incoming").glob("*.parquet"))) == 12
    batches = []

    def land(batch, batch_id):
        batches.append([r[0] for r in batch.select("document_id").collect()])

    stream.writeStream.option("checkpointLocation", str(tmp_path / "at")).trigger(
        availableNow=True
    ).foreachBatch(land).start().awaitTermination()
    assert len(batches) == registry.ARRIVALS
    assert sorted(i for ids in batches for i in ids) == list(range(1000))
    assert max(map(len, batches)) < 500


def test_forecasts_are_spread_by_the_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr(driver, "LINES_PER_TASK", 50)
    lineitem = spark.range(2000).selectExpr(
        "id AS l_orderkey", "id % 400 AS l_partkey", "id % 10 AS l_suppkey", "2.0D AS l_quantity",
        "TIMESTAMP_NTZ'2024-01-15 00:00:00' AS l_shipdate",
    )
    supplier = spark.range(10).selectExpr("id AS s_suppkey", "CAST(id % 5 AS INT) AS s_nationkey")
    part = spark.range(400).selectExpr("id AS p_partkey", "3.0D AS p_retailprice")
    found = driver.demand_forecast_versions(lineitem, supplier, part)
    parts = found.select(F.spark_partition_id().alias("part"), "product_id", "forecast_quantity", "scenario_id")
    sizes = parts.groupBy("part").agg(F.countDistinct("product_id").alias("products")).collect()
    assert len(sizes) > 30 and sum(r.products for r in sizes) == 400
    assert parts.where("scenario_id = 1").agg(F.sum("forecast_quantity")).first()[0] == 4000


def test_sales_are_summed_where_the_lines_of_a_product_lie(spark, monkeypatch, capsys):
    monkeypatch.setattr(driver, "LINES_PER_TASK", 50)
    lineitem = spark.range(2000).selectExpr(
        "id AS l_orderkey", "nullif(id % 400, 7) AS l_partkey", "nullif(id % 10, 3) AS l_suppkey",
        "if(id = 11, NULL, 2.0D) AS l_quantity", "TIMESTAMP_NTZ'2024-01-15 00:00:00' AS l_shipdate",
    )
    supplier = spark.range(10).selectExpr("id AS s_suppkey", "nullif(CAST(id % 5 AS INT), 4) AS s_nationkey")
    sales = driver.monthly_sales(lineitem, supplier)
    placed = sales.select(F.spark_partition_id().alias("part"), "product_id").distinct().collect()
    assert len({r.part for r in placed}) > 30 and len(placed) == len({r.product_id for r in placed}) == 360
    found = {(r.product_id, r.site_id, r.m): r.units for r in sales.collect()}
    assert found[(None, 2, 7)] == 10 and found[(9, None, 7)] == 10 and found[(11, 1, 7)] == 8
    part = spark.range(400).selectExpr("id AS p_partkey", "3.0D AS p_retailprice")
    driver.demand_forecast_versions(lineitem, supplier, part).explain()
    shuffled = re.findall(r"hashpartitioning\((product_id.*?)\)", capsys.readouterr().out)
    assert len(shuffled) == 1 and "site_id" not in shuffled[0]


def test_golden_checks_of_forecasts_shuffle_no_forecast_again(spark, capsys):
    lineitem = spark.range(100).selectExpr(
        "id AS l_orderkey", "id % 20 AS l_partkey", "id % 10 AS l_suppkey", "2.0D AS l_quantity",
        "TIMESTAMP_NTZ'2024-01-15 00:00:00' AS l_shipdate",
    )
    supplier = spark.range(10).selectExpr("id AS s_suppkey", "CAST(id % 5 AS INT) AS s_nationkey")
    part = spark.range(20).selectExpr("id AS p_partkey", "3.0D AS p_retailprice")
    rows = driver.demand_forecast_versions(lineitem, supplier, part).select(
        "product_id", "site_id", "forecast_quantity"
    )
    compared = quality.row_differences(rows, rows)
    assert compared.isEmpty()
    compared.explain()
    shuffled = re.findall(r"hashpartitioning\((.*?)\)", capsys.readouterr().out)
    assert shuffled and not any("forecast_quantity" in keys for keys in shuffled)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_staged_text_is_compressed_and_read_whole(spark, tmp_path):
    rows = table(spark, "site", [{"site_id": k, "site_code": f"S-{k}", "site_name": 'a "b", c'} for k in range(1, 6)])
    registry._stage(str(tmp_path), "site", rows)
    files = [p for p in tmp_path.rglob("part-*")]
    assert files and all(p.name.endswith(".csv.snappy") for p in files)
    raw = raw_csv.load_raw(spark, str(tmp_path), "site")
    assert sorted((r.site_id, r.site_code, r.site_name) for r in raw.collect()) == [
        (str(k), f"S-{k}", 'a "b", c') for k in range(1, 6)
    ]


def test_headers_are_found_without_sorting_lines(spark, tmp_path):
    for name, header in (("a", "z,y"), ("b", "b,a"), ("c", "z,y")):
        (tmp_path / f"{name}_x.csv").write_text(header + "\n" + "0,0\n" * 50)
    (tmp_path / "d_x.csv").write_text("")
    found = raw_csv._headers(spark, f"{tmp_path}/*x.csv")
    assert [(c, [p[-7:] for p in paths]) for c, paths in found] == [
        (["b", "a"], ["b_x.csv"]), (["z", "y"], ["a_x.csv", "c_x.csv"])
    ]
    plan = _plan(raw_csv._first_lines(spark, f"{tmp_path}/*x.csv"))
    assert "SortAggregate" not in plan and "Sort " not in plan


def test_stored_sales_are_summed_once_and_give_the_same_forecasts(spark):
    once = driver.driver_tables(spark, SF_DIR).demand_forecast_versions
    stored = driver.driver_tables(spark, SF_DIR, store_sales=True).demand_forecast_versions
    assert "l_quantity" in _plan(once) and "l_quantity" not in _plan(stored)
    assert stored.count() and quality.row_differences(stored, once).isEmpty()


def test_queries_that_read_forecasts_often_sum_the_lines_once(spark, monkeypatch):
    sums, monthly = [], driver.monthly_sales

    def counted(lineitem, supplier):
        sums.append(1)
        return monthly(lineitem, supplier)

    asked, stored = driver.monthly_sales, []
    monkeypatch.setattr(driver, "monthly_sales", counted)
    monkeypatch.setattr(driver, "written", lambda df, name, keep=driver.written: stored.append(name) or keep(df, name))
    for name in ("constraint_report", "golden_checks"):
        plan = _plan(registry.QUERIES[name](spark, SF_DIR))
        assert "l_quantity" not in plan
    assert len(sums) == 2 and stored == ["sales", "sales"] and asked is monthly


def test_kpis_price_any_number_of_rates_in_compiled_code(spark):
    rates = [f"{k}.0{k}" for k in range(1, 10)] + ["3.03", None]
    dimensions = {
        "scenario_definition": [{"scenario_id": 1, "scenario_code": "BASELINE", "scenario_name": None}],
        "product": [{"product_id": 1, "unit_cost": "2"}],
        "product_category": [],
        "site": [{"site_id": s} for s in (1, 2)],
        "logistics_cost_fact": [
            {"logistics_cost_id": k, "site_id": 1, "storage_cost_per_pallet_per_day": r} for k, r in enumerate(rates)
        ],
        "demand_forecast_versions": [
            {"demand_forecast_id": k, "scenario_id": 1, "product_id": 1, "site_id": s, "forecast_quantity": q,
             "total_revenue": "7"}
            for k, (s, q) in enumerate([(1, "10.3333"), (1, "-0.0050"), (2, "3.7"), (1, None)])
        ],
    }
    t = PlanningTables(**{name: table(spark, name, body) for name, body in dimensions.items()})
    kpis = mart.scenario_kpis(t, as_of=driver.as_of())
    assert "lambda" not in _plan(kpis)
    rate = F.coalesce("storage_cost_per_pallet_per_day", dec(DEFAULT_STORAGE_RATE))
    wanted = mart.scenario_comparison(t).select(
        F.sum(storage_cost(F.col("forecast_quantity"), rate)), F.sum("forecast_quantity"), F.sum("total_revenue")
    ).first()
    found = kpis.select("total_warehousing_cost", "total_forecast_quantity", "total_forecasted_revenue").first()
    assert tuple(found) == tuple(wanted)


def test_submitted_json_is_parsed_once(spark, monkeypatch):
    stored = []

    def keep(df, name, write=registry.written):
        stored.append(name)
        return write(df, name)

    monkeypatch.setattr(registry, "written", keep)
    assert registry.QUERIES["submit_json_payload"](spark, SF_DIR).count()
    assert stored == ["updates"]
