"""Files to RAW to ATOMIC: null spellings, bad rows, rounding, reloads."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from conftest import make_tables
from pyspark.sql import functions as F

from granary.functions.casting import try_boolean, try_number
from granary.functions.numbers import safe_number, storage_cost
from granary.schemas import RAW_FILES, RAW_METADATA, raw_columns
from granary.sources import raw_csv
from granary.sources.atomic import to_atomic, transform_raw_to_atomic
from granary.sources.driver_tables import as_of
from granary.sources.tables import PlanningTables, read_tables, write_tables

PRODUCTS = """product_id,PRODUCT_CODE,Unit_Cost,UNIT_PRICE,PRODUCT_NAME,PRODUCT_STATUS
1,A,2.5,10.5,"a ""quoted"", name",ACTIVE
x,B,1,1,bad id,ACTIVE
,C,1,1,no id,ACTIVE
2,D,null,NULL,nulls,
3,E
4,F,0.49,-2.5,long row,ACTIVE,surplus,fields
5.5,G,abc,1.25,half id,ACTIVE
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "products.csv").write_text(PRODUCTS)
    return str(tmp_path)


def test_raw_is_text_matched_by_name(spark, folder):
    raw = raw_csv.load_raw(spark, folder, "product", as_of())
    assert raw.columns == [*raw_columns("product"), *RAW_METADATA]
    assert raw.count() == 7
    first = raw.where("product_code = 'A'").first()
    assert first["unit_cost"] == "2.5" and first["product_name"] == 'a "quoted", name'
    assert first["product_type"] is None and first["_source_file_name"] is None
    assert first["_loaded_timestamp"] == dt.datetime(2024, 9, 1)
    nulls = raw.where("product_code = 'D'").first()
    assert nulls["unit_cost"] is None and nulls["unit_price"] is None
    assert nulls["product_status"] is None
    assert raw.where("product_code = 'E'").first()["product_name"] is None
    assert raw.where("product_code = 'F'").first()["product_status"] == "ACTIVE"


@pytest.mark.parametrize(
    ("numeric", "cost", "price", "negative"),
    [("scale0", D("3"), D("11"), D("-3")), ("declared", D("2.5"), D("10.5"), D("-2.5"))],
)
def test_atomic_types(spark, folder, numeric, cost, price, negative):
    atomic = to_atomic(raw_csv.load_raw(spark, folder, "product"), "product", as_of(), numeric)
    rows = {r["product_code"]: r for r in atomic.collect()}
    assert sorted(rows) == ["A", "D", "E", "F", "G"]
    assert (rows["A"]["unit_cost"], rows["A"]["unit_price"]) == (cost, price)
    assert rows["F"]["unit_price"] == negative
    assert rows["G"]["product_id"] == 6 if numeric == "scale0" else True
    assert rows["G"]["unit_cost"] is None
    assert rows["A"]["is_current_flag"] is True and rows["A"]["created_by_user"] == "system"
    assert rows["A"]["valid_from_timestamp"] == dt.datetime(2024, 9, 1)
    assert rows["A"]["valid_to_timestamp"] is None


def test_scale_zero_rounds_half_away_from_zero(spark):
    values = ["2.5", "-2.5", "0.92", "1.44", "0.33", "299.99", "x", "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(try_number(F.col("v"))).collect()]
    assert got == [3, -3, 1, 1, 0, 300, None, None, None]
    with pytest.raises(ValueError):
        try_number(F.col("v"), numeric="scale4")


def test_booleans(spark):
    values = ["TRUE", "false", "on", "Off", "1", "n", "maybe", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(try_boolean(F.col("v"))).collect()]
    assert got == [True, False, True, False, True, False, None, None]


def test_forecast_revenue_uses_typed_numbers(spark, tmp_path):
    (tmp_path / "demand_forecasts.csv").write_text(
        "DEMAND_FORECAST_ID,FORECAST_QUANTITY,UNIT_REVENUE,FORECAST_DATE,FORECAST_CREATION_DATE\n"
        "1,10.5,2.5,2024-07-01,2024-13-01\n"
    )
    raw = raw_csv.load_raw(spark, str(tmp_path), "demand_forecast_versions")

    def revenue(numeric):
        row = to_atomic(raw, "demand_forecast_versions", as_of(), numeric).first()
        assert row["forecast_date"] == dt.date(2024, 7, 1)
        assert row["forecast_creation_date"] is None and row["is_current_version"] is True
        return row["total_revenue"]

    assert revenue("scale0") == D("33") and revenue("declared") == D("26.25")


def test_files_of_other_tables_are_not_read(spark, folder, tmp_path):
    (tmp_path / "sites.csv").write_text("SITE_ID,SITE_NAME\n1,only site\n")
    assert raw_csv.load_raw(spark, folder, "site").count() == 1
    named = raw_csv.with_source_file(spark, folder, "site").first()
    assert named["_source_file_name"] == "sites.csv"


def test_rejected_rows_show_wrong_field_counts(spark, tmp_path):
    names = raw_columns("site")
    good = ",".join(["1", *["v"] * (len(names) - 1)])
    (tmp_path / "sites.csv").write_text(",".join(names) + f"\n{good}\n2,short\n")
    lines = raw_csv.rejected_rows(spark, str(tmp_path), "site").collect()
    assert [(r["key"], r["line"]) for r in lines] == [("2", "2,short")]
    assert lines[0]["source_file"].endswith("/sites.csv")
    (tmp_path / "products.csv").write_text("")
    assert raw_csv.rejected_rows(spark, str(tmp_path), "product").count() == 0


def test_append_doubles_and_overwrite_does_not(spark, folder, tmp_path):
    for table, name in RAW_FILES.items():
        if table != "product":
            header = ",".join(raw_columns(table))
            (tmp_path / name).write_text(f"{header}\n{','.join(['1'] * len(raw_columns(table)))}\n")
    root = str(tmp_path / "raw")
    first = {r[0]: r[1] for r in raw_csv.load_staged_data(spark, folder, root).collect()}
    assert first["product_stage"] == 7 and first["site_stage"] == 1 and len(first) == 9
    second = raw_csv.load_staged_data(spark, folder, root).collect()
    assert {r[0]: r[1] for r in second}["product_stage"] == 14
    third = raw_csv.load_staged_data(spark, folder, root, "overwrite").collect()
    assert {r[0]: r[1] for r in third}["product_stage"] == 7

    store = str(tmp_path / "atomic")
    for _ in range(2):
        transform_raw_to_atomic(spark, root, store, as_of())
    stored = read_tables(spark, store)
    assert stored.product.count() == 5 and stored.scenario_definition.count() == 1
    assert stored.scenario_definition.first()["version_number"] == 1
    assert "created_date" not in stored.scenario_definition.columns
    with pytest.raises(ValueError):
        raw_csv.append_raw(stored.product, root, "product", "replace")


def test_round_trip_through_storage(spark, tables, tmp_path):
    root = str(tmp_path / "store")
    write_tables(tables, root)
    again = read_tables(spark, root)
    for name, df in tables.items():
        assert getattr(again, name).exceptAll(df).isEmpty(), name
        assert getattr(again, name).count() == df.count(), name
    plan = again.demand_forecast_versions.where("scenario_id = 2")._jdf
    assert "PartitionFilters: [isnotnull(scenario_id" in plan.queryExecution().toString()


def test_tables_are_resolved_on_demand(spark):
    t = PlanningTables(product=lambda: spark.range(1), site=lambda: 1 / 0)
    assert t.product is t.product
    with pytest.raises(AttributeError):
        _ = t.nonsense
    with pytest.raises(TypeError):
        PlanningTables(products=spark.range(1))
    assert t.with_(site=spark.range(2)).site.count() == 2
    assert make_tables(spark).names()[0] == "product_category"


def test_numbers(spark):
    one = spark.range(1)
    quantity, rate = F.lit("1000.5").cast("decimal(18,4)"), F.lit("1.4444").cast("decimal(18,4)")
    row = one.select(
        storage_cost(quantity, rate).alias("month"),
        storage_cost(quantity, rate, days=7).alias("week"),
        safe_number(F.lit(float("nan"))).alias("nan"),
        safe_number(F.lit(float("-inf")), 1.5).alias("inf"),
        safe_number(F.lit(None).cast("double")).alias("null"),
        safe_number(F.lit(2.0)).alias("fine"),
    ).first()
    assert row["month"] == D("4335.37") and row["week"] == D("1011.59")
    assert (row["nan"], row["inf"], row["null"], row["fine"]) == (0.0, 1.5, 0.0, 2.0)


def test_columns_match_by_the_header_of_each_file(spark, tmp_path):
    (tmp_path / "a_sites.csv").write_text('SITE_NAME,SITE_ID,REGION\nNorth,1,X\n"two\nlines",2,Y\n')
    (tmp_path / "b_sites.csv").write_text("site_id,region,site_name\n3,Z,South\n4,Z\n")
    folder = str(tmp_path)
    named = raw_csv.with_source_file(spark, folder, "site", multi_line=True).collect()
    assert sorted((r.site_id, r.site_name, r.region, r._source_file_name) for r in named if r.site_name) == [
        ("1", "North", "X", "a_sites.csv"), ("2", "two\nlines", "Y", "a_sites.csv"), ("3", "South", "Z", "b_sites.csv"),
    ]
    loaded = raw_csv.load_raw(spark, folder, "site", multi_line=True).collect()
    assert sorted((r.site_id, r.region) for r in loaded) == [("1", "X"), ("2", "Y"), ("3", "Z"), ("4", "Z")]
    bad = raw_csv.rejected_rows(spark, folder, "site", multi_line=True).collect()
    assert [(r.key, r.line) for r in bad] == [("4", "4,Z")]
