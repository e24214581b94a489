"""One local Spark session and small literal planning tables for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from granary.schemas import columns_of  # noqa: E402
from granary.sources.tables import PlanningTables  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("granary-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def table(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """Rows of one atomic table; values may be text, missing columns are null."""
    columns = columns_of(name)
    schema = ", ".join(f"{c} string" for c in columns)
    defaults = {"is_current_flag": "true", "is_current_version": "true"}
    data = [
        tuple(
            None if row.get(c, defaults.get(c)) is None else str(row.get(c, defaults.get(c)))
            for c in columns
        )
        for row in rows
    ]
    return spark.createDataFrame(data, schema).selectExpr(
        *[f"CAST({c} AS {kind}) AS {c}" for c, kind in columns.items()]
    )


def rows(header: str, body: str) -> list[dict]:
    """Table rows from a header line and comma-separated lines; blank is null."""
    names = header.split(",")
    return [
        {n: (v or None) for n, v in zip(names, line.strip().split(","))}
        for line in body.strip().splitlines()
    ]


# The sample master data of the reference (columns used by the marts).
SITES = rows(
    "site_id,site_code,site_name,site_type,region",
    """1,PLT-WEST,Western Manufacturing Plant,PLANT,West
    2,PLT-CENT,Central Manufacturing Plant,PLANT,Central
    3,WH-WEST,Western Distribution Center,WAREHOUSE,West
    4,WH-CENT,Central Distribution Center,WAREHOUSE,Central
    5,WH-NE,Northeast Distribution Center,WAREHOUSE,Northeast""",
)
ZONES = rows(
    "warehouse_zone_id,zone_name,site_id,max_capacity_pallets,current_occupancy_pallets",
    """301,General Storage A,3,8000,5200
    302,General Storage B,3,8000,4800
    303,High Value Storage,3,5000,3500
    304,Staging Area,3,4000,2100
    401,Appliance Storage A,4,10000,7500
    402,Appliance Storage B,4,10000,6800
    403,Electronics Storage,4,5000,4200
    404,Outdoor Equipment,4,3000,1800
    405,Staging & Shipping,4,2000,1200
    501,General Storage A,5,6000,5400
    502,General Storage B,5,5000,4200
    503,Electronics Storage,5,4000,3600
    504,Overflow Area,5,3000,2400
    505,Staging Dock,5,2000,1500""",
)
COSTS = rows(
    "logistics_cost_id,site_id,warehouse_zone_id,storage_cost_per_pallet_per_day,"
    "overflow_penalty_rate,overflow_penalty_threshold_pct",
    """1,3,301,2.0,4.0,90
    2,3,302,2.0,4.0,90
    3,3,303,3.0,4.0,90
    4,3,304,1.6,4.0,90
    5,4,401,1.8,3.5,90
    6,4,402,1.8,3.5,90
    7,4,403,2.7,3.5,90
    8,4,404,1.8,3.5,90
    9,4,405,1.44,3.5,90
    10,5,501,2.5,5.0,85
    11,5,502,2.5,5.0,85
    12,5,503,3.75,5.0,85
    13,5,504,2.5,5.0,85
    14,5,505,2.0,5.0,85""",
)
WORK_CENTERS = rows(
    "work_center_id,work_center_name,site_id,capacity_per_hour,hours_per_day,"
    "available_shifts,efficiency_factor",
    """101,Electronics Assembly Line 1,1,150,16,2,0.92
    102,Electronics Assembly Line 2,1,120,16,2,0.9
    103,Tool Fabrication Line,1,200,16,2,0.88
    104,Packaging Line West,1,300,16,2,0.95
    201,Appliance Assembly Line 1,2,80,24,3,0.91
    202,Appliance Assembly Line 2,2,120,24,3,0.89
    203,Outdoor Equipment Line,2,50,16,2,0.87
    204,Metal Fabrication,2,100,24,3,0.85
    205,Quality Inspection,2,250,24,3,0.98
    206,Packaging Line Central,2,400,24,3,0.94""",
)
SCENARIOS = rows(
    "scenario_id,scenario_code,scenario_name,scenario_type,is_official_baseline",
    """1,BASELINE,Baseline Forecast,BASELINE,true
    2,Q4_PUSH,Q4 Marketing Push,MARKETING_PUSH,false
    3,CONSERVATIVE,Conservative Estimate,CONSERVATIVE,false""",
)
CATEGORIES = rows(
    "product_category_id,category_name,parent_category_id,category_level",
    """1,All Products,,1
    10,Electronics,1,2
    11,Televisions,10,3
    12,Audio Systems,10,3""",
)
PRODUCTS = rows(
    "product_id,product_code,product_name,product_category_id,unit_price,unit_cost",
    """10,TV-001,Television,11,299.99,180
    50,SPK-005,Bluetooth Speaker,12,49.99,25""",
)
# Made up, because the reference ships no forecasts.
FORECASTS = rows(
    "demand_forecast_id,product_id,site_id,scenario_id,forecast_date,forecast_quantity,"
    "confidence_level,fiscal_month,fiscal_quarter,unit_revenue,total_revenue,is_current_version",
    """1,10,5,1,2024-10-01,1000,0.9,October,Q4,299.99,299990,true
    2,10,5,2,2024-10-01,1300,0.8,October,Q4,299.99,389987,true
    3,50,1,1,2024-08-01,400,0.9,August,Q3,49.99,19996,true
    4,50,3,1,2024-12-01,55.5,0.9,December,Q4,49.99,2774.45,true
    5,10,5,2,2024-07-01,7,0.8,July,Q3,299.99,2099.93,true
    6,10,5,2,2024-10-01,9999,0.8,October,Q4,299.99,1,false
    7,99,5,1,2024-10-01,5,0.9,October,Q4,1,5,true""",
)
FIXTURE = {
    "product_category": CATEGORIES,
    "product": PRODUCTS,
    "site": SITES,
    "work_center": WORK_CENTERS,
    "warehouse_zone": ZONES,
    "scenario_definition": SCENARIOS,
    "demand_forecast_versions": FORECASTS,
    "logistics_cost_fact": COSTS,
    "inventory_balance": [],
}


def make_tables(spark: SparkSession, **replaced: list[dict]) -> PlanningTables:
    """The fixture tables with some of them replaced."""
    content = {**FIXTURE, **replaced}
    return PlanningTables(**{name: table(spark, name, data) for name, data in content.items()})


@pytest.fixture(scope="session")
def tables(spark):
    return make_tables(spark)
