"""The benchmark's star-schema tables mapped to the planning model.

Nations become sites, parts products, suppliers work centers, and line items
monthly demand in July to December, which three scenarios scale. Capacities
and rates follow from key arithmetic, so every number can be recomputed in SQL.
Some keys also get a superseded row, so that reading only current rows matters.

The mapping is a set of SQL projections; the planning code itself never sees
the benchmark tables.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.constants import BASELINE, FISCAL_MONTHS, PLAN_YEAR, Q4_PUSH
from granary.operators.durable import written
from granary.schemas import columns_of
from granary.sources.tables import PlanningTables

#: Sold lines per task where prices and scenarios multiply them.
LINES_PER_TASK = 250_000
AS_OF = "2024-09-01 00:00:00"
EARLIER = "2024-06-01 00:00:00"

# The columns of the benchmark tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
}

# Scenario id, code, name, type, official baseline.
SCENARIOS = (
    (1, BASELINE, "Baseline Forecast", "BASELINE", True),
    (2, Q4_PUSH, "Q4 Marketing Push", "MARKETING_PUSH", False),
    (3, "CONSERVATIVE", "Conservative Estimate", "CONSERVATIVE", False),
)
# Place, scenario id, Q3 factor, Q4 factor, confidence, current version.
DEMAND_RULES = """array(
    named_struct('place', 0, 'id', 1, 'q3', 1.00, 'q4', 1.00, 'sure', 0.95, 'live', true),
    named_struct('place', 1, 'id', 2, 'q3', 1.00, 'q4', 1.30, 'sure', 0.85, 'live', true),
    named_struct('place', 2, 'id', 3, 'q3', 0.90, 'q4', 0.90, 'sure', 0.75, 'live', true),
    named_struct('place', 3, 'id', 2, 'q3', 1.10, 'q4', 1.10, 'sure', 0.50, 'live', false))"""
_MONTHS = "array(" + ", ".join(f"'{m}'" for m in FISCAL_MONTHS) + ")"

# Part types in alphabetical order number the leaf categories of a brand.
_BRAND = "CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT)"
_LEAF = (
    f"(1000 + {_BRAND} * 10 + array_position("
    "array('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'), p_type))"
)


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _shape(df: DataFrame, table: str) -> DataFrame:
    """Declared columns in declared order; what is not supplied is null."""
    stamps = {"created_by_user": "'system'", "created_timestamp": f"'{AS_OF}'"}
    have = {**stamps, **{c: c for c in df.columns}}
    return df.selectExpr(
        *[f"CAST({have.get(n, 'NULL')} AS {kind}) AS {n}" for n, kind in columns_of(table).items()]
    )


def _with_history(df: DataFrame, has_old: str) -> DataFrame:
    """Mark rows current and add a superseded twin where the condition holds."""
    return df.selectExpr(
        "*", f"explode(if({has_old}, array(true, false), array(true))) AS is_current_flag"
    ).selectExpr(
        "*",
        f"if(is_current_flag, '{AS_OF}', '{EARLIER}') AS valid_from_timestamp",
        f"if(is_current_flag, NULL, '{AS_OF}') AS valid_to_timestamp",
    )


def site(nation: DataFrame, region: DataFrame) -> DataFrame:
    rows = nation.join(region, F.expr("n_regionkey = r_regionkey")).selectExpr(
        "n_nationkey AS site_id",
        "concat(if(n_nationkey % 5 = 0, 'PLT-', 'WH-'), n_nationkey) AS site_code",
        "concat(n_name, if(n_nationkey % 5 = 0, ' Plant', ' Distribution Center')) AS site_name",
        "if(n_nationkey % 5 = 0, 'PLANT', 'WAREHOUSE') AS site_type",
        "r_name AS region",
        "n_name AS country",
        "'ACTIVE' AS operating_status",
        "1000 + n_nationkey * 10 AS capacity_metric",
        "if(n_nationkey % 5 = 0, 'UNITS_PER_MONTH', 'PALLETS') AS capacity_unit_of_measure",
    )
    return _shape(_with_history(rows, "site_id % 4 = 0"), "site")


def product_category(part: DataFrame) -> DataFrame:
    """Three levels: everything, brand, part type within a brand."""
    rows = (
        part.select("p_brand", "p_type")
        .distinct()
        .selectExpr(
            f"""inline(array(
                named_struct('product_category_id', 1L, 'product_category_code', 'ALL',
                             'parent_category_id', CAST(NULL AS BIGINT), 'category_level', 1),
                named_struct('product_category_id', 10 + {_BRAND},
                             'product_category_code', p_brand,
                             'parent_category_id', 1L, 'category_level', 2),
                named_struct('product_category_id', {_LEAF},
                             'product_category_code', concat(p_brand, ' ', p_type),
                             'parent_category_id', 10 + {_BRAND}, 'category_level', 3)))"""
        )
        .distinct()
        .selectExpr(
            "*",
            "if(category_level = 1, 'All Products', product_category_code) AS category_name",
        )
    )
    return _shape(_with_history(rows, "false"), "product_category")


def product(part: DataFrame) -> DataFrame:
    rows = part.selectExpr(
        "p_partkey AS product_id",
        "concat('P-', p_partkey) AS product_code",
        "p_name AS product_name",
        "'FINISHED_GOOD' AS product_type",
        "if(p_size % 10 = 0, 'DISCONTINUED', 'ACTIVE') AS product_status",
        f"{_LEAF} AS product_category_id",
        "CAST(p_retailprice AS DECIMAL(18,4)) AS unit_price",
        "CAST(CAST(p_retailprice AS DECIMAL(18,4)) * 0.6 AS DECIMAL(18,4)) AS unit_cost",
    )
    return _shape(_with_history(rows, "product_id % 10 = 0"), "product")


def work_center(supplier: DataFrame) -> DataFrame:
    rows = supplier.selectExpr(
        "s_suppkey AS work_center_id",
        "concat('WC-', s_suppkey) AS work_center_code",
        "concat('Line ', s_suppkey) AS work_center_name",
        "element_at(array('ASSEMBLY', 'FABRICATION', 'PACKAGING'), CAST(s_suppkey % 3 + 1 AS INT))"
        " AS work_center_type",
        "s_nationkey AS site_id",
        "s_suppkey % 3 + 1 AS capacity_per_hour",
        "if(s_suppkey % 2 = 0, 16, 24) AS hours_per_day",
        "if(s_suppkey % 2 = 0, 2, 3) AS available_shifts",
        "if(s_suppkey % 7 <> 0, (80 + s_suppkey % 20) * 0.01, NULL) AS efficiency_factor",
    )
    return _shape(_with_history(rows, "work_center_id % 6 = 0"), "work_center")


def _zones(nation: DataFrame) -> DataFrame:
    """One to three zones per warehouse nation."""
    return (
        nation.where("n_nationkey % 5 <> 0")
        .selectExpr(
            "CAST(n_nationkey AS BIGINT) AS site_id",
            "explode(sequence(1, n_nationkey % 3 + 1)) AS place",
        )
        .selectExpr("*", "site_id * 100 + place AS warehouse_zone_id")
    )


def warehouse_zone(nation: DataFrame) -> DataFrame:
    rows = (
        _zones(nation)
        .selectExpr(
            "*",
            "if(warehouse_zone_id % 17 = 3, 0, 500 + warehouse_zone_id * 37 % 1100)"
            " AS max_capacity_pallets",
        )
        .selectExpr(
            "warehouse_zone_id",
            "concat('Z-', warehouse_zone_id) AS zone_code",
            "concat('Zone ', place) AS zone_name",
            "site_id",
            "element_at(array('STANDARD', 'HIGH_VALUE', 'COLD_STORAGE'), place) AS zone_type",
            "'AMBIENT' AS zone_temperature_control",
            "max_capacity_pallets",
            "max_capacity_pallets * (50 + warehouse_zone_id % 45) div 100"
            " AS current_occupancy_pallets",
        )
    )
    return _shape(_with_history(rows, "warehouse_zone_id % 8 = 0"), "warehouse_zone")


def logistics_cost_fact(nation: DataFrame) -> DataFrame:
    rows = (
        _zones(nation)
        .where("warehouse_zone_id % 13 <> 5")
        .selectExpr(
            "warehouse_zone_id AS logistics_cost_id",
            "site_id",
            "warehouse_zone_id",
            "(144 + warehouse_zone_id * 7 % 200) * 0.01 AS storage_cost_per_pallet_per_day",
            "(15 + warehouse_zone_id % 20) * 0.01 AS transport_cost_per_unit",
            "(356 + warehouse_zone_id % 300) * 0.01 AS handling_cost_per_pallet",
            "(350 + site_id * 10) * 0.01 AS overflow_penalty_rate",
            "if(site_id % 2 = 0, 85, 90) AS overflow_penalty_threshold_pct",
            "'2024-01-01' AS effective_date",
            "'2024-12-31' AS expiry_date",
            "concat('Vendor ', site_id) AS vendor_name",
            "concat('3PL-', warehouse_zone_id) AS contract_reference",
        )
    )
    return _shape(_with_history(rows, "warehouse_zone_id % 9 = 0"), "logistics_cost_fact")


def scenario_definition(spark: SparkSession, region: DataFrame) -> DataFrame:
    """The three planning scenarios and one empty custom one per region."""
    # An expression over one row has a size estimate, unlike local data from Python,
    # so the few scenarios are broadcast and the fact stays where it is.
    rows = ", ".join(
        f"struct({i}L, '{code}', '{name}', '{kind}', {str(official).lower()}, CAST(NULL AS BIGINT))"
        for i, code, name, kind, official in SCENARIOS
    )
    fixed = spark.range(1).selectExpr(
        f"inline(array({rows})) AS (scenario_id, scenario_code, scenario_name, scenario_type, "
        "is_official_baseline, parent_scenario_id)"
    )
    custom = region.selectExpr(
        "CAST(100 + r_regionkey AS BIGINT) AS scenario_id",
        "concat('CUSTOM_', r_regionkey) AS scenario_code",
        "concat('Plan for ', r_name) AS scenario_name",
        "'CUSTOM' AS scenario_type",
        "false AS is_official_baseline",
        "1L AS parent_scenario_id",
    )
    rows = fixed.unionByName(custom).selectExpr(
        "*", "concat('About ', scenario_name) AS scenario_description", "1 AS version_number"
    )
    return _shape(rows, "scenario_definition")


def line_tasks(lineitem: DataFrame) -> int:
    """Tasks for work whose memory follows the number of lines, not the shuffled bytes."""
    lines = lineitem.count()  # Parquet footers alone are read
    return max(lineitem.sparkSession.sparkContext.defaultParallelism, -(-lines // LINES_PER_TASK))


def monthly_sales(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """Units sold per product, nation and fiscal month (July to December).

    Every line item counts: January to June fall on July to December too. Few lines
    share a product, nation and month, so sums of an input split or of coalesced
    partitions would hold nearly a row per line: the lines are spread by product
    first, and each task sums its own.
    """
    return (
        lineitem.join(supplier, F.expr("l_suppkey = s_suppkey"))
        .selectExpr(
            "l_partkey AS product_id",
            "CAST(s_nationkey AS BIGINT) AS site_id",
            "(month(l_shipdate) - 1) % 6 + 7 AS m",
            "CAST(l_quantity AS DECIMAL(8,2)) AS sold",
        )
        .repartition(line_tasks(lineitem), "product_id")
        .groupBy("product_id", "site_id", "m")
        .agg(F.expr("CAST(sum(sold) AS DECIMAL(14,2)) AS units"))
    )


def demand_forecast_versions(
    lineitem: DataFrame, supplier: DataFrame, part: DataFrame, store_sales: bool = False
) -> DataFrame:
    """Monthly sales scaled by each scenario's factors.

    The sales are summed before they meet the prices, so that a best-seller
    reaches the join as a few rows per task; the rules are a fixed array. They
    stay where they were summed, by product. ``store_sales`` writes the sums to
    the shared folder, so that whoever reads the forecasts several times sums
    the line items once; read back, they are spread by product again.
    """
    prices = part.selectExpr(
        "p_partkey AS product_id", "CAST(p_retailprice AS DECIMAL(18,4)) AS unit_revenue"
    )
    sales = monthly_sales(lineitem, supplier)
    if store_sales:
        sales = written(sales, "sales").repartition(line_tasks(lineitem), "product_id")
    rows = (
        sales.join(prices, "product_id")
        .selectExpr("*", f"explode({DEMAND_RULES}) AS rule")
        .selectExpr(
            "((product_id * 32 + site_id) * 16 + m) * 4 + rule.place AS demand_forecast_id",
            "product_id",
            "site_id",
            "rule.id AS scenario_id",
            f"make_date({PLAN_YEAR}, m, 1) AS forecast_date",
            "'2024-06-30' AS forecast_creation_date",
            "CAST(units * if(m < 10, rule.q3, rule.q4) AS DECIMAL(18,4)) AS forecast_quantity",
            "'DEMAND' AS forecast_type",
            "'HISTORY' AS forecast_method",
            "'MONTHLY' AS forecast_horizon",
            "rule.sure AS confidence_level",
            f"element_at({_MONTHS}, m - 6) AS fiscal_month",
            "if(m < 10, 'Q3', 'Q4') AS fiscal_quarter",
            f"{PLAN_YEAR} AS fiscal_year",
            "unit_revenue",
            f"if(rule.live, '{AS_OF}', '{EARLIER}') AS version_timestamp",
            "rule.live AS is_current_version",
        )
        .selectExpr(
            "*",
            "concat('FY24-', upper(left(fiscal_month, 3))) AS fiscal_period",
            "forecast_quantity * unit_revenue AS total_revenue",
        )
    )
    return _shape(rows, "demand_forecast_versions")


def inventory_balance(part: DataFrame) -> DataFrame:
    rows = part.selectExpr(
        "p_partkey + 1 AS inventory_balance_id",
        "p_partkey AS product_id",
        "p_partkey % 25 AS site_id",
        "if(p_partkey % 5 <> 0, p_partkey % 25 * 100 + 1, NULL) AS warehouse_zone_id",
        "'2024-09-01' AS balance_date",
        "p_size * 30 AS quantity_on_hand",
        "p_size * 4 AS quantity_reserved",
        "p_size * 26 AS quantity_available",
        "'EACH' AS unit_of_measure",
    )
    return _shape(rows, "inventory_balance")


def driver_tables(spark: SparkSession, sf_dir: str, store_sales: bool = False) -> PlanningTables:
    """All nine planning tables as lazy DataFrames over the given Parquet.

    ``store_sales`` is for queries that read the forecasts more than once.
    """

    @cache
    def read(name: str) -> DataFrame:
        return read_driver_table(spark, sf_dir, name)

    return PlanningTables(
        product_category=lambda: product_category(read("part")),
        product=lambda: product(read("part")),
        site=lambda: site(read("nation"), read("region")),
        work_center=lambda: work_center(read("supplier")),
        warehouse_zone=lambda: warehouse_zone(read("nation")),
        scenario_definition=lambda: scenario_definition(spark, read("region")),
        demand_forecast_versions=lambda: demand_forecast_versions(
            read("lineitem"), read("supplier"), read("part"), store_sales
        ),
        logistics_cost_fact=lambda: logistics_cost_fact(read("nation")),
        inventory_balance=lambda: inventory_balance(read("part")),
    )


def documents(df: DataFrame) -> DataFrame:
    """Documents with a path whose name tells type, vendor and region."""
    return df.selectExpr(
        "doc_id AS document_id",
        """concat_ws('/', if(doc_id % 7 = 0, 'contracts', source), element_at(array(
            concat('northeast_3pl_contract_', doc_id, '.pdf'),
            concat('Warehouse_capacity_SLA_', doc_id, '.PDF'),
            concat('sop_meeting_minutes_', doc_id, '.docx'),
            concat('acme_west_', doc_id, '.pdf'),
            concat('acme_contract_notes_', doc_id, '.txt'),
            concat('report_', doc_id, '.pdf')), CAST(doc_id % 6 + 1 AS INT))) AS relative_path""",
        "DATE'2024-01-01' AS effective_date",
        "if(doc_id % 2 = 0, DATE'2024-12-31', NULL) AS expiry_date",
        "text",
    )


def submissions(events: DataFrame) -> DataFrame:
    """Events as submitted forecast lines: a day of events is one version.

    Works on a batch and on a stream.
    """
    return events.selectExpr(
        "event_id AS demand_forecast_id",
        "event_id AS line_id",
        "user_id AS product_id",
        "event_id % 25 AS site_id",
        "user_id % 3 + 1 AS scenario_id",
        f"make_date({PLAN_YEAR}, CAST(event_id % 6 + 7 AS INT), 1) AS forecast_date",
        "CAST(value AS DECIMAL(18,4)) AS forecast_quantity",
        "'DEMAND' AS forecast_type",
        "0.90 AS confidence_level",
        f"element_at({_MONTHS}, CAST(event_id % 6 + 1 AS INT)) AS fiscal_month",
        "if(event_id % 6 < 3, 'Q3', 'Q4') AS fiscal_quarter",
        f"{PLAN_YEAR} AS fiscal_year",
        "CAST(user_id % 50 + 10 AS DECIMAL(18,4)) AS unit_revenue",
        "CAST(value AS DECIMAL(18,4)) * (user_id % 50 + 10) AS total_revenue",
        "date_trunc('day', ts) AS version_timestamp",
    )


def product_text(part: DataFrame) -> DataFrame:
    """Parts as the text of a products file, with nulls, quotes and bad ids."""
    return part.selectExpr(
        "concat(if(p_partkey % 50 = 49, 'x', ''), p_partkey) AS PRODUCT_ID",
        "concat('P-', p_partkey) AS Product_Code",
        "p_name AS PRODUCT_NAME",
        "concat('size \"', p_size, '\", ', p_type) AS PRODUCT_DESCRIPTION_SHORT",
        "'FINISHED_GOOD' AS PRODUCT_TYPE",
        "if(p_size % 5 = 0, 'null', 'ACTIVE') AS PRODUCT_STATUS",
        f"CAST({_LEAF} AS STRING) AS PRODUCT_CATEGORY_ID",
        "CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING) AS UNIT_PRICE",
        "CASE p_size % 7 WHEN 0 THEN 'NULL' WHEN 1 THEN 'n/a'"
        " ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 0.6 AS STRING) END AS UNIT_COST",
    )


def forecast_text(lineitem: DataFrame) -> DataFrame:
    """Line items as the text of a forecast file; every quantity ends in .5."""
    return lineitem.selectExpr(
        "CAST(l_orderkey * 8 + l_linenumber AS STRING) AS DEMAND_FORECAST_ID",
        "CAST(l_partkey AS STRING) AS PRODUCT_ID",
        "CAST(l_suppkey % 25 AS STRING) AS SITE_ID",
        "if(l_linenumber = 7, '2024-13-01', date_format(l_shipdate, 'yyyy-MM-dd'))"
        " AS FORECAST_DATE",
        "'NULL' AS FORECAST_CREATION_DATE",
        "CAST(CAST(l_quantity AS DECIMAL(12,2)) + 0.5 AS STRING) AS FORECAST_QUANTITY",
        "'DEMAND' AS FORECAST_TYPE",
        "'HISTORY' AS FORECAST_METHOD",
        "'MONTHLY' AS FORECAST_HORIZON",
        "'0.85' AS CONFIDENCE_LEVEL",
        "CAST(l_linenumber % 3 + 1 AS STRING) AS SCENARIO_ID",
        "'' AS FISCAL_PERIOD",
        "date_format(l_shipdate, 'MMMM') AS FISCAL_MONTH",
        "concat('Q', quarter(l_shipdate)) AS FISCAL_QUARTER",
        "CAST(year(l_shipdate) AS STRING) AS FISCAL_YEAR",
        "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) AS UNIT_REVENUE",
    )
