"""Declared column types of the planning tables.

``ATOMIC`` holds the business columns in load order; the lifecycle columns that
every versioned table carries are added by :func:`columns_of`.
"""

from __future__ import annotations

from pyspark.sql import types as T

ID = "bigint"
MONEY = "decimal(18,4)"
STAMP = "timestamp_ntz"

ATOMIC: dict[str, dict[str, str]] = {
    "product_category": {
        "product_category_id": ID,
        "product_category_code": "string",
        "category_name": "string",
        "category_description": "string",
        "parent_category_id": ID,
        "category_level": ID,
    },
    "product": {
        "product_id": ID,
        "product_code": "string",
        "product_name": "string",
        "product_description_short": "string",
        "product_type": "string",
        "product_status": "string",
        "product_category_id": ID,
        "unit_price": MONEY,
        "unit_cost": MONEY,
    },
    "site": {
        "site_id": ID,
        "site_code": "string",
        "site_name": "string",
        "site_type": "string",
        "region": "string",
        "address_line_1": "string",
        "city": "string",
        "state_province": "string",
        "country": "string",
        "operating_status": "string",
        "capacity_metric": MONEY,
        "capacity_unit_of_measure": "string",
    },
    "work_center": {
        "work_center_id": ID,
        "work_center_code": "string",
        "work_center_name": "string",
        "work_center_description": "string",
        "work_center_type": "string",
        "site_id": ID,
        "capacity_per_hour": MONEY,
        "hours_per_day": "decimal(8,2)",
        "available_shifts": ID,
        "efficiency_factor": "decimal(5,4)",
    },
    "warehouse_zone": {
        "warehouse_zone_id": ID,
        "zone_code": "string",
        "zone_name": "string",
        "site_id": ID,
        "zone_type": "string",
        "zone_temperature_control": "string",
        "max_capacity_pallets": ID,
        "current_occupancy_pallets": ID,
    },
    "scenario_definition": {
        "scenario_id": ID,
        "scenario_code": "string",
        "scenario_name": "string",
        "scenario_description": "string",
        "scenario_type": "string",
        "is_official_baseline": "boolean",
        "created_by_user": "string",
    },
    "demand_forecast_versions": {
        "demand_forecast_id": ID,
        "product_id": ID,
        "site_id": ID,
        "scenario_id": ID,
        "forecast_date": "date",
        "forecast_creation_date": "date",
        "forecast_quantity": MONEY,
        "forecast_type": "string",
        "forecast_method": "string",
        "forecast_horizon": "string",
        "confidence_level": "decimal(5,2)",
        "fiscal_period": "string",
        "fiscal_month": "string",
        "fiscal_quarter": "string",
        "fiscal_year": ID,
        "unit_revenue": MONEY,
    },
    "logistics_cost_fact": {
        "logistics_cost_id": ID,
        "site_id": ID,
        "warehouse_zone_id": ID,
        "storage_cost_per_pallet_per_day": MONEY,
        "transport_cost_per_unit": MONEY,
        "handling_cost_per_pallet": MONEY,
        "overflow_penalty_rate": MONEY,
        "overflow_penalty_threshold_pct": "decimal(5,2)",
        "effective_date": "date",
        "expiry_date": "date",
        "vendor_name": "string",
        "contract_reference": "string",
    },
    "inventory_balance": {
        "inventory_balance_id": ID,
        "product_id": ID,
        "site_id": ID,
        "warehouse_zone_id": ID,
        "balance_date": "date",
        "quantity_on_hand": MONEY,
        "quantity_reserved": MONEY,
        "quantity_available": MONEY,
        "unit_of_measure": "string",
    },
}

SCD = {
    "valid_from_timestamp": STAMP,
    "valid_to_timestamp": STAMP,
    "is_current_flag": "boolean",
}
AUDIT = {
    "created_by_user": "string",
    "created_timestamp": STAMP,
    "updated_by_user": "string",
    "updated_timestamp": STAMP,
}
SCD_TABLES = (
    "product_category",
    "product",
    "site",
    "work_center",
    "warehouse_zone",
    "logistics_cost_fact",
)
EXTRA = {
    "scenario_definition": {"version_number": ID, "parent_scenario_id": ID},
    "demand_forecast_versions": {
        "total_revenue": "decimal(18,2)",
        "version_timestamp": STAMP,
        "is_current_version": "boolean",
    },
}
PRIMARY_KEY = {table: next(iter(columns)) for table, columns in ATOMIC.items()}

FOREIGN_KEYS = (
    ("product_category", "parent_category_id", "product_category", "product_category_id"),
    ("product", "product_category_id", "product_category", "product_category_id"),
    ("work_center", "site_id", "site", "site_id"),
    ("warehouse_zone", "site_id", "site", "site_id"),
    ("scenario_definition", "parent_scenario_id", "scenario_definition", "scenario_id"),
    ("demand_forecast_versions", "product_id", "product", "product_id"),
    ("demand_forecast_versions", "site_id", "site", "site_id"),
    ("demand_forecast_versions", "scenario_id", "scenario_definition", "scenario_id"),
    ("logistics_cost_fact", "site_id", "site", "site_id"),
    ("logistics_cost_fact", "warehouse_zone_id", "warehouse_zone", "warehouse_zone_id"),
    ("inventory_balance", "product_id", "product", "product_id"),
    ("inventory_balance", "site_id", "site", "site_id"),
    ("inventory_balance", "warehouse_zone_id", "warehouse_zone", "warehouse_zone_id"),
)

# The value lists the data model documents for its code columns.
ALLOWED_VALUES = {
    ("product", "product_type"): ("FINISHED_GOOD", "RAW_MATERIAL", "COMPONENT"),
    ("product", "product_status"): ("ACTIVE", "INACTIVE", "DISCONTINUED"),
    ("site", "site_type"): ("PLANT", "WAREHOUSE", "DISTRIBUTION_CENTER"),
    ("site", "operating_status"): ("ACTIVE", "INACTIVE", "SEASONAL"),
    ("work_center", "work_center_type"): ("ASSEMBLY", "FABRICATION", "PACKAGING"),
    ("warehouse_zone", "zone_type"): ("STANDARD", "COLD_STORAGE", "HAZMAT", "HIGH_VALUE"),
    ("scenario_definition", "scenario_type"): (
        "BASELINE",
        "MARKETING_PUSH",
        "CONSERVATIVE",
        "CUSTOM",
    ),
    ("demand_forecast_versions", "forecast_type"): ("DEMAND", "SUPPLY", "INVENTORY"),
}

# The file each raw table is loaded from, and source columns that stop in RAW.
RAW_FILES = {
    "product_category": "product_categories.csv",
    "product": "products.csv",
    "site": "sites.csv",
    "work_center": "work_centers.csv",
    "warehouse_zone": "warehouse_zones.csv",
    "scenario_definition": "scenario_definitions.csv",
    "demand_forecast_versions": "demand_forecasts.csv",
    "logistics_cost_fact": "logistics_costs.csv",
    "inventory_balance": "inventory_balances.csv",
}
RAW_ONLY = {"scenario_definition": ("created_date",)}
RAW_METADATA = ("_source_file_name", "_source_file_row_number", "_loaded_timestamp")

BUILD_PLAN = {
    "plan_id": ID,
    "product_id": ID,
    "work_center_id": ID,
    "scenario_id": ID,
    "production_week": "date",
    "fiscal_month": "string",
    "fiscal_quarter": "string",
    "recommended_quantity": MONEY,
    "current_capacity_available": MONEY,
    "capacity_utilization_pct": "decimal(5,2)",
    "projected_inventory": MONEY,
    "warehouse_utilization_pct": "decimal(5,2)",
    "projected_production_cost": "decimal(18,2)",
    "projected_storage_cost": "decimal(18,2)",
    "projected_total_cost": "decimal(18,2)",
    "model_version": "string",
    "model_confidence": "decimal(5,4)",
    "created_timestamp": STAMP,
}


def raw_columns(table: str) -> list[str]:
    """Source-file columns of a raw table, all text."""
    return [*ATOMIC[table], *RAW_ONLY.get(table, ())]


def columns_of(table: str) -> dict[str, str]:
    """Every stored column of an atomic table with its declared type."""
    columns = {**ATOMIC[table], **EXTRA.get(table, {})}
    if table in SCD_TABLES:
        columns.update(SCD)
    return {**columns, **AUDIT}


def struct_of(columns: dict[str, str]) -> T.StructType:
    """A declared column map as a Spark schema."""
    return T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in columns.items()))
