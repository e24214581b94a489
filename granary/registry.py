"""Every query by name, each a function of a session and a table folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.numbers import dec, present, safe_number
from granary.operators.current import current_rows, scd2_upsert
from granary.operators.durable import scratch_path, shuffles_released, written
from granary.operators.keys import dense_ids, next_id
from granary.plans import (
    build_plan,
    builder,
    capacity,
    dashboards,
    document_load,
    documents,
    golden,
    mart,
    metrics,
    quality,
    writeback,
)
from granary.plans import search as searching
from granary.schemas import ATOMIC, RAW_FILES
from granary.sources import driver_tables as driver
from granary.sources import load_ledger, raw_csv
from granary.sources.atomic import to_atomic, transform_raw_to_atomic
from granary.sources.driver_tables import as_of, driver_tables, read_driver_table
from granary.sources.tables import PlanningTables, read_tables, write_tables
from granary.streaming import kpi_deltas
from granary.streaming.kpis import kpi_stream, read_kpis, refresh_all_kpis
from granary.streaming.search_index import compact_index, index_stream, search_stored
from granary.streaming.versions import read_versions, version_history, version_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def over_tables(name: str, build: Callable[..., DataFrame], **options) -> None:
    """Register a data product that needs nothing but the planning tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(build(driver_tables(spark, sf_dir), **options))

    QUERIES[name] = run


def query(run: Query) -> Query:
    """Register a function under its own name."""
    QUERIES[run.__name__] = run
    return run


over_tables("scenario_comparison", mart.scenario_comparison)
over_tables(
    "scenario_comparison_site_avg",
    mart.scenario_comparison,
    cost_grain="site_avg",
    family_level=2,
)


def _kpis(t: PlanningTables, **options) -> DataFrame:
    return mart.scenario_kpis(t, as_of=as_of(), **options)


over_tables("scenario_kpis", _kpis)
over_tables("scenario_kpis_site_avg", _kpis, cost_grain="site_avg")
over_tables("production_capacity", mart.production_capacity)
over_tables("warehouse_utilization", mart.warehouse_utilization)
over_tables("warehouse_utilization_shared", mart.warehouse_utilization, allocation="capacity_share")
over_tables("inventory_buildup", mart.inventory_buildup)
over_tables("inventory_buildup_fiscal", mart.inventory_buildup, month_order="fiscal")


# Executive dashboard ---------------------------------------------------------

# Small enough that the benchmark's sites exceed it, as the reference's do.
BENCH_SITE_CAPACITY = 10_000
BENCH_REGION = "ASIA"
SCENARIO_CODES = ("BASELINE", "Q4_PUSH", "CONSERVATIVE")

over_tables("planning_stats", dashboards.planning_stats)
over_tables("scenario_summary", dashboards.scenario_summary)
over_tables("scenario_summary_site_avg", dashboards.scenario_summary, cost_grain="site_avg")
over_tables("warehouse_cost", dashboards.warehouse_cost, site_capacity=BENCH_SITE_CAPACITY)
over_tables("warehouse_cost_default", dashboards.warehouse_cost)
over_tables("headline_kpis_default", dashboards.headline_kpis)
over_tables("monthly_demand", dashboards.monthly_demand)
over_tables("available_scenarios", dashboards.available_scenarios)
over_tables("headline_kpis", dashboards.headline_kpis, site_capacity=BENCH_SITE_CAPACITY)
over_tables(
    "cost_matrix",
    dashboards.cost_matrix,
    scenarios=SCENARIO_CODES,
    site_capacity=BENCH_SITE_CAPACITY,
)
over_tables("demand_matrix", dashboards.demand_matrix, scenarios=SCENARIO_CODES)
over_tables("demand_increase", dashboards.demand_increase)
over_tables("bottleneck_site", dashboards.bottleneck_site, site_capacity=BENCH_SITE_CAPACITY)
over_tables("cost_verdict", lambda t: dashboards.cost_verdict(mart.scenario_kpis(t)))
over_tables(
    "monthly_demand_report",
    lambda t: dashboards.in_report_order(
        dashboards.monthly_demand(t), "scenario_code", "month_order"
    ),
)
over_tables(
    "demand_preview_rows",
    lambda t: dashboards.in_report_order(
        dashboards.monthly_demand(t), "scenario_code", "fiscal_month"
    ).limit(10),
)

# Capacity --------------------------------------------------------------------

over_tables("capacity_by_line", capacity.capacity_by_line)
over_tables("zone_status", capacity.zone_status)
over_tables("zones_at_risk", capacity.zones_at_risk)
over_tables("site_capacity", capacity.site_capacity)
over_tables("total_capacity", capacity.total_capacity)
over_tables("warehouse_totals", capacity.warehouse_totals)
over_tables("capacity_overview", capacity.capacity_overview)
over_tables("demand_vs_capacity", capacity.demand_vs_capacity)
over_tables("capacity_shortfalls", capacity.capacity_shortfalls, scenario="Q4_PUSH")

# Scenario builder ------------------------------------------------------------

over_tables("builder_scenarios", builder.scenarios_in_order)
over_tables("builder_products", builder.products)
over_tables("builder_sites", builder.sites)
over_tables("forecast_detail", builder.forecast_detail)
over_tables("scenario_detail", builder.scenario_detail, scenario_id=2)
over_tables(
    "scenario_month_totals", lambda t: builder.month_totals(builder.scenario_detail(t, 2))
)
over_tables("preview_percent", writeback.preview_adjustment, scenario_id=2, pct=15)
over_tables(
    "preview_units", writeback.preview_adjustment, scenario_id=2, units=100, quarter="Q4"
)
over_tables(
    "preview_units_per_row",
    writeback.preview_adjustment,
    scenario_id=2,
    units=100,
    per_row=True,
    cost_grain="site_avg",
)
over_tables(
    "preview_totals",
    lambda t: writeback.preview_totals(writeback.preview_adjustment(t, 2, pct=15)),
)

# Write-back ------------------------------------------------------------------


def _versions(forecasts: DataFrame) -> DataFrame:
    """Every row of a forecast table, as far as a write-back decides it."""
    return present(
        forecasts.select(
            "demand_forecast_id", "scenario_id", "product_id", "site_id", "is_current_version",
            "forecast_method", "forecast_type", "updated_by_user", "fiscal_month",
            "forecast_quantity", "total_revenue",
        )
    )


def _updates(t: PlanningTables) -> DataFrame:
    """New quantities for the whole Q4 push: 7 % more, halves included."""
    rows = t.demand_forecast_versions.where(
        (F.col("scenario_id") == 2) & F.col("is_current_version")
    )
    return rows.select(*writeback.UPDATE_FIELDS).withColumns(
        {
            "forecast_quantity": (
                F.col("forecast_quantity") * dec("1.07", "decimal(3,2)")
            ).cast("decimal(18,4)"),
            "forecast_method": F.lit(None).cast("string"),
        }
    )


def _submit(t: PlanningTables, numeric: str = "scale0") -> writeback.VersionChange:
    return writeback.submit_forecast_version(
        t.demand_forecast_versions, _updates(t), 2, "planner", as_of(), numeric
    )


over_tables("submit_version", lambda t: _versions(_submit(t).forecasts))
over_tables("submit_version_declared", lambda t: _versions(_submit(t, "declared").forecasts))
over_tables("submit_version_receipt", lambda t: _submit(t).receipt)


@query
def submit_json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The write-back fed with JSON arrays of one or two elements, some of them null."""
    t = driver_tables(spark, sf_dir, store_sales=True)
    line = F.struct(
        F.col("l_partkey").alias("PRODUCT_ID"),
        (F.col("l_suppkey") % 25).alias("SITE_ID"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("FORECAST_DATE"),
        (F.col("l_quantity") + 0.5).alias("FORECAST_QUANTITY"),
        F.lit(2.25).alias("UNIT_REVENUE"),
        F.date_format("l_shipdate", "MMMM").alias("FISCAL_MONTH"),
        F.when(F.col("l_linenumber") == 1, "SUPPLY").alias("FORECAST_TYPE"),
        F.lit("0.85").alias("CONFIDENCE_LEVEL"),
    )
    more = line.withField("FORECAST_QUANTITY", F.col("l_quantity") + 1.5)
    number = F.col("l_linenumber")
    elements = (
        F.when(number == 1, F.array(line, more))
        .when(number == 2, F.array(F.lit(None), line))
        .otherwise(F.array(line))
    )
    payloads = read_driver_table(spark, sf_dir, "lineitem").select(
        F.to_json(elements).alias("payload")
    )
    # Numbering the lines reads them twice, and parsing them is dear.
    updates = written(writeback.parse_updates(payloads), "updates")
    change = writeback.submit_forecast_version(
        t.demand_forecast_versions, updates, 3, "planner", as_of()
    )
    return _versions(change.forecasts.where(F.col("scenario_id") == 3))


@query
def dense_key_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogate keys for all line items in product order, on top of a maximum."""
    lines = read_driver_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"
    )
    return dense_ids(
        lines,
        ("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"),
        "key",
        next_id(read_driver_table(spark, sf_dir, "orders"), "o_orderkey"),
    )


def _copy(t: PlanningTables, mode: str) -> writeback.ScenarioCopy:
    return writeback.create_scenario_copy(
        t.scenario_definition,
        t.demand_forecast_versions,
        2,
        "RESIN_GAP",
        "Resin gap in autumn",
        "planner",
        as_of(),
        mode=mode,
    )


over_tables("copy_scenario", lambda t: _versions(_copy(t, "full").forecasts))
over_tables("copy_scenario_minimal", lambda t: _versions(_copy(t, "ui_minimal").forecasts))
over_tables(
    "copy_scenario_definitions",
    lambda t: _copy(t, "full").scenarios.select(
        "scenario_id",
        "scenario_code",
        "scenario_name",
        "scenario_description",
        "scenario_type",
        "is_official_baseline",
        "version_number",
        "parent_scenario_id",
    ),
)
over_tables(
    "copy_scenario_receipt", lambda t: writeback.receipt_json(_copy(t, "full").receipt)
)


def _adjusted(t: PlanningTables, **options) -> DataFrame:
    return _versions(writeback.adjust_forecast(t, 2, "planner", as_of(), **options))


over_tables("adjust_percent", _adjusted, pct=15, quarter="Q4")
over_tables("adjust_units", _adjusted, units=100, recompute_revenue=True)
over_tables("adjust_filtered", _adjusted, pct=-10, category="Brand#7 PROMO", site_id=6)


@query
def upsert_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close and reopen product versions: a third changed price, some are new."""
    t = driver_tables(spark, sf_dir)
    key = F.col("product_id")
    business = [c for c in ATOMIC["product"]]
    changes = (
        current_rows(t.product)
        .where(key % 3 != 2)
        .select(*business)
        .withColumn(
            "unit_price",
            F.when(key % 3 == 0, F.col("unit_price") + 5)
            .otherwise(F.col("unit_price"))
            .cast("decimal(18,4)"),
        )
        .withColumn("product_id", F.when(key % 30 == 0, key + 10_000_000).otherwise(key))
    )
    merged = scd2_upsert(t.product, changes, ["product_id"], as_of(), "planner")
    return present(
        merged.select(
            "product_id", "unit_price", "is_current_flag", "updated_by_user", "created_by_user",
            F.col("valid_to_timestamp").isNotNull().alias("closed"),
        )
    )


# Build plan ------------------------------------------------------------------

PLAN_SCENARIOS = ("BASELINE", "Q4_PUSH")
PLAN_KEYS = ("scenario_id", "scenario_code")

over_tables("plan_limits", build_plan.plan_limits)
over_tables("network_plan", build_plan.network_plan, scenarios=PLAN_SCENARIOS)
over_tables("site_plans", build_plan.site_plans, scenarios=PLAN_SCENARIOS)
over_tables(
    "product_plans", build_plan.product_plans, scenarios=PLAN_SCENARIOS, cost_grain="site_avg"
)


def _product_schedule(t: PlanningTables) -> DataFrame:
    return build_plan.schedule(
        build_plan.product_plans(t, PLAN_SCENARIOS, cost_grain="site_avg")
    )


over_tables("plan_schedule", _product_schedule)
over_tables(
    "plan_summary",
    lambda t: build_plan.plan_summary(_product_schedule(t), (*PLAN_KEYS, "product_id")),
)


@query
def stored_build_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store the plans of both scenarios, replace those of one, read them back."""
    t = driver_tables(spark, sf_dir)
    path = scratch_path(spark, "build-plan")
    rows = build_plan.build_plan_rows(t, _product_schedule(t), as_of())
    build_plan.write_build_plan(rows, path)
    stored = build_plan.write_build_plan(rows.where(F.col("scenario_id") == 2), path)
    view = capacity.build_plan_view(stored, t.scenario_definition)
    return present(
        view.groupBy("scenario_name", "fiscal_month", "fiscal_quarter", "model_version").agg(
            F.count("*").alias("row_count"),
            F.sum("recommended_quantity").alias("quantity"),
            F.sum("projected_inventory").alias("inventory"),
            F.sum("projected_total_cost").alias("cost"),
            F.max("model_confidence").alias("confidence"),
        )
    )


@query
def stored_product_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store the plans of two scenarios, ask one of them again without a feasible
    plan, and read back every row that remains, by product."""
    t = driver_tables(spark, sf_dir)
    path = scratch_path(spark, "product-plans")
    rows = build_plan.build_plan_rows(t, _product_schedule(t), as_of())
    build_plan.write_build_plan(rows.where(F.col("scenario_id") == 2), path)
    build_plan.write_build_plan(rows.where(F.col("scenario_id") != 2), path)
    asked = rows.where(F.col("scenario_id") != 2).select("scenario_id").distinct()
    stored = build_plan.write_build_plan(rows.limit(0), path, asked)
    return present(
        stored.select(
            F.col("plan_id").alias("plan_rank"),
            "scenario_id",
            "product_id",
            "fiscal_month",
            F.col("recommended_quantity").alias("quantity"),
            F.col("projected_inventory").alias("inventory"),
        )
    )


over_tables(
    "all_units",
    lambda t: present(
        t.demand_forecast_versions.where(
            (F.col("scenario_id") == 1) & F.col("is_current_version")
        ).agg(F.sum("forecast_quantity").alias("units"))
    ),
)


# Metrics ---------------------------------------------------------------------

over_tables("warehousing_cost_october", metrics.warehousing_cost_october)
over_tables("margin_impact", metrics.margin_impact)
over_tables("margin_percentages", metrics.margin_percentages)
over_tables("revenue_by_family", metrics.revenue_by_family)
over_tables("regional_storage", metrics.regional_storage, region=BENCH_REGION)
over_tables(
    "overflow_risk", lambda t: metrics.overflow_risk(mart.warehouse_utilization(t))
)
over_tables(
    "region_quarter_demand",
    metrics.metric_query,
    metrics=["total units"],
    dims=["area", "quarter"],
    filters=["baseline_only"],
)


def _all_metrics(t: PlanningTables) -> DataFrame:
    rows = metrics.metric_query(
        t,
        metrics=list(metrics.COMPARISON.metrics),
        dims=["scenario_code", "region", "fiscal_quarter"],
        filters=["q4_only"],
    )
    ratios = ("gross_margin_percentage", "average_confidence")
    return rows.withColumns({c: F.round(c, 6) for c in ratios})


over_tables("all_metrics", _all_metrics)
over_tables(
    "metric_facts",
    metrics.metric_query,
    facts=["units", "margin", "storage cost", "confidence_level"],
    dims=["product_id", "site_code", "date"],
    filters=["q4_push_only", "october"],
)

over_tables(
    "top_families",
    metrics.metric_query,
    metrics=["total revenue", "sum quantity"],
    dims=["scenario", "family"],
    order=["sum revenue desc", "scenario", "family"],
    limit=20,
)

# Quality ---------------------------------------------------------------------

over_tables("table_profile", lambda t: quality.table_profile(dict(t.items())))
over_tables(
    "catalog_profile",
    lambda t: quality.catalog_profile(
        {
            "SCENARIO_COMPARISON_V": mart.scenario_comparison(t),
            "DT_SCENARIO_KPI_SUMMARY": mart.scenario_kpis(t),
            "WAREHOUSE_UTILIZATION_PROJECTION": mart.warehouse_utilization(t),
            "INVENTORY_BUILDUP_CURVE": mart.inventory_buildup(t),
        }
    ),
)
EXPECTATIONS = [
    quality.Expectation(
        "table_totals", dashboards.planning_stats, "Totals over all planning tables", 1
    ),
    quality.Expectation(
        "quarter_totals", dashboards.scenario_summary, "Demand, revenue and cost of each quarter", 1
    ),
    quality.Expectation(
        "site_storage", dashboards.warehouse_cost, "Storage cost of each site in each scenario", 1
    ),
    quality.Expectation(
        "month_totals", dashboards.monthly_demand, "Units of each month in each scenario", 19
    ),
]
over_tables("expectations", quality.run_expectations, expectations=EXPECTATIONS)


@query
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All declared constraints, on tables with some broken rows mixed in."""
    t = driver_tables(spark, sf_dir, store_sales=True)
    forecasts = t.demand_forecast_versions
    broken = forecasts.where(F.col("site_id") == 3).withColumns(
        {
            "product_id": F.col("product_id") + 50_000_000,
            "forecast_type": F.lit("GUESS"),
        }
    )
    return quality.constraint_report(
        t.with_(demand_forecast_versions=forecasts.unionByName(broken))
    )


@query
def golden_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result against itself, against a changed copy, and without a target."""
    t = driver_tables(spark, sf_dir, store_sales=True)
    rows = t.demand_forecast_versions.select("product_id", "site_id", "forecast_quantity")
    changed = rows.withColumn(
        "forecast_quantity",
        F.when(F.col("site_id") == 3, F.col("forecast_quantity") + 1)
        .otherwise(F.col("forecast_quantity"))
        .cast("decimal(18,4)"),
    )
    return (
        quality.golden_check("same", rows, rows)
        .unionByName(quality.golden_check("changed", changed, rows))
        .unionByName(quality.golden_check("open", rows, None))
    )


@query
def golden_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden and verified queries against stored results, one altered, one never stored."""
    t = driver_tables(spark, sf_dir, store_sales=True)
    named = {
        "warehousing_cost_by_scenario_october": metrics.warehousing_cost_october(t),
        "margin_impact_q4_push": metrics.margin_percentages(t),
        "warehouse_overflow_risk": metrics.overflow_risk(mart.warehouse_utilization(t)),
        "revenue_by_product_family": metrics.revenue_by_family(t),
        "margin_impact_comparison": metrics.margin_impact(t),
        "northeast_capacity_impact": metrics.regional_storage(t, BENCH_REGION),
    }
    named = {name: present(df) for name, df in named.items()}
    expected = {name: scratch_path(spark, "expected") for name in named if name != "margin_impact_q4_push"}
    for name, folder in expected.items():
        df = named[name]
        if name == "revenue_by_product_family":
            money = F.col("total_forecasted_revenue")
            changed = money + F.when(F.col("scenario_code") == "BASELINE", 1).otherwise(0)
            df = df.withColumn("total_forecasted_revenue", changed.cast(df.schema["total_forecasted_revenue"].dataType))
        golden.store_result(df, folder)
    return golden.golden_run(spark, named, expected).drop("opened_buckets")


@query
def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents too long for a chunk column or with an overlong path."""
    docs = driver.documents(read_driver_table(spark, sf_dir, "documents"))
    return quality.too_long(docs, {"text": 16_000, "relative_path": 30})


# Documents -------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver.documents(read_driver_table(spark, sf_dir, "documents"))


def _attributes(spark: SparkSession, sf_dir: str, rules: str = "procedure") -> DataFrame:
    return documents.classify_documents(_documents(spark, sf_dir).drop("text"), rules)


@query
def classified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, vendor and region of every document by file name."""
    return _attributes(spark, sf_dir)


@query
def classified_documents_deploy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, vendor and region of every PDF by its whole path."""
    return _attributes(spark, sf_dir, "deploy")


@query
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in chunks of 500 words with dense ids."""
    docs = _documents(spark, sf_dir).select("document_id", "text")
    return documents.number_chunks(documents.chunk_documents(docs))


@query
def document_load_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their chunks after a load, one that failed, and one that added to it."""
    root = scratch_path(spark, "document-load")
    docs = _documents(spark, sf_dir).select("relative_path", "text")
    document_load.load_documents(docs, root)
    document_load.stage(docs, f"{root}/parts/failed", 7, 7)
    receipt = document_load.load_documents(docs, root, "append")
    metadata, chunks = document_load.read_documents(spark, root)
    totals = chunks.groupBy("document_id").agg(
        F.count("*").alias("n_chunks"),
        F.min("chunk_id").alias("first_chunk_id"),
        F.sum(F.char_length("chunk_text")).alias("n_chars"),
    )
    return metadata.join(totals, "document_id", "left").withColumn("receipt", F.lit(receipt))


@query
def document_chunks_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one chunk each, enriched with their metadata."""
    docs = documents.classify_documents(_documents(spark, sf_dir)).select(
        "document_id", "file_path", "text"
    )
    chunks = documents.number_chunks(documents.chunk_documents(docs, "whole"))
    return documents.search_results(
        chunks.withColumnRenamed("file_path", "relative_path"), _attributes(spark, sf_dir)
    )


def _benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_driver_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )


def _search_chunks(docs: DataFrame) -> DataFrame:
    return documents.chunk_documents(docs).withColumn(
        "chunk_id", F.concat_ws("#", "document_id", "chunk_index")
    )


@query
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best chunks for every benchmark passage."""
    docs = _documents(spark, sf_dir).select("document_id", "relative_path", "text")
    hits = searching.search_chunks(_search_chunks(docs), _benchmark_queries(spark, sf_dir))
    return hits.select("query_id", "rank", "chunk_id", "score", "relative_path", "chunk_text")


@query
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best chunks for every passage among one vendor's contracts."""
    docs = documents.classify_documents(_documents(spark, sf_dir)).drop(
        "effective_date", "expiry_date"
    )
    hits = searching.search_chunks(
        _search_chunks(docs),
        _benchmark_queries(spark, sf_dir),
        {"document_type": "CONTRACT", "vendor_name": "Northeast 3PL", "region": "Northeast"},
        k=2,
    )
    return hits.select("query_id", "rank", "chunk_id", "score", "file_path")


# Ingest ----------------------------------------------------------------------


def _write_csv(df: DataFrame, folder: str, table: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(f"{folder}/{RAW_FILES[table]}")


def _raw(spark: SparkSession, rows: DataFrame, table: str) -> DataFrame:
    folder = scratch_path(spark, "stage")
    _write_csv(rows, folder, table)
    return raw_csv.load_raw(spark, folder, table, as_of())


def _ingest_products(spark: SparkSession, sf_dir: str, numeric: str) -> DataFrame:
    text = driver.product_text(read_driver_table(spark, sf_dir, "part"))
    atomic = to_atomic(_raw(spark, text, "product"), "product", as_of(), numeric)
    return present(atomic.select(*ATOMIC["product"], "is_current_flag", "created_by_user"))


@query
def ingest_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A products file through RAW to ATOMIC, numbers rounded to scale 0."""
    return _ingest_products(spark, sf_dir, "scale0")


@query
def ingest_products_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A products file through RAW to ATOMIC under the declared scales."""
    return _ingest_products(spark, sf_dir, "declared")


@query
def ingest_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as a forecast file through RAW to ATOMIC."""
    text = driver.forecast_text(read_driver_table(spark, sf_dir, "lineitem"))
    raw = _raw(spark, text, "demand_forecast_versions")
    atomic = to_atomic(raw, "demand_forecast_versions", as_of())
    return present(
        atomic.select(
            "demand_forecast_id", "scenario_id", "product_id", "site_id", "forecast_date",
            "fiscal_year", "fiscal_month", "fiscal_quarter", "fiscal_period",
            "forecast_quantity", "confidence_level", "total_revenue",
        )
    )


def _stage(folder: str, table: str, rows: DataFrame) -> None:
    """A table as two compressed text files whose headers differ in order and case."""
    key = F.col(next(iter(ATOMIC[table])))
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in ATOMIC[table]])
    turned = [F.col(c).alias(c.upper()) for c in reversed(text.columns)]
    for name, part in (("a", text.where(key % 2 == 0)), ("b", text.where(key % 2 != 0).select(*turned))):
        part.write.option("header", True).option("escape", '"').option("compression", "snappy").csv(
            f"{folder}/{name}_{RAW_FILES[table]}"
        )


@query
def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with too few or too many fields of two product files with other headers."""
    folder = scratch_path(spark, "stage")
    parts = read_driver_table(spark, sf_dir, "part")
    brand = F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand"))
    surplus = F.when(F.col("p_partkey") % 7 == 0, F.lit("surplus"))
    files = {
        "product_id,product_name,product_code": ("p_partkey", "p_name", brand, surplus),
        "product_name,product_id,product_code": ("p_name", "p_partkey", brand, surplus),
    }
    for number, (header, fields) in enumerate(files.items()):
        lines = parts.where(F.col("p_partkey") % 2 == number).select(F.concat_ws(",", *fields).alias(header))
        lines.write.option("header", True).option("sep", "\u0001").csv(f"{folder}/{number}_{RAW_FILES['product']}")
    return raw_csv.rejected_rows(spark, folder, "product").withColumn(
        "source_file", F.regexp_extract("source_file", "([0-9]_[^/]*)/[^/]*$", 1)
    )


@query
def second_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three product files in two loads, the second of which meets one known and one new file."""
    folder, root = scratch_path(spark, "stage"), scratch_path(spark, "raw")
    parts = read_driver_table(spark, sf_dir, "part")
    for number in range(3):
        lines = parts.where(F.col("p_partkey") % 3 == number)
        cells = [F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name")]
        lines.coalesce(1).sortWithinPartitions("p_partkey").select(*cells).write.option("header", True).csv(
            f"{folder}/{number}_{RAW_FILES['product']}"
        )
        if number:
            load_ledger.load_new_files(spark, folder, root, "product")
    return load_ledger.read_loads(spark, root, "product").select(
        "product_id", "product_name", F.col("number").alias("load_number"),
        F.col("_source_file_row_number").alias("row_number"),
    )


def _current(t: PlanningTables, table: str) -> DataFrame:
    rows = getattr(t, table)
    flag = [c for c in ("is_current_flag", "is_current_version") if c in rows.columns]
    return rows.where(flag[0]) if flag else rows


def _ingest(table: str, numeric: str = "declared", multi_line: bool = False, **changed: str) -> Query:
    """A query that sends the current rows of a table through text files, RAW and ATOMIC."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch_path(spark, "stage")
        rows = _current(driver_tables(spark, sf_dir), table)
        _stage(folder, table, rows.withColumns({c: F.expr(e) for c, e in changed.items()}))
        raw = raw_csv.load_raw(spark, folder, table, as_of(), multi_line)
        return present(to_atomic(raw, table, as_of(), numeric).select(*ATOMIC[table]))

    return run


QUERIES["ingest_categories"] = _ingest("product_category")
QUERIES["ingest_sites"] = _ingest("site", "scale0")
QUERIES["ingest_work_centers"] = _ingest("work_center")
QUERIES["ingest_zones"] = _ingest("warehouse_zone", "scale0")
# Booleans in words, line breaks in quotes.
QUERIES["ingest_scenarios"] = _ingest(
    "scenario_definition",
    multi_line=True,
    is_official_baseline="if(is_official_baseline, 'on', 'no')",
    scenario_description="concat('About\n\"', scenario_name, '\"')",
)
QUERIES["ingest_costs"] = _ingest("logistics_cost_fact")
QUERIES["ingest_inventory"] = _ingest("inventory_balance", "scale0")


def _stage_all(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch_path(spark, "stage")
    t = driver_tables(spark, sf_dir, store_sales=True)
    for table in RAW_FILES:
        _stage(folder, table, _current(t, table))
    return folder


@query
def staged_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each raw table after all nine files were loaded."""
    folder = _stage_all(spark, sf_dir)
    return raw_csv.load_staged_data(spark, folder, scratch_path(spark, "raw"))


@query
def ingest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine files through RAW to ATOMIC, and the KPI table from what was stored."""
    raw, root = scratch_path(spark, "raw"), scratch_path(spark, "atomic")
    raw_csv.load_staged_data(spark, _stage_all(spark, sf_dir), raw)
    transform_raw_to_atomic(spark, raw, root, as_of(), "declared")
    return present(_kpis(read_tables(spark, root)))


@query
def usable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values with null, NaN and infinite ones replaced by zero."""
    events = read_driver_table(spark, sf_dir, "events")
    value, kind = F.col("value"), F.col("event_id") % 5
    broken = (
        F.when(kind == 0, F.lit(None)).when(kind == 1, F.lit(float("nan")))
        .when(kind == 2, -F.lit(float("inf"))).otherwise(value)
    )
    return events.select("event_id", safe_number(broken).alias("value"))


@query
def raw_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loading a file twice: appended rows double, overwritten rows do not."""
    text = driver.product_text(read_driver_table(spark, sf_dir, "part"))
    raw = _raw(spark, text, "product")
    counts = []
    for mode in ("append", "overwrite"):
        root = scratch_path(spark, "raw")
        raw_csv.append_raw(raw, root, "product", mode)
        raw_csv.append_raw(raw, root, "product", mode)
        stored = spark.read.parquet(f"{root}/product_stage")
        counts.append(
            stored.agg(F.count("*").alias("row_count"), F.count("_source_file_name").alias("named"))
            .withColumn("mode", F.lit(mode))
        )
    return counts[0].unionByName(counts[1])


@query
def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables written and read back: the KPI table from storage."""
    root = scratch_path(spark, "atomic")
    write_tables(driver_tables(spark, sf_dir), root)
    return present(_kpis(read_tables(spark, root)))


# Streaming -------------------------------------------------------------------


def _event_files(spark: SparkSession, sf_dir: str) -> str:
    """The events as four files in time order, for a stream of four batches."""
    folder = scratch_path(spark, "events")
    events = read_driver_table(spark, sf_dir, "events")
    events.repartitionByRange(4, "ts").write.parquet(folder)
    return folder


def _submission_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _event_files(spark, sf_dir)
    schema = read_driver_table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return driver.submissions(stream)


@query
def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions submitted as a stream: history and what is current."""
    root = scratch_path(spark, "versions")
    version_stream(
        _submission_stream(spark, sf_dir), root, f"{root}/checkpoint", {"availableNow": True}
    ).awaitTermination()
    history = version_history(read_versions(spark, root))
    return present(
        history.select(
            "scenario_id", "is_current_version", "version_timestamp", "product_id", "site_id",
            "fiscal_month", "forecast_quantity", "total_revenue",
        )
    )


@query
def stream_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The KPI table maintained while versions stream in."""
    root = scratch_path(spark, "kpis")
    kpi_stream(
        _submission_stream(spark, sf_dir),
        driver_tables(spark, sf_dir),
        root,
        f"{root}/checkpoint",
        {"availableNow": True},
        as_of(),
    ).awaitTermination()
    return present(read_kpis(spark, root))


@query
def stream_kpis_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The KPI table of every scenario: one is submitted anew, then all rates rise."""
    root = scratch_path(spark, "kpis")
    t = driver_tables(spark, sf_dir, store_sales=True)
    refresh_all_kpis(spark, t, root, as_of())
    pushed = _submission_stream(spark, sf_dir).where(F.col("scenario_id") == 2)
    kpi_stream(
        pushed, t, root, f"{root}/checkpoint", {"availableNow": True}, as_of()
    ).awaitTermination()
    rate = "storage_cost_per_pallet_per_day"
    dearer = t.logistics_cost_fact.withColumn(rate, (F.col(rate) + 1).cast("decimal(18,4)"))
    refresh_all_kpis(spark, t.with_(logistics_cost_fact=dearer), root, as_of())
    return present(read_kpis(spark, root))


def _base_changes(t: PlanningTables) -> list[DataFrame]:
    """All rows but some forecasts, then inserts, updates and deletes of every base table."""
    forecasts, costs = t.demand_forecast_versions, t.logistics_cost_fact
    late, dropped = F.col("demand_forecast_id") % 10 == 3, F.col("demand_forecast_id") % 11 == 5
    dearer = t.product.where("product_id % 7 = 0")
    withdrawn = t.product.where("product_id % 13 = 4")
    raised = costs.where("site_id % 4 = 1")
    rate = "storage_cost_per_pallet_per_day"
    cautious = t.scenario_definition.where("scenario_id = 3")
    return [
        kpi_deltas.all_rows(t.with_(demand_forecast_versions=forecasts.where(~late))),
        kpi_deltas.signed_rows("demand_forecast_versions", forecasts.where(late)).unionAll(
            kpi_deltas.changed_rows(
                "product", dearer, dearer.withColumn("unit_cost", F.col("unit_cost") + dec("1.25"))
            )
        ),
        kpi_deltas.changed_rows(
            "logistics_cost_fact", raised, raised.withColumn(rate, F.col(rate) + 1)
        ).unionAll(kpi_deltas.signed_rows("demand_forecast_versions", forecasts.where(dropped), -1)),
        kpi_deltas.signed_rows("site", t.site.where("site_id % 8 = 6"), -1)
        .unionAll(
            kpi_deltas.signed_rows("product", withdrawn.where("product_id % 7 <> 0"), -1)
        )
        .unionAll(
            kpi_deltas.changed_rows(
                "scenario_definition", cautious,
                cautious.withColumn("scenario_name", F.lit("Cautious Estimate")),
            )
        ),
    ]


@query
def stream_kpis_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The KPI table that follows inserts, updates and deletes of every base table."""
    root = scratch_path(spark, "kpi-changes")
    for changes in _base_changes(driver_tables(spark, sf_dir, store_sales=True)):
        # What has landed since the last run of the stream is one batch, in any number of files.
        with shuffles_released(spark):
            changes.write.mode("append").option("compression", "zstd").parquet(f"{root}/incoming")
        stream = spark.readStream.schema(changes.schema).option("cleanSource", "delete")
        kpi_deltas.change_stream(
            stream.parquet(f"{root}/incoming"), root, f"{root}/checkpoint", {"availableNow": True}
        ).awaitTermination()
    return present(kpi_deltas.read_followed_kpis(spark, root, as_of()))


#: Batches in which the documents of a search stream arrive.
ARRIVALS = 3


def _arriving(rows: DataFrame, splits: int, folder: str, *keys: str) -> DataFrame:
    """The rows as files, one per split and batch, and the stream of their batches."""
    rows.repartition(ARRIVALS * splits, *keys).write.parquet(folder)
    stream = rows.sparkSession.readStream.schema(rows.schema)
    return stream.option("maxFilesPerTrigger", splits).parquet(folder)


@query
def stream_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over an index built from a stream of documents."""
    root = scratch_path(spark, "search")
    docs = read_driver_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), "text"
    )
    stream = _arriving(docs, docs.rdd.getNumPartitions(), f"{root}/incoming", "document_id")
    index_stream(stream, root, f"{root}/checkpoint", {"availableNow": True}).awaitTermination()
    hits = search_stored(spark, root, _benchmark_queries(spark, sf_dir))
    return hits.select("query_id", "rank", "chunk_id", "score")


def _land(changes: DataFrame, turn: int, folder: str) -> None:
    """Add to the folder what arrives in one turn of all that is sent about each document.

    A document is sent as a draft and in its final form, an old one comes and is
    withdrawn. Each of the four comes in a turn drawn by itself, so versions meet
    in a batch or arrive late. Texts are multiplied as they are written, behind
    the one shuffle that spread the documents.
    """
    sent = F.array(
        *[
            F.struct(*[F.lit(v).alias(n) for n, v in zip(("old", "version", "deleted"), form)])
            for form in ((False, 2, False), (False, 1, False), (True, 1, False), (True, 2, True))
        ]
    )
    drawn = F.xxhash64("document_id", F.col("_sent.old"), F.col("_sent.version"))
    due = F.pmod(drawn, F.lit(ARRIVALS)) == turn
    draft = ~F.col("_sent.old") & (F.col("_sent.version") == 1)
    changes.select("*", F.explode(sent).alias("_sent")).where(due).select(
        F.when(F.col("_sent.old"), F.concat(F.lit("old"), "document_id"))
        .otherwise(F.col("document_id")).alias("document_id"),
        "_sent.version", "_sent.deleted", "relative_path",
        F.when(draft, F.concat_ws(" ", F.lit("draft"), "text", "text"))
        .otherwise(F.col("text")).alias("text"),
        "document_type", "vendor_name", "region",
    ).write.mode("append").option("compression", "zstd").parquet(folder)


def _updated_index(spark: SparkSession, sf_dir: str) -> str:
    """An index of all documents, each sent first as a draft, and of withdrawn ones."""
    root = scratch_path(spark, "search")
    about = documents.classify_documents(_documents(spark, sf_dir)).select(
        "document_id", "document_type", "vendor_name", "region"
    )
    docs = _documents(spark, sf_dir).select("document_id", "relative_path", "text")
    spread = docs.repartition(4 * docs.rdd.getNumPartitions(), "document_id")
    known = spread.join(about, "document_id", "left")
    known = known.withColumn("document_id", F.col("document_id").cast("string"))
    changes = written(known, "changes", "zstd")
    for turn in range(ARRIVALS):
        # What has landed since the last run of the stream is one batch, in any number of files.
        _land(changes, turn, f"{root}/incoming")
        sent = spark.read.parquet(f"{root}/incoming").schema
        stream = spark.readStream.schema(sent).option("cleanSource", "delete")
        index_stream(
            stream.parquet(f"{root}/incoming"), root, f"{root}/checkpoint", {"availableNow": True},
            attributes=("relative_path", "document_type", "vendor_name", "region"),
        ).awaitTermination()
    return root


@query
def stream_search_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, with texts, after every document changed and others were withdrawn."""
    root = _updated_index(spark, sf_dir)
    hits = search_stored(spark, root, _benchmark_queries(spark, sf_dir))
    return hits.select(
        "query_id", "rank", "chunk_id", "score",
        F.col("attributes")["relative_path"].alias("relative_path"), "chunk_text",
    )


@query
def stream_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered search in the changed index after it was compacted."""
    root = _updated_index(spark, sf_dir)
    compact_index(spark, root, f"{root}/compacted")
    hits = search_stored(
        spark, f"{root}/compacted", _benchmark_queries(spark, sf_dir), 2,
        {"document_type": "CONTRACT", "vendor_name": "Northeast 3PL", "region": "Northeast"},
    )
    return hits.select(
        "query_id", "rank", "chunk_id", "score",
        F.col("attributes")["relative_path"].alias("file_path"),
    )
