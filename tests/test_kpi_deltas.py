"""KPIs that follow signed changes against the KPIs of the changed tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from granary.plans import mart
from granary.sources.driver_tables import as_of
from granary.streaming import kpi_deltas as deltas

LEFT_OUT = "_refreshed_timestamp"


def _rows(df):
    return sorted((tuple(str(v) for v in r) for r in df.drop(LEFT_OUT).collect()))


def _same(spark, root, t):
    found = deltas.read_followed_kpis(spark, root, as_of())
    wanted = mart.scenario_kpis(t, as_of=as_of()).select(*found.columns)
    cost, margin = "total_forecasted_cost", "total_gross_margin"
    shorter = lambda df: df.withColumns(
        {c: F.round(c, 4).cast("double") for c, kind in df.dtypes if kind.startswith("decimal")}
    )
    assert cost in found.columns and margin in found.columns
    assert _rows(shorter(found)) == _rows(shorter(wanted))


def test_every_kind_of_change_is_followed(spark, tables, tmp_path):
    root = str(tmp_path / "kpis")
    deltas.apply_changes(deltas.all_rows(tables), 0, root)
    _same(spark, root, tables)
    t = tables
    rate, null = "storage_cost_per_pallet_per_day", lambda kind: F.lit(None).cast(kind)
    cost = F.when(F.col("product_id") == 10, 1).otherwise(F.col("unit_cost")).cast("decimal(18,4)")
    steps = [
        ("product", lambda df: df.withColumn("unit_cost", cost).where("product_id <> 99")),
        ("logistics_cost_fact", lambda df: df.where("site_id <> 5").withColumn(rate, null("decimal(18,4)"))),
        ("site", lambda df: df.where("site_id <> 1").unionAll(df.where("site_id = 3"))),
        ("scenario_definition", lambda df: df.withColumn("scenario_name", F.concat(F.lit("New "), "scenario_name")).where("scenario_id <> 2")),
        ("demand_forecast_versions", lambda df: df.withColumns({"forecast_quantity": null("decimal(18,4)"), "total_revenue": null("decimal(18,2)")})),
        ("demand_forecast_versions", lambda df: df.where("false")),
    ]
    for batch_id, (name, change) in enumerate(steps, 1):
        before = getattr(t, name)
        after = change(before)
        deltas.apply_changes(deltas.changed_rows(name, before, after), batch_id, root, merge_at=3)
        t = t.with_(**{name: after})
        if batch_id in (1, 3):  # a batch may come again
            deltas.apply_changes(deltas.changed_rows(name, before, after), batch_id, root, merge_at=3)
        _same(spark, root, t)
    assert deltas.read_followed_kpis(spark, root).count() == 0
    assert len(deltas.CELLS.folders(spark, root)) <= 4  # merged on the way


def test_random_changes_in_any_order(spark, tables, tmp_path):
    rng = random.Random(3)
    forecasts = tables.demand_forecast_versions
    grown = forecasts
    for k in range(3):
        grown = grown.unionAll(forecasts.withColumns({
            "demand_forecast_id": F.col("demand_forecast_id") + 100 * (k + 1),
            "site_id": F.lit(rng.randrange(1, 6)).cast("bigint"), "scenario_id": F.lit(rng.randrange(1, 4)).cast("bigint"),
            "forecast_quantity": F.lit(rng.randrange(1, 10**6) / 1000).cast("decimal(18,4)"),
        }))
    batches = [
        deltas.all_rows(tables),
        deltas.changed_rows("demand_forecast_versions", forecasts, grown),
        deltas.changed_rows("product", tables.product, tables.product.withColumn("unit_cost", (F.col("unit_cost") * 2).cast("decimal(18,4)"))),
    ]
    after = tables.with_(
        demand_forecast_versions=grown,
        product=tables.product.withColumn("unit_cost", (F.col("unit_cost") * 2).cast("decimal(18,4)")),
    )
    for order in ((0, 1, 2), (2, 1, 0)):
        root = str(tmp_path / "".join(map(str, order)))
        for batch_id, k in enumerate(order):
            deltas.apply_changes(batches[k], batch_id, root)
        _same(spark, root, after)


def test_a_price_reads_only_the_files_of_its_products(spark, tmp_path):
    root = str(tmp_path / "kpis")
    lines = spark.range(4000).selectExpr(
        "0 AS product_bucket", "0 AS site_bucket", "1L AS scenario_id", "id % 40 AS product_id", "id % 25 AS site_id",
        "CAST(id AS decimal(18,4)) AS quantity", "1L AS n", "CAST(1 AS decimal(38,2)) AS revenue", "1L AS n_revenue",
    ).withColumns({"product_bucket": deltas._bucket("product_id"), "site_bucket": deltas._bucket("site_id")})
    deltas.CELLS.add(lines, root, 0)
    everything = deltas.CELLS.rows(spark, root, 1)
    ids = spark.createDataFrame([(7,)], "product_id bigint")
    read = deltas.touched_cells(spark, root, 1, ids, "product_id")
    assert read.count() == 100
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "product_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    bucket = spark.range(1).select(deltas._bucket("id")).where("false").count()
    met = lines.where("product_id = 7").select("product_bucket").first()[0]
    files = [f for f in everything.inputFiles() if f"product_bucket={met}/" in f]
    opened = lines.where(F.col("product_bucket") == met).count()
    assert bucket == 0 and 0 < len(files) < len(everything.inputFiles()) / 2 and opened < 2000


def test_no_batch_yet(spark, tmp_path):
    assert deltas.read_followed_kpis(spark, str(tmp_path / "none")).count() == 0
