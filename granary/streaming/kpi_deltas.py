"""The KPI table kept up to date by signed changes of its base tables.

A change is a row with a sign: a new row comes with +1, a removed one with -1, an
update as both. The KPIs are sums over forecasts x products x site profiles, so a
batch adds three products, each with one changed side::

    changed forecasts x products before x sites before
    forecasts now     x changed products x sites before
    forecasts now     x products now     x changed sites

The second and third read only the forecast cells of the products and sites that
changed; unchanged forecasts are not read. A product with a side that has no row
yet is left out. The effects are linear in the number of lines, so cells need not
be summed before, and are stored as sums by product and by site. Distinct products and sites are
counted by their multiplicities, which a batch changes for its own pairs alone.
Changes commute, so batches may come in any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.constants import DEFAULT_STORAGE_RATE
from granary.functions.numbers import dec, storage_cost
from granary.operators.current import current_rows, current_versions
from granary.operators.durable import shuffles_released, written
from granary.plans.mart import KPI_KEYS, kpi_columns
from granary.sources.tables import PlanningTables
from granary.streaming.signed import MERGE_AT, SignedTable
from granary.streaming.versions import start

BUCKETS = 8
_RATE = "storage_cost_per_pallet_per_day"
_SCENARIO = {
    "scenario_id": "bigint", "scenario_code": "string", "scenario_name": "string",
    "scenario_type": "string", "is_official_baseline": "boolean",
}
# One row of any base table with its sign; columns of other tables are null.
CHANGE = {
    "kind": "string", "sign": "int", **_SCENARIO, "product_id": "bigint", "site_id": "bigint",
    "quantity": "decimal(18,4)", "revenue": "decimal(18,2)", "unit_cost": "decimal(18,4)", "rate": "decimal(18,4)",
}
# Forecast lines: equal ones are one cell with their number.
CELLS = SignedTable(
    "cells",
    {
        "product_bucket": "int", "site_bucket": "int", "scenario_id": "bigint", "product_id": "bigint",
        "site_id": "bigint", "quantity": "decimal(18,4)",
    },
    {"n": "bigint", "revenue": "decimal(38,2)", "n_revenue": "bigint"},
    ("product_bucket", "site_bucket"),
)
PRODUCTS = SignedTable("products", {"product_id": "bigint", "unit_cost": "decimal(18,4)"}, {"n": "bigint"})
SITES = SignedTable("sites", {"site_id": "bigint"}, {"n": "bigint"})
RATES = SignedTable("rates", {"site_id": "bigint", "rate": "decimal(18,4)"}, {"n": "bigint"})
SCENARIOS = SignedTable("scenarios", _SCENARIO, {"n": "bigint"})
BY_PRODUCT = SignedTable("by_product", {"scenario_id": "bigint", "product_id": "bigint"}, {"n": "bigint"})
BY_SITE = SignedTable("by_site", {"scenario_id": "bigint", "site_id": "bigint"}, {"n": "bigint"})
# Values with the number of lines that have one, as a sum over none is null.
_SUMS = {
    "n": "bigint", "quantity": "decimal(38,4)", "n_quantity": "bigint", "revenue": "decimal(38,2)",
    "n_revenue": "bigint", "cost": "decimal(38,8)", "n_cost": "bigint", "storage": "decimal(38,2)",
}
TOTALS = SignedTable(
    "totals", {"scenario_id": "bigint"}, {**_SUMS, "product_count": "bigint", "site_count": "bigint"}
)
# The base table that each state follows.
_KEPT = {
    CELLS: "demand_forecast_versions", PRODUCTS: "product", SITES: "site",
    RATES: "logistics_cost_fact", SCENARIOS: "scenario_definition",
}
_ALL = (*_KEPT, BY_PRODUCT, BY_SITE, TOTALS)
# kind: (rows in force, the columns that the KPIs read)
_TAKEN = {
    "demand_forecast_versions": (
        current_versions,
        {
            "scenario_id": "scenario_id", "product_id": "product_id", "site_id": "site_id",
            "quantity": "forecast_quantity", "revenue": "total_revenue",
        },
    ),
    "product": (current_rows, {"product_id": "product_id", "unit_cost": "unit_cost"}),
    "site": (current_rows, {"site_id": "site_id"}),
    "logistics_cost_fact": (current_rows, {"site_id": "site_id", "rate": _RATE}),
    "scenario_definition": (lambda df: df, {n: n for n in _SCENARIO}),
}


def signed_rows(table: str, rows: DataFrame, sign: int = 1) -> DataFrame:
    """Rows of a base table as changes; rows not in force are no part of the KPIs."""
    in_force, taken = _TAKEN[table]
    values = {"kind": F.lit(table), "sign": F.lit(sign), **{n: F.col(c) for n, c in taken.items()}}
    return in_force(rows).select(
        *[values.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in CHANGE.items()]
    )


def changed_rows(table: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """The changes that lead from ``before`` to ``after``; equal rows cancel out."""
    return signed_rows(table, before, -1).unionAll(signed_rows(table, after))


def all_rows(t: PlanningTables) -> DataFrame:
    """Every base row as an insert, to begin with."""
    return reduce(DataFrame.unionAll, [signed_rows(name, getattr(t, name)) for name in _TAKEN])


def _bucket(column: str) -> Column:
    return F.pmod(F.hash(column), F.lit(BUCKETS)).cast("int")


def touched_cells(spark: SparkSession, root: str, before: int, ids: DataFrame, key: str) -> DataFrame:
    """Forecast cells of the given products or sites; files of other buckets stay closed.

    A cell may come as several rows, one for each batch that changed it.
    """
    bucket = key.replace("_id", "_bucket")
    met = [r[0] for r in ids.select(_bucket(key)).distinct().collect()]  # at most BUCKETS numbers
    cells = CELLS.rows(spark, root, before, F.col(bucket).isin(met))
    return cells.join(ids.select(key).distinct(), key, "left_semi")


def _profile(sites: DataFrame, rates: DataFrame) -> DataFrame:
    """``site_id, rate, w``: how often a line of the site counts at each rate."""
    times = rates.withColumnRenamed("n", "times")
    return sites.join(times, "site_id", "left").select(
        "site_id",
        F.coalesce("rate", dec(DEFAULT_STORAGE_RATE)).alias("rate"),
        (F.col("n") * F.coalesce("times", F.lit(1))).alias("w"),
    )


def _effects(cells: DataFrame, products: DataFrame, profile: DataFrame) -> DataFrame:
    """What cells x products x sites add to every scenario, product and site."""
    # Stored, few sites are known to be few, and no cell is shuffled to meet them.
    per_site = written(
        profile.groupBy("site_id").agg(
            F.collect_list(F.struct("rate", "w")).alias("_rates"), F.sum("w").alias("_w")
        ),
        "profile",
    )
    quantity = F.col("quantity")
    k = F.col("n") * F.col("_p")
    times = (k * F.col("_w")).cast("decimal(10,0)")
    none = F.lit("0").cast("decimal(38,2)")
    stored = F.aggregate(
        "_rates", none,
        lambda total, r: (
            total + F.coalesce(storage_cost(quantity, r["rate"]), F.lit(0)) * (k * r["w"]).cast("decimal(10,0)")
        ).cast("decimal(38,2)"),
    )
    cost = (quantity * F.col("unit_cost")).cast("decimal(27,8)")

    def known(value: Column) -> Column:
        return F.when(value.isNotNull(), k * F.col("_w")).otherwise(0)

    joined = cells.join(products.withColumnRenamed("n", "_p"), "product_id").join(per_site, "site_id")
    # The lambda sees the aliases of its own select, so the storage cost comes before.
    return joined.withColumn("_stored", stored).select(
        "scenario_id", "product_id", "site_id",
        (k * F.col("_w")).alias("n"),
        (quantity * times).cast("decimal(38,4)").alias("quantity"), known(quantity).alias("n_quantity"),
        (F.col("revenue") * (F.col("_p") * F.col("_w")).cast("decimal(10,0)")).cast("decimal(38,2)").alias("revenue"),
        (F.col("n_revenue") * F.col("_p") * F.col("_w")).alias("n_revenue"),
        (cost * times).cast("decimal(38,8)").alias("cost"), known(cost).alias("n_cost"),
        F.col("_stored").alias("storage"),
    )


def _appeared(table: SignedTable, spark: SparkSession, root: str, batch_id: int, count: str) -> DataFrame:
    """By how much the number of keys with lines changes in each scenario."""
    touched = table.own(spark, root, batch_id)
    before = table.state(spark, root, batch_id).withColumnRenamed("n", "_old")
    old = F.coalesce("_old", F.lit(0))
    now = old + F.col("n")
    return touched.join(before, list(table.keys), "left").groupBy("scenario_id").agg(
        F.sum((now > 0).cast("int") - (old > 0).cast("int")).cast("bigint").alias(count)
    )


def _cells(changes: DataFrame) -> DataFrame:
    return changes.select(
        _bucket("product_id").alias("product_bucket"), _bucket("site_id").alias("site_bucket"),
        "scenario_id", "product_id", "site_id", "quantity", F.col("sign").alias("n"),
        (F.col("revenue") * F.col("sign")).alias("revenue"),
        F.when(F.col("revenue").isNotNull(), F.col("sign")).otherwise(0).alias("n_revenue"),
    )


def apply_changes(batch: DataFrame, batch_id: int, root: str, merge_at: int = MERGE_AT) -> None:
    """Bring the stored KPIs up to date with one batch of changes.

    Applying a batch again gives the same folders. The totals are written last;
    readers take the batches whose totals are complete.
    """
    with shuffles_released(batch.sparkSession):
        _apply(batch, batch_id, root, merge_at)


def _apply(batch: DataFrame, batch_id: int, root: str, merge_at: int) -> None:
    spark = batch.sparkSession
    for table in _ALL:
        table.merge(spark, root, batch_id, merge_at)
    path = f"{root}/changes/batch={batch_id}"
    batch.select(*[F.col(n).cast(kind) for n, kind in CHANGE.items()]).write.mode("overwrite").option(
        "compression", "zstd"
    ).parquet(path)
    changes = spark.read.schema(", ".join(f"{n} {k}" for n, k in CHANGE.items())).parquet(path)

    kinds = {r[0] for r in changes.select("kind").distinct().collect()}  # one row per base table at most
    old, new = batch_id, batch_id + 1
    for table, source in _KEPT.items():
        if source in kinds:
            of = changes.where(F.col("kind") == source)
            table.add(_cells(of) if table is CELLS else of.withColumn("n", F.col("sign")), root, batch_id)

    def state(table: SignedTable, before: int) -> DataFrame:
        return table.state(spark, root, before)

    def own(table: SignedTable) -> DataFrame:
        return table.own(spark, root, batch_id)

    def begun(table: SignedTable, before: int) -> bool:
        return bool(table.folders(spark, root, before))

    terms = []
    if "demand_forecast_versions" in kinds and begun(PRODUCTS, old) and begun(SITES, old):
        profile = _profile(state(SITES, old), state(RATES, old))
        terms.append(_effects(own(CELLS), state(PRODUCTS, old), profile))
    if "product" in kinds and begun(CELLS, new) and begun(SITES, old):
        profile = _profile(state(SITES, old), state(RATES, old))
        cells = touched_cells(spark, root, new, own(PRODUCTS), "product_id")
        terms.append(_effects(cells, own(PRODUCTS), profile))
    met = [own(table).select("site_id") for table in (SITES, RATES) if _KEPT[table] in kinds]
    if met and begun(CELLS, new) and begun(PRODUCTS, new):
        ids = reduce(DataFrame.union, met).distinct()
        before, after = (
            _profile(state(SITES, at).join(ids, "site_id", "left_semi"), state(RATES, at)) for at in (old, new)
        )
        moved = (
            after.unionAll(before.withColumn("w", -F.col("w")))
            .groupBy("site_id", "rate").agg(F.sum("w").alias("w")).where("w <> 0")
        )
        cells = touched_cells(spark, root, new, ids, "site_id")
        terms.append(_effects(cells, state(PRODUCTS, new), moved))
    if not terms:  # scenarios alone, or nothing to multiply
        TOTALS.add(spark.createDataFrame([], TOTALS.schema), root, batch_id)
        return
    sums = [F.sum(n).cast(kind).alias(n) for n, kind in _SUMS.items()]
    by = ["scenario_id", "product_id"], ["scenario_id", "site_id"]
    effects = written(
        reduce(DataFrame.unionAll, terms)
        .groupingSets(by, "scenario_id", "product_id", "site_id").agg(*sums),
        "effects", "zstd",
    )
    # Every effect has a product and a site: the other one is null in its sum.
    by_product = effects.where("product_id IS NOT NULL")
    BY_PRODUCT.add(by_product, root, batch_id)
    BY_SITE.add(effects.where("site_id IS NOT NULL"), root, batch_id)
    counts = _appeared(BY_PRODUCT, spark, root, batch_id, "product_count").join(
        _appeared(BY_SITE, spark, root, batch_id, "site_count"), "scenario_id", "full"
    )
    totals = by_product.groupBy("scenario_id").agg(*[F.sum(n).alias(n) for n in _SUMS])
    TOTALS.add(totals.join(counts, "scenario_id", "left"), root, batch_id)


def change_stream(
    changes: DataFrame, root: str, checkpoint: str, trigger: dict, merge_at: int = MERGE_AT
) -> StreamingQuery:
    """Follow a stream of base-table changes."""

    def land(batch: DataFrame, batch_id: int) -> None:
        apply_changes(batch, batch_id, root, merge_at)

    return start(
        changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(land), trigger
    )


def read_followed_kpis(spark: SparkSession, root: str, as_of: Column | None = None) -> DataFrame:
    """The KPI table as of the last complete batch."""
    batches = TOTALS.folders(spark, root)
    upto = batches[-1][1] + 1 if batches else 0
    scenarios = SCENARIOS.state(spark, root, upto)
    totals = TOTALS.state(spark, root, upto).where("n > 0")

    def known(value: str) -> Column:
        return F.when(F.col(f"n_{value}") != 0, F.col(value))

    sums = totals.join(scenarios.withColumnRenamed("n", "_times"), "scenario_id").select(
        *KPI_KEYS, "product_count", "site_count",
        (known("quantity") * F.col("_times")).cast("decimal(38,4)").alias("total_forecast_quantity"),
        (known("revenue") * F.col("_times")).cast("decimal(38,2)").alias("total_forecasted_revenue"),
        (known("cost") * F.col("_times")).cast("decimal(38,8)").alias("total_forecasted_cost"),
        F.when(F.col("n_quantity") != 0, F.col("storage") * F.col("_times")).cast("decimal(38,2)").alias("total_warehousing_cost"),
    )
    return kpi_columns(sums, as_of)
