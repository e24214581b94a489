"""Scenario KPIs that follow the submitted versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.operators.current import current_versions
from granary.plans.mart import scenario_kpis
from granary.sources.tables import PlanningTables
from granary.streaming.versions import (
    as_forecasts,
    live_lines,
    read_heads,
    start,
    store_batch,
    submission,
)

TARGET_LAG = {"processingTime": "5 minutes"}


def _store(ids: DataFrame, tables: PlanningTables, root: str, as_of: Column | None) -> None:
    """Replace the KPI rows of the given scenarios, each in its own partition.

    A scenario without a valid line becomes an empty row, which readers skip.
    """
    (
        ids.join(scenario_kpis(tables, as_of=as_of), "scenario_id", "left")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("scenario_id")
        .parquet(f"{root}/kpis")
    )


def refresh_kpis(
    t: PlanningTables, root: str, touched: DataFrame, as_of: Column | None = None
) -> None:
    """Recompute the KPI rows of the touched scenarios and replace only those.

    A submission supersedes all of its scenario's lines, so a touched scenario is
    computed from its live submission alone: the stored heads name the batch
    folders and scenario partitions that hold it, and no other is read.
    """
    ids = touched.select("scenario_id").distinct()
    lines = live_lines(touched.sparkSession, root, ids)
    _store(ids, t.with_(demand_forecast_versions=as_forecasts(lines)), root, as_of)


def refresh_all_kpis(
    spark: SparkSession, t: PlanningTables, root: str, as_of: Column | None = None
) -> None:
    """Recompute the KPI rows of every scenario that the base tables or a submission has.

    Call it once before the stream starts and whenever a base table changes: a
    price, a rate, a site or the scenarios. Scenarios with a submission take
    its lines, all others the current rows of ``t``.
    """
    heads = read_heads(spark, root)
    base = t.demand_forecast_versions
    kept = current_versions(base).join(heads, "scenario_id", "left_anti")
    forecasts = kept.unionByName(as_forecasts(live_lines(spark, root)))
    ids = (
        t.scenario_definition.select("scenario_id")
        .union(base.select("scenario_id").distinct())
        .union(heads.select("scenario_id"))
        .where("scenario_id IS NOT NULL")
        .distinct()
    )
    _store(ids, t.with_(demand_forecast_versions=forecasts), root, as_of)


def kpi_stream(
    submissions: DataFrame,
    t: PlanningTables,
    root: str,
    checkpoint: str,
    trigger: dict = TARGET_LAG,
    as_of: Column | None = None,
) -> StreamingQuery:
    """Store submitted lines and refresh the KPIs of their scenarios.

    Replaying a batch rewrites the same folder and recomputes the same rows.
    :func:`refresh_all_kpis` gives the rows of the scenarios that nobody
    submits.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        refresh_kpis(t, root, store_batch(batch, batch_id, root), as_of)

    writer = (
        submission(submissions)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(land)
    )
    return start(writer, trigger)


def read_kpis(spark: SparkSession, root: str) -> DataFrame:
    """The maintained KPI table."""
    df = spark.read.parquet(f"{root}/kpis").where(F.col("scenario_code").isNotNull())
    return df.withColumn("scenario_id", F.col("scenario_id").cast("bigint"))
