"""Forecast versions submitted as a stream.

Every micro-batch becomes one folder of an append-only table, overwritten when
the batch is replayed. Which version is current is not stored but derived: the
latest timestamp per scenario. Superseding a version therefore rewrites nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.schemas import ATOMIC, EXTRA, columns_of, struct_of

# A submitted line: the forecast columns, its version, and an id that a source
# repeats when it delivers the same line again.
SUBMISSION = {
    **ATOMIC["demand_forecast_versions"],
    "total_revenue": EXTRA["demand_forecast_versions"]["total_revenue"],
    "version_timestamp": EXTRA["demand_forecast_versions"]["version_timestamp"],
    "line_id": "bigint",
}
# What names a version.
HEAD = {"scenario_id": "bigint", "version_timestamp": "timestamp"}


def submission(df: DataFrame) -> DataFrame:
    """Shape rows (batch or stream) as submitted lines; absent columns are null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(n) if n in have else F.lit(None)).cast(kind).alias(n)
            for n, kind in SUBMISSION.items()
        ]
    )


def store_batch(batch: DataFrame, batch_id: int, root: str) -> DataFrame:
    """Write one micro-batch to its own folder; replaying it changes nothing.

    The versions it holds, one row each, are written after the lines. Returns
    the stored rows, so that a second use does not read the source again.
    """
    path = f"{root}/versions/batch_id={batch_id}"
    batch.write.mode("overwrite").partitionBy("scenario_id").parquet(path)
    lines = batch.sparkSession.read.schema(struct_of(SUBMISSION)).parquet(path)
    lines.select(*HEAD).distinct().write.mode("overwrite").parquet(
        f"{root}/heads/batch_id={batch_id}"
    )
    return lines


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    """All submitted lines."""
    return _read(spark, f"{root}/versions", {**SUBMISSION, "batch_id": "bigint"})


def _read(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A stored table, without rows as long as no batch has been written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], struct_of(columns))
    return spark.read.schema(struct_of(columns)).parquet(path)


def read_heads(spark: SparkSession, root: str) -> DataFrame:
    """The latest version of every scenario and the batches that hold lines of it.

    Derived from the stored versions, one row per scenario, version and batch;
    no line is read.
    """
    known = _read(spark, f"{root}/heads", {**HEAD, "batch_id": "bigint"})
    return known.join(latest_versions(known), "scenario_id").where(
        "version_timestamp <=> _head"
    ).drop("_head")


def live_lines(spark: SparkSession, root: str, ids: DataFrame | None = None) -> DataFrame:
    """The lines of the latest versions, of the scenarios ``ids`` or of all.

    Lines are partitioned by batch and scenario, so the join with the heads
    prunes the folders that it reads. Each line counts once, in whatever batches
    it came.
    """
    heads = read_heads(spark, root)
    if ids is not None:
        heads = heads.join(ids, "scenario_id", "left_semi")
    heads = heads.withColumnRenamed("version_timestamp", "_head")
    joined = read_versions(spark, root).join(heads, ["scenario_id", "batch_id"])
    return _each_once(joined.where("version_timestamp <=> _head").drop("_head"))


def latest_versions(versions: DataFrame) -> DataFrame:
    """The latest timestamp of every scenario.

    One row per scenario: adaptive execution broadcasts it by its measured size
    and splits a scenario with many lines beyond that.
    """
    return versions.groupBy("scenario_id").agg(F.max("version_timestamp").alias("_head"))


def _each_once(lines: DataFrame) -> DataFrame:
    return lines.dropDuplicates(["scenario_id", "version_timestamp", "line_id"])


def current_lines(versions: DataFrame) -> DataFrame:
    """The lines of each scenario's latest version, each line once."""
    joined = versions.join(latest_versions(versions), "scenario_id")
    return _each_once(joined.where("version_timestamp = _head").drop("_head"))


def as_forecasts(lines: DataFrame, flag: Column | None = None) -> DataFrame:
    """Submitted lines as rows of the forecast table."""
    current = F.lit(True) if flag is None else flag
    have = set(lines.columns)
    return lines.select(
        *[
            (current if n == "is_current_version" else F.col(n) if n in have else F.lit(None))
            .cast(kind)
            .alias(n)
            for n, kind in columns_of("demand_forecast_versions").items()
        ]
    )


def version_history(versions: DataFrame) -> DataFrame:
    """Every submitted line as a forecast row, flagged by whether it is current."""
    joined = _each_once(versions).join(latest_versions(versions), "scenario_id")
    return as_forecasts(joined, F.col("version_timestamp").eqNullSafe(F.col("_head")))


def start(writer, trigger: dict) -> StreamingQuery:
    """Start a stream writer under a trigger such as ``{"availableNow": True}``."""
    return writer.trigger(**trigger).start()


def version_stream(
    submissions: DataFrame, root: str, checkpoint: str, trigger: dict
) -> StreamingQuery:
    """Store a stream of submitted lines below ``root``."""

    def land(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, batch_id, root)

    writer = (
        submission(submissions)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(land)
    )
    return start(writer, trigger)
