"""Golden queries: results held against stored ones, opening only what differs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.durable import scratch_path

BUCKETS = 64
REPORT = (
    "query_name string, status string, row_count bigint, missing_rows bigint, "
    "unexpected_rows bigint, opened_buckets int"
)


def store_result(df: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Write a result as distinct rows with their number, by bucket of their hash.

    Beside them lies one fingerprint per bucket, the rows and the sum of their
    hashes, which doesn't depend on order or partitions. Nulls are hashed as such,
    so they can't move between columns unseen. Rows are counted before they are
    shuffled by bucket, so one that repeats is one row.
    """
    names = sorted(df.columns)
    cells = [x for c in names for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    hashed = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_copies"))
    hashed = hashed.withColumn("_hash", F.xxhash64(*cells))
    bucketed = hashed.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int"))
    bucketed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{folder}/rows")
    # The schema is given, for an empty result leaves no file to read it from.
    rows = df.sparkSession.read.schema(bucketed.schema).parquet(f"{folder}/rows")
    total = F.sum(F.col("_hash").cast("decimal(20,0)") * F.col("_copies"))
    rows.groupBy("_bucket").agg(F.sum("_copies").alias("rows"), total.alias("total")).write.parquet(
        f"{folder}/fingerprints"
    )


def compare_stored(spark: SparkSession, name: str, actual: str, expected: str | None) -> tuple:
    """One report row from two stored results; without an expected one, NOT_RUN.

    Only buckets whose fingerprints differ are read, by partition pruning; their
    numbers, at most as many as there are buckets, come to the driver. Results
    with other columns or types differ in every row.
    """
    ours = spark.read.parquet(f"{actual}/fingerprints")
    count = ours.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if expected is None or not _exists(spark, expected):
        return name, "NOT_RUN", count, 0, 0, 0
    theirs = spark.read.parquet(f"{expected}/fingerprints")
    tables = [_rows(spark, folder) for folder in (actual, expected)]
    if sorted(tables[0].dtypes) != sorted(tables[1].dtypes):
        wanted = theirs.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        return name, "FAILED", count, wanted, count, 0
    sides = ours.withColumn("side", F.lit(1)).unionByName(theirs.withColumn("side", F.lit(-1)))
    signed = sides.groupBy("_bucket").agg(
        F.sum(F.col("rows") * F.col("side")).alias("rows"), F.sum(F.col("total") * F.col("side")).alias("total")
    )
    differing = sorted(r[0] for r in signed.where("rows <> 0 OR total <> 0").select("_bucket").collect())
    if not differing:
        return name, "PASSED", count, 0, 0, 0
    columns = [f"`{c}`" for c in tables[1].columns if c not in ("_copies", "_hash", "_bucket")]
    opened = [table.where(F.col("_bucket").isin(differing)) for table in tables]
    both = opened[0].unionByName(opened[1].withColumn("_copies", -F.col("_copies")))
    surplus = both.groupBy(*[F.col(c) for c in columns]).agg(F.sum("_copies").alias("_surplus"))
    missing, unexpected = surplus.agg(
        F.sum(F.greatest(-F.col("_surplus"), F.lit(0))), F.sum(F.greatest("_surplus", F.lit(0)))
    ).first()
    return name, "FAILED", count, missing, unexpected, len(differing)


def golden_run(
    spark: SparkSession, queries: Mapping[str, DataFrame], expected: Mapping[str, str], buckets: int = BUCKETS
) -> DataFrame:
    """Every query's status against its stored expectation, by :func:`store_result`.

    PASSED and FAILED compare all rows as multisets; a query without a folder in
    ``expected``, or whose folder holds nothing, is NOT_RUN. Each result is stored
    once, so a query runs once, however many of its buckets are opened.
    """
    report = []
    for name, df in queries.items():
        folder = scratch_path(spark, "golden")
        store_result(df, folder, buckets)
        report.append(compare_stored(spark, name, folder, expected.get(name)))
    return spark.createDataFrame(report, REPORT)


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{folder}/rows")
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        # An empty result: any schema will do, as it has no row to compare.
        return spark.createDataFrame([], "_copies bigint, _hash bigint, _bucket int")


def _exists(spark: SparkSession, folder: str) -> bool:
    try:
        spark.read.parquet(f"{folder}/fingerprints")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True
