"""Raw loads that take each file once, and the place of every row in its file.

A load writes its rows, then the ledger entries that name them. Readers see only rows
of loads in the ledger, so a load that fails leaves nothing to see and is simply run
again. One loader at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.schemas import RAW_FILES, RAW_METADATA, raw_columns
from granary.sources import raw_csv

_ENTRY = "number bigint, folder string, file string, line_count bigint, checksum decimal(38,0), loaded_at timestamp_ntz"


def file_checksums(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """``file, line_count, checksum`` of the table's files below a folder.

    The checksum adds up the hashes of the lines, so a file is read in splits and
    partly summed in each. Files without any line are not listed.
    """
    lines = spark.read.text(f"{folder}/*{RAW_FILES[table]}").select(
        F.col("_metadata.file_path").alias("file"), F.xxhash64("value").cast("decimal(20,0)").alias("hash")
    )
    return lines.groupBy("file").agg(
        F.count("*").alias("line_count"), F.sum("hash").cast("decimal(38,0)").alias("checksum")
    )


def ledger(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One row per loaded file; empty before the first load."""
    path = f"{root}/{table}_loads/files"
    try:
        return spark.read.schema(_ENTRY).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _ENTRY)


def load_new_files(
    spark: SparkSession, folder: str, root: str, table: str, force: bool = False,
    loaded_at: Column | None = None, multi_line: bool = False,
) -> DataFrame:
    """Load the files whose path and content the ledger doesn't have; returns their entries.

    A file that changed is loaded again as a whole, and its earlier rows stay, as raw
    loads append. ``force`` takes all files. A missing file raises.
    """
    loaded = ledger(spark, root, table)
    known = loaded.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    found = file_checksums(spark, folder, table)
    if not force:
        found = found.join(loaded, ["file", "line_count", "checksum"], "left_anti")
    stamp = F.current_timestamp() if loaded_at is None else loaded_at
    part = f"{root}/{table}_loads/rows/{known + 1}-{uuid.uuid4().hex}"
    entries = found.select(
        F.lit(known + 1).cast("bigint").alias("number"), F.lit(part).alias("folder"), "file", "line_count",
        "checksum", stamp.cast("timestamp_ntz").alias("loaded_at"),
    )
    # Written before the rows, so that both speak of the same files.
    entries.write.parquet(f"{part}/files")
    taken = spark.read.schema(_ENTRY).parquet(f"{part}/files")
    paths = [row["file"] for row in taken.select("file").orderBy("file").toLocalIterator()]
    if paths:
        stamp = F.lit(taken.first()["loaded_at"]).cast("timestamp_ntz")
        rows = raw_csv.placed_rows(spark, paths, table, multi_line)
        rows.withColumns({"number": F.lit(known + 1).cast("bigint"), "_loaded_timestamp": stamp}).write.parquet(f"{part}/rows")
        taken.coalesce(1).write.mode("append").parquet(f"{root}/{table}_loads/files")
    return taken


def read_loads(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All loaded raw rows with the file, the number of the row in it, and the load.

    Splits of a file count their own rows, and the sizes of those before are added: one
    number per split. Numbers start at 1 after the header; blank lines have none.
    """
    columns = [*raw_columns(table), *RAW_METADATA, "number"]
    loads = ledger(spark, root, table).select("folder").distinct().orderBy("folder").collect()
    if not loads:
        text = [f"{c} string" for c in raw_columns(table)]
        return spark.createDataFrame([], ", ".join([*text, raw_csv.METADATA_DDL, "number bigint"]))
    stored = spark.read.parquet(*[f"{load['folder']}/rows" for load in loads])
    key = ["number", "_path", "_block"]
    before = Window.partitionBy("number", "_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = stored.groupBy(*key).agg(F.min("_line").alias("first"), F.count("*").alias("size")).select(
        *key, (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first") + 1).alias("shift")
    )
    return stored.join(shifts, key).withColumn(
        "_source_file_row_number", F.col("_line") + F.col("shift")
    ).select(*columns)
