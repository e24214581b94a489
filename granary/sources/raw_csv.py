"""Landing planning files as text (the RAW layer)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.casting import blank_to_null
from granary.schemas import RAW_FILES, RAW_METADATA, raw_columns

_METADATA_TYPES = ("string", "bigint", "timestamp_ntz")
METADATA_DDL = ", ".join(f"{n} {k}" for n, k in zip(RAW_METADATA, _METADATA_TYPES))

_BAD = "_corrupt_record"


def _first_lines(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """``path, header``: the first line of every file that matches and isn't empty.

    Lines are looked for in the first split of each file: once for their place
    alone, which an aggregate holds as a number, and once for their text.
    """
    lines = spark.read.text(pattern).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    ).where("start = 0")
    places = lines.groupBy("path").agg(F.min("line").alias("line"))  # one row per file
    return lines.join(F.broadcast(places), ["path", "line"]).select("path", F.col("value").alias("header"))


def _headers(spark: SparkSession, pattern: str | list[str]) -> list[tuple[list[str], list[str]]]:
    """Column names and paths of the files that match, one entry per header."""
    first = _first_lines(spark, pattern)
    groups = first.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [
        (spark.read.option("header", True).option("escape", '"').csv(row["paths"][0]).columns, row["paths"])
        for row in groups.orderBy("header").collect()
    ]


def _rows(
    spark: SparkSession, columns: list[str], paths: list[str], multi_line: bool
) -> DataFrame:
    """Files of one header as text columns; rows of another width keep their line."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _BAD]])
    read = (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("multiLine", multi_line)
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", _BAD)
    )
    return read.csv(paths)


def _named(df: DataFrame) -> DataFrame:
    """The data columns, trimmed of the null spellings."""
    return df.select(
        *[blank_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns if c != _BAD]
    )


def read_csv(
    spark: SparkSession, folder: str, file_name: str, multi_line: bool = False
) -> DataFrame:
    """Comma-separated files with a header, every column as text.

    ``file_name`` may also name a folder of part files. Columns are matched by the
    header of each file, ignoring case; one that a file lacks is null there. Short
    rows are padded with nulls and surplus fields are cut; the null spellings
    become nulls. ``multi_line`` allows line breaks inside quotes, at the price
    that a file can't be split over tasks.
    """
    parts = [
        _named(_rows(spark, columns, paths, multi_line))
        for columns, paths in _headers(spark, f"{folder}/*{file_name}")
    ]
    if not parts:
        return spark.createDataFrame([], T.StructType([]))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def match_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Pick columns by name, ignoring case; a missing one becomes null."""
    found = {c.strip().lower(): c for c in df.columns}
    return df.select(
        *[
            (F.col(f"`{found[n]}`") if n in found else F.lit(None)).cast("string").alias(n)
            for n in names
        ]
    )


def load_raw(
    spark: SparkSession,
    folder: str,
    table: str,
    loaded_at: Column | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """One raw table from its file, with the load metadata columns.

    File name and row number stay null, as a load that matches columns by name
    leaves them; :func:`with_source_file` fills the name where it is wanted.
    """
    found = read_csv(spark, folder, RAW_FILES[table], multi_line)
    raw = match_columns(found, raw_columns(table))
    stamp = F.current_timestamp() if loaded_at is None else loaded_at
    values = (F.lit(None), F.lit(None), stamp)
    return raw.select(
        "*",
        *[v.cast(k).alias(n) for n, k, v in zip(RAW_METADATA, _METADATA_TYPES, values)],
    )


def with_source_file(
    spark: SparkSession, folder: str, table: str, multi_line: bool = False
) -> DataFrame:
    """The raw rows, matched by name, with the file each one came from."""
    parts = []
    for columns, paths in _headers(spark, f"{folder}/*{RAW_FILES[table]}"):
        rows = _rows(spark, columns, paths, multi_line)
        source = F.col("_metadata.file_name").alias("_source_file_name")
        cells = [blank_to_null(F.col(f"`{c}`")).alias(c) for c in columns]
        named = rows.select(*cells, source)
        parts.append(match_columns(named, [*raw_columns(table), "_source_file_name"]))
    return reduce(DataFrame.unionByName, parts)


def placed_rows(spark: SparkSession, paths: list[str], table: str, multi_line: bool = False) -> DataFrame:
    """The raw rows of some files with their file's path and name, its split, and a line.

    Lines count up within a split, from any start; they hold for one evaluation, so the
    rows are to be written before they are looked at again.
    """
    place = [
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_source_file_name"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"),
    ]
    parts = []
    for columns, files in _headers(spark, paths):
        cells = [blank_to_null(F.col(f"`{c}`")).alias(c) for c in columns]
        rows = _rows(spark, columns, files, multi_line).select(*cells, *place)
        named = {c.strip().lower(): c for c in columns}
        parts.append(
            rows.select(
                *[
                    (F.col(f"`{named[n]}`") if n in named else F.lit(None)).cast("string").alias(n)
                    for n in raw_columns(table)
                ],
                "_path", "_source_file_name", "_block", "_line",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def rejected_rows(
    spark: SparkSession, folder: str, table: str, multi_line: bool = False
) -> DataFrame:
    """Key, text and file of the rows whose field count differs from their file's header.

    Empty files have no row; a missing file raises, as in every load.
    """
    key = raw_columns(table)[0]
    parts = []
    for columns, paths in _headers(spark, f"{folder}/*{RAW_FILES[table]}"):
        rows = _rows(spark, columns, paths, multi_line).where(F.col(_BAD).isNotNull())
        source = F.col("_metadata.file_path").alias("source_file")
        cells = rows.select(*[F.col(f"`{c}`").alias(c) for c in columns], F.col(_BAD).alias("line"), source)
        parts.append(match_columns(cells, [key, "line", "source_file"]).withColumnRenamed(key, "key"))
    if not parts:
        return spark.createDataFrame([], "key string, line string, source_file string")
    return reduce(DataFrame.unionByName, parts)


def append_raw(df: DataFrame, root: str, table: str, mode: str = "append") -> None:
    """Add a load to the stored raw table, or replace it with ``overwrite``."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"mode must be 'append' or 'overwrite', not {mode!r}")
    df.write.mode(mode).parquet(f"{root}/{table}_stage")


def load_staged_data(
    spark: SparkSession, folder: str, root: str, mode: str = "append"
) -> DataFrame:
    """Load all nine files into the stored raw layer; returns rows per table."""
    counts = None
    for table in RAW_FILES:
        append_raw(load_raw(spark, folder, table), root, table, mode)
        stored = spark.read.parquet(f"{root}/{table}_stage")
        count = stored.agg(F.count("*").alias("row_count")).select(
            F.lit(f"{table}_stage").alias("table_name"), "row_count"
        )
        counts = count if counts is None else counts.unionByName(count)
    return counts
