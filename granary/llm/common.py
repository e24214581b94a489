"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.durable import scratch_path

_ROOT = str(Path(__file__).resolve().parents[2])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by Spark's own reader, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready_workers(spark: SparkSession) -> None:
    """Let Python workers import this package whatever folder the driver runs in.

    On a cluster the package is shipped with ``--py-files``; the entry is then
    only an unused folder name.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back.

    Cuts the lineage and fixes values that would differ if a lost executor's
    tasks were run again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def quoted(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_bytes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and the UTF-8 bytes of the text; a null text stays null."""
    return df.select(
        quoted(id_column).cast("long").alias("doc_id"),
        quoted(text_column).cast("string").cast("binary").alias("text"),
    )


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Row tuples of Arrow batches, one short run at a time to bound memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield from zip(*(column.to_pylist() for column in part.columns))


def slices_of(
    batches: Iterable[pa.RecordBatch], column: str, rows: int = 4096, most: int = 1 << 23
) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, of at most ``most`` bytes in a binary column or one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(), dtype=np.int64)
        at = before = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(ends, before + most, side="right"))
            end = min(max(end, at + 1), at + rows)
            yield batch.slice(at, end - at)
            at, before = end, ends[end - 1]


def in_runs(items: Iterable, size_of: Callable[[object], int], most: int) -> Iterator[list]:
    """Runs of consecutive items, each closed when its sizes reach ``most``."""
    kept, size = [], 0
    for item in items:
        kept.append(item)
        size += size_of(item)
        if size >= most:
            yield kept
            kept, size = [], 0
    if kept:
        yield kept


def to_batches(
    rows: Iterable[tuple], schema: pa.Schema, most: int = 8192
) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``most`` rows."""
    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) >= most:
            yield _batch(kept, schema)
            kept = []
    if kept:
        yield _batch(kept, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [
        pa.array(values, type=field.type) for values, field in zip(zip(*rows), schema)
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
