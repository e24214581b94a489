"""Document metadata and chunks loaded as one: both are seen together or not at all."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.keys import dense_ids
from granary.plans.documents import chunk_documents, classify_documents, number_chunks

_PUBLISHED = "number bigint, folder string, parts array<string>"
TABLES = ("metadata", "chunks")


def published(spark: SparkSession, root: str) -> tuple[int, list[str]]:
    """Number and part folders of the newest published load; 0 and none before the first."""
    try:
        loads = spark.read.schema(_PUBLISHED).parquet(f"{root}/published")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, []
    newest = loads.orderBy(F.col("number").desc(), F.col("folder").desc()).limit(1).collect()
    return (newest[0]["number"], newest[0]["parts"]) if newest else (0, [])


def stage(
    docs: DataFrame, folder: str, metadata_start: int = 0, chunk_start: int = 0,
    rules: str = "procedure", chunks: str = "tokens",
) -> None:
    """Write both tables of one load below ``folder``; nobody reads them yet.

    ``docs`` has ``relative_path`` and ``text``. Ids go on after the given starts in
    the order of the paths; texts are cut where they lie and never sorted.
    """
    spark = docs.sparkSession
    kept = classify_documents(docs, rules)
    numbered = dense_ids(kept, ("file_path",), "document_id", metadata_start, "keys")
    # Written first and read back, so that both tables have the same ids.
    numbered.write.parquet(f"{folder}/documents")
    loaded = spark.read.schema(numbered.schema).parquet(f"{folder}/documents")
    loaded.drop("text").write.parquet(f"{folder}/metadata")
    about = ["document_id", "file_path", "document_type", "vendor_name", "region"]
    number_chunks(chunk_documents(loaded.select(*about, "text"), chunks), chunk_start).write.parquet(
        f"{folder}/chunks"
    )


def publish(spark: SparkSession, root: str, number: int, parts: list[str]) -> None:
    """Make a load the newest one by the one file that names its parts.

    The file appears at once, by the committer's rename or the store's put; until
    then readers see the load before. One loader at a time.
    """
    spark.createDataFrame([(number, parts[-1], parts)], _PUBLISHED).coalesce(1).write.mode("append").parquet(
        f"{root}/published"
    )


def read_documents(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Metadata and chunks of one and the same load, the newest."""
    _, parts = published(spark, root)
    if not parts:
        raise ValueError(f"nothing published below {root}")
    return tuple(spark.read.parquet(*[f"{part}/{table}" for part in parts]) for table in TABLES)


def load_documents(
    docs: DataFrame, root: str, mode: str = "truncate", rules: str = "procedure", chunks: str = "tokens"
) -> str:
    """Classify, number, chunk, store and publish documents; returns the receipt.

    ``truncate`` replaces what is published, ``append`` adds a part to it and reads
    none of the earlier texts. A load that fails leaves a folder that no reader
    knows, and is simply run again. A null path is no document; a document
    without words has metadata and no chunk under ``tokens``; repeated rows are
    documents of their own. The receipt counts this load's files and, as the
    procedure does, all chunks.
    """
    if mode not in ("truncate", "append"):
        raise ValueError(f"mode must be 'truncate' or 'append', not {mode!r}")
    spark = docs.sparkSession
    number, parts = published(spark, root)
    parts = parts if mode == "append" else []
    starts = [0, 0]
    if parts:
        keys = zip(read_documents(spark, root), ("document_id", "chunk_id"))
        starts = [table.agg(F.coalesce(F.max(key), F.lit(0))).first()[0] for table, key in keys]
    folder = f"{root}/parts/{number + 1}-{uuid.uuid4().hex}"
    stage(docs, folder, *starts, rules=rules, chunks=chunks)
    publish(spark, root, number + 1, [*parts, folder])
    files = spark.read.parquet(f"{folder}/metadata").count()
    total = read_documents(spark, root)[1].count()
    return f"Processed {files} files, created {total} chunks"
