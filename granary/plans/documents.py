"""Document metadata and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import file_name, words
from granary.operators.keys import dense_ids

SUFFIXES = {"procedure": (".pdf", ".docx"), "deploy": (".pdf",)}


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the PDF and DOCX files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select(F.col("path").alias("relative_path"))
        .where(is_document(F.col("relative_path")))
    )


def is_document(path: Column, rules: str = "procedure") -> Column:
    """Whether a path ends in a suffix the rule set reads."""
    lower = F.lower(path)
    hit = F.lit(False)
    for suffix in SUFFIXES[rules]:
        hit = hit | lower.endswith(suffix)
    return hit


def classify_documents(paths: DataFrame, rules: str = "procedure") -> DataFrame:
    """Document type, vendor and region from the path, first match wins.

    ``procedure`` looks at the file name and knows one more vendor, one more
    region and an unknown vendor; ``deploy`` looks at the whole path of PDFs.
    """
    if rules not in SUFFIXES:
        raise ValueError(f"rules must be one of {sorted(SUFFIXES)}, not {rules!r}")
    path = F.col("relative_path")
    seen = F.lower(file_name(path) if rules == "procedure" else path)

    kind = (
        F.when(seen.contains("contract"), "CONTRACT")
        .when(seen.contains("sla"), "SLA")
        .when(seen.contains("meeting") | seen.contains("minutes"), "MEETING_MINUTES")
        .otherwise("OTHER")
    )
    northeast = seen.contains("northeast")
    if rules == "procedure":
        vendor = (
            F.when(seen.contains("acme"), "ACME Logistics")
            .when(northeast, "Northeast 3PL")
            .otherwise("Unknown")
        )
        region = (
            F.when(northeast, "Northeast").when(seen.contains("west"), "West").otherwise("National")
        )
    else:
        vendor = F.when(northeast, "Northeast 3PL").otherwise("National")
        region = F.when(northeast, "Northeast").otherwise("National")
    return paths.where(is_document(path, rules)).select(
        *[c for c in paths.columns if c != "relative_path"],
        path.alias("file_path"),
        file_name(path).alias("file_name"),
        kind.alias("document_type"),
        vendor.alias("vendor_name"),
        region.alias("region"),
    )


def chunk_documents(
    docs: DataFrame, mode: str = "tokens", target_tokens: int = 500
) -> DataFrame:
    """Cut the ``text`` of each document into chunks of whole words.

    ``tokens`` gives consecutive chunks of ``target_tokens`` words, numbered
    from 1, that together hold every word; ``whole`` keeps one chunk per
    document with its text unchanged, as the reference stores it. A document
    without words has no chunk under ``tokens``.
    """
    if mode == "whole":
        return docs.withColumns(
            {
                "chunk_index": F.lit(1).cast("bigint"),
                "chunk_text": F.col("text"),
                "page_number": F.lit(1).cast("bigint"),
            }
        ).drop("text")
    if mode != "tokens":
        raise ValueError(f"mode must be 'tokens' or 'whole', not {mode!r}")
    if target_tokens < 1:
        raise ValueError("target_tokens must be positive")
    split = docs.withColumn("_words", words(F.col("text"))).drop("text")
    last = F.greatest(F.size("_words"), F.lit(1))
    starts = F.sequence(F.lit(1), last, F.lit(target_tokens))
    pieces = F.transform(
        starts, lambda s: F.array_join(F.slice("_words", s, F.lit(target_tokens)), " ")
    )
    kept = [c for c in docs.columns if c != "text"]
    # The outer form keeps Spark from cutting every text twice, once to see
    # whether there is anything to explode.
    return (
        split.select(*kept, F.posexplode_outer(pieces).alias("_place", "chunk_text"))
        .where(F.col("chunk_text") != "")
        .select(
            *kept,
            (F.col("_place") + 1).cast("bigint").alias("chunk_index"),
            "chunk_text",
            F.lit(1).cast("bigint").alias("page_number"),
        )
    )


def number_chunks(chunks: DataFrame, start: Column | int = 0) -> DataFrame:
    """Dense chunk ids in document order; no text is stored for it."""
    return dense_ids(chunks, ("document_id", "chunk_index"), "chunk_id", start, "keys")


def search_results(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Chunks (or search hits) with their document's metadata."""
    about = metadata.select(
        "document_id",
        "file_name",
        "file_path",
        "document_type",
        "vendor_name",
        "region",
        "effective_date",
        "expiry_date",
    )
    own = [c for c in chunks.columns if c == "document_id" or c not in about.columns]
    return chunks.select(*own).join(about, "document_id")
