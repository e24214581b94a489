"""The registered query of each operator, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import (
    contamination, exact_dedup, filter_audit, license_scan, packing, page_text, piece_codec, pseudo_likelihood,
    quality_rules, sharding, simhash, token_alignment, token_files,
)
from granary.llm.common import read_table
from granary.operators.durable import scratch_path


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(read_table(spark, sf_dir, "documents"))


def _token_files(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, path)
    return token_files.read_tokens(spark.read.parquet(path))


def _page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.page_texts(read_table(spark, sf_dir, "pages"))


def _contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (read_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return contamination.contaminated_documents(docs, benchmark)


def _filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(*(read_table(spark, sf_dir, name) for name in ("documents", "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": _documents(simhash.near_duplicates),
    "op2_quality_rules": _documents(quality_rules.quality_report),
    "op3_token_files": _documents(_token_files),
    "op4_exact_dedup": _documents(exact_dedup.exact_duplicates),
    "op5_piece_codec": _documents(piece_codec.piece_digests),
    "op6_packing": _documents(packing.pack_documents),
    "op7_license_scan": _documents(license_scan.license_scan),
    "op8_sharding": _documents(sharding.shard_documents),
    "op9_page_text": _page_text,
    "op10_pseudo_likelihood": _documents(pseudo_likelihood.pseudo_likelihood),
    "op11_contamination": _contamination,
    "op12_filter_audit": _filter_audit,
    "op13_token_alignment": _documents(token_alignment.alignment_report),
}
