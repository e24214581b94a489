"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import free_name, quoted, ready_workers, rows_of, stored, text_bytes, to_batches
from granary.llm.components import component_labels

BITS = 64
SEED = 42
_SLAB = 1 << 16
_SIGNED = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: bytes | None, shingle_words: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Fewer
    words than a shingle make one shingle; no words give 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    size = min(shingle_words, len(words))
    total = len(words) - size + 1
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, _SLAB):
        part = words[at : min(at + _SLAB, total) + size - 1]
        shingles = zip(*(part[k:] for k in range(size)))
        hashes = np.array([digest(b" ".join(s), SEED) for s in shingles], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _sign(shingle_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (doc_id, int(np.uint64(fingerprint(text, shingle_words)).view(np.int64)))
            for doc_id, text in rows_of(batches)
        )
        return to_batches(rows, _SIGNED)

    return run


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` holds the 64 bits as a bigint."""
    ready_workers(docs.sparkSession)
    return text_bytes(docs).mapInArrow(_sign(shingle_words), "doc_id bigint, fp bigint")


def ball_masks(radius: int) -> list[int]:
    """All ways to flip at most half of ``radius`` bits, as signed integers."""
    masks = [sum(1 << b for b in c) for k in range(radius // 2 + 1) for c in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def fingerprint_links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(a, b)`` that join all distinct ``fp`` within ``radius`` bits.

    Every fingerprint emits all variants within half the radius; two are within
    the radius exactly if they share a variant. All holders of a variant are
    within the radius of one another, so linking each to the smallest of them
    loses no connection; a variant has at most as many holders as the half-radius
    ball has points (65 at radius 2), so no group is large. Each link is checked.
    """
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius must be 0, 2 or 4")
    masks = F.array(*[F.lit(m).cast("bigint") for m in ball_masks(radius)])
    emitted = nodes.select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")
    )
    same = Window.partitionBy("variant")
    return (
        emitted.select("fp", F.min("fp").over(same).alias("first"))
        .where("fp <> first")
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("first"))) <= radius)
        .select(F.col("first").alias("a"), F.col("fp").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, radius: int = 2, shingle_words: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest
    doc_id reachable over links of at most ``radius`` differing bits. Equal
    fingerprints are one node, so copies cost nothing. Null, empty and blank
    texts have fingerprint 0 and are linked like any other; rows with a null
    doc_id keep it and take their component's smallest non-null doc_id (null if
    there is none); repeated rows come back repeated; an empty table gives no
    rows; other columns of ``docs`` are ignored.
    """
    rows = stored(fingerprints(docs, shingle_words), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    labels = component_labels(fingerprint_links(nodes, radius))
    labelled = stored(
        nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "least_id", F.coalesce("label", "fp").alias("label")
        ),
        "labelled",
    )
    smallest = stored(
        labelled.groupBy("label").agg(F.min("least_id").alias("component_id")), "smallest"
    )
    named = stored(labelled.join(smallest, "label").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_per_group(docs: DataFrame, radius: int = 2, shingle_words: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group.

    All columns stay. Rows that share that smallest doc_id stay together; rows
    without a doc_id can't be named by a decision and stay.
    """
    found = near_duplicates(docs, radius, shingle_words)
    name = free_name(docs, "_dropped_id")
    dropped = (
        found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    )
    return docs.join(dropped, quoted("doc_id").cast("long") == quoted(name), "left_anti")
