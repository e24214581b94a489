"""A search index that follows new, changed and deleted documents.

Every micro-batch is one folder of two append-only tables, overwritten when the
batch is replayed: the versions that arrived, a few bytes each, and the chunks
with text, attributes and term counts. Which version of a document is live is
derived: the highest ``version``, then the latest batch. A change therefore
rewrites nothing; :func:`compact_index` drops what is no longer live.

Texts of documents that come several times in a batch are shuffled, to find the
row that counts; others are indexed where they lie, as a :class:`Sieve` tells.
Another tells whether a chunk is live where it lies, with the few stale versions
that slip through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.operators.durable import shuffles_released, written
from granary.operators.sieve import Sieve
from granary.plans.documents import chunk_documents
from granary.plans.search import MAX_RESULTS, best_chunks, index_chunks
from granary.streaming.versions import start

TARGET_LAG = {"processingTime": "1 minute"}
_VERSIONS = "document_id string, version bigint, deleted boolean, batch_id bigint"
_INDEX = (
    "document_id string, version bigint, chunk_id string, chunk_text string, "
    "attributes map<string,string>, chunk_length bigint, "
    "counts array<struct<term:string,first:int,next:int>>, batch_id bigint"
)


def _sent(batch: DataFrame, batch_id: int, attributes: Sequence[str]) -> DataFrame:
    """The rows of a batch with every column; a deleted document needs no text."""

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in batch.columns else default

    pairs = [part for a in attributes for part in (F.lit(a), F.col(a).cast("string"))]
    deleted = given("deleted", F.lit(False))
    return batch.select(
        F.col("document_id").cast("string").alias("document_id"),
        given("version", F.lit(batch_id)).cast("bigint").alias("version"),
        deleted.alias("deleted"),
        F.when(~deleted, F.col("text")).alias("text"),
        F.create_map(*pairs).cast("map<string,string>").alias("attributes"),
    )


def _arrivals(rows: DataFrame) -> DataFrame:
    """One row per document: its highest version, then the greatest text."""
    place = F.struct("version", "deleted", "text")
    return (
        rows.groupBy("document_id")
        .agg(F.max_by(F.struct("version", "deleted", "text", "attributes"), place).alias("_row"))
        .select("document_id", "_row.*")
    )


def index_batch(
    batch: DataFrame,
    batch_id: int,
    root: str,
    mode: str,
    target_tokens: int,
    attributes: Sequence[str] = (),
) -> None:
    """Chunk and index one micro-batch of documents into its own folder.

    A chunk is identified by its document and place, so that batches need no
    common counter. The versions are written last: a batch that failed between
    the two tables has chunks that no version names.
    """
    rows = _sent(batch, batch_id, attributes)
    # The version that counts is told without the texts.
    known = written(
        rows.groupBy("document_id")
        .agg(F.max(F.struct("version", "deleted")).alias("_row"), F.count("*").alias("_rows"))
        .select("document_id", "_row.*", "_rows"),
        "sent",
    )
    marked = Sieve(known.where("_rows > 1"), ["document_id"]).marked(rows, "_repeated")
    once = marked.where(~F.col("_repeated")).drop("_repeated")
    arrived = once.unionByName(_arrivals(marked.where("_repeated").drop("_repeated")))
    chunks = chunk_documents(arrived.where(~F.col("deleted")), mode, target_tokens)
    key = F.concat_ws("#", "document_id", "chunk_index")
    index = index_chunks(
        chunks.withColumn("chunk_id", key),
        "document_id", "version", "chunk_id", "chunk_text", "attributes",
    )
    with shuffles_released(batch.sparkSession):
        _store(index, f"{root}/index/batch_id={batch_id}")
        _store(known.drop("_rows"), f"{root}/versions/batch_id={batch_id}")


def _store(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def index_stream(
    documents: DataFrame,
    root: str,
    checkpoint: str,
    trigger: dict = TARGET_LAG,
    mode: str = "tokens",
    target_tokens: int = 500,
    attributes: Sequence[str] = (),
) -> StreamingQuery:
    """Keep the index below ``root`` up to date with a stream of documents.

    ``documents`` has ``document_id`` and ``text``; a document sent again
    replaces what was sent before. An optional ``version`` orders the versions
    (else later batches win), an optional ``deleted`` takes a document away, and
    the columns named by ``attributes`` are kept for filters.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        index_batch(batch, batch_id, root, mode, target_tokens, attributes)

    writer = documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(land)
    return start(writer, trigger)


def _versions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_VERSIONS).parquet(f"{root}/versions")


def _live(versions: DataFrame) -> DataFrame:
    """``document_id, live``: the version and batch in force, null when deleted."""
    newest = F.max_by(F.struct("version", "batch_id", "deleted"), F.struct("version", "batch_id"))
    return versions.groupBy("document_id").agg(newest.alias("_last")).select(
        "document_id", F.when(~F.col("_last.deleted"), F.col("_last.batch_id")).alias("live")
    )


_PLACE = ("document_id", "batch_id")


class _InForce:
    """Tells live chunks where they lie: only versions, a few bytes each, are shuffled."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        versions = _versions(spark, root)
        known = _live(versions)
        live = known.where("live IS NOT NULL").withColumnRenamed("live", "batch_id")
        self._live = Sieve(written(live, "live"), _PLACE)
        stale = versions.join(known, "document_id").where(
            ~F.col("batch_id").eqNullSafe(F.col("live"))
        )
        slipped = self._live.marked(stale.select(*_PLACE), "_maybe").where("_maybe")
        # One in many: adaptive execution broadcasts them by their measured size.
        self._slipped = written(slipped.drop("_maybe"), "slipped")
        # One number per batch that has versions.
        self.batches = [r[0] for r in versions.select("batch_id").distinct().collect()]

    def of(self, index: DataFrame, unnamed: bool) -> DataFrame:
        """The live rows, with ``unnamed`` also those that no version can name."""
        other = F.col("document_id").isNull() | ~F.col("batch_id").isin(self.batches)
        marked = self._live.marked(index, "_maybe")
        kept = marked.where(F.col("_maybe") | other) if unnamed else marked.where(F.col("_maybe") & ~other)
        return kept.drop("_maybe").join(self._slipped, list(_PLACE), "left_anti")


def _index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{root}/index")


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """The live chunks: document, chunk id, text, attributes and term counts."""
    live = _InForce(spark, root).of(_index(spark, root), unnamed=True)
    return live.drop("batch_id", "version")


def compact_index(spark: SparkSession, root: str, target: str) -> None:
    """Write the live state of the index below ``root`` as one batch of ``target``.

    Deleted documents keep their version, so that an older one that arrives late
    stays away. The stream goes on with ``target`` and its old checkpoint; it
    must be stopped meanwhile. What is read is never overwritten.
    """
    versions = _versions(spark, root)
    last = versions.agg(F.max("batch_id")).first()[0] or 0
    newest = F.struct("version", "batch_id")
    kept = versions.groupBy("document_id").agg(
        F.max("version").alias("version"), F.max_by("deleted", newest).alias("deleted")
    )
    live = _InForce(spark, root).of(_index(spark, root), unnamed=False).drop("batch_id")
    with shuffles_released(spark):
        live.write.option("compression", "zstd").parquet(f"{target}/index/batch_id={last}")
        kept.write.option("compression", "zstd").parquet(f"{target}/versions/batch_id={last}")


def search_stored(
    spark: SparkSession,
    root: str,
    queries: DataFrame,
    k: int = MAX_RESULTS,
    filters: dict[str, str] | None = None,
) -> DataFrame:
    """The best ``k`` live chunks per query with their text and attributes.

    ``filters`` are equality conditions on the stored attributes; they narrow the
    corpus before it is scored.
    """
    corpus = read_index(spark, root)
    for name, value in (filters or {}).items():
        corpus = corpus.where(F.col("attributes")[name] == value)
    ranked = written(best_chunks(corpus, queries, k), "ranked")
    shown = corpus.select("chunk_id", "document_id", "chunk_text", "attributes")
    return shown.join(ranked, "chunk_id")
