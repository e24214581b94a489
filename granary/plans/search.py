"""Ranked text search over chunks with BM25 scores.

Terms are counted inside each chunk's row by array functions; the index is
written once and read by the passes that need document frequencies and scores.
What the queries ask is a written table too, so Spark knows its size and
broadcasts it where that is small. :func:`best_chunks` prunes by bounds,
:func:`search_index` scores every chunk; both give the same results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import terms
from granary.operators.durable import written

K1 = 1.2
B = 0.75
SCORE_DIGITS = 6
MAX_RESULTS = 5
#: A query's rarest terms with this many postings choose the chunks for its floor,
RARE_POSTINGS = 256
#: this many times the wanted number of results.
TRIED = 8
#: The share of a floor that terms left out at first may add up to.
WEAK = 0.25
#: More than rounding can lift a score, so that ties with the floor stay.
SLACK = 10.0 ** (1 - SCORE_DIGITS)


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms of each query: ``query_id``, ``term``."""
    return queries.select(
        "query_id", F.explode(F.array_distinct(terms(F.col("query_text")))).alias("term")
    )


def index_chunks(chunks: DataFrame, *keep: str) -> DataFrame:
    """Key (or the columns to ``keep``), length and term counts of every chunk.

    A row-local operation: sorting the terms puts equal ones next to each
    other, so ``first`` and ``next`` are where a term and its successor start,
    and their distance is the count.
    """
    keep = keep or ("chunk_id",)
    ordered = F.sort_array(terms(F.col("chunk_text")))
    prepared = chunks.select(*keep, ordered.alias("_terms"))
    starts = F.transform(
        "_terms",
        lambda term, i: F.when(
            (i == 0) | (term != F.get("_terms", F.greatest(i - 1, F.lit(0)))), i
        ),
    )
    located = prepared.select(*keep, "_terms", F.array_compact(starts).alias("_first"))
    groups = F.size("_first")
    following = F.concat(F.slice("_first", F.lit(2), groups), F.array(F.size("_terms")))
    zipped = F.arrays_zip(
        F.array_distinct("_terms").alias("term"),
        F.col("_first").alias("first"),
        F.slice(following, F.lit(1), groups).alias("next"),
    )
    return located.select(
        *keep, F.size("_terms").cast("bigint").alias("chunk_length"), zipped.alias("counts")
    )


def postings(index: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row per chunk and term: key, length, term, tf."""
    return index.select(key, "chunk_length", F.inline("counts")).select(
        key, "chunk_length", "term", (F.col("next") - F.col("first")).cast("bigint").alias("tf")
    )


def search_index(
    index: DataFrame, queries: DataFrame, key: str = "chunk_id"
) -> DataFrame:
    """BM25 score of every chunk that shares a term with a query.

    The index is partitioned by chunk, so that, where Spark broadcasts the
    queries' terms by their measured size, the scores of a chunk are summed and
    ranked in its task: no pair of query and chunk is shuffled but each task's
    best. With more terms than that, both sides meet by term.
    """
    wanted = written(query_terms(queries), "query-terms")
    asked = wanted.select("term").distinct()
    frequency = (
        postings(index, key).join(asked, "term", "left_semi").groupBy("term").agg(
            F.count("*").alias("df")
        )
    )
    corpus = index.agg(
        F.struct(F.count("*").alias("chunks"), F.avg("chunk_length").alias("mean_length"))
    ).scalar()
    half = F.lit(0.5)
    idf = F.log(1 + (corpus["chunks"] - F.col("df") + half) / (F.col("df") + half))
    weights = wanted.join(frequency, "term").select("query_id", "term", idf.alias("idf"))
    weighted = written(weights, "query-weights")
    length = F.col("chunk_length") / corpus["mean_length"]
    tf = F.col("tf")
    saturated = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
    return (
        postings(index.repartition(key), key)
        .select(key, "term", saturated.alias("saturated"))
        .join(weighted, "term")
        .groupBy("query_id", key)
        .agg(F.round(F.sum(F.col("idf") * F.col("saturated")), SCORE_DIGITS).alias("score"))
    )


def top_k(scores: DataFrame, k: int = MAX_RESULTS, key: str = "chunk_id") -> DataFrame:
    """The best ``k`` chunks per query; equal scores keep key order.

    Spark limits each task to its own best ``k`` rows before the shuffle.
    """
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _corpus(index: DataFrame) -> Column:
    """Number of chunks and their mean length, as a scalar subquery."""
    return index.agg(
        F.struct(F.count("*").alias("chunks"), F.avg("chunk_length").alias("mean_length"))
    ).scalar()


def impacts(index: DataFrame, asked: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, term, impact`` of the asked terms: what a score takes times the term's idf."""
    length = F.col("chunk_length") / _corpus(index)["mean_length"]
    tf = F.col("tf")
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
    return postings(index, key).select(key, "term", impact.alias("impact")).join(
        asked, "term", "left_semi"
    )


def term_bounds(index: DataFrame, lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """``query_id, term, df, idf, most``: a term can add ``most`` to a score and no more.

    ``before`` counts the postings of the query's rarer terms.
    """
    half = F.lit(0.5)
    chunks = _corpus(index)["chunks"]
    terms_met = lists.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("top"))
    idf = F.log(1 + (chunks - F.col("df") + half) / (F.col("df") + half))
    rarer = (
        Window.partitionBy("query_id").orderBy("df", "term")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        wanted.join(terms_met, "term")
        .select("query_id", "term", "df", idf.alias("idf"), (idf * F.col("top")).alias("most"))
        .withColumn("before", F.coalesce(F.sum("df").over(rarer), F.lit(0)))
    )


def _added(lists: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Sum of the weighted impacts of each query and chunk that share a term."""
    return lists.join(weights.select("query_id", "term", "idf"), "term").groupBy(
        "query_id", key
    ).agg(F.sum(F.col("idf") * F.col("impact")).alias("part"))


def _completed(pairs: DataFrame, lists: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """The whole score of the given pairs of query and chunk."""
    return (
        lists.join(pairs.select("query_id", key), key)
        .join(weights.select("query_id", "term", "idf"), ["query_id", "term"])
        .groupBy("query_id", key)
        .agg(F.sum(F.col("idf") * F.col("impact")).alias("whole"))
    )


def score_floors(lists: DataFrame, weights: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """``query_id, floor``: a score that ``k`` chunks reach, where so many are found.

    The chunks that a query's rarest terms rank best are scored whole; the
    ``k``-th best of these scores can't exceed that of all chunks.
    """
    rare = weights.where(F.col("before") < RARE_POSTINGS)
    place = Window.partitionBy("query_id").orderBy(F.col("part").desc(), F.col(key))
    tried = _added(lists, rare, key).withColumn("_place", F.row_number().over(place)).where(
        F.col("_place") <= TRIED * k
    )
    whole = _completed(written(tried.select("query_id", key), "tried"), lists, weights, key)
    best = Window.partitionBy("query_id").orderBy(F.col("whole").desc())
    return whole.withColumn("_place", F.row_number().over(best)).where(F.col("_place") == k).select(
        "query_id", F.col("whole").alias("floor")
    )


def reachable(lists: DataFrame, weights: DataFrame, floors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The pairs of query and chunk whose score may reach the query's floor.

    A query's terms are ordered by what they can add. The weakest, which together
    stay below ``WEAK`` of the floor, are left out at first: a chunk must find the
    rest of the floor in stronger terms, and what these add to it, with all that
    the weak ones could, is its bound. No pair that reaches the floor is missed.
    """
    weaker = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    judged = (
        weights.join(floors, "query_id", "left")
        .withColumn("_sum", F.sum("most").over(weaker))
        .withColumn("_low", F.coalesce(F.col("floor"), F.lit(0.0)) - SLACK)
        .withColumn("_weak", F.col("_sum") < F.col("_low") * WEAK)
    )
    judged = written(judged, "judged-terms")
    rest = judged.groupBy("query_id").agg(
        F.coalesce(F.sum(F.when(F.col("_weak"), F.col("most"))), F.lit(0.0)).alias("_rest"),
        F.max("_low").alias("_low"),
    )
    met = _added(lists, judged.where(~F.col("_weak")), key)
    return met.join(rest, "query_id").where(F.col("part") + F.col("_rest") >= F.col("_low")).select(
        "query_id", key
    )


def best_chunks(
    index: DataFrame, queries: DataFrame, k: int = MAX_RESULTS, key: str = "chunk_id"
) -> DataFrame:
    """The best ``k`` chunks of every query, as ``top_k(search_index(...))`` gives them.

    Exact, but few pairs are scored: the postings of the asked terms are written
    once with their impacts; a query's rare terms give a floor that its results
    must reach; only chunks that hold a term strong enough, and whose bound
    reaches the floor, are scored whole. A query with fewer than ``k`` results
    has no floor and scores every chunk that shares a term.
    """
    wanted = written(query_terms(queries), "query-terms")
    lists = written(impacts(index, wanted.select("term").distinct(), key), "impacts")
    weights = written(term_bounds(index, lists, wanted), "term-bounds")
    floors = written(score_floors(lists, weights, k, key), "floors")
    pairs = written(reachable(lists, weights, floors, key), "reachable")
    scores = _completed(pairs, lists, weights, key).select(
        "query_id", key, F.round("whole", SCORE_DIGITS).alias("score")
    )
    return top_k(scores, k, key)


def search_chunks(
    chunks: DataFrame,
    queries: DataFrame,
    filters: dict[str, str] | None = None,
    k: int = MAX_RESULTS,
) -> DataFrame:
    """The best chunks for every query, with id, text and title columns.

    ``filters`` are equality conditions on attributes such as document type,
    vendor, region or path; they narrow the corpus before it is scored.
    """
    corpus = chunks
    for column, value in (filters or {}).items():
        corpus = corpus.where(F.col(column) == value)
    # Terms are counted row by row: the chunks of few large files spread out first.
    spread = corpus.repartition("chunk_id")
    index = written(index_chunks(spread, *corpus.columns), "index")
    ranked = written(best_chunks(index, queries, k), "ranked")
    shown = [c for c in corpus.columns if c != "chunk_id"]
    return index.select("chunk_id", *shown).join(ranked, "chunk_id")
