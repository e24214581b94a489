"""Exact duplicates by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import free_name, quoted, stored

PREFIX_CHARS = 64


def _text() -> Column:
    return F.coalesce(quoted("text").cast("string"), F.lit(""))


def _doc_id() -> Column:
    return quoted("doc_id").cast("long")


def repeated_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, n``: how many rows of each doc_id hold a text that others hold too.

    Rows are grouped by length in bytes, those with company by a hash of their
    first characters, and only what is left by the SHA-256 of the whole text;
    the first two steps move a few numbers per row, never texts. Groups are
    counted in each task before the shuffle, and the join has unique rows on the
    right, so a group that holds a third of all rows is split by adaptive
    execution. Rows are known by their values alone, so no step depends on how
    the table is split when it is read again.
    """
    rows = docs.select(
        _doc_id().alias("doc_id"),
        F.octet_length(_text()).alias("size"),
        F.xxhash64(F.left(_text(), F.lit(PREFIX_CHARS))).alias("start"),
        _text().alias("body"),
    )
    heads = stored(rows.groupBy("size", "start").agg(F.count("*").alias("n")), "heads")
    sizes = heads.groupBy("size").agg(F.sum("n").alias("m")).where("m > 1").select("size")
    alike = stored(heads.where("n > 1").join(sizes, "size", "left_semi").drop("n"), "alike")
    full = rows.join(alike, ["size", "start"], "left_semi").select("doc_id", F.sha2("body", 256).alias("digest"))
    return stored(full.groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "digests")


def _groups(repeated: DataFrame) -> DataFrame:
    """One row per text with company: the doc_id that stays and how many rows have it."""
    best = F.max(F.struct(F.col("doc_id"), F.col("n")))
    return (
        repeated.groupBy("digest").agg(best.alias("keep"), F.sum("n").alias("group_size"))
        .where("group_size > 1")
        .select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.n").alias("n_keep"), "group_size")
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Texts are equal when identical after no change; a null text counts as empty.
    Of equal texts the row with the largest doc_id stays (a null doc_id only if
    there is no other; of rows repeated with that id, one), so exactly one row
    of each group is kept. An empty table gives no rows; other columns are
    ignored. Repeated rows are told apart by numbers that are written once.
    """
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            _doc_id().alias("doc_id"),
            F.sha2(_text(), 256).alias("digest"),
        ),
        "rows",
    )
    groups = stored(_groups(repeated_texts(docs)), "groups")
    several = groups.where("n_keep > 1").select("digest", F.col("keep_id").alias("doc_id"))
    one = (
        rows.join(several, (rows.digest == several.digest) & rows.doc_id.eqNullSafe(several.doc_id), "left_semi")
        .groupBy("digest").agg(F.max("row").alias("keep_row"))
    )
    found = rows.join(groups.join(one, "digest", "left"), "digest", "left")
    alone = F.col("group_size").isNull()
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True))
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | stays).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts.

    The cases of ``exact_duplicates`` hold. Rows go by their values, so nothing
    depends on the order or the splits in which ``docs`` is read: by doc_id
    alone where one row has it, else by doc_id and digest. Of rows repeated
    with the id that stays, one is taken by an aggregate.
    """
    repeated = repeated_texts(docs)
    groups = stored(_groups(repeated), "groups")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    judged = stored(
        repeated.join(groups, "digest").where(~stays | (F.col("n_keep") > 1)).select("doc_id", "digest", stays.alias("stays")),
        "judged",
    )
    shared = stored(
        docs.groupBy(_doc_id().alias("doc_id")).agg(F.count("*").alias("n"))
        .where("n > 1 OR doc_id IS NULL").select("doc_id"),
        "shared",
    )
    doc_id, digest, gone = (free_name(docs, name) for name in ("_doc_id", "_digest", "_gone"))

    def joined(rows: DataFrame, which: DataFrame, how: str) -> DataFrame:
        named = which.select(*(F.col(c).alias(f"{gone}{k}") for k, c in enumerate(which.columns)))
        keys = zip((doc_id, digest), named.columns)
        return rows.join(named, reduce(and_, (quoted(a).eqNullSafe(quoted(b)) for a, b in keys)), how)

    rows = docs.withColumn(doc_id, _doc_id())
    # Written, so that Spark plans with the ids' measured size.
    ids = stored(judged.select("doc_id").unionAll(shared).distinct(), "ids")
    by_id = joined(rows, ids, "left_anti")
    by_text = joined(rows, shared, "left_semi").withColumn(digest, F.sha2(_text(), 256))
    one = joined(by_text, judged.where("stays").drop("stays"), "left_semi").dropDuplicates([doc_id, digest])
    several = joined(by_text, judged.drop("stays"), "left_anti").unionAll(one).drop(digest)
    return by_id.unionAll(several).drop(doc_id)
