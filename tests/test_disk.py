"""What streams keep on disk: shuffles end with their query, texts move once."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from granary import registry
from granary.operators.durable import shuffles_released, written
from granary.operators.sieve import Sieve
from granary.streaming import kpi_deltas as deltas
from granary.streaming import search_index as index_jobs


def _shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffle_files_end_with_the_query_that_is_stored(spark):
    before = _shuffle_files(spark)
    rows = written(spark.range(5000).repartition(7, "id"), "ended")
    assert len(rows.collect()) == 5000
    with shuffles_released(spark):
        spark.range(5000).groupBy(F.col("id") % 9).count().write.format("noop").mode("overwrite").save()
    assert _shuffle_files(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_sieve_lets_all_members_through_and_few_others(spark):
    members = spark.range(0, 6000, 3).selectExpr("CAST(id AS STRING) AS name", "id % 4 AS batch_id")
    sieve = Sieve(members, ("name", "batch_id"))
    assert sieve.marked(members, "in").where("in").count() == 2000
    others = spark.range(0, 20000).selectExpr("CAST(id AS STRING) AS name", "(id + 1) % 4 AS batch_id")
    assert sieve.marked(others, "in").count() == 20000
    assert sieve.marked(others, "in").where("in").count() < 20000 / 25
    assert Sieve(members.where("false"), ("name",)).marked(others, "in").where("in").count() == 0


def _index(spark, root):
    sent = "document_id string, text string, version int, deleted boolean, region string"
    batches = [
        [(str(i), f"alpha w{i} " * 3, 1, False, "West") for i in range(300)] + [(None, "alpha none", 1, False, "West")],
        [(str(i), f"beta w{i}", 2, i % 3 == 0, "East") for i in range(200)]
        + [("7", "zeta", 2, False, "East"), ("6", "gone or not", 2, False, "East"), (None, "beta none", 2, False, "West")],
    ]
    for number, rows in enumerate(batches):
        index_jobs.index_batch(spark.createDataFrame(rows, sent), number, root, "tokens", 500, ["region"])
    live = {str(i): f"beta w{i}" for i in range(200) if i % 3} | {"7": "zeta"}
    return live | {str(i): " ".join([f"alpha w{i}"] * 3) for i in range(200, 300)}


def test_chunks_are_judged_where_they_lie(spark, tmp_path):
    """A text is shuffled to find a batch's last row of a document, never to find the live chunks."""
    root = str(tmp_path / "index")
    wanted = _index(spark, root)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # smaller than the versions, as at size
    try:
        found = index_jobs.read_index(spark, root)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        rows = [(r[0], r[1]) for r in found.select("document_id", "chunk_text").collect()]
        # No version can take a document without an id away.
        assert sorted(t for i, t in rows if i is None) == ["alpha none", "beta none"]
        assert {i: t for i, t in rows if i is not None} == wanted and len(rows) == len(wanted) + 2
        index_jobs.compact_index(spark, root, f"{root}/small")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    small = index_jobs.read_index(spark, f"{root}/small").select("document_id", "chunk_text").collect()
    assert {r[0]: r[1] for r in small} == wanted and len(small) == len(wanted)


def test_all_that_is_sent_lands_once_without_a_shuffle(spark, tmp_path):
    columns = ("relative_path", "document_type", "vendor_name", "region")
    docs = spark.range(200).select(
        F.col("id").cast("string").alias("document_id"), F.concat(F.lit("text "), "id").alias("text"),
        *[F.lit(c).alias(c) for c in columns],
    )
    changes, folder, before = written(docs, "docs"), str(tmp_path / "in"), _shuffle_files(spark)
    counts = []
    for turn in range(registry.ARRIVALS):
        registry._land(changes, turn, folder)
        counts.append(len(spark.read.parquet(folder).select("version").collect()))
    assert _shuffle_files(spark) <= before
    assert counts[-1] == 800 and min(b - a for a, b in zip([0, *counts], counts)) > 100
    landed = spark.read.parquet(folder).selectExpr("document_id", "version", "deleted", "text").collect()
    of = {tuple(r) for r in landed if r[0] in ("17", "old17")}
    assert len({tuple(r) for r in landed}) == 800 and of == {
        ("17", 2, False, "text 17"), ("17", 1, False, "draft text 17 text 17"),
        ("old17", 1, False, "text 17"), ("old17", 2, True, "text 17"),
    }


def test_a_text_sent_once_is_indexed_where_it_lies(spark, tmp_path, monkeypatch):
    root, folder = str(tmp_path / "index"), str(tmp_path / "in")
    texts = spark.range(400).selectExpr(
        "CAST(id AS STRING) AS document_id", "concat('words ', repeat(concat(sha2(CAST(id AS STRING), 512), ' '), 40)) AS text",
        "1 AS version", "false AS deleted",
    )
    again = spark.createDataFrame(
        [("5", "five", 2, False), ("6", "six a", 2, False), ("6", "six b", 2, False), ("7", "seven", 1, True)],
        "document_id string, text string, version int, deleted boolean",
    )
    texts.unionByName(again).repartition(4).write.parquet(folder)
    compared = []

    def seen(rows):
        compared.append(rows.count())
        return plain(rows)

    plain = index_jobs._arrivals
    monkeypatch.setattr(index_jobs, "_arrivals", seen)
    index_jobs.index_batch(spark.read.parquet(folder), 0, root, "whole", 500)
    assert compared and 7 <= compared[0] < 40
    found = {r[0]: r[1] for r in index_jobs.read_index(spark, root).select("document_id", "chunk_text").collect()}
    assert len(found) == 399 and found["5"] == "five" and found["6"] == "six b" and "7" not in found
    assert found["399"].startswith("words ")


def _lines(spark, count, products):
    return spark.range(count).selectExpr(
        "1L AS scenario_id", f"id % {products} AS product_id", "id % 25 AS site_id", "CAST(id % 7 AS decimal(18,4)) AS quantity",
        "1L AS n", "CAST(2 AS decimal(38,2)) AS revenue", "1L AS n_revenue",
    ).withColumns({"product_bucket": deltas._bucket("product_id"), "site_bucket": deltas._bucket("site_id")})


def test_cells_are_summed_where_their_files_are_written(spark, tmp_path):
    root, lines = str(tmp_path / "kpis"), _lines(spark, 7000, 40)
    plan = deltas.CELLS.summed(lines)._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert [[c.split("#")[0].strip() for c in m.split(",")][:3] for m in moved] == [["product_bucket", "site_bucket", "_part"]]
    kept = _shuffle_files(spark)
    deltas.CELLS.add(lines, root, 0)
    assert _shuffle_files(spark) <= kept
    cells = deltas.CELLS.rows(spark, root, 1)
    assert cells.agg(F.sum("n"), F.sum("revenue")).first() == (7000, 14000)
    assert cells.count() == lines.select("product_id", "site_id", "quantity").distinct().count() == 1400


def test_effects_are_kept_by_product_and_by_site(spark, tables, tmp_path, monkeypatch):
    """A side without rows has no product of its own, and no line is stored as an effect."""
    root, made, stored = str(tmp_path / "kpis"), [], []
    effects, write = deltas._effects, deltas.written
    monkeypatch.setattr(deltas, "_effects", lambda *sides: made.append(1) or effects(*sides))
    monkeypatch.setattr(deltas, "written", lambda rows, *name: stored.append(write(rows, *name)) or stored[-1])
    line = tables.demand_forecast_versions.where("demand_forecast_id = 1")
    many = spark.range(300).join(line.withColumn("site_id", F.lit(None).cast("bigint"))).selectExpr(
        "*", "CAST(id % 5 + 1 AS bigint) AS place"
    ).withColumns({"site_id": F.col("place"), "forecast_quantity": F.col("id").cast("decimal(18,4)")}).drop("id", "place")
    nothing = line.withColumn("scenario_id", F.lit(None).cast("bigint"))
    t = tables.with_(demand_forecast_versions=many.unionByName(nothing))
    deltas.apply_changes(deltas.all_rows(t), 0, root)
    assert len(made) == 1
    profile, sums = stored
    assert profile.count() == 5
    # Five sites and a product, with a scenario and with none.
    assert sums.count() == 8 and sums.where("scenario_id = 1 AND site_id IS NOT NULL").count() == 5
    assert not deltas.touched_cells(spark, root, 1, spark.range(9).selectExpr("id AS site_id"), "site_id").isEmpty()
    assert [r[0] for r in deltas.read_followed_kpis(spark, root).select("site_count").collect()] == [5]
