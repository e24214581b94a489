"""Metrics, quality reports, documents, search and streams."""

from __future__ import annotations

import math
import random
import re

import pytest
from conftest import FORECASTS, SCENARIOS, make_tables
from pyspark.sql import functions as F

from granary.plans import builder, dashboards, documents, mart, metrics, quality
from granary.plans import search as searching
from granary.plans.search import index_chunks, postings
from granary.schemas import ALLOWED_VALUES, FOREIGN_KEYS, PRIMARY_KEY
from granary.sources.driver_tables import as_of
from granary.sources.tables import read_tables, write_tables
from granary.streaming import kpis as kpi_jobs
from granary.streaming import search_index as index_jobs
from granary.streaming import versions as version_jobs


# Metrics ---------------------------------------------------------------------


def test_synonyms_resolve(tables):
    by_name = metrics.metric_query(
        tables, metrics=["total_warehousing_cost"], dims=["scenario_code"], filters=["october_only"]
    )
    by_synonym = metrics.warehousing_cost_october(tables)
    assert by_name.exceptAll(by_synonym).isEmpty() and by_name.count() == 2


def test_metrics_equal_the_view(tables):
    view = mart.scenario_comparison(tables).groupBy("region").agg(
        F.sum("total_revenue").alias("r"),
        F.sum("projected_warehousing_cost").alias("s"),
        F.avg(F.col("confidence_level").cast("double")).alias("c"),
    )
    want = {r["region"]: r for r in view.collect()}
    got = metrics.metric_query(
        tables,
        metrics=["total revenue", "warehousing budget", "average_confidence", "margin %"],
        dims=["territory"],
    ).collect()
    assert len(got) == len(want) == 2
    for row in got:
        ref = want[row["region"]]
        assert row["total_forecasted_revenue"] == ref["r"]
        assert row["total_warehousing_cost"] == ref["s"]
        assert math.isclose(row["average_confidence"], ref["c"])
        assert row["gross_margin_percentage"] is not None


def test_unknown_names_raise(tables):
    for options in (
        {"metrics": ["profitability"]},
        {"metrics": ["total revenue"], "dims": ["planet"]},
        {"metrics": ["total revenue"], "filters": ["q5"]},
        {"table": "nothing", "metrics": ["total revenue"]},
        {"table": "scenario_kpi", "metrics": ["total revenue"]},
        {"facts": ["colour"]},
    ):
        with pytest.raises(KeyError):
            metrics.metric_query(tables, **options)
    with pytest.raises(ValueError):
        metrics.metric_query(tables)
    with pytest.raises(ValueError):
        metrics.metric_query(tables, metrics=["total revenue"], facts=["units"])


def test_named_filters_and_own_ones(tables):
    def quantity(*filters, models=metrics.MODELS):
        return metrics.metric_query(
            tables, metrics=["total units"], filters=filters, models=models
        ).first()[0]

    assert quantity("baseline_only", "Q3") == 400
    assert quantity("NE", "q4_push_only", "oct") == 6500
    assert quantity("q4", "baseline_only") == 5222
    model = metrics.COMPARISON.with_filter("plants", lambda: F.col("site_type") == "PLANT")
    assert quantity("plants", models={"scenario_comparison": model}) == 400


def test_cost_columns_join_only_on_demand(tables):
    def plan(name):
        df = metrics.metric_query(tables, metrics=[name], dims=["scenario"])
        return df._jdf.queryExecution().optimizedPlan().toString()

    by_rate = re.compile(r"Aggregate \[site_id#\d+L, storage_cost_per_pallet_per_day")
    assert not by_rate.search(plan("total units"))
    assert by_rate.search(plan("warehousing budget"))


def test_verified_queries_run(tables):
    assert {n: q(tables).count() for n, q in metrics.VERIFIED_QUERIES.items()} == {
        "warehousing_cost_by_scenario_october": 2,
        "margin_impact_comparison": 2,
        "revenue_by_product_family_scenario": 3,
        "northeast_capacity_impact": 3,
    }
    risk = metrics.overflow_risk(mart.warehouse_utilization(tables)).collect()
    assert risk == []


# Quality ---------------------------------------------------------------------


def _violations(t):
    return {
        (r["constraint_type"], r["table_name"], r["column_name"]): r["violations"]
        for r in quality.constraint_report(t).collect()
        if r["violations"]
    }


def test_constraints_find_each_kind(spark):
    t = make_tables(
        spark,
        scenario_definition=[*SCENARIOS, SCENARIOS[0], {"scenario_code": "NOID"}],
        demand_forecast_versions=[
            *FORECASTS,
            {**FORECASTS[0], "site_id": "77", "forecast_type": "GUESS"},
        ],
    )
    assert _violations(t) == {
        ("PRIMARY KEY", "scenario_definition", "scenario_id"): 1,
        ("NOT NULL", "scenario_definition", "scenario_id"): 1,
        ("PRIMARY KEY", "demand_forecast_versions", "demand_forecast_id"): 1,
        ("FOREIGN KEY", "demand_forecast_versions", "product_id"): 1,
        ("FOREIGN KEY", "demand_forecast_versions", "site_id"): 1,
        ("ALLOWED VALUES", "demand_forecast_versions", "forecast_type"): 1,
    }


def test_earlier_versions_are_parents_but_no_duplicates(spark):
    site = {"site_id": "3", "site_code": "S", "site_type": "PLANT", "operating_status": "ACTIVE"}
    t = make_tables(
        spark,
        site=[site, {**site, "is_current_flag": "false"}, {**site, "site_id": "4", "is_current_flag": "false"}],
        work_center=[
            {"work_center_id": "1", "site_id": "3", "work_center_type": "ASSEMBLY"},
            {"work_center_id": "2", "site_id": "4"},
            {"work_center_id": "3", "site_id": "5"},
            {"work_center_id": "4", "site_id": "5", "work_center_type": "ELSE"},
            {"work_center_id": "5"},
        ],
    )
    found = {k: n for k, n in _violations(t).items() if k[1] in ("site", "work_center")}
    assert found == {
        ("FOREIGN KEY", "work_center", "site_id"): 2,
        ("ALLOWED VALUES", "work_center", "work_center_type"): 1,
    }


def test_constraints_of_empty_tables_are_all_listed_and_kept(spark):
    t = make_tables(spark)
    empty = t.with_(**{name: df.where("false") for name, df in t.items()})
    found = quality.constraint_report(empty).collect()
    listed = 2 * len(PRIMARY_KEY) + len(ALLOWED_VALUES) + len(FOREIGN_KEYS)
    assert len(found) == listed and all(r["violations"] == 0 for r in found)


def test_constraints_scan_each_stored_table_once(spark, tmp_path):
    write_tables(make_tables(spark), str(tmp_path))
    plan = quality.constraint_report(read_tables(spark, str(tmp_path)))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[.*\] parquet", text)) == len(PRIMARY_KEY)
    assert "Join" not in text


def test_golden_check_counts_multiset_differences(spark):
    def frame(*values):
        return spark.createDataFrame([(v,) for v in values], "v int")

    def check(actual, expected):
        row = quality.golden_check("q", actual, expected).first()
        return row["status"], row["missing_rows"], row["unexpected_rows"]

    assert check(frame(1, 1, None), frame(None, 1, 1)) == ("PASSED", 0, 0)
    assert check(frame(1, 2), frame(1, 1, 3)) == ("FAILED", 2, 1)
    assert check(frame(1), None) == ("NOT_RUN", 0, 0)


def test_expectations_and_profile(tables):
    report = quality.run_expectations(
        tables,
        [
            quality.Expectation("ok", dashboards.planning_stats, min_rows=1),
            quality.Expectation("few", dashboards.scenario_summary, min_rows=99),
        ],
    )
    assert {r["query_name"]: r["passed"] for r in report.collect()} == {"ok": True, "few": False}
    counts = {r[0]: r[1] for r in quality.table_profile(dict(tables.items())).collect()}
    assert counts["logistics_cost_fact"] == 14 and counts["inventory_balance"] == 0


def test_available_scenarios_have_lines(tables):
    ids = sorted(r["scenario_id"] for r in dashboards.available_scenarios(tables).collect())
    assert ids == [1, 2]
    names = [r["scenario_name"] for r in builder.scenarios_in_order(tables).collect()]
    assert names == ["Baseline Forecast", "Conservative Estimate", "Q4 Marketing Push"]


# Documents -------------------------------------------------------------------

PATHS = [
    "docs/northeast_3pl_contract.pdf",
    "warehouse_capacity_sla.pdf",
    "x/sop_meeting_minutes_aug2024.PDF",
    "acme_west.docx",
    "contracts/plain.pdf",
    "readme.txt",
]


def test_classification_rules_differ(spark):
    paths = spark.createDataFrame([(p,) for p in PATHS], "relative_path string")
    by_name = {r["file_name"]: r for r in documents.classify_documents(paths).collect()}
    assert len(by_name) == 5
    first = by_name["northeast_3pl_contract.pdf"]
    assert (first["document_type"], first["vendor_name"], first["region"]) == (
        "CONTRACT", "Northeast 3PL", "Northeast",
    )
    acme = by_name["acme_west.docx"]
    assert (acme["document_type"], acme["vendor_name"], acme["region"]) == (
        "OTHER", "ACME Logistics", "West",
    )
    assert by_name["warehouse_capacity_sla.pdf"]["vendor_name"] == "Unknown"
    assert by_name["sop_meeting_minutes_aug2024.PDF"]["document_type"] == "MEETING_MINUTES"
    assert by_name["plain.pdf"]["document_type"] == "OTHER"
    whole = {r["file_name"]: r for r in documents.classify_documents(paths, "deploy").collect()}
    assert "acme_west.docx" not in whole and len(whole) == 4
    assert whole["plain.pdf"]["document_type"] == "CONTRACT"
    assert whole["warehouse_capacity_sla.pdf"]["vendor_name"] == "National"
    with pytest.raises(ValueError):
        documents.classify_documents(paths, "guess")


def test_listing_reads_names_only(spark, tmp_path):
    for name in ("a.pdf", "b.DOCX", "c.txt"):
        (tmp_path / name).write_text("x")
    found = sorted(r[0].rsplit("/", 1)[1] for r in
                   documents.list_documents(spark, str(tmp_path)).collect())
    assert found == ["a.pdf", "b.DOCX"]


def test_chunks_hold_every_word(spark):
    texts = [" one  two\nthree four five ", "", None, "single"]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    chunks = documents.chunk_documents(docs, target_tokens=2).orderBy("document_id", "chunk_index")
    assert [(r["document_id"], r["chunk_index"], r["chunk_text"]) for r in chunks.collect()] == [
        (0, 1, "one two"), (0, 2, "three four"), (0, 3, "five"), (3, 1, "single"),
    ]
    whole = documents.chunk_documents(docs, "whole")
    assert whole.count() == 4 and whole.where("document_id = 0").first()["chunk_text"] == texts[0]
    ids = sorted(r["chunk_id"] for r in documents.number_chunks(chunks, 10).collect())
    assert ids == [11, 12, 13, 14]
    for bad in ({"mode": "pages"}, {"target_tokens": 0}):
        with pytest.raises(ValueError):
            documents.chunk_documents(docs, **bad)


CHUNKS = [
    (1, "Late delivery penalty, penalty terms", "CONTRACT"),
    (2, "warehouse capacity and overflow PENALTY", "SLA"),
    (3, "", "SLA"),
    (4, "meeting notes", "OTHER"),
]


def brute_bm25(query):
    docs = {i: [w.strip(",").lower() for w in text.split()] for i, text, _ in CHUNKS}
    mean = sum(map(len, docs.values())) / len(docs)
    scores = {}
    for term in set(query.lower().split()):
        df = sum(term in words for words in docs.values())
        for i, words in docs.items():
            tf = words.count(term)
            if tf:
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                part = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
                scores[i] = scores.get(i, 0) + part
    return {i: round(s, 6) for i, s in scores.items()}


def test_term_counts(spark):
    df = spark.createDataFrame(CHUNKS, "chunk_id long, chunk_text string, document_type string")
    counted = {(r["chunk_id"], r["term"]): (r["tf"], r["chunk_length"]) for r in
               postings(index_chunks(df)).collect()}
    assert counted[1, "penalty"] == (2, 5) and counted[2, "penalty"] == (1, 5)
    assert sum(tf for tf, _ in counted.values()) == 12
    assert index_chunks(df).where("chunk_id = 3").first()["chunk_length"] == 0


def test_search_equals_brute_force(spark):
    df = spark.createDataFrame(CHUNKS, "chunk_id long, chunk_text string, document_type string")
    text = "penalty overflow notes"
    queries = spark.createDataFrame([(1, text), (2, "nothing here")], "query_id int, query_text string")
    hits = searching.search_chunks(df, queries).collect()
    assert {r["chunk_id"]: r["score"] for r in hits} == brute_bm25(text)
    assert sorted(r["rank"] for r in hits) == [1, 2, 3]
    top = searching.search_chunks(df, queries, k=1).collect()
    assert len(top) == 1 and top[0]["rank"] == 1
    only = searching.search_chunks(df, queries, {"document_type": "SLA"}).collect()
    assert {r["chunk_id"] for r in only} == {2}


def test_pruned_search_gives_the_best_of_all_scores(spark):
    rng = random.Random(5)
    pool = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.choice([0, 3, 40, 200]))) for _ in range(400)]
    texts += texts[:40] + ["w1 w2 w1", "w1 w1 w2"] * 8  # ties
    index = searching.written(
        searching.index_chunks(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, chunk_text string")), "index"
    )
    asked = [" ".join(rng.choice(pool) for _ in range(n)) for n in (1, 2, 5, 30, 60)]
    asked += [texts[7], texts[50], "w1 w2", "nothing of it", "", None, "w299 w298"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query_text string")
    for k in (1, 5, 17):
        found = searching.best_chunks(index, queries, k).select("query_id", "chunk_id", "score", "rank")
        wanted = searching.top_k(searching.search_index(index, queries), k).select(*found.columns)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_few_pairs_reach_the_floor(spark):
    rng = random.Random(6)
    pool = [f"w{int(rng.paretovariate(0.9)) % 2000}" for _ in range(20000)]
    texts = [" ".join(rng.choice(pool) for _ in range(120)) for _ in range(500)]
    index = searching.written(
        searching.index_chunks(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, chunk_text string")), "index"
    )
    queries = spark.createDataFrame([(k, texts[k][:200]) for k in range(20)], "query_id int, query_text string")
    wanted = searching.query_terms(queries)
    lists = searching.impacts(index, wanted.select("term").distinct())
    bounds = searching.term_bounds(index, lists, wanted)
    floors = searching.score_floors(lists, bounds, 5)
    met = lists.join(bounds, "term").select("query_id", "chunk_id").distinct().count()
    assert floors.count() == 20
    assert searching.reachable(lists, bounds, floors).count() < met / 10


# Streams ---------------------------------------------------------------------


def test_kpis_cover_untouched_scenarios_and_base_changes(spark, tables, tmp_path):
    root = str(tmp_path / "store")

    def stored():
        found = kpi_jobs.read_kpis(spark, root).collect()
        return {r["scenario_id"]: (r["total_forecast_quantity"], r["total_warehousing_cost"]) for r in found}

    def batch(forecasts, t):
        found = mart.scenario_kpis(t.with_(demand_forecast_versions=forecasts), as_of=as_of()).collect()
        return {r["scenario_id"]: (r["total_forecast_quantity"], r["total_warehousing_cost"]) for r in found}

    base = tables.demand_forecast_versions
    kpi_jobs.refresh_all_kpis(spark, tables, root, as_of())
    assert stored() == batch(base, tables) and set(stored()) == {1, 2}
    sent = version_jobs.submission(_lines(spark, "2024-09-02", 5.0))
    kpi_jobs.refresh_kpis(tables, root, version_jobs.store_batch(sent, 0, root), as_of())
    late = version_jobs.submission(_lines(spark, "2024-09-01", 9.0))
    kpi_jobs.refresh_kpis(tables, root, version_jobs.store_batch(late, 1, root), as_of())
    both = base.where("scenario_id <> 2").unionByName(version_jobs.as_forecasts(sent))
    assert stored() == batch(both, tables)
    rate = "storage_cost_per_pallet_per_day"
    dear = tables.with_(logistics_cost_fact=tables.logistics_cost_fact.withColumn(
        rate, (F.col(rate) * 2).cast("decimal(18,4)")))
    kpi_jobs.refresh_all_kpis(spark, dear, root, as_of())
    assert stored() == batch(both, dear) and set(stored()) == {1, 2}


def _lines(spark, version, quantity, scenario=2, first=1):
    return spark.createDataFrame(
        [(first + i, 10, 5, scenario, quantity, version) for i in range(3)],
        "line_id long, product_id long, site_id long, scenario_id long, "
        "forecast_quantity double, version_timestamp string",
    ).withColumns({"total_revenue": F.lit(9), "fiscal_month": F.lit("October")})


def _stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_replayed_and_late_versions(spark, tmp_path):
    root, now = str(tmp_path / "store"), {"availableNow": True}
    folder = str(tmp_path / "in")
    _lines(spark, "2024-09-02", 5.0).coalesce(1).write.parquet(folder)
    _lines(spark, "2024-09-01", 1.0).coalesce(1).write.mode("append").parquet(folder)
    _lines(spark, "2024-09-01", 7.0, scenario=3).coalesce(1).write.mode("append").parquet(folder)
    for attempt in ("first", "replay"):
        version_jobs.version_stream(
            _stream(spark, folder), root, str(tmp_path / attempt), now
        ).awaitTermination()
        versions = version_jobs.read_versions(spark, root)
        live = version_jobs.current_lines(versions)
        sums = {r[0]: (r[1], r[2]) for r in
                live.groupBy("scenario_id").agg(F.sum("forecast_quantity"), F.count("*")).collect()}
        assert sums == {2: (15, 3), 3: (21, 3)}
        history = version_jobs.version_history(versions)
        assert history.count() == 9
        assert history.where("is_current_version").count() == 6
    # delivered once more under other batch numbers: still each line once
    version_jobs.store_batch(
        version_jobs.submission(_lines(spark, "2024-09-02", 5.0)), 99, root
    )
    assert version_jobs.current_lines(version_jobs.read_versions(spark, root)).count() == 6


def test_kpi_stream_equals_batch_and_touches_only_its_scenarios(spark, tables, tmp_path):
    root, folder = str(tmp_path / "store"), str(tmp_path / "in")
    now = {"availableNow": True}

    def run():
        kpi_jobs.kpi_stream(
            _stream(spark, folder), tables, root, str(tmp_path / "checkpoint"), now, as_of()
        ).awaitTermination()

    _lines(spark, "2024-09-01", 5.0).withColumn(
        "product_id", F.col("product_id").cast("int")
    ).write.parquet(folder)
    run()
    _lines(spark, "2024-09-02", 6.0, scenario=3, first=10).withColumn(
        "product_id", F.col("product_id").cast("int")
    ).write.mode("append").parquet(folder)
    untouched = [f for f in tmp_path.glob("store/kpis/scenario_id=2/*.parquet")]
    run()
    assert [f for f in tmp_path.glob("store/kpis/scenario_id=2/*.parquet")] == untouched
    live = version_jobs.current_lines(version_jobs.read_versions(spark, root))
    batch = mart.scenario_kpis(
        tables.with_(demand_forecast_versions=version_jobs.as_forecasts(live)), as_of=as_of()
    )
    stream = kpi_jobs.read_kpis(spark, root).select(*batch.columns)
    assert stream.count() == 2 and stream.exceptAll(batch).isEmpty()
    # a version of nothing but unknown products takes its scenario's row away
    lost = _lines(spark, "2024-09-03", 1.0, scenario=3, first=20)
    lost.withColumn("product_id", F.lit(999)).write.mode("append").parquet(folder)
    run()
    assert [r["scenario_id"] for r in kpi_jobs.read_kpis(spark, root).collect()] == [2]


def test_scores_are_summed_and_limited_before_the_shuffle(spark, tmp_path):
    chunks = spark.createDataFrame([(str(i), text) for i, text, _ in CHUNKS], "chunk_id string, chunk_text string")
    index_chunks(chunks).write.parquet(str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "penalty notes")], "query_id int, query_text string")
    scores = searching.search_index(spark.read.parquet(str(tmp_path / "index")), queries)
    plan = searching.top_k(scores)._jdf.queryExecution().sparkPlan().toString()
    physical = searching.top_k(scores)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", physical)
    assert [m.split("#")[0] for m in moved] == ["query_id", "chunk_id"]
    assert all("," not in re.sub(r"#\d+L?, \d+$", "", m) for m in moved)


def test_index_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, text) for i, text, _ in CHUNKS], "document_id long, text string"
    )
    folder, root = str(tmp_path / "in"), str(tmp_path / "store")
    docs.repartition(2).write.parquet(folder)
    index_jobs.index_stream(
        _stream(spark, folder), root, str(tmp_path / "cp"), {"availableNow": True}, "whole"
    ).awaitTermination()
    queries = spark.createDataFrame([(1, "penalty notes")], "query_id int, query_text string")
    hits = index_jobs.search_stored(spark, root, queries).collect()
    assert {int(r["chunk_id"].split("#")[0]): r["score"] for r in hits} == brute_bm25("penalty notes")


def test_index_takes_updates_and_deletes(spark, tmp_path):
    root = str(tmp_path / "store")
    sent = "document_id long, text string, version int, deleted boolean, region string"
    batches = [
        [(7, "alpha beta", 1, None, "West"), (8, "beta", 1, False, "East"), (9, None, 1, False, None)],
        [(7, "gamma beta", 3, False, "West"), (7, "delta", 2, False, "West"), (8, "beta", 2, True, "East")],
        [(7, "alpha late", 2, False, "West"), (8, "beta late", 1, False, "East")],
    ]
    for attempt in range(2):  # a replay changes nothing
        for number, rows in enumerate(batches):
            index_jobs.index_batch(
                spark.createDataFrame(rows, sent), number, root, "tokens", 500, ["region"]
            )
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "late")], "query_id int, query_text string")
    index_jobs.compact_index(spark, root, f"{root}/small")
    for folder in (root, f"{root}/small"):
        hits = index_jobs.search_stored(spark, folder, asked).collect()
        assert [(r["query_id"], r["chunk_id"], r["chunk_text"]) for r in hits] == [(2, "7#1", "gamma beta")]
        assert index_jobs.search_stored(spark, folder, asked, filters={"region": "East"}).isEmpty()


def test_streaming_defaults_match_the_refresh_targets():
    assert kpi_jobs.TARGET_LAG == {"processingTime": "5 minutes"}
    assert index_jobs.TARGET_LAG == {"processingTime": "1 minute"}
