"""Golden runs, document loads and the order of metric queries."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from granary.plans import document_load, golden, metrics
from granary.sources import load_ledger


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, "a int, b int, c string")


ROWS = [(k, None if k % 7 == 0 else k % 5, f"r{k % 11}") for k in range(500)] + [(1, 1, "same")] * 50


def run(spark, folder, actual, expected):
    golden.store_result(expected, f"{folder}/e")
    return golden.golden_run(spark, {"q": actual}, {"q": f"{folder}/e"}).first().asDict()


@pytest.mark.parametrize(
    ("change", "missing", "unexpected"),
    [
        (lambda rows: rows[::-1], 0, 0),
        (lambda rows: rows[1:], 1, 0),
        (lambda rows: [*rows, (1, 1, "same")], 0, 1),
        (lambda rows: [*rows[1:], (None, 0, "r0")], 1, 1),
        (lambda rows: [], 550, 0),
    ],
)
def test_golden_runs_compare_multisets(spark, frame, tmp_path, change, missing, unexpected):
    found = run(spark, tmp_path, frame(change(ROWS)).repartition(3), frame(ROWS))
    status = "FAILED" if missing or unexpected else "PASSED"
    assert (found["status"], found["missing_rows"], found["unexpected_rows"]) == (status, missing, unexpected)
    assert found["row_count"] == len(change(ROWS))
    assert found["opened_buckets"] <= missing + unexpected


def test_golden_runs_know_empty_unstored_and_other_columns(spark, frame, tmp_path):
    none = frame([])
    assert run(spark, tmp_path / "1", none, none)["status"] == "PASSED"
    assert run(spark, tmp_path / "2", frame(ROWS[:3]), none)["unexpected_rows"] == 3
    other = run(spark, tmp_path / "3", frame(ROWS), frame(ROWS[:9]).drop("c"))
    assert (other["status"], other["missing_rows"], other["unexpected_rows"]) == ("FAILED", 9, 550)
    report = golden.golden_run(spark, {"q": none, "r": frame(ROWS)}, {"r": str(tmp_path / "nothing")})
    assert {r.query_name: r.status for r in report.collect()} == {"q": "NOT_RUN", "r": "NOT_RUN"}


def test_only_differing_buckets_are_read(spark, frame, tmp_path):
    golden.store_result(frame(ROWS), str(tmp_path / "e"))
    changed = [(r[0], r[1], "x") if r[0] == 3 else r for r in ROWS]
    golden.store_result(frame(changed), str(tmp_path / "a"))
    for bucket in reversed(range(golden.BUCKETS)):  # one that is the same on both sides may be gone
        prints = [spark.read.parquet(f"{tmp_path}/{x}/fingerprints").where(F.col("_bucket") == bucket).collect() for x in "ae"]
        if prints[0] == prints[1]:
            for file in (tmp_path / "e" / "rows" / f"_bucket={bucket}").glob("*.parquet"):
                file.write_bytes(b"broken")
            break
    found = golden.compare_stored(spark, "q", str(tmp_path / "a"), str(tmp_path / "e"))
    assert found[:5] == ("q", "FAILED", 550, 1, 1)


DOCS = [
    ("x/acme_contract.pdf", "word " * 1200), ("x/sla_west.docx", "one two"), ("x/notes.txt", "no document"),
    ("a/minutes.pdf", ""), ("a/null.pdf", None), (None, "lost"), ("b/twice.pdf", "same"), ("b/twice.pdf", "same"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "relative_path string, text string").repartition(3)


def state(spark, root):
    metadata, chunks = document_load.read_documents(spark, root)
    return (
        sorted((r.document_id, r.file_path) for r in metadata.collect()),
        sorted((r.chunk_id, r.document_id, r.chunk_index, r.file_path) for r in chunks.collect()),
    )


def test_a_load_publishes_both_tables_or_none(spark, docs, tmp_path, monkeypatch):
    root = str(tmp_path / "docs")
    assert document_load.published(spark, root) == (0, [])
    with pytest.raises(ValueError):
        document_load.read_documents(spark, root)
    assert document_load.load_documents(docs, root) == "Processed 6 files, created 6 chunks"
    first = state(spark, root)
    assert [i for i, _ in first[0]] == list(range(1, 7)) and [i for i, *_ in first[1]] == list(range(1, 7))
    assert [p for _, p in first[0]] == sorted(p for p, _ in DOCS if p and not p.endswith(".txt"))

    real = document_load.number_chunks
    monkeypatch.setattr(document_load, "number_chunks", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        document_load.load_documents(docs, root, "append")
    assert state(spark, root) == first
    monkeypatch.setattr(document_load, "number_chunks", real)

    assert document_load.load_documents(docs, root, "append") == "Processed 6 files, created 12 chunks"
    both = state(spark, root)
    assert [i for i, _ in both[0]] == list(range(1, 13)) and [i for i, *_ in both[1]] == list(range(1, 13))
    assert {(c[1], c[3]) for c in both[1]} <= set(both[0])
    assert document_load.load_documents(docs.limit(0), root, "append") == "Processed 0 files, created 12 chunks"
    assert document_load.load_documents(docs, root, chunks="whole") == "Processed 6 files, created 6 chunks"
    assert len(state(spark, root)[0]) == 6
    with pytest.raises(ValueError):
        document_load.load_documents(docs, root, "merge")


def test_an_empty_load_is_an_empty_pair(spark, docs, tmp_path):
    root = str(tmp_path / "docs")
    assert document_load.load_documents(docs.limit(0), root) == "Processed 0 files, created 0 chunks"
    assert state(spark, root) == ([], [])
    assert document_load.load_documents(docs, root, "append") == "Processed 6 files, created 6 chunks"


def test_metrics_come_in_the_order_asked(tables):
    ask = {"metrics": ["total units"], "dims": ["scenario", "site_code"]}
    rows = metrics.metric_query(tables, **ask, order=["sum quantity DESC", "scenario asc", "site_code"]).collect()
    keys = [(-r.total_forecasted_quantity, r.scenario_code, r.site_code) for r in rows]
    assert keys == sorted(keys) and len(keys) > 1
    top = metrics.metric_query(tables, **ask, order=["sum quantity desc", "scenario", "site_code"], limit=1)
    assert top.collect() == rows[:1]
    for order, limit in ((["region"], None), (["margin"], None), ([], 3)):
        with pytest.raises((KeyError, ValueError)):
            metrics.metric_query(tables, **ask, order=order, limit=limit)


def test_metrics_of_another_table_read_its_own_rows(tables):
    total = metrics.Metric(lambda: F.sum("total_forecasted_revenue"))
    model = metrics.TableModel(("scenario_code",), (), ("total_forecasted_revenue",), {"revenue": total})
    rows = metrics.metric_query(
        tables, "scenario_kpi", metrics=["revenue"], dims=["scenario_code"], models={"scenario_kpi": model}
    ).collect()
    facts = metrics.metric_query(tables, "scenario_kpi", dims=["scenario_code"], facts=["total_forecasted_revenue"]).collect()
    assert {(r.scenario_code, Decimal(r.revenue)) for r in rows} == {
        (r.scenario_code, Decimal(r.total_forecasted_revenue)) for r in facts
    }


def _file(folder, name, rows, header="site_id,site_name"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([header, *rows]) + "\n")


def _loads(spark, root):
    rows = load_ledger.read_loads(spark, root, "site").collect()
    return sorted((r.number, r._source_file_name, r._source_file_row_number, r.site_id, r.site_name) for r in rows)


def test_only_new_or_changed_files_are_loaded(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "raw")
    _file(folder, "a_sites.csv", ["1,x", "2,y", "2,y"])
    _file(folder, "b_sites.csv", ["z,3"], "SITE_NAME,SITE_ID")
    assert _loads(spark, root) == []
    assert load_ledger.load_new_files(spark, str(folder), root, "site").count() == 2
    first = [(1, "a_sites.csv", k, i, n) for k, i, n in ((1, "1", "x"), (2, "2", "y"), (3, "2", "y"))]
    first.append((1, "b_sites.csv", 1, "3", "z"))
    assert _loads(spark, root) == first
    assert load_ledger.load_new_files(spark, str(folder), root, "site").count() == 0
    _file(folder, "a_sites.csv", ["1,x", "2,w"])
    assert load_ledger.load_new_files(spark, str(folder), root, "site").count() == 1
    second = [(2, "a_sites.csv", 1, "1", "x"), (2, "a_sites.csv", 2, "2", "w")]
    assert _loads(spark, root) == first + second
    assert load_ledger.load_new_files(spark, str(folder), root, "site", force=True).count() == 2
    assert len(_loads(spark, root)) == 9


def test_rows_are_numbered_over_all_splits_of_a_file(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "raw")
    _file(folder, "a_sites.csv", [f"{k},{'n' * (k % 50)}" for k in range(1, 3001)])
    _file(folder, "b_sites.csv", [f"{k},b" for k in range(1, 20)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    try:
        load_ledger.load_new_files(spark, str(folder), root, "site")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = load_ledger.read_loads(spark, root, "site")
    assert rows.where("site_id != _source_file_row_number").count() == 0 and rows.count() == 3019


def test_a_load_that_fails_is_not_seen(spark, tmp_path, monkeypatch):
    folder, root = tmp_path / "in", str(tmp_path / "raw")
    _file(folder, "a_sites.csv", ["1,x"])
    with monkeypatch.context() as broken:
        broken.setattr(load_ledger.raw_csv, "placed_rows", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            load_ledger.load_new_files(spark, str(folder), root, "site")
    assert _loads(spark, root) == []
    load_ledger.load_new_files(spark, str(folder), root, "site")
    assert len(_loads(spark, root)) == 1
