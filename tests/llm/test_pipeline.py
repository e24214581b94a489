"""The pipeline against a plain rerun of its decisions, and its registration."""

from __future__ import annotations

from collections import Counter

import duckdb

import corpus_pipeline
from granary.llm.oracles import ORACLES
from granary.llm.quality_rules import BASE, RULES, Text, first_rejection
from granary.llm.queries import QUERIES
from .conftest import texts
from .test_dedup import plain_fingerprint, roots
from .test_tokens import crc, library_ids


def test_stages_keep_what_plain_decisions_keep(spark, documents):
    rows = [(i, t) for i, t in texts(documents) if first_rejection(Text(t.encode()), (*BASE, *RULES)) is None]
    last = {}
    for i, t in rows:
        last[t] = max(i, last.get(t, i))
    rows = sorted((i, t) for t, i in last.items())
    prints = {i: plain_fingerprint(t) for i, t in rows}
    distinct = sorted(set(prints.values()))
    root = roots(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2])
    first = {}
    for i, _ in rows:
        first.setdefault(root[prints[i]], i)
    rows = [(i, t) for i, t in rows if first[root[prints[i]]] == i]
    ids = [x + [0] for x in library_ids("byte_bpe_50k.json", rows)]
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in found) == Counter(
        (i, s, len(x[s : s + 1024]), crc(x[s : s + 1024])) for (i, _), x in zip(rows, ids) for s in range(0, len(x), 1024)
    )


def test_stages_take_odd_rows(spark, odd_table):
    docs = odd_table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == odd_table.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 0


def test_one_query_per_operator():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14))


def test_sql_gives_the_same_rows(spark):
    duck = duckdb.connect()
    folder = "/root/testdata/sf0.001"
    for name in ("documents", "benchmark", "labels"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name, sql in ORACLES.items():
        found = QUERIES[name](spark, folder)
        expected = duck.execute(sql)
        columns = [c[0] for c in expected.description]
        assert sorted(columns) == sorted(found.columns)
        assert Counter(map(tuple, found.select(*columns).collect())) == Counter(expected.fetchall())
