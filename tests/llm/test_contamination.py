"""Suffix-array decontamination against plain window search."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from granary.llm.contamination import (
    SuffixShard, TestBlock, contaminated_documents, drop_contaminated, longest_matches, words_of,
)
from .conftest import texts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = [
    ("i1", "the quick brown fox jumps over the lazy dog and runs"),
    ("i2", "SAME"), ("i2", "same"), ("i3", None), ("i4", " . "), (None, "naïve café 日本語"),
    ("i5", "words go on and on long words go on and on long words go on"), ("i6", "never seen anywhere"),
]


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(rows, items, window=10):
    wanted = {}
    for item_id, text in items:
        words = plain_words(text)
        size = min(window, len(words))
        for p in range(len(words) - size + 1 if words else 0):
            wanted.setdefault(tuple(words[p : p + size]), set()).add("" if item_id is None else str(item_id))
    sizes = {len(w) for w in wanted}
    out = []
    for doc_id, text in rows:
        words, hit, met = plain_words(text), set(), set()
        for size in sizes:
            for p in range(len(words) - size + 1):
                if owners := wanted.get(tuple(words[p : p + size])):
                    hit.update(range(p, p + size))
                    met |= owners
        digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(met), digest, bool(hit)))
    return Counter(out)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id string, text string, doc_id string")


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 200}, {"block_bytes": 1}, {"shard_bytes": 1, "block_bytes": 30}])
def test_odd_rows_equal_brute_force(odd, items, sizes):
    found = contaminated_documents(odd, items, **sizes)
    assert Counter(map(tuple, found.collect())) == plain_hits(texts(odd), ITEMS)


def test_whole_table_equals_brute_force(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = plain_hits(texts(documents), [(r.item_id, r.text) for r in bench.collect()])
    assert Counter(map(tuple, contaminated_documents(documents, bench).collect())) == want
    assert sum(n for row, n in want.items() if row[-1]) > 0


def test_empty_tables(spark, odd, none, items):
    assert contaminated_documents(none, items).collect() == []
    nothing = items.limit(0)
    assert not any(r.contaminated or r.n_items for r in contaminated_documents(odd, nothing).collect())
    assert drop_contaminated(odd, nothing).count() == odd.count()
    assert longest_matches(odd, nothing).collect() == []


def test_affected_documents_go_with_all_columns(odd, items):
    left = drop_contaminated(odd, items, shard_bytes=300)
    assert left.schema == odd.schema
    bad = {row[0] for row in plain_hits(texts(odd), ITEMS) if row[-1]}
    clean = [(i, t) for i, t in texts(odd) if not plain_hits([(i, t)], ITEMS).keys() & {r for r in plain_hits([(i, t)], ITEMS) if r[-1]}]
    assert Counter(texts(left)) == Counter(clean) and bad


def test_longest_matches_equal_brute_force(spark):
    rng = random.Random(4)
    words = lambda n, pool="abcd": " ".join(rng.choice(pool) for _ in range(n))
    docs = [(k if k % 7 else None, words(rng.randrange(0, 40))) for k in range(1, 60)]
    docs += docs[:9]
    tests = [(f"t{k}", words(rng.randrange(0, 15), "abcde")) for k in range(12)]
    found = longest_matches(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4),
        spark.createDataFrame(tests, "item_id string, text string"), 3, shard_bytes=300, block_bytes=60,
    )
    want = set()
    for item_id, text in tests:
        item = text.split()
        for start in range(len(item)):
            for length in range(len(item) - start, 2, -1):
                places = [
                    (i is None, i, p) for i, t in docs for p in range(len(t.split()) - length + 1)
                    if t.split()[p : p + length] == item[start : start + length]
                ]
                if places:
                    first = min(places, key=lambda x: (x[0], x[1] or 0, x[2]))
                    want.add((item_id, start, length, len(places), *first[1:]))
                    break
    assert {tuple(r) for r in found.collect()} == want and want


def test_suffixes_are_in_order_to_the_depth():
    rng = random.Random(9)
    for _ in range(60):
        docs = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))).encode() for _ in range(rng.randrange(1, 6))]
        depth = rng.randrange(1, 50)
        shard = SuffixShard(docs * 2, depth)
        ends = {int(p): int(e) for e in shard.ends for p in range(e)}
        ends = {p: min(int(e) for e in shard.ends if e >= p) for p in ends}
        cut = [tuple(shard.words[p : min(p + depth, ends[p])]) for p in shard.order.tolist()]
        assert cut == sorted(cut) and len(cut) == int((shard.words > 0).sum())


def test_words_of_long_texts_come_whole():
    text = "Ab1-é\x00日本 " * 300_000
    assert sum(map(len, words_of(text.encode()))) == 900_000
    assert [w.decode() for run in words_of(text.encode()[:28]) for w in run][:3] == ["ab1", "é", "日本"]
    assert TestBlock([("a", b"x y z"), ("b", b"x y"), ("c", b"")], 2).sizes.tolist() == [2, 2]
