"""SimHash groups, components and exact duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
import xxhash

from granary.llm.components import component_labels
from granary.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from granary.llm.simhash import ball_masks, fingerprint, fingerprint_links, keep_one_per_group, near_duplicates
from .conftest import texts


def plain_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def roots(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def plain_groups(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    near = [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2]
    root = roots(distinct, near)
    least = {}
    for (doc_id, _), p in zip(rows, prints):
        if doc_id is not None:
            least[root[p]] = min(least.get(root[p], doc_id), doc_id)
    return Counter((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints))


@pytest.mark.parametrize("table", ["odd", "documents", "none"])
def test_near_duplicates_equal_brute_force(table, request):
    df = request.getfixturevalue(table)
    found = Counter((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(df).collect())
    assert found == plain_groups(texts(df))


def test_all_links_within_two_bits_connect(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values for _ in range(3)]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    links = [(r.a, r.b) for r in fingerprint_links(nodes).collect()]
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert all(bits(a, b) <= 2 for a, b in links)
    assert roots(signed, links) == roots(signed, [(a, b) for a in signed for b in signed if a < b and bits(a, b) <= 2])
    assert len(ball_masks(2)) == 65 and len(ball_masks(4)) == 1 + 64 + 2016
    with pytest.raises(ValueError):
        ball_masks(2) and fingerprint_links(nodes, 3)


def test_long_texts_are_signed_whole():
    text = " ".join(str(k % 977) for k in range(150_000))
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 90)] + [(5, 5), (7, 6), (7, 6), (None, 3)]
    rows = component_labels(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.label for r in rows} == {**{k: 0 for k in range(201)}, **{1000 + k: 1000 for k in range(90)}}
    assert component_labels(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_one_of_each_near_group_stays(odd, none):
    kept = keep_one_per_group(odd)
    assert kept.columns == odd.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {1, 3, 6, 8}.issubset(ids) and not {2, 4, 5, 7} & ids
    assert keep_one_per_group(none).count() == 0


@pytest.mark.parametrize("table", ["odd_table", "documents", "none"])
def test_exact_duplicates_equal_brute_force(table, request):
    df = request.getfixturevalue(table)
    rows = texts(df)
    size = Counter(t or "" for _, t in rows)
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    found = exact_duplicates(df).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == Counter(
        (i, None if best[t or ""] < 0 else best[t or ""], size[t or ""], hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in rows
    )
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter(
        {hashlib.sha256(t.encode()).hexdigest(): 1 for t in size}
    )
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    left = drop_exact_duplicates(df)
    assert left.columns == df.columns
    assert Counter(t or "" for _, t in texts(left)) == Counter(dict.fromkeys(size, 1))


def test_decisions_hold_when_the_table_is_split_anew(spark, tmp_path):
    """Executors come and go: each step may read the same table in other splits."""
    path = str(tmp_path / "documents.parquet")
    rows = [(k % 400, f"text {k % 150}", f"x{k}") for k in range(900)]
    spark.createDataFrame(rows, "doc_id bigint, text string, note string").repartition(7).write.parquet(path)
    setting = "spark.sql.leafNodeDefaultParallelism"
    results = []
    try:
        for first, second in ((1, 8), (8, 2), (3, 3)):
            spark.conf.set(setting, first)
            left, found = (f(spark.read.parquet(path)) for f in (drop_exact_duplicates, exact_duplicates))
            spark.conf.set(setting, second)
            assert Counter(r.text for r in left.collect()) == Counter({f"text {k}": 1 for k in range(150)})
            results.append((
                sorted((r.doc_id, r.text) for r in left.collect()),
                sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect()),
            ))
    finally:
        spark.conf.unset(setting)
    assert results[0] == results[1] == results[2]
    assert sum(row[3] for row in results[0][1]) == 150


def test_one_of_a_hot_repeated_row_stays(spark):
    rows = [(5, "hot", k) for k in range(500)] + [(4, "hot", 1), (None, "none", 1), (None, "none", 2), (6, "alone", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `n.x` int").repartition(6)
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "none"), (5, "hot"), (6, "alone")]
    found = exact_duplicates(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == Counter(
        {(5, 5, 501, True): 1, (5, 5, 501, False): 499, (4, 5, 501, False): 1, (None, None, 2, True): 1, (None, None, 2, False): 1, (6, 6, 1, True): 1}
    )
