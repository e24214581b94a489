"""Decision diagrams against plain counting in every order."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from granary.llm.filter_audit import FILTERS, Diagram, audit_rows, filter_audit, plain_changes
from .conftest import ODD


def plain_audit(masks):
    """``masks``: (part, set of failed letters, good, toxic) of each document."""
    out = []
    parts = defaultdict(list)
    for part, *rest in masks:
        parts[part].append(rest)
    for part, rows in parts.items():
        removed_by = Counter()
        steps = []
        for order in map("".join, permutations(FILTERS)):
            left = rows
            for at, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                removed_by[x] += len(gone)
                fails = sum(x in r[0] for r in rows)
                steps.append((
                    part, order, at, len(left), len(gone), fails - len(gone), sum(r[0] == {x} for r in rows),
                    sum(r[1] for r in gone), sum(r[2] for r in gone),
                ))
        out += [(*s, removed_by[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def plain_masks(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = []
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows):
            fails.add("E")
        out.append((source or "", fails, doc_id in good, doc_id in toxic))
    return out


def test_every_order_comes_by_adjacent_swaps():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in plain_changes(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(n)))) == 1 + len(list(plain_changes(n)))


def test_diagrams_equal_plain_counts():
    rng = random.Random(2)
    for size in (0, 1, 5, 300):
        masks = [
            ("p", {x for x in FILTERS if rng.random() < 0.3}, rng.random() < 0.4, rng.random() < 0.1) for _ in range(size)
        ]
        counts = {}
        for _, fails, good, toxic in masks:
            m = sum(1 << FILTERS.index(x) for x in fails)
            counts[m] = tuple(a + b for a, b in zip(counts.get(m, (0, 0, 0)), (1, good, toxic)))
        rows = sorted(audit_rows("p", counts or {0: (0, 0, 0)}, FILTERS))
        assert rows == (plain_audit(masks) if masks else rows) and len(rows) == 600


def test_swapping_shares_nodes_and_comes_back():
    counts = {m: (1, 0, 0) for m in range(32)}
    diagram = Diagram(counts, FILTERS)
    assert [len(level) for level in diagram.levels] == [1] * 6  # equal halves are one node
    before = diagram.steps()
    for level in (0, 3, 3, 0):
        diagram.swap(level)
    assert diagram.steps() == before and diagram.order == list(FILTERS)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(8)
    rows = [(i, t, "s1" if k % 3 else None) for k, (i, t) in enumerate(ODD)]
    rows += [(100 + k, " ".join(rng.choice(["Aa", "bb", "c#", "dd ee ff", "XX"]) for _ in range(60)), "s2") for k in range(30)]
    rows += [(200 + k, rows[-1 - k % 2][1], ["s1", "s2", ""][k % 3]) for k in range(20)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, _, _ in rows] + [(None, 1, 1), (7777, 1, 1), (101, 1, 0)]
    return rows, labels


def test_whole_audit_equals_brute_force(spark, cases):
    rows, labels = cases
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, part string, mask int")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = filter_audit(docs.repartition(5), marks)
    assert sorted(map(tuple, found.collect())) == plain_audit(plain_masks(rows, labels))


def test_empty_tables(spark, cases):
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(cases[0], "doc_id bigint, text string, source string")
    assert filter_audit(docs.limit(0), marks).collect() == []
    assert all(r.good_lost == r.toxic_lost == 0 for r in filter_audit(docs, marks).collect())
