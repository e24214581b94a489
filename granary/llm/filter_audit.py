"""Filter interaction audit by count-weighted decision diagrams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import quoted, ready_workers, stored, to_batches

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITAL_PERCENT = 5
JUNK = "[#$%&*|]"
_BLANK = "[ \\t-\\r]+"
_AUDIT = pa.schema(
    [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())]
    + [
        (name, pa.int64())
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    ]
)
_AUDIT_DDL = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)


def plain_changes(n: int) -> Iterator[int]:
    """Adjacent swaps that lead through all orders of ``n`` things, one by one.

    ``k`` says that the things at ``k`` and ``k + 1`` change places.
    """
    if n < 2:
        return
    inner = plain_changes(n - 1)
    leftward = True
    while True:
        yield from range(n - 2, -1, -1) if leftward else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if leftward else step
        leftward = not leftward


class Diagram:
    """A decision diagram over failure bits whose nodes carry document counts.

    Every path tests all variables in ``order``; a node's low child holds the
    documents that pass its filter, the high child those that fail. Equal
    sub-diagrams of a level are one node. The weight of a node is the sum of the
    counts below it, so the all-pass path shows what each filter leaves.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], names: str):
        self.order = list(names)
        depth = len(names)
        width = len(next(iter(counts.values()), (0,)))
        self.low: list[int] = []
        self.high: list[int] = []
        self.weight: list[tuple[int, ...]] = []
        self.levels: list[dict] = [{} for _ in range(depth + 1)]
        below = [
            self._node(depth, counts.get(mask, (0,) * width), None) for mask in range(1 << depth)
        ]
        # Bit k of a mask is variable k, so the last variable is paired first.
        for level in range(depth - 1, -1, -1):
            half = 1 << level
            below = [self._node(level, below[m], below[m + half]) for m in range(half)]
        self.root = below[0]

    def _node(self, level: int, low, high) -> int:
        found = self.levels[level].get((low, high))
        if found is None:
            found = self.levels[level][low, high] = len(self.weight)
            leaf = high is None
            self.low.append(-1 if leaf else low)
            self.high.append(-1 if leaf else high)
            self.weight.append(
                low if leaf else tuple(map(sum, zip(self.weight[low], self.weight[high])))
            )
        return found

    def swap(self, level: int) -> None:
        """Exchange the variables at ``level`` and the one below, in place.

        Only nodes of these two levels change: a node keeps its number and its
        weight, so nothing above it notices, and its grandchildren are regrouped.
        """
        upper = list(self.levels[level].values())
        quads = [
            (self.low[self.low[n]], self.high[self.low[n]], self.low[self.high[n]], self.high[self.high[n]])
            for n in upper
        ]
        self.levels[level], self.levels[level + 1] = {}, {}
        for node, (pass_pass, pass_fail, fail_pass, fail_fail) in zip(upper, quads):
            self.low[node] = self._node(level + 1, pass_pass, fail_pass)
            self.high[node] = self._node(level + 1, pass_fail, fail_fail)
            self.levels[level][self.low[node], self.high[node]] = node
        order = self.order
        order[level], order[level + 1] = order[level + 1], order[level]

    def steps(self) -> list[tuple[str, tuple, tuple, tuple]]:
        """``(filter, kept, removed, alone)`` counts along the all-pass path.

        ``alone`` counts the documents below the failing edge that pass all
        filters further down; on the all-pass path they fail this filter only.
        """
        node, out = self.root, []
        for name in self.order:
            single = self.high[node]
            while self.low[single] >= 0:
                single = self.low[single]
            out.append((name, self.weight[self.low[node]], self.weight[self.high[node]], self.weight[single]))
            node = self.low[node]
        return out


def audit_rows(part: str, counts: dict[int, tuple[int, int, int]], names: str) -> Iterator[tuple]:
    """The audit of one part: a row for each order of the filters and each step."""
    diagram = Diagram(counts, names)
    orders = [("".join(diagram.order), diagram.steps())]
    for level in plain_changes(len(names)):
        diagram.swap(level)
        orders.append(("".join(diagram.order), diagram.steps()))
    fails = {steps[0][0]: steps[0][2][0] for _, steps in orders}
    shapley = dict.fromkeys(names, 0)
    for _, steps in orders:
        for name, _, removed, _ in steps:
            shapley[name] += removed[0]
    for order, steps in orders:
        for at, (name, kept, removed, alone) in enumerate(steps, 1):
            yield (
                part, order, at, kept[0], removed[0], fails[name] - removed[0], alone[0],
                removed[1], removed[2], shapley[name],
            )


def _audit(names: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row
            for batch in batches
            for part in batch.to_pylist()
            for row in audit_rows(
                part["part"], {m["mask"]: (m["n"], m["good"], m["toxic"]) for m in part["masks"]}, names
            )
        )
        return to_batches(rows, _AUDIT)

    return run


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: which of the filters A to D a text fails."""
    words = F.array_remove(F.split(text, _BLANK), "")
    n_words = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failures = (
        n_words < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n_words,
        100 * capitals > MAX_CAPITAL_PERCENT * F.length(text),
        text.rlike(JUNK),
    )
    bits = [F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(failures)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def failure_masks(docs: DataFrame, labels: DataFrame, part_column: str = "source") -> DataFrame:
    """``doc_id, part, mask, good, toxic`` of every row of ``docs``.

    Bit k of ``mask`` is set if the row fails filter k of ``FILTERS``. E, "equal
    to the text of a smaller doc_id", needs no group of copies in one place:
    each text's smallest doc_id is found by a pre-aggregated minimum, and rows
    look themselves up by doc_id and digest, keys that copies do not share.
    """
    text = F.coalesce(quoted("text").cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            quoted("doc_id").cast("long").alias("doc_id"),
            F.coalesce(quoted(part_column).cast("string"), F.lit("")).alias("part"),
            text.alias("body"),
        ).select("doc_id", "part", text_failures(F.col("body")).alias("mask"), F.sha2("body", 256).alias("digest")),
        "failures",
    )
    firsts = (
        rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
        .where("doc_id IS NOT NULL")
        .withColumn("is_first", F.lit(True))
    )
    marks = labels.select(
        quoted("doc_id").cast("long").alias("doc_id"),
        (quoted("quality") == 1).alias("good"),
        (quoted("toxic") == 1).alias("toxic"),
    )
    marks = marks.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    copied = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return (
        rows.join(firsts, ["doc_id", "digest"], "left")
        .join(marks, "doc_id", "left")
        .select(
            "doc_id", "part",
            (F.col("mask") + F.when(copied, 16).otherwise(0)).alias("mask"),
            F.coalesce("good", F.lit(False)).alias("good"),
            F.coalesce("toxic", F.lit(False)).alias("toxic"),
        )
    )


def mask_counts(masks: DataFrame) -> DataFrame:
    """One row per part: ``masks``, an array of at most 2^filters counts."""
    counted = masks.groupBy("part", "mask").agg(
        F.count("*").alias("n"),
        F.count_if("good").alias("good"),
        F.count_if("toxic").alias("toxic"),
    )
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))


def filter_audit(docs: DataFrame, labels: DataFrame, part_column: str = "source") -> DataFrame:
    """What five filters remove in each of their 120 orders, by part of ``docs``.

    Failure masks are counted per part, and each part's counts, 32 at most,
    become a ``Diagram``. Adjacent level swaps bring it through all orders, and
    the all-pass path of each order yields its steps. Columns: ``part,
    filter_order, step`` and the counts of documents ``kept`` after the step,
    ``removed`` by it, ``redundant`` (failing its filter, removed before),
    ``unique_fails`` (failing its filter only), ``good_lost`` and ``toxic_lost``
    (removed here with such a label) and ``shapley`` (removed by the step's
    filter, summed over all orders).

    Defined cases: a null text is empty; a null part is the empty string; a row
    without a doc_id is nobody's smaller copy and never fails E; rows that share
    the smallest doc_id of a text all pass E; a document is good (toxic) if any
    of its labels says so, and labels of unknown or null ids count for nothing;
    texts of any length are judged whole; an empty table has no parts and gives
    no rows; other columns are ignored.
    """
    ready_workers(docs.sparkSession)
    return mask_counts(failure_masks(docs, labels, part_column)).mapInArrow(_audit(FILTERS), _AUDIT_DDL)
