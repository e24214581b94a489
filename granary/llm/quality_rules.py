"""Quality rules as a short-circuit cascade, cheapest rejection first."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import free_name, quoted, ready_workers, rows_of, text_bytes, to_batches

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
#: Share of words, in percent, inside repeated windows beyond which a text fails.
MAX_REPEATED = 30
#: The costs and rejections of the rules are estimated on the first rows of the
#: first input partitions, so many of each. The sample decides the order of the
#: rules only, never the verdict.
SAMPLE_PARTITIONS, SAMPLE_ROWS = 16, 128


def code_points(data: bytes) -> int:
    """Characters of UTF-8 bytes."""
    if data.isascii():
        return len(data)
    return int(np.count_nonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))


class Text:
    """One document's bytes with the views that the rules share, each made once."""

    def __init__(self, data: bytes | None):
        self.data = data or b""
        self.words = self.data.split()
        self._codes: np.ndarray | None = None

    @property
    def codes(self) -> np.ndarray:
        """A number for each word, equal exactly for equal words."""
        if self._codes is None:
            seen: dict[bytes, int] = {}
            self._codes = np.array([seen.setdefault(w, len(seen)) for w in self.words], dtype=np.int64)
        return self._codes

    def word_chars(self) -> int:
        return code_points(self.data.translate(None, BLANKS))

    def symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    def lines(self) -> tuple[int, int]:
        """Lines with a word, and those of them equal to an earlier line."""
        lines = [x for x in self.data.split(b"\n") if x.split()]
        return len(lines), len(lines) - len(set(lines))

    def repeated_words(self) -> int:
        """Words inside 8-word windows that occur twice or more, the first too.

        Windows are named in three doublings: a pair of names of half the length
        gets a new name, so equal names mean equal words without any hashing.
        """
        n = len(self.words) - WINDOW + 1
        if n < 2:
            return 0
        names = self.codes
        for step in (1, 2, 4):
            pairs = names[:-step] * (int(names.max()) + 1) + names[step:]
            names = np.unique(pairs, return_inverse=True)[1]
        again = np.bincount(names)[names] > 1
        edges = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(edges, np.flatnonzero(again), 1)
        np.add.at(edges, np.flatnonzero(again) + WINDOW, -1)
        return int(np.count_nonzero(np.cumsum(edges[:-1])))

    def uppercase_words(self) -> int:
        return sum(1 for w in self.words if len(w) > 1 and w.isupper())

    def echoed_words(self) -> int:
        """Words equal to the word before them."""
        return int(np.count_nonzero(self.codes[1:] == self.codes[:-1]))


@dataclass(frozen=True)
class Rule:
    """A named test; ``rejects`` is true for a document that must go."""

    name: str
    rejects: Callable[[Text], bool]


def few_words(t: Text) -> bool:
    return len(t.words) < MIN_WORDS


def repeated_windows(t: Text) -> bool:
    return 100 * t.repeated_words() > MAX_REPEATED * len(t.words)


def symbol_heavy(t: Text) -> bool:
    """Over one symbol to ten words."""
    return 10 * t.symbols() > len(t.words)


def shouted(t: Text) -> bool:
    """Over half of the words in capitals."""
    return 2 * t.uppercase_words() > len(t.words)


def odd_word_length(t: Text) -> bool:
    """Words of under 2 or over 12 characters on average."""
    chars, n = t.word_chars(), len(t.words)
    return n > 0 and not 2 * n <= chars <= 12 * n


def repeated_lines(t: Text) -> bool:
    """Over half of at least four lines repeat an earlier one."""
    lines, again = t.lines()
    return lines >= 4 and 2 * again > lines


def stuttered(t: Text) -> bool:
    """Over three in ten words only repeat the word before."""
    return 10 * t.echoed_words() > 3 * len(t.words)


BASE = (Rule("few_words", few_words), Rule("repeated_windows", repeated_windows))
RULES = (
    Rule("symbol_heavy", symbol_heavy),
    Rule("shouted", shouted),
    Rule("odd_word_length", odd_word_length),
    Rule("repeated_lines", repeated_lines),
    Rule("stuttered", stuttered),
)


def estimate_order(
    docs: DataFrame,
    rules: Sequence[Rule],
    sample_partitions: int = SAMPLE_PARTITIONS,
    sample_rows: int = SAMPLE_ROWS,
) -> list[str]:
    """Names of the rules by rejections per second on a bounded sample, best first.

    The sample is measured where it lies; two sums per rule leave a task.
    Ties, as on an empty table, keep the given order. The measured times differ
    from run to run, so the order may; the verdict is the same in any order.
    """
    ready_workers(docs.sparkSession)
    named = tuple(rules)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, found = [0.0] * len(named), [0] * len(named)
        rows = rows_of(batches) if TaskContext.get().partitionId() < sample_partitions else ()
        for (_, data), _ in zip(rows, range(sample_rows)):
            for k, rule in enumerate(named):
                text, began = Text(data), time.perf_counter()
                found[k] += rule.rejects(text)
                spent[k] += time.perf_counter() - began
        rows = [(k, spent[k], found[k]) for k in range(len(named))]
        return to_batches(rows, pa.schema([("rule", pa.int32()), ("s", pa.float64()), ("n", pa.int64())]))

    totals = (
        text_bytes(docs).mapInArrow(measure, "rule int, s double, n bigint")
        .groupBy("rule").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    )
    rate = {r["rule"]: (r["n"] or 0) / max(r["s"] or 0.0, 1e-9) for r in totals}
    return [named[k].name for k in sorted(range(len(named)), key=lambda k: (-rate.get(k, 0.0), k))]


def first_rejection(text: Text, rules: Sequence[Rule]) -> str | None:
    """Name of the first rule that rejects; later rules are not evaluated."""
    return next((r.name for r in rules if r.rejects(text)), None)


def ordered(rules: Sequence[Rule], names: Sequence[str]) -> tuple[Rule, ...]:
    return tuple(sorted(rules, key=lambda r: names.index(r.name)))


_MEASURED = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()), ("kept", pa.bool_()),
    ]
)


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts and verdict for every row of ``docs``, in one pass without a shuffle.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` count the
    whole text; ``base_failed`` is true under 20 words or with over 30 % of words
    in repeated windows; ``kept`` is false if so, else the cascade's verdict. A
    null or empty text has no words and fails; repeated rows are judged alike;
    an empty table gives no rows; other columns are ignored.
    """
    ready_workers(docs.sparkSession)
    cascade = ordered(rules, estimate_order(docs, rules))

    def judge(data: bytes | None) -> tuple:
        text = Text(data)
        again = text.repeated_words()
        failed = few_words(text) or 100 * again > MAX_REPEATED * len(text.words)
        kept = not failed and first_rejection(text, cascade) is None
        return (len(text.words), text.word_chars(), text.symbols(), text.lines()[1], again, failed, kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return to_batches(((doc_id, *judge(data)) for doc_id, data in rows_of(batches)), _MEASURED)

    return text_bytes(docs).mapInArrow(
        run,
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, kept boolean",
    )


def keep_good(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *RULES)) -> DataFrame:
    """The rows of ``docs``, with all columns, that no rule rejects.

    Only the rules that a document needs are evaluated. Null and empty texts go.
    """
    ready_workers(docs.sparkSession)
    cascade = ordered(rules, estimate_order(docs, rules))

    @F.pandas_udf("boolean")
    def passes(texts):
        return texts.map(lambda data: first_rejection(Text(data), cascade) is None)

    name = free_name(docs, "_passes")
    judged = docs.withColumn(name, passes(F.coalesce(quoted("text").cast("string"), F.lit("")).cast("binary")))
    return judged.where(quoted(name)).drop(name)
