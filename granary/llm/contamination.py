"""Benchmark decontamination by suffix arrays over shards of training text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import in_runs, quoted, ready_workers, rows_of, text_bytes, to_batches

WINDOW = 10
#: Text of one suffix array; a longer document has an array of its own.
SHARD_BYTES = 16 << 20
#: Text of one block of test items; a longer item is a block of its own.
BLOCK_BYTES = 8 << 20
_SLICE = 1 << 20
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_HITS = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
        ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
    ]
)
_HITS_DDL = (
    "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
)
_MATCHES = pa.schema(
    [
        ("item", pa.int64()), ("item_id", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
        ("n_locations", pa.int64()), ("doc_id", pa.int64()), ("doc_start", pa.int64()),
    ]
)
_MATCHES_DDL = (
    "item bigint, item_id string, start bigint, length bigint, n_locations bigint, doc_id bigint, doc_start bigint"
)


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """Words of a UTF-8 text in runs: letters, digits and all non-ASCII characters.

    A-Z are lower-cased; every other ASCII character parts words.
    """
    plain = (text or b"").translate(_WORD_BYTES)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + _SLICE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


class _Numbers(dict):
    """Numbers words from 1 on as they are met; 0 parts texts."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def number_texts(texts: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray, _Numbers]:
    """Word numbers of all texts, each text closed by 0, the texts' ends, and the numbering."""
    numbers = _Numbers()
    parts, ends, at = [], [], 0
    for text in texts:
        for words in words_of(text):
            parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
            at += len(words)
        parts.append(np.zeros(1, dtype=np.int32))
        ends.append(at)
        at += 1
    return np.concatenate(parts), np.array(ends, dtype=np.int64), numbers


class TestBlock:
    """Test items whose suffixes are searched together.

    ``words`` holds numbers of the block's own vocabulary. ``windows`` are the
    starts of distinct windows with their ``sizes``; window k belongs to the
    items ``window_items[window_from[k]:window_from[k + 1]]``.
    """

    __test__ = False  # no test case for pytest

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int, first: int = 0):
        self.first = first
        self.ids = ["" if i is None else i for i, _ in items]
        self.words, self.ends, numbers = number_texts(text for _, text in items)
        self.vocabulary = list(numbers)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        sizes = self.ends - self.starts
        self.longest = int(sizes.max(initial=0))
        found: dict[bytes, list[int]] = {}
        places: list[int] = []
        for item, (start, size) in enumerate(zip(self.starts.tolist(), sizes.tolist())):
            span = min(window, size)
            for at in range(start, start + size - span + 1 if size else start):
                owners = found.setdefault(self.words[at : at + span].tobytes(), [])
                if not owners:
                    places.append(at)
                if not owners or owners[-1] != item:
                    owners.append(item)
        self.windows = np.array(places, dtype=np.int64)
        self.sizes = np.array([len(key) // 4 for key in found], dtype=np.int64)
        self.window_items = np.array([i for owners in found.values() for i in owners], dtype=np.int64)
        self.window_from = np.cumsum([0, *map(len, found.values())])


class SuffixShard:
    """The suffix array of a shard of documents, over whole words.

    Suffixes are ordered by their first ``depth`` words at least, all that a
    search for a text of that length can tell apart. The first sort takes as many
    words as fit a 64-bit key; after that only suffixes that are still equal and
    have not met the end of their document are sorted again by the rank that
    follows, and each round doubles the depth.
    """

    def __init__(self, texts: list[bytes | None], depth: int):
        self.words, self.ends, self.numbers = number_texts(texts)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        words = self.words
        n = len(words)
        bits = len(self.numbers).bit_length() or 1
        reach = max(1, min(depth, n, 62 // bits))
        key = words.astype(np.int64)
        alive = words > 0
        for k in range(1, reach):
            key <<= bits
            alive[: n - k] &= words[k:] > 0
            alive[n - k :] = False
            key[: n - k] += np.where(alive[: n - k], words[k:], 0)
        order = np.flatnonzero(words)
        order = order[np.argsort(key[order])]
        self.order = order
        in_order = key[order]
        del key
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = in_order[1:] != in_order[:-1]
        del in_order
        # A suffix that ends within the sorted words needs no further order.
        left = np.repeat(self.ends, self.ends - self.starts + 1) - np.arange(n)
        rank = None
        while reach < depth:
            lone = fresh.copy()
            lone[:-1] &= fresh[1:]
            open_at = np.flatnonzero(~lone & (left[order] > reach))
            if not len(open_at):
                break
            if rank is None:
                rank = np.zeros(n, dtype=np.int64)
                rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0)) + 1
            at = order[open_at]
            pair = (rank[at] << 32) | rank[at + reach]
            again = np.argsort(pair)
            order[open_at] = at = at[again]
            pair = pair[again]
            changed = np.ones(len(pair), dtype=bool)
            changed[1:] = pair[1:] != pair[:-1]
            fresh[open_at] = changed
            rank[at] = open_at[np.maximum.accumulate(np.where(changed, np.arange(len(pair)), 0))] + 1
            reach *= 2
        counts = np.bincount(words, minlength=len(self.numbers) + 1)
        counts[0] = 0
        #: Suffixes that begin with word w lie from bucket[w] to bucket[w + 1].
        self.bucket = np.concatenate([[0], np.cumsum(counts)])

    def translate(self, vocabulary: list[bytes]) -> np.ndarray:
        """Numbers of this shard for a vocabulary; -1 for 0 and words it lacks."""
        known = [self.numbers.get(word, -1) for word in vocabulary]
        return np.array([-1, *known], dtype=np.int64)

    def search(self, block: TestBlock) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Binary search for every suffix of the block's items at once.

        Yields, for each number of words d, the suffixes that match d words here
        and their intervals in the suffix array, then which of them match no more:
        ``(d, suffixes, low, high, ended)``.
        """
        query = self.translate(block.vocabulary)[block.words]
        suffixes = np.flatnonzero(query >= 0)
        low, high = self.bucket[query[suffixes]], self.bucket[query[suffixes] + 1]
        depth = 1
        while len(suffixes):
            wanted = query[suffixes + depth]
            left = self._bound(low, high, wanted, depth, False)
            right = self._bound(left, high, wanted, depth, True)
            ended = (left >= right) | (wanted < 0)
            yield depth, suffixes, low, high, ended
            go = ~ended
            suffixes, low, high = suffixes[go], left[go], right[go]
            depth += 1

    def _bound(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, depth: int, after: bool) -> np.ndarray:
        """First place in each ``[low, high)`` whose word at ``depth`` is not below (is above) ``wanted``."""
        low, high = low.copy(), high.copy()
        busy = np.flatnonzero((low < high) & (wanted >= 0))
        while len(busy):
            middle = (low[busy] + high[busy]) >> 1
            word = self.words[self.order[middle] + depth]
            below = word <= wanted[busy] if after else word < wanted[busy]
            low[busy[below]] = middle[below] + 1
            high[busy[~below]] = middle[~below]
            busy = busy[low[busy] < high[busy]]
        return low

    def locations(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All text positions of the intervals, and the number of each one's interval."""
        sizes = high - low
        owner = np.repeat(np.arange(len(low)), sizes)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.order[low[owner] + inside], owner

    def document_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


class _Hits:
    """Which words of a shard lie in windows, and which items each document met."""

    def __init__(self, shard: SuffixShard):
        self.shard = shard
        self.edges = np.zeros(len(shard.words) + 1, dtype=np.int32)
        self.items: dict[int, set[str]] = {}

    def add(self, block: TestBlock) -> None:
        shard, lows, highs = self.shard, np.zeros(len(block.windows), np.int64), np.zeros(len(block.windows), np.int64)
        for depth, suffixes, low, high, _ in shard.search(block):
            at = np.searchsorted(suffixes, block.windows)
            found = (block.sizes == depth) & (at < len(suffixes))
            found[found] = suffixes[at[found]] == block.windows[found]
            lows[found], highs[found] = low[at[found]], high[at[found]]
            if depth >= block.sizes.max(initial=0):
                break
        positions, window = shard.locations(lows, highs)
        if not len(positions):
            return
        np.add.at(self.edges, positions, 1)
        np.add.at(self.edges, positions + block.sizes[window], -1)
        pairs = np.unique(shard.document_of(positions) * len(block.windows) + window)
        for pair in pairs.tolist():
            doc, k = divmod(pair, len(block.windows))
            owners = block.window_items[block.window_from[k] : block.window_from[k + 1]]
            self.items.setdefault(doc, set()).update(block.ids[i] for i in owners)

    def per_document(self) -> tuple[np.ndarray, np.ndarray]:
        """Words and hit words of each document."""
        shard = self.shard
        total = np.concatenate([[0], np.cumsum(np.cumsum(self.edges[:-1]) > 0)])
        return shard.ends - shard.starts, total[shard.ends] - total[shard.starts]


class _Blocks:
    """The blocks of test items, of which a task holds one at a time."""

    def __init__(self, sent: list[Broadcast], depth: int):
        self.sent = sent
        self.depth = depth

    def __iter__(self) -> Iterator[TestBlock]:
        for block in self.sent:
            yield block.value
            if len(self.sent) > 1:
                vars(block).pop("_value", None)


def test_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> _Blocks:
    """The test items in blocks of bounded size, for the tasks to read one by one.

    Items stream through the driver a partition at a time, and a block goes out
    as soon as it is full, so neither the driver nor a task holds more than one
    block and one partition; executors keep blocks on disk.
    """
    context = benchmark.sparkSession.sparkContext
    rows = benchmark.select(
        quoted("item_id").cast("string").alias("item_id"), quoted("text").cast("string").cast("binary").alias("text")
    )
    sent, depth, kept, size, first = [], window, [], 0, 0

    def send() -> None:
        nonlocal depth, kept, size, first
        block = TestBlock(kept, window, first)
        depth = max(depth, block.longest)
        first += len(kept)
        sent.append(context.broadcast(block))
        kept, size = [], 0

    for item_id, text in rows.toLocalIterator():
        kept.append((item_id, None if text is None else bytes(text)))
        size += len(text or b"")
        if size >= block_bytes:
            send()
    if kept:
        send()
    return _Blocks(sent, depth)


test_blocks.__test__ = False


def _text_size(row: tuple) -> int:
    return len(row[-1] or b"") + 8


def _hit_rows(blocks: _Blocks, shard_bytes: int):
    nothing = hashlib.sha256(b"").hexdigest()

    def digest(items: set[str]) -> str:
        return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for docs in in_runs(rows_of(batches), _text_size, shard_bytes):
            shard = SuffixShard([text for _, text in docs], blocks.depth)
            hits = _Hits(shard)
            for block in blocks:
                hits.add(block)
            for at, ((doc_id, _), n_words, n_hit) in enumerate(zip(docs, *(x.tolist() for x in hits.per_document()))):
                items = hits.items.get(at)
                yield doc_id, n_words, n_hit, len(items or ()), digest(items) if items else nothing, n_hit > 0

    return lambda batches: to_batches(rows(batches), _HITS)


def contaminated_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per row of ``docs``.

    A task builds the suffix array of each shard of its documents and finds every
    suffix of every test item in it by binary search. A window is ``window``
    consecutive words of an item, or a whole shorter item; the interval where
    the search stands after that many words holds all its locations. ``n_hit`` counts
    the words inside any of them, ``n_items`` the item ids with such windows,
    and ``items_sha256`` digests those ids, sorted as strings and joined by
    commas (of no ids: the digest of the empty string).

    Nothing is shuffled; work is a sort of each shard plus one search per test
    suffix and shard. Defined cases: a null text has no words; an item without
    words has no windows; a null item_id is the empty string; repeated items
    count once by id; repeated rows come back repeated, null doc_ids stay;
    an empty ``docs`` gives no rows, an empty ``benchmark`` no hits; other
    columns are ignored. Texts are searched whole; a task needs memory for its
    longest text.
    """
    ready_workers(docs.sparkSession)
    blocks = test_blocks(benchmark, window, block_bytes)
    return text_bytes(docs).mapInArrow(_hit_rows(blocks, shard_bytes), _HITS_DDL)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no window of a test item.

    The cases of ``contaminated_documents`` hold; a text decides alone, so
    repeated rows and null ids need no care.
    """
    ready_workers(docs.sparkSession)
    blocks = test_blocks(benchmark, window, block_bytes)
    name = "text"
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # any name will do in Arrow
    body = plain[f"c{docs.columns.index('text')}"].cast("string").cast("binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512))
        for group in in_runs(((s,) for s in slices), lambda s: s[0].column(name).nbytes + 1, shard_bytes):
            texts = [text for (part,) in group for text in part.column(name).to_pylist()]
            hits = _Hits(SuffixShard(texts, blocks.depth))
            for block in blocks:
                hits.add(block)
            clean, at = hits.per_document()[1] == 0, 0
            for (part,) in group:
                yield part.filter(pa.array(clean[at : at + part.num_rows])).drop_columns([name])
                at += part.num_rows

    return plain.withColumn(name, body).mapInArrow(run, plain.schema).toDF(*docs.columns)


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, min_words: int = WINDOW,
    shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Longest verbatim match of every test suffix with at least ``min_words`` words.

    ``item_id, start, length, n_locations, doc_id, doc_start``: the words of the
    item from word ``start`` on that occur in a document, how often the longest
    does over all shards, and its location with the smallest doc_id and word
    offset. Each shard answers for itself; the shards' answers are aggregated in
    Spark. Repeated items have rows of their own; other cases as in
    ``contaminated_documents``.
    """
    ready_workers(docs.sparkSession)
    blocks = test_blocks(benchmark, 1, block_bytes)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for group in in_runs(rows_of(batches), _text_size, shard_bytes):
            shard = SuffixShard([text for _, text in group], blocks.depth)
            ids = np.array([np.iinfo(np.int64).max if i is None else i for i, _ in group])
            for block in blocks:
                for depth, suffixes, low, high, ended in shard.search(block):
                    if depth < min_words or not ended.any():
                        continue
                    positions, owner = shard.locations(low[ended], high[ended])
                    doc = shard.document_of(positions)
                    offset = positions - shard.starts[doc]
                    best = np.lexsort((offset, ids[doc], owner))
                    best = best[np.unique(owner[best], return_index=True)[1]]
                    item = np.searchsorted(block.starts, suffixes[ended], side="right") - 1
                    for k, i, at in zip(best.tolist(), item.tolist(), (suffixes[ended] - block.starts[item]).tolist()):
                        d = int(doc[k])
                        yield (
                            block.first + i, block.ids[i], at, depth,
                            int((high[ended] - low[ended])[owner[k]]), group[d][0], int(offset[k]),
                        )

    found = text_bytes(docs).mapInArrow(lambda batches: to_batches(rows(batches), _MATCHES), _MATCHES_DDL)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "doc_start")
    by_length = found.groupBy("item", "item_id", "start", "length").agg(
        F.sum("n_locations").alias("n_locations"), F.min(place).alias("place")
    )
    best = by_length.groupBy("item", "item_id", "start").agg(
        F.max(F.struct("length", "n_locations", "place")).alias("best")
    )
    return best.select(
        "item_id", "start", "best.length", "best.n_locations", "best.place.doc_id", "best.place.doc_start"
    )
