"""Best-fit-decreasing packing of token pieces into fixed windows."""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import ready_workers, rows_of, stored, text_bytes, to_batches

WINDOW = 1024
END_ID = 0
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Fixed value: the special token of that vocabulary.
SPECIAL = (("<|endoftext|>", 50256),)
#: Partial pieces packed together in one task. More fill windows no better.
TASK_PIECES = 16384
_TASK_BITS = 40
#: Sequence ids of full windows start here, above those of all packing tasks.
FULL = 1 << 62
_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ]
)
_PACKED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PIECES_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


@functools.lru_cache(maxsize=2)
def encoder(ranks_path: str, special: tuple[tuple[str, int], ...] = ()) -> tiktoken.Encoding:
    """The byte-level BPE of a rank file, several times faster than tokenizers.

    Gives that library's ids for the same vocabulary: those of its default where
    the special tokens are named, else those with ``encode_special_tokens`` on.
    """
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special)
    )


class CapacityTree:
    """Open windows by room left, in a segment tree over the capacities.

    A node holds the number of open windows in its range of capacities, so the
    tightest window with room for a piece is found in log2(window) steps.
    """

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        node = self.size + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Smallest capacity of at least ``least`` with a window, and that window."""
        node = self.size + least
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.size
        sequence = self.open[capacity].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, sequence


def best_fit(lengths: Iterable[int], window: int) -> Iterator[tuple[int, int]]:
    """``(sequence, offset)`` of each length, which must come in falling order."""
    tree, made = CapacityTree(window), 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            capacity, sequence = window, made
            made += 1
        else:
            capacity, sequence = found
        if capacity > length:
            tree.put(capacity - length, sequence)
        yield sequence, window - capacity


def token_pieces(docs: DataFrame, window: int = WINDOW, ranks_path: str = RANKS, end_id: int = END_ID,
                 special: tuple[tuple[str, int], ...] = SPECIAL) -> DataFrame:
    """Each document's ids and the end id, cut into full windows and one rest.

    Rows are ``doc_id, start, length, ids_crc32, doc_tokens``; the ids themselves
    stay in the task that made them. A string of a special token is its id. A null
    or empty text has the end id alone, a long one as many pieces as it needs;
    repeated rows are cut again, an empty table gives no rows, other columns are
    ignored.
    """
    ready_workers(docs.sparkSession)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        encode = encoder(ranks_path, special).encode_to_numpy
        for doc_id, data in rows_of(batches):
            ids = encode((data or b"").decode("utf-8", "replace"), allowed_special="all")
            ids = np.append(ids, end_id).astype("<u4")
            for start in range(0, len(ids), window):
                part = ids[start : start + window]
                yield doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)

    return text_bytes(docs).mapInArrow(lambda b: to_batches(cut(b), _PIECES), _PIECES_DDL)


def pack_documents(
    docs: DataFrame,
    window: int = WINDOW,
    ranks_path: str = RANKS,
    end_id: int = END_ID,
    task_pieces: int = TASK_PIECES,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece.

    Overlong documents are cut into full windows, each a sequence of its own,
    numbered where they lie; the rests are packed by best fit decreasing. Texts
    are tokenised once; only the rests' rows are shuffled, dealt out evenly
    whatever their ids, to as many tasks as there are times ``task_pieces`` rests. ``sequence_id`` is unique over
    all tasks, ``offset`` counts from 0 without gaps inside a sequence.

    A null or empty text is one piece that holds the end id alone. Rows with a
    null or repeated doc_id are packed like any other; an empty table gives no
    rows; other columns are ignored.
    """
    pieces = stored(token_pieces(docs, window, ranks_path, end_id), "pieces")
    rests = pieces.where(F.col("length") < window)
    tasks = max(1, -(-rests.count() // task_pieces))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        first = TaskContext.get().partitionId() << _TASK_BITS
        rows = []

        def falling() -> Iterator[int]:
            for row in rows_of(batches):
                rows.append(row)
                yield row[2]

        for sequence, offset in best_fit(falling(), window):
            yield (*rows.pop(), first + sequence, offset)

    order = [F.col("length").desc(), "doc_id", "start", "ids_crc32", "doc_tokens"]
    packed = (
        rests.repartition(tasks)
        .sortWithinPartitions(*order)
        .mapInArrow(
            lambda b: to_batches(pack(b), _PACKED), f"{_PIECES_DDL}, sequence_id bigint, offset bigint"
        )
    )
    full = pieces.where(F.col("length") == window).select(
        "*", (F.monotonically_increasing_id() + F.lit(FULL)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return full.union(packed)
