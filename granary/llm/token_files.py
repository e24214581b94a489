"""Token ids in compressed block files: a context-mixing range coder.

A file row is one block of at most ``BLOCK`` ids. Its bytes are a header (magic,
counts, first id's place in the shard, the documents that begin or go on in it),
the range coder's 32-bit words, and a CRC-32 of all before. Every block starts
from an empty model, so blocks are coded, lost and read independently.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm.common import ready_workers, rows_of, text_bytes, to_batches
from granary.llm.crc_parts import moved
from granary.llm.range_coder import MOST_IDS, decode_blocks, encode_blocks

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
BLOCK = MOST_IDS
#: Blocks coded side by side, one per numpy lane.
LANES = 1024
_MAGIC = b"GTB2"
_HEAD = struct.Struct("<4sIIII")
_MEMORY = 600_000
#: U+001C to U+001F are white space to str.split, and symbols to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WORDS = re.compile("[\\S\x1c-\x1f]+")


def pack_block(first: int, pieces: Sequence[tuple[int | None, int, bool]], coded: bytes, count: int) -> bytes:
    """A block's bytes. A piece is its document's id, ids here, and whether it ends."""
    table = b"".join(
        struct.pack("<qIBB", doc_id or 0, n, ends, doc_id is None) for doc_id, n, ends in pieces
    )
    body = _HEAD.pack(_MAGIC, count, len(pieces), first & 0xFFFFFFFF, first >> 32) + table + coded
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_block(data: bytes) -> tuple[int, list[tuple[int | None, int, bool]], bytes, int]:
    """``first, pieces, coded, count`` of a block; damage raises."""
    body, (check,) = data[:-4], struct.unpack("<I", data[-4:])
    if body[:4] != _MAGIC or zlib.crc32(body) != check:
        raise ValueError("damaged token block")
    _, count, n, low, high = _HEAD.unpack_from(body)
    size = struct.calcsize("<qIBB")
    pieces = []
    for k in range(n):
        doc_id, length, ends, missing = struct.unpack_from("<qIBB", body, _HEAD.size + k * size)
        pieces.append((None if missing else doc_id, length, bool(ends)))
    return high << 32 | low, pieces, body[_HEAD.size + n * size :], count


class WordMemory:
    """Ids of texts by the tokenizers library, one call per new word.

    The tokenizer's words never cross white space (it is dropped, and neither
    normalisation nor lower-casing looks over it), so a text's ids are those of
    its white-space chunks in order. A string of a special token, which has no
    white space, is that token's id, as the library has it by default.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.memory: dict[str, np.ndarray] = {}

    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        words = [_WORDS.findall(text) if _SEPARATORS.search(text) else text.split() for text in texts]
        fresh = list({w for ws in words for w in ws if w not in self.memory})
        if len(self.memory) + len(fresh) > _MEMORY:
            self.memory.clear()
            fresh = list({w for ws in words for w in ws})
        encoded = self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)
        for word, e in zip(fresh, encoded):
            self.memory[word] = np.array(e.ids, dtype="<u4").tobytes()
        get = self.memory.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), dtype="<u4") for ws in words]


@functools.lru_cache(maxsize=2)
def word_memory(path: str) -> WordMemory:
    return WordMemory(path)


#: ``earlier``: ids of a block's first document that lie in blocks before it.
_BLOCKS = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("ids", pa.int64()), ("earlier", pa.int64()), ("data", pa.binary())]
)
_BLOCKS_DDL = "shard int, block int, ids bigint, earlier bigint, data binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                 block: int = BLOCK, lanes: int = LANES) -> None:
    """Write the ids of all documents in ascending doc_id order as block files.

    Rows are range-partitioned, so shard numbers follow the order; rows of one
    doc_id are ordered, and spread if need be, by their texts' hash. Null ids come
    first. A shard is a Spark partition: a lost task writes its files again, and
    only whole ones are committed. Memory is bounded by ``lanes`` blocks. A null text
    counts as empty and has the end id alone; texts of any length are written whole,
    repeated rows repeatedly; other columns are ignored, an empty table has no blocks.
    """
    ready_workers(docs.sparkSession)

    def blocks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, int]]:
        words = word_memory(tokenizer)
        held, pieces, room, earlier = [], [], block, 0
        rows = rows_of(batches)
        while group := [row for _, row in zip(range(128), rows)]:
            texts = [(data or b"").decode("utf-8", "replace") for _, data in group]
            for (doc_id, _), found in zip(group, words.ids(texts)):
                ids, at = np.append(found, np.uint32(end_id)), 0
                while at < len(ids):
                    part = ids[at : at + room]
                    at += len(part)
                    held.append(part)
                    pieces.append((doc_id, len(part), at == len(ids)))
                    room -= len(part)
                    if not room:
                        yield pieces, np.concatenate(held), earlier
                        held, pieces, room = [], [], block
                        earlier = at if at < len(ids) else 0
        if held:
            yield pieces, np.concatenate(held), earlier

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        source = blocks_of(batches)
        while group := [b for _, b in zip(range(lanes), source)]:
            for (pieces, ids, earlier), coded in zip(group, encode_blocks([ids for _, ids, _ in group])):
                yield shard, number, len(ids), earlier, pack_block(first, pieces, coded, len(ids))
                number, first = number + 1, first + len(ids)

    rows = text_bytes(docs)
    order = [F.col("doc_id"), F.xxhash64("text")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed.mapInArrow(lambda b: to_batches(code(b), _BLOCKS, 64), _BLOCKS_DDL).write.parquet(path)


_PIECES = pa.schema(
    [("shard", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("part", pa.int64())]
)


def read_tokens(files: DataFrame, lanes: int = LANES) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in block files.

    Blocks are decoded where they lie, in any order; one small row per piece is
    shuffled, and a document's checksum is joined from those of its pieces. ``start``
    adds the sizes of earlier shards, one number per shard, to the place in its own.
    Files of no documents give no rows; a damaged block raises; further columns of
    the files are ignored. Memory is bounded by ``lanes`` blocks.
    """
    ready_workers(files.sparkSession)

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches)
        while group := [row for _, row in zip(range(lanes), rows)]:
            blocks = [unpack_block(data) for _, _, data in group]
            ids = decode_blocks([b[2] for b in blocks], [b[3] for b in blocks])
            found = []
            for (shard, earlier, _), (first, pieces, _, _), block in zip(group, blocks, ids):
                at = 0
                for doc_id, length, _ in pieces:
                    part = block[at : at + length].tobytes()
                    found.append((shard, first + at - earlier, doc_id, length, earlier + length, zlib.crc32(part)))
                    at, earlier = at + length, 0
            shards, places, doc_ids, sizes, ends, crcs = zip(*found)
            parts = moved(crcs, -4 * np.array(ends, dtype=np.int64)).tolist()
            yield from to_batches(zip(shards, places, doc_ids, sizes, parts), _PIECES)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, sizes = batch.column("part").to_numpy(), batch.column("n_tokens").to_numpy()
            crcs = pa.array(moved(parts, 4 * sizes).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], crcs], ["doc_id", "start", "n_tokens", "ids_crc32"])

    pieces = files.select("shard", "earlier", "data").mapInArrow(
        decode, "shard int, place bigint, doc_id bigint, n bigint, part bigint"
    )
    docs = pieces.groupBy("shard", "place").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.bit_xor("part").alias("part")
    )
    sizes = files.groupBy("shard").agg(F.sum("ids").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    return docs.join(shifts, "shard").select(
        "doc_id", (F.col("place") + F.col("before")).alias("start"), "n_tokens", "part"
    ).mapInArrow(whole, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
