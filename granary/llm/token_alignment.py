"""Alignment of two tokenizers' tokens by lockstep vectorised merging."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import in_runs, ready_workers, rows_of, stored, text_bytes, to_batches
from granary.llm.packing import RANKS, encoder
from granary.llm.piece_codec import MODEL, PieceCodec

#: Text aligned together; bounds a task's memory and the size of a group below.
CHUNK_BYTES = 2 << 20
#: A long text is cut into lanes of about this many characters.
LANE_CHARS = 2048
#: A group with more token pairs is reduced to its distinct ids first.
WIDE = 4096
#: Both tokenizers begin a token at a single space between other characters: A's
#: pattern takes white space only as one leading space or alone, and no piece of
#: B has a space behind another character (``PieceCodec`` checks that).
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_ALIGNED = pa.schema(
    [("doc_id", pa.int64())]
    + [(name, pa.list_(pa.int32())) for name in ("a_ids", "b_ids", "group_a", "group_b")]
)
_ALIGNED_DDL = "doc_id bigint, a_ids array<int>, b_ids array<int>, group_a array<int>, group_b array<int>"
_LINKED = pa.schema(
    [
        ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
        ("places", pa.binary()), ("times", pa.binary()),
        ("pairs", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int64())),
    ]
)
_LINKED_DDL = (
    "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "places binary, times binary, pairs array<bigint>, n_docs array<bigint>"
)
_DIGEST = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
_REPORT_DDL = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "n_best bigint, count_sum bigint, groups_sha256 string"
)
_REPORT = pa.schema(
    [(name, pa.int64()) for name in (*_DIGEST, "n_best", "count_sum")] + [("groups_sha256", pa.string())]
)


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, right-aligned in rows with one more cell, and their number."""
    numbers = np.arange(n)
    width = len(str(max(n - 1, 0)))
    powers = 10 ** np.arange(width - 1, -1, -1)
    shown = (numbers[:, None] >= powers) | (powers == 1)
    cells = np.zeros((n, width + 1), dtype=np.uint8)
    cells[:, :width] = np.where(shown, numbers[:, None] // powers % 10 + ord("0"), 0)
    return cells, shown.sum(axis=1)


class TokenizerPair:
    """A byte-level BPE (A) and a byte-fallback SentencePiece model (B) over the same text.

    A encodes a space and the text, B the text, to which it adds the space
    itself. Strings of special tokens are plain text.
    """

    def __init__(self, ranks_path: str, model_path: str):
        self.a = encoder(ranks_path)
        codec = PieceCodec(model_path)  # also checks that B's pieces never reach over a safe cut
        self.b = codec.library
        self.b_raw = codec.raw
        self.a_sizes = np.array([len(self.a.decode_single_token_bytes(k)) for k in range(self.a.n_vocab)])
        self.b_sizes = np.array([len(raw) for raw in codec.raw])
        self.b_bits = max(1, (len(codec.raw) - 1).bit_length())
        self.pair_bits = self.b_bits + max(1, (self.a.n_vocab - 1).bit_length())
        self.cells, self.widths = _digits(max(self.a.n_vocab, len(codec.raw)))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a lane's text, unless their bytes aren't a space and the text."""
        spaced = " " + text
        a, b = self.a.encode_ordinary(spaced), self.b.encode(text, num_threads=1)
        whole = spaced.encode()
        if self.a.decode_bytes(a) != whole or b"".join(map(self.b_raw.__getitem__, b)) != whole:
            return None
        return np.array(a, dtype=np.int32), np.array(b, dtype=np.int32)


@functools.lru_cache(maxsize=2)
def tokenizer_pair(ranks_path: str, model_path: str) -> TokenizerPair:
    return TokenizerPair(ranks_path, model_path)


def lanes(text: str, chars: int = LANE_CHARS) -> Iterator[str]:
    """The text, cut at safe spaces, without them; both tokenizers add them again.

    Joined by single spaces the lanes are the text. A text without a safe space is one lane.
    """
    at = 0
    while cut := _SAFE.search(text, at + chars):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


class Groups:
    """Token groups of many lanes: half-open token ranges, in lane order."""

    def __init__(self, lane, a_from, a_to, b_from, b_to):
        self.lane, self.a_from, self.b_from = lane, a_from, b_from
        self.a_size, self.b_size = (a_to - a_from).astype(np.int64), (b_to - b_from).astype(np.int64)


def lockstep(
    a_ends: np.ndarray, a_from: np.ndarray, a_to: np.ndarray,
    b_ends: np.ndarray, b_from: np.ndarray, b_to: np.ndarray,
    a_ids: np.ndarray, b_ids: np.ndarray,
) -> tuple[Groups, tuple[np.ndarray, ...]]:
    """Merge the token ends of all lanes at once.

    Lane k holds the tokens ``a_from[k]`` to ``a_to[k]`` and ``b_from[k]`` to
    ``b_to[k]`` of the flat arrays, whose ends are byte offsets in the lane; both
    sides end at the same byte. A state matrix holds each running lane's pointers
    and the starts of its open group. A step moves the pointer whose token ends
    first, or both at a cut, where the group closes and its links are emitted;
    finished lanes leave the state. Returns the groups and the links as
    ``(lane, a_id, b_id, times)``.
    """
    cuts, links = [], []
    lane = np.flatnonzero(a_to > a_from)
    state = np.stack([lane, a_from[lane], b_from[lane], a_from[lane], b_from[lane], a_to[lane]]).astype(np.int32)
    while state.shape[1]:
        at_a, at_b = state[1], state[2]
        end_a, end_b = a_ends[at_a], b_ends[at_b]
        cut = end_a == end_b
        state[1] += end_a <= end_b
        state[2] += end_b <= end_a
        closed = state[:, cut]
        if closed.shape[1]:
            cuts.append(closed[:5])
            links.append(_links(closed, a_ids, b_ids))
            state[3:5, cut] = closed[1:3]
            running = state[1] < state[5]
            if not running.all():
                state = state[:, running]
    if not cuts:
        empty = np.zeros(0, dtype=np.int64)
        return Groups(empty, empty, empty, empty, empty), (empty, empty, empty, empty)
    merged = np.concatenate(cuts, axis=1)
    merged = merged[:, np.argsort(merged[0], kind="stable")]
    groups = Groups(merged[0], merged[3], merged[1], merged[4], merged[2])
    return groups, tuple(np.concatenate(part) for part in zip(*links))


def _links(closed: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links of the groups that a step closes, all pairs of each group's tokens."""
    lane, a_to, b_to, a_at, b_at = closed[:5]
    a_size, b_size = a_to - a_at, b_to - b_at
    pairs = a_size.astype(np.int64) * b_size
    if pairs.max() == 1:
        return lane, a_ids[a_at], b_ids[b_at], pairs
    large = np.flatnonzero(pairs > WIDE)
    if len(large):
        pairs[large] = 0
    owner = np.repeat(np.arange(len(pairs)), pairs)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    across, down = np.divmod(inside, b_size[owner])
    found = [(lane[owner], a_ids[a_at[owner] + across], b_ids[b_at[owner] + down], np.ones(len(owner), np.int64))]
    for k in large.tolist():
        a, n_a = np.unique(a_ids[a_at[k] : a_to[k]], return_counts=True)
        b, n_b = np.unique(b_ids[b_at[k] : b_to[k]], return_counts=True)
        found.append((
            np.full(len(a) * len(b), lane[k]), np.repeat(a, len(b)), np.tile(b, len(a)), np.outer(n_a, n_b).ravel()
        ))
    return tuple(np.concatenate(part) for part in zip(*found)) if len(found) > 1 else found[0]


class AlignedTexts:
    """Tokens, groups and links of a run of texts."""

    def __init__(self, texts: list[bytes | None], pair: TokenizerPair):
        self.pair, self.n = pair, len(texts)
        lane_doc, a_lists, b_lists = [], [], []
        for doc, raw in enumerate(texts):
            found = [pair.encode(lane) for lane in lanes(raw.decode())] if raw else []
            if None in found:
                continue
            for a, b in found:
                lane_doc.append(doc)
                a_lists.append(a)
                b_lists.append(b)
        self.lane_doc = np.array(lane_doc, dtype=np.int64)
        self.a_ids, a_from, a_to, a_ends = self._flat(a_lists, pair.a_sizes)
        self.b_ids, b_from, b_to, b_ends = self._flat(b_lists, pair.b_sizes)
        self.groups, links = lockstep(a_ends, a_from, a_to, b_ends, b_from, b_to, self.a_ids, self.b_ids)
        self.links = (self.lane_doc[links[0]], *links[1:])
        self.group_doc = self.lane_doc[self.groups.lane]
        self.n_a = self._per_doc(self.lane_doc, a_to - a_from)
        self.n_b = self._per_doc(self.lane_doc, b_to - b_from)
        self.n_groups = np.bincount(self.group_doc, minlength=self.n)
        self.n_links = self._per_doc(self.group_doc, self.groups.a_size * self.groups.b_size)

    @staticmethod
    def _flat(lists: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        lengths = np.array([len(ids) for ids in lists], dtype=np.int64)
        last = np.cumsum(lengths)
        first = last - lengths
        ids = np.concatenate([np.zeros(0, dtype=np.int32), *lists])
        ends = np.cumsum(sizes[ids])
        before = np.concatenate([[0], ends])[first]
        return ids, first, last, (ends - np.repeat(before, lengths)).astype(np.int32)

    def _per_doc(self, doc: np.ndarray, amounts: np.ndarray) -> np.ndarray:
        """Whole-number sums by document; ``doc`` is ascending."""
        total = np.concatenate([[0], np.cumsum(amounts)])
        edges = np.searchsorted(doc, np.arange(self.n + 1))
        return total[edges[1:]] - total[edges[:-1]]

    def distinct_links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``document, pair, times`` of each distinct id pair of each document, sorted."""
        doc, a, b, times = self.links
        bits = self.pair.pair_bits
        key = doc << bits | a.astype(np.int64) << self.pair.b_bits | b
        keys, counts = np.unique(key[times == 1], return_counts=True)
        if len(keys) < len(key) and (more := times > 1).any():
            both = np.concatenate([keys, key[more]])
            amounts = np.concatenate([counts, times[more]])
            order = np.argsort(both, kind="stable")
            keys, first = np.unique(both[order], return_index=True)
            counts = np.add.reduceat(amounts[order], first)
        return keys >> bits, keys & ((1 << bits) - 1), counts

    def group_texts(self) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document, built for all of them in one byte matrix."""
        g = self.groups
        n_a, n_b = len(self.a_ids), len(self.b_ids)
        a_row = np.arange(n_a) + np.repeat(np.cumsum(g.b_size) - g.b_size, g.a_size)
        b_row = np.arange(n_b) + np.repeat(np.cumsum(g.a_size), g.b_size)
        cells = np.empty((n_a + n_b, self.pair.cells.shape[1]), dtype=np.uint8)
        widths = np.empty(n_a + n_b, dtype=np.int64)
        for ids, row, sizes, mark in ((self.a_ids, a_row, g.a_size, "|"), (self.b_ids, b_row, g.b_size, ";")):
            cells[row] = self.pair.cells[ids]
            cells[row, -1] = ord(",")
            cells[row[np.cumsum(sizes) - 1], -1] = ord(mark)
            widths[row] = self.pair.widths[ids] + 1
        flat = cells.ravel()
        whole = flat[flat != 0].tobytes()
        ends = np.concatenate([[0], np.cumsum(widths)])[np.cumsum(self.n_a + self.n_b)]
        at = 0
        for end in ends.tolist():
            yield whole[at : max(at, end - 1)]
            at = end


def _aligned_rows(ranks_path: str, model_path: str, chunk_bytes: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        pair = tokenizer_pair(ranks_path, model_path)
        for docs in in_runs(rows_of(batches), lambda row: len(row[1] or b"") + 8, chunk_bytes):
            found = AlignedTexts([text for _, text in docs], pair)
            a, b, g = (np.cumsum(x).tolist() for x in (found.n_a, found.n_b, found.n_groups))
            for (doc_id, _), a0, a1, b0, b1, g0, g1 in zip(docs, [0, *a], a, [0, *b], b, [0, *g], g):
                yield (
                    doc_id, found.a_ids[a0:a1], found.b_ids[b0:b1],
                    found.groups.a_size[g0:g1], found.groups.b_size[g0:g1],
                )

    return lambda batches: to_batches(rows(batches), _ALIGNED, 512)


def aligned_tokens(
    docs: DataFrame, ranks_path: str = RANKS, model_path: str = MODEL, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """``doc_id, a_ids, b_ids, group_a, group_b`` of every row of ``docs``.

    ``group_a`` and ``group_b`` hold how many tokens of A and B each group has, in
    order; a group ends where tokens of both end. Cases as in ``alignment_report``.
    """
    ready_workers(docs.sparkSession)
    return text_bytes(docs).mapInArrow(_aligned_rows(ranks_path, model_path, chunk_bytes), _ALIGNED_DDL)


def _chunk_rows(chunk: int, docs: list[tuple], pair: TokenizerPair) -> Iterator[tuple]:
    """A row of each document, then one with the chunk's distinct pairs."""
    found = AlignedTexts([text for _, text in docs], pair)
    doc, linked, times = found.distinct_links()
    found.links = None
    pairs, places, n_docs = np.unique(linked, return_inverse=True, return_counts=True)
    places, times = places.astype("<i4"), times.astype("<i8")
    edges = np.searchsorted(doc, np.arange(len(docs) + 1)).tolist()
    counts = zip(*(x.tolist() for x in (found.n_a, found.n_b, found.n_groups, found.n_links)))
    for (doc_id, _), n, text, at, end in zip(docs, counts, found.group_texts(), edges, edges[1:]):
        digest = hashlib.sha256(text).hexdigest() if n[0] else ""
        yield (chunk, doc_id, *n, digest, places[at:end].tobytes(), times[at:end].tobytes(), None, None)
    if len(pairs):
        yield (chunk, *(None,) * 8, pairs, n_docs)


def _linked_rows(ranks_path: str, model_path: str, chunk_bytes: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        pair = tokenizer_pair(ranks_path, model_path)
        task = TaskContext.get().partitionId() << 32
        runs = in_runs(rows_of(batches), lambda row: len(row[1] or b"") + 8, chunk_bytes)
        for chunk, docs in enumerate(runs, task):
            yield from _chunk_rows(chunk, docs, pair)

    return lambda batches: to_batches(rows(batches), _LINKED, 512)


def _counted(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums over each document's links, from the corpus-wide counts of its chunk's pairs."""
    place = pairs.column("place").to_numpy()
    count = np.zeros(len(place), dtype=np.int64)
    best = np.zeros(len(place), dtype=np.int64)
    count[place] = pairs.column("n").to_numpy()
    best[place] = pairs.column("best").to_numpy()
    sums = []
    for places, times in zip(docs.column("places").to_pylist(), docs.column("times").to_pylist()):
        at, weight = np.frombuffer(places, "<i4"), np.frombuffer(times, "<i8")
        sums.append((int((best[at] * weight).sum()), int((count[at] * weight).sum())))
    columns = [docs.column(name).cast(pa.int64()) for name in _DIGEST]
    columns += [pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)]
    return pa.Table.from_arrays([*columns, docs.column("groups_sha256").cast(pa.string())], schema=_REPORT)


def pair_counts(linked: DataFrame, b_bits: int) -> DataFrame:
    """``pair, n, best``: in how many documents ids are linked, and if no other B id beats that."""
    counts = linked.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).groupBy(
        F.col("p.pairs").alias("pair")
    ).agg(F.sum("p.n_docs").alias("n"))
    same_a = Window.partitionBy(F.shiftright("pair", b_bits))
    return counts.withColumn("best", (F.col("n") == F.max("n").over(same_a)).cast("bigint"))


def alignment_report(
    docs: DataFrame, ranks_path: str = RANKS, model_path: str = MODEL, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """How two tokenizers' tokens align in every row of ``docs``, and how common the links are.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.
    Documents are aligned in chunks of bounded text, each by one lockstep merge.
    A chunk hands on its distinct id pairs with the number of documents that link
    them; the corpus-wide counts come from these, pre-aggregated, and return to
    the chunks, where each document's sums are taken. So pairs are shuffled once per
    chunk and not once per document, a frequent pair is one row of a chunk, and
    a pair's count is never held whole anywhere.

    Defined cases: null and empty texts, and texts whose tokens' joined bytes
    differ from a space and the text (one with U+2581, for instance), have no
    tokens, zeros and an empty ``groups_sha256``; they count for no pair. A row
    is a document: repeated rows count each, null doc_ids stay. A very long text
    is aligned whole, cut only where both tokenizers always begin a token. An
    empty table gives no rows; other columns are ignored.
    """
    ready_workers(docs.sparkSession)
    b_bits = tokenizer_pair(ranks_path, model_path).b_bits
    linked = stored(
        text_bytes(docs).mapInArrow(_linked_rows(ranks_path, model_path, chunk_bytes), _LINKED_DDL), "links"
    )
    of_chunks = linked.where("pairs IS NOT NULL")
    places = of_chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    met = places.join(pair_counts(of_chunks, b_bits), "pair").select(
        F.col("chunk").alias("of_chunk"), "place", "n", "best"
    )
    rows = linked.where("pairs IS NULL").drop("pairs", "n_docs")
    return rows.groupBy("chunk").cogroup(met.groupBy("of_chunk")).applyInArrow(_counted, _REPORT_DDL)
