"""SentencePiece encoding with a score-ordered agenda, and decoding."""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from granary.llm.common import in_runs, ready_workers, rows_of, text_bytes, to_batches

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: Encoded chunks kept per worker; a full memory is emptied and fills again.
MEMORY = 600_000
_PLACE_BITS = 40
_PLACES = (1 << _PLACE_BITS) - 1
_LONG = 64
#: Agendas of chunks up to these lengths advance together.
_WIDTHS = (4, 8, 12, 16, 24, 40, _LONG)
_FEW = 64
#: Bytes of texts that are looked up together.
_RUN = 4 << 20
_SYMBOL_BITS = 21
_PAD = (1 << _SYMBOL_BITS) - 1
_NO_PAIR = np.iinfo(np.int32).max
#: A chunk starts with its spaces; no piece reaches over the start of a chunk.
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
_NORMAL, _UNKNOWN, _USER, _BYTE, _UNUSED = 1, 2, 4, 6, 5


class PieceCodec:
    """Encoder and decoder of a merge-type (BPE) SentencePiece model.

    Takes models with the identity normaliser, byte fallback and a dummy prefix,
    none of whose pieces has a space sign after another character or a line feed;
    anything else raises, as the chunks would not be independent.
    """

    def __init__(self, model_path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as file:
            model.ParseFromString(file.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        normal = [p.piece for p in model.pieces if p.type == _NORMAL]
        if (
            trainer.model_type != 2 or not trainer.byte_fallback or kinds & {_USER, _UNUSED}
            or norm.precompiled_charsmap or norm.remove_extra_whitespaces
            or not norm.add_dummy_prefix or not norm.escape_whitespaces
            or trainer.treat_whitespace_as_suffix
            or any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in normal)
        ):
            raise ValueError("a byte-fallback BPE model without a normaliser is needed")
        scores = sorted({p.score for p in model.pieces if p.type == _NORMAL}, reverse=True)
        place = {score: k for k, score in enumerate(scores)}
        self.ranks = {p.piece: place[p.score] for p in model.pieces if p.type == _NORMAL}
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == _NORMAL}
        self._index_pairs(len(model.pieces))
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []
        for k, p in enumerate(model.pieces):
            if p.type == _BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = k
                self.raw.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.raw.append(p.piece.replace(SPACE, " ").encode() if p.type == _NORMAL else b"")
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.memory: dict[str, tuple[str, int, bytes]] = {}

    def _index_pairs(self, n: int) -> None:
        """Symbols as numbers: a piece's id, or ``n`` + its code point for another
        character; ranks and pieces of all pairs of symbols that join to a piece."""
        self.others = n
        self.of_char = np.arange(n, n + 0x110000, dtype=np.int32)
        for piece, k in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = k
        pairs = []
        for piece, k in self.ids.items():
            for at in range(1, len(piece)):
                left, right = self._symbol(piece[:at]), self._symbol(piece[at:])
                if left is not None and right is not None:
                    pairs.append((left << _SYMBOL_BITS | right, self.ranks[piece], k))
        pairs.sort()
        keys, ranks, pieces = np.array([*pairs, (np.iinfo(np.int64).max, _NO_PAIR, 0)], dtype=np.int64).T
        self.pair_keys = np.ascontiguousarray(keys)
        self.pair_ranks, self.pair_pieces = ranks.astype(np.int32), pieces.astype(np.int32)

    def _symbol(self, text: str) -> int | None:
        return int(self.of_char[ord(text)]) if len(text) == 1 else self.ids.get(text)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; no rank where they join to none."""
        keys = left.astype(np.int64) << _SYMBOL_BITS | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NO_PAIR), self.pair_pieces[at]

    def merge_all(self, chunks: list[str]) -> list[list[int]]:
        """``merge`` of many chunks, in their order.

        A chunk's agenda is a matrix row with the rank of each adjacent pair. In every
        step each chunk joins its pair of best score, of equal scores the leftmost, and
        looks up the two new pairs; chunks without a pair leave. Very long chunks, and
        chunks that few others of their length join, have an agenda of their own.
        """
        found: list[list[int]] = [[]] * len(chunks)
        lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        least = 0
        for width in _WIDTHS:
            places = np.flatnonzero((lengths > least) & (lengths <= width))
            least = width
            if len(places) < _FEW:
                for k in places:
                    found[k] = self.merge(chunks[k])
                continue
            for part in np.array_split(places, len(places) // 16384 + 1):
                self._advance([chunks[k] for k in part], lengths[part], width, part.tolist(), found)
        for k in np.flatnonzero(lengths > least):
            found[k] = self.merge(chunks[k])
        return found

    def _advance(self, chunks: list[str], sizes: np.ndarray, width: int, places: list[int], found: list) -> None:
        symbols = np.full((len(chunks), width + 1), _PAD, dtype=np.int32)
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype="<u4")
        symbols[np.arange(width + 1) < sizes[:, None]] = self.of_char[points]
        ranks, pieces = self._pairs(symbols[:, :-1], symbols[:, 1:])
        places_left = np.array(places, dtype=np.int64)
        while len(symbols):
            best = ranks.argmin(axis=1)
            lane = np.arange(len(symbols))
            live = ranks[lane, best] != _NO_PAIR
            if not live.all():
                done = ~live
                for place, row in zip(places_left[done].tolist(), symbols[done].tolist()):
                    found[place] = self._ids_of(row)
                symbols, ranks, pieces = symbols[live], ranks[live], pieces[live]
                places_left, best = places_left[live], best[live]
                lane = np.arange(len(symbols))
            if not len(symbols):
                return
            symbols[lane, best] = pieces[lane, best]
            # The right symbol and the joined pair go; later ones move up by one.
            columns = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, columns + (columns > best[:, None]), 1)
            kept = columns[:-1] + (columns[:-1] >= best[:, None])
            ranks, pieces = np.take_along_axis(ranks, kept, 1), np.take_along_axis(pieces, kept, 1)
            for mine, at in ((lane, best), (lane[best > 0], best[best > 0] - 1)):
                inside = at < ranks.shape[1]
                mine, at = mine[inside], at[inside]
                ranks[mine, at], pieces[mine, at] = self._pairs(symbols[mine, at], symbols[mine, at + 1])
            if not ranks.shape[1]:
                for place, row in zip(places_left.tolist(), symbols.tolist()):
                    found[place] = self._ids_of(row)
                return

    def _ids_of(self, symbols: list[int]) -> list[int]:
        """The row's ids up to its padding, with bytes for characters without a piece."""
        if symbols[-1] == _PAD:
            symbols = symbols[: symbols.index(_PAD)]
        if max(symbols) < self.others:
            return symbols
        return [
            k
            for symbol in symbols
            for k in ([symbol] if symbol < self.others else [self.byte_ids[b] for b in chr(symbol - self.others).encode()])
        ]

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk: the adjacent pair of best score joins first, of equal
        scores the leftmost, until no pair is a piece.

        An entry of the agenda is the pair's rank and its left place in one
        number. It is stale if the pair now at that place has another rank.
        """
        ranks = self.ranks
        symbols = list(chunk)
        n = len(symbols)
        agenda = [
            ranks[pair] << _PLACE_BITS | k
            for k, pair in enumerate(map(str.__add__, symbols, symbols[1:]))
            if pair in ranks
        ]
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            entry = heapq.heappop(agenda)
            left = entry & _PLACES
            right = after[left]
            if right >= n or not symbols[left]:  # "" was joined to its left neighbour
                continue
            pair = symbols[left] + symbols[right]
            if ranks.get(pair) != entry >> _PLACE_BITS:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = follower = after[right]
            if follower < n:
                before[follower] = left
                rank = ranks.get(pair + symbols[follower])
                if rank is not None:
                    heapq.heappush(agenda, rank << _PLACE_BITS | left)
            leader = before[left]
            if leader >= 0:
                rank = ranks.get(symbols[leader] + pair)
                if rank is not None:
                    heapq.heappush(agenda, rank << _PLACE_BITS | leader)
        found: list[int] = []
        for symbol in symbols:
            if symbol:
                known = self.ids.get(symbol)
                if known is None:
                    found.extend(self.byte_ids[b] for b in symbol.encode())
                else:
                    found.append(known)
        return found

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [k for chunk in self.chunks(text) for k in self.merge(chunk)]

    def decode(self, ids: Iterable[int]) -> str:
        return self.text(b"".join(self.raw[k] for k in ids))

    @staticmethod
    def text(raw: bytes) -> str:
        """The dummy prefix is dropped."""
        return raw.decode("utf-8", "replace").removeprefix(" ")

    def look_up(self, texts: list[list[str]]) -> Iterator[list[tuple[str, int, bytes]]]:
        """Comma-joined ids, their number and the decoded bytes of each text's chunks.

        Chunks that are new to this worker are encoded by the agenda, compared
        with the library in one batch, and remembered unless they are very long.
        """
        found = [list(map(self.memory.get, chunks)) for chunks in texts]
        fresh = list({c for chunks, f in zip(texts, found) if None in f for c, e in zip(chunks, f) if e is None})
        ids = self.merge_all(fresh)
        self.check(fresh, ids)
        new = {
            chunk: (",".join(map(str, own)), len(own), b"".join([self.raw[k] for k in own]))
            for chunk, own in zip(fresh, ids)
        }
        if len(self.memory) + len(new) > MEMORY:
            self.memory.clear()
        self.memory.update((c, e) for c, e in new.items() if len(c) <= _LONG)
        for chunks, entries in zip(texts, found):
            yield [e or new[c] for c, e in zip(chunks, entries)] if None in entries else entries

    def check(self, chunks: list[str], ids: list[list[int]]) -> None:
        """Raise if the library encodes or decodes one of the chunks differently.

        The dummy prefix that the library adds stands for a chunk's first space;
        a chunk without one follows a line feed, so it is checked behind one.
        """
        texts = [c[1:] if c[0] == SPACE else "\n" + c for c in chunks]
        expected = self.library.encode(texts, num_threads=1)
        decoded = self.library.decode(expected, num_threads=1)
        prefix = [self.ids[SPACE], self.byte_ids[10]]
        for chunk, text, own, theirs, back in zip(chunks, texts, ids, expected, decoded):
            if chunk[0] != SPACE:
                own = prefix + own
            if text and (own != theirs or self.decode(own) != back):
                raise ValueError(f"the sentencepiece library differs on {chunk!r}")


@functools.lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


_CODED = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def piece_digests(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """Number of ids, and SHA-256 of the ids and of the decoded text, per row.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256``: ids as decimals joined by
    commas, without begin and end ids. Every chunk that a worker encodes anew is
    compared with the sentencepiece library, batch by batch; a difference fails
    the job. A null text counts as empty and has no ids; texts of any length are
    encoded whole; repeated rows come back repeated, an empty table gives no rows,
    other columns are ignored. One narrow pass.
    """
    ready_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_path)

        def coded() -> Iterator[tuple]:
            for rows in in_runs(rows_of(batches), lambda row: len(row[1] or b"") + 64, _RUN):
                texts = [coder.chunks((data or b"").decode("utf-8", "replace")) for _, data in rows]
                for (doc_id, _), found in zip(rows, coder.look_up(texts)):
                    ids = ",".join([f[0] for f in found]).encode()
                    text = coder.text(b"".join([f[2] for f in found])).encode()
                    yield (
                        doc_id, sum([f[1] for f in found]),
                        hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest(),
                    )

        return to_batches(coded(), _CODED)

    return text_bytes(docs).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def encoded(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """``doc_id, ids, decoded``: the ids of each text and the text they decode to."""
    ready_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_path)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
        texts = ((doc_id, (data or b"").decode("utf-8", "replace")) for doc_id, data in rows_of(batches))
        return to_batches(((k, ids := coder.encode(t), coder.decode(ids)) for k, t in texts), schema, 256)

    return text_bytes(docs).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")
