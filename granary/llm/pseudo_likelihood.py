"""Masked pseudo-likelihood scores from a bidirectional window network."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import ready_workers, slices_of, stored, text_bytes

#: Words on each side that a prediction sees.
REACH = 2
#: Words are hashed to SIDE * SIDE ids: a class of SIDE, then one of its SIDE members.
SIDE = 64
PAD = SIDE * SIDE
EMBEDDING, HIDDEN = 16, 32
BATCH = 16384
RATE = 0.1
_MEMORY = 600_000
#: Words whose counts every scoring task holds; the others' are joined.
HEAD = 1 << 18
_SHAPES = {
    "embed": (PAD + 1, EMBEDDING), "into": (2 * REACH * EMBEDDING, HIDDEN), "bias": (HIDDEN,),
    "klass": (HIDDEN + 1, SIDE), "member": (SIDE, HIDDEN + 1, SIDE),
}
_OFFSETS = np.array([*range(-REACH, 0), *range(1, REACH + 1)])


class WordIds:
    """Hashed ids of a text's lower-cased words, remembered per worker.

    ``keys`` holds the remembered words' own keys: 64 bits of two hashes, the
    lowest 12 being the id, so words of one id stay apart.
    """

    def __init__(self) -> None:
        self.memory = _Places()
        self.keys = np.empty(1 << 12, dtype=np.int64)

    def __call__(self, data: bytes | None) -> np.ndarray:
        if len(self.memory) > _MEMORY:
            self.memory.clear()
        return self.ids(self.places(data))

    def places(self, data: bytes | None) -> np.ndarray:
        """Places of a text's words in the memory, for as long as it isn't cleared."""
        return self._known((data or b"").lower().split())

    def places_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the texts' distinct words, all words as numbers of these, and each text's word count."""
        words, numbers, sizes = distinct_words(texts)
        return self._known(words), numbers, sizes

    def _known(self, words: list[bytes]) -> np.ndarray:
        first = len(self.memory)
        places = np.fromiter(map(self.memory.__getitem__, words), dtype=np.int64, count=len(words))
        fresh = len(self.memory) - first
        if fresh:
            new = list(islice(reversed(self.memory), fresh))[::-1]
            self.keys = lengthened(self.keys, first + fresh)
            self.keys[first : first + fresh] = word_keys(new).view(np.int64)
        return places

    def ids(self, places: np.ndarray) -> np.ndarray:
        return (self.keys[places] & (PAD - 1)).astype(np.int32)


class _Places(dict):
    """Places of words, a new one for a word not met before."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


def distinct_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``words, numbers, sizes`` of binary texts, words as ``lower().split()`` of bytes has them.

    ``numbers`` are the places in ``words`` of all words in turn, ``sizes`` the words of each text.
    """
    texts = texts.fill_null(b"")
    texts = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    found = coded.dictionary
    words = pa.Array.from_buffers(pa.binary(), len(found), found.buffers(), offset=found.offset)
    words = words.to_numpy(zero_copy_only=False).tolist()
    numbers, sizes = coded.indices.to_numpy(), split.value_lengths().to_numpy()
    if b"" in words:  # beside white space at either end of a text
        empty = words.index(b"")
        full = numbers != empty
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full], minlength=len(sizes))
        numbers = numbers[full]
        numbers = numbers - (numbers > empty)
        del words[empty]
    return words, numbers, sizes


def word_keys(words: list[bytes]) -> np.ndarray:
    """Unsigned 64 bits of each word: 52 of XXH3, and its id."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    ids = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words)) % np.uint64(PAD)
    return hashes >> np.uint64(12) << np.uint64(12) | ids


def lengthened(values: np.ndarray, least: int) -> np.ndarray:
    """``values``, with zeros behind them if there are fewer than ``least``."""
    if len(values) >= least:
        return values
    return np.concatenate([values, np.zeros(max(least - len(values), len(values)), dtype=values.dtype)])


@dataclass
class Network:
    """Weights in one vector, with a view for each layer."""

    flat: np.ndarray

    def __post_init__(self) -> None:
        self._rooms: dict[str, np.ndarray] = {}
        at = 0
        for name, shape in _SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + size].reshape(shape))
            at += size

    @staticmethod
    def size() -> int:
        return sum(int(np.prod(s)) for s in _SHAPES.values())

    @classmethod
    def fresh(cls, seed: int = 0) -> Network:
        """The common start: small random embeddings and inner weights."""
        net = cls(np.zeros(cls.size(), dtype=np.float32))
        random = np.random.default_rng(seed)
        net.embed[:] = random.normal(0, 0.3, net.embed.shape)
        net.into[:] = random.normal(0, 1 / 8, net.into.shape)
        return net

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(context)
        seen = self._room("seen", n, 2 * REACH * EMBEDDING)
        np.take(self.embed, context, axis=0, out=seen.reshape(n, 2 * REACH, EMBEDDING), mode="clip")
        sums = np.matmul(seen, self.into, out=self._room("sums", n, HIDDEN))
        sums += self.bias
        inner = self._room("inner", n, HIDDEN + 1)
        np.tanh(sums, out=inner[:, :HIDDEN])
        inner[:, HIDDEN] = 1
        return seen, inner

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p(target | both sides) of each row."""
        order, klass, member, runs = _by_class(target)
        _, inner = self.hidden(context[order])
        sure = _log_share(self._class_logits(inner), klass)
        sure += _log_share(self._member_logits(inner, klass, runs), member)
        found = np.empty(len(order))
        found[order] = sure
        return found

    def gradient(self, context: np.ndarray, target: np.ndarray) -> Network:
        """Of the mean negative log probability."""
        out = Network(np.zeros_like(self.flat))
        order, klass, member, runs = _by_class(target)
        context, n = context[order], len(order)
        seen, inner = self.hidden(context)
        error = _error(self._class_logits(inner), klass)
        np.matmul(inner.T, error, out=out.klass)
        back = np.matmul(error, self.klass.T, out=self._room("back", n, HIDDEN + 1))
        error = _error(self._member_logits(inner, klass, runs), member)
        within = self._room("within", n, HIDDEN + 1)
        for first, end in runs:
            own = error[first:end]
            np.matmul(inner[first:end].T, own, out=out.member[klass[first]])
            np.matmul(own, self.member[klass[first]].T, out=within[first:end])
        back += within
        slope = np.square(inner[:, :HIDDEN], out=self._room("sums", n, HIDDEN))
        np.subtract(1, slope, out=slope)
        back = np.multiply(back[:, :HIDDEN], slope, out=slope)
        out.into[:], out.bias[:] = seen.T @ back, back.sum(axis=0)
        words, places = context.reshape(-1), np.argsort(context.astype(np.uint16), axis=None, kind="stable")
        words = words[places]
        firsts = np.flatnonzero(np.diff(words, prepend=-1))
        steps = np.matmul(back, self.into.T, out=seen).reshape(-1, EMBEDDING)
        sorted_steps = self._room("steps", len(steps), EMBEDDING)
        np.take(steps, places, axis=0, out=sorted_steps, mode="clip")
        out.embed[words[firsts]] = np.add.reduceat(sorted_steps, firsts, axis=0)
        return out

    def _class_logits(self, inner: np.ndarray) -> np.ndarray:
        return np.matmul(inner, self.klass, out=self._room("logits", len(inner), SIDE))

    def _member_logits(self, inner: np.ndarray, klass: np.ndarray, runs: list[tuple[int, int]]) -> np.ndarray:
        logits = self._room("logits", len(inner), SIDE)
        for first, end in runs:
            np.matmul(inner[first:end], self.member[klass[first]], out=logits[first:end])
        return logits

    def _room(self, name: str, rows: int, columns: int) -> np.ndarray:
        """Memory kept from batch to batch; fresh pages cost more than what is computed in them."""
        have = self._rooms.get(name)
        if have is None or len(have) < rows:
            have = self._rooms[name] = np.empty((rows, columns), dtype=np.float32)
        return have[:rows]


#: Rows whose logits stay in a core's own cache.
_ROWS = 2048


def _shifted(logits: np.ndarray) -> np.ndarray:
    """The logits less each row's largest, in place."""
    logits -= logits.max(axis=1, keepdims=True)
    return logits


def _log_share(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log of the softmax at one column of each row; the logits are overwritten."""
    shares = np.empty(len(logits), dtype=np.float32)
    for at in range(0, len(logits), _ROWS):
        part = _shifted(logits[at : at + _ROWS])
        own = part[np.arange(len(part)), chosen[at : at + _ROWS]]
        shares[at : at + _ROWS] = own - np.log(np.exp(part, out=part).sum(axis=1))
    return shares


def _error(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Gradient of the rows' mean loss by their logits, in place."""
    n = np.float32(len(logits))
    for at in range(0, len(logits), _ROWS):
        part = _shifted(logits[at : at + _ROWS])
        np.exp(part, out=part)
        part /= part.sum(axis=1, keepdims=True)
        part[np.arange(len(part)), chosen[at : at + _ROWS]] -= 1
        part /= n
    return logits


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """An order that brings classes together, with classes, members and runs in it."""
    order = np.argsort((target // SIDE).astype(np.uint8), kind="stable")
    klass, member = np.divmod(target[order], SIDE)
    ends = [*np.flatnonzero(np.diff(klass)) + 1, len(klass)] if len(klass) else []
    return order, klass, member, list(zip([0, *ends[:-1]], ends))


def windows(texts: Iterable[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``context, target, text number`` of every word, in batches.

    Texts are laid end to end with padding between them, so a window sees its own
    text only; a text longer than a batch is cut into several.
    """
    pad = np.full(REACH, PAD, dtype=np.int32)
    parts, numbers, size = [pad], [], 0
    for number, ids in enumerate(texts):
        parts += (np.asarray(ids, dtype=np.int32), pad)
        numbers.append(number)
        size += len(ids)
        if size >= BATCH:
            yield from _cut(parts, numbers)
            parts, numbers, size = [pad], [], 0
    yield from _cut(parts, numbers)


def _parts(values: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Consecutive parts of ``values``, of the given sizes."""
    ends = np.cumsum(sizes).tolist()
    return (values[first:end] for first, end in zip([0, *ends], ends))


def _cut(parts: list[np.ndarray], numbers: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids = np.concatenate(parts)
    owner = np.repeat(np.array(numbers, dtype=np.int32), [len(x) for x in parts[1::2]])
    places = np.flatnonzero(ids != PAD)
    for at in range(0, len(places), BATCH):
        some = places[at : at + BATCH]
        yield ids[some[:, None] + _OFFSETS], ids[some], owner[at : at + BATCH]


_SUMS = pa.schema([("place", pa.int32()), ("word", pa.int64()), ("value", pa.float64()), ("weight", pa.float64())])


def train(docs: DataFrame, rounds: int = 1, seed: int = 0) -> np.ndarray:
    """Weights fitted on every document, by parallel descent and averaging."""
    return fitted(docs, rounds, seed)[0]


def fitted(docs: DataFrame, rounds: int = 1, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """The network's weights, and ``word, n``: the key and count of every word.

    In each round every task starts from the common weights, goes once over all
    windows of its rows, and gives its weights, which are averaged by the number
    of words behind them. The first round counts all words on the way; that table
    grows with the corpus and stays distributed. What reaches the driver is one
    vector of fixed size.
    """
    if rounds < 1:
        raise ValueError("training takes a round at least")
    ready_workers(docs.sparkSession)
    rows = text_bytes(docs)
    current, counted = Network.fresh(seed).flat, None
    for turn in range(rounds):
        common = docs.sparkSession.sparkContext.broadcast(current)

        def fit(batches: Iterable[pa.RecordBatch], counting: bool = not turn) -> Iterator[pa.RecordBatch]:
            net, words, n = Network(common.value.copy()), WordIds(), 0
            squares = np.full_like(net.flat, 1e-6)
            counts, ready = np.zeros(1 << 12), []

            def give() -> None:
                known = len(words.memory)
                ready.extend(_sums(None, words.keys[:known], counts[:known], np.zeros(known)))
                words.memory.clear()
                counts[:] = 0

            def texts() -> Iterator[np.ndarray]:
                nonlocal counts
                for batch in slices_of(batches, "text"):
                    if len(words.memory) > _MEMORY:
                        give()
                    places, numbers, sizes = words.places_of(batch.column("text"))
                    counts = lengthened(counts, len(words.memory))
                    counts[places] += np.bincount(numbers, minlength=len(places))
                    yield from _parts(words.ids(places)[numbers], sizes)

            for context, target, _ in windows(texts()):
                step = net.gradient(context, target).flat
                squares += step * step
                net.flat -= RATE * step / np.sqrt(squares)
                n += len(target)
                if counting:
                    yield from ready
                ready.clear()
            give()
            if counting:
                yield from ready
            if n:
                yield from _sums(np.arange(len(net.flat)), None, net.flat.astype(np.float64) * n, np.full(len(net.flat), float(n)))

        sums = stored(
            rows.mapInArrow(fit, "place int, word bigint, value double, weight double")
            .groupBy("place", "word").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight")),
            "fitted",
        )
        averaged = sums.where("place IS NOT NULL").select("place", (F.col("value") / F.col("weight")).alias("value")).toArrow()
        if averaged.num_rows:
            current = np.zeros(Network.size(), dtype=np.float32)
            current[averaged["place"].to_numpy()] = averaged["value"].to_numpy()
        if counted is None:
            counted = sums.where("place IS NULL").select("word", F.col("value").cast("bigint").alias("n"))
    return current, counted


def _sums(places: np.ndarray | None, words: np.ndarray | None, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(values[0]), 50_000):
        size = len(values[0][at : at + 50_000])
        columns = [
            pa.nulls(size, field.type) if x is None else pa.array(x[at : at + size].astype(field.type.to_pandas_dtype()))
            for x, field in zip((places, words, *values), _SUMS)
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=_SUMS)


def head_and_totals(words: DataFrame, most: int = HEAD) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """The counts split by size: ``(tail, keys, counts, totals)``.

    ``keys`` (ascending) and ``counts`` are the commonest words, at most ``most``;
    ``tail`` has the others that were met more than once; ``totals`` the number of
    words of each id.
    """
    level = F.floor(F.log2("n") * 8)
    repeated = words.where("n > 1").withColumn("level", level)
    room, least = most, 1 << 30
    for r in sorted(repeated.groupBy("level").count().collect(), reverse=True):
        if r["count"] > room:
            break
        room, least = room - r["count"], r["level"]
    head = repeated.where(F.col("level") >= least).select("word", "n").toArrow()
    keys, counts = head["word"].to_numpy(), head["n"].to_numpy()
    order = np.argsort(keys)
    totals = np.zeros(PAD)
    for r in words.groupBy(F.col("word").bitwiseAND(PAD - 1).alias("id")).agg(F.sum("n").alias("n")).collect():
        totals[r["id"]] = r["n"]
    return repeated.where(F.col("level") < least).select("word", "n"), keys[order], counts[order], totals


_SCORES = ["doc_id", "n_tokens", "log_likelihood", "tail"]
#: Texts whose windows make batches of their own when scored.
_TOGETHER = 128


def score(docs: DataFrame, weights: np.ndarray, words: DataFrame | None = None, head: int = HEAD) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean_log_probability`` per row.

    The sum, over all words of the whole text, of the log probability of the word
    given the two words on either side: that of its id by the network, and that of
    the word among the words of its id by the counts ``words``. Of ``N`` words of
    an id, one met ``n`` times has n / (N + 1), and all unmet words together
    1 / (N + 1). The commonest words' counts are in every task; the others meet
    theirs in a join of word keys. Without ``words`` ids alone are scored.

    Null and blank texts have 0 words, sum 0 and a null mean; repeated rows score
    alike (to rounding); an empty table gives no rows; other columns are ignored.
    """
    ready_workers(docs.sparkSession)
    spark = docs.sparkSession
    tail, *known = (None, None) if words is None else head_and_totals(words, head)
    shared = spark.sparkContext.broadcast((weights, known))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, known = shared.value
        net, words = Network(vector.copy()), WordIds()
        shares, common, done = np.zeros(1 << 12), np.zeros(1 << 12, dtype=bool), 0
        if len(known) > 1:
            keys, counts, totals = known
            ends, logs, spread = np.append(keys, 0), np.log(np.append(counts, 1)), np.log(totals + 1)

        def look_up() -> None:
            nonlocal shares, common, done
            size = len(words.memory)
            shares, common = lengthened(shares, size), lengthened(common, size)
            fresh = words.keys[done:size]
            at = np.searchsorted(keys, fresh)
            met = (at < len(keys)) & (ends[at] == fresh)
            shares[done:size] = np.where(met, logs[at], 0) - spread[fresh & (PAD - 1)]
            common[done:size], done = met, size

        for batch in slices_of(batches, "text"):
            if len(words.memory) > _MEMORY:
                words.memory.clear()
                done = 0
            places, numbers, sizes = words.places_of(batch.column("text"))
            sums, n = np.zeros(len(sizes)), np.zeros(len(sizes) + 1, dtype=np.int32)
            texts = _parts(words.ids(places)[numbers], sizes)
            for at in range(0, len(sizes), _TOGETHER):
                own = sums[at : at + _TOGETHER]
                for context, target, owner in windows(islice(texts, len(own))):
                    own += np.bincount(owner, net.log_probabilities(context, target), len(own))
            rare = np.empty(0, dtype=np.int64)
            if len(known) > 1:
                look_up()
                owner = np.repeat(np.arange(len(sizes)), sizes)
                sums += np.bincount(owner, shares[places][numbers], len(sizes))
                tails = ~common[places][numbers]
                rare = words.keys[places][numbers[tails]]
                np.cumsum(np.bincount(owner[tails], minlength=len(sizes)), out=n[1:])
            scores = [batch.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(sums), pa.ListArray.from_arrays(pa.array(n), pa.array(rare))]
            yield pa.RecordBatch.from_arrays(scores, _SCORES)

    found = text_bytes(docs).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, log_likelihood double, tail array<bigint>"
    )
    if tail is not None:
        found = stored(found.withColumn("row", F.monotonically_increasing_id()), "scored")
        shares = (
            found.select("row", F.explode("tail").alias("word")).join(tail, "word")
            .groupBy("row").agg(F.sum(F.log("n")).alias("share"))
        )
        found = found.drop("tail").join(shares, "row", "left").withColumn(
            "log_likelihood", F.col("log_likelihood") + F.coalesce("share", F.lit(0.0))
        )
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return found.select("doc_id", "n_tokens", "log_likelihood", mean.alias("mean_log_probability"))


def pseudo_likelihood(docs: DataFrame, rounds: int = 1, seed: int = 0) -> DataFrame:
    """Train on ``docs`` and score every row of it."""
    return score(docs, *fitted(docs, rounds, seed))
