"""Adaptive context-mixing range coder for token ids, many blocks side by side.

Orders 0 to 2 predict the next id: order 0 counts the block's ids so far, orders
1 and 2 name the id seen last after the same one or two ids. Each prediction's
share of the coding interval follows how often it was right at the same
confidence. One carry-propagating range coder step codes an id. Every block
lists its own alphabet and has a model of its own that starts empty; blocks
advance together, one per numpy lane, and encoder and decoder make the same
steps in whole numbers, whichever blocks are beside one another.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

#: Ids in a block at most, and so symbols in its alphabet.
MOST_IDS = 8192
_SIDE = 21  # its cube holds every alphabet and one symbol more
_SIZE = _SIDE**3
_SLOT_BITS = 13
_SLOTS = 1 << _SLOT_BITS
#: Order-0 shares sum to 2**20, the three orders' shares to 2**10 of these.
_COUNT_BITS, _SHARE_BITS = 20, 10
_ALL_BITS = _COUNT_BITS + _SHARE_BITS
_FULL = 1 << _SHARE_BITS
_ID_BITS = 16
_REBUILDS = (0, 32, 64, 128, 256, 512, 1024, 2048, 3072, 4096, 6144)
_HEAD = struct.Struct("<I")
_WORD = np.uint64(32)
_LEAST = np.uint64(1 << 32)
_COARSE = np.uint64(_ALL_BITS)


class Mixer:
    """The models of all lanes over places in their alphabets."""

    def __init__(self, lanes: int):
        self.size = _SIZE
        lane = np.arange(lanes)
        self.n, self.lane = lanes, lane
        self.base0, self.base0s, self.base = lane * self.size, lane * (self.size + 1), lane * _SLOTS
        self.counts = np.zeros(lanes * self.size, dtype=np.uint16)
        self.sums = np.zeros(lanes * (self.size + 1), dtype=np.uint32)
        self.buckets = np.empty(0, dtype=np.int64)
        self.seen1 = np.zeros(lanes * _SLOTS, dtype=np.uint32)
        self.seen2 = np.zeros(lanes * _SLOTS, dtype=np.uint32)
        # Misses and hits by confidence, order and lane; none is ever at 0.
        self.tries1 = np.ones(8 * lanes, dtype=np.int64)
        self.tries2 = np.ones(8 * lanes, dtype=np.int64)
        self.last1 = np.zeros(lanes, dtype=np.int64)
        self.last2 = np.zeros(lanes, dtype=np.int64)
        self.at = 0

    def _rebuild(self) -> None:
        """Order-0 sums and the trust in orders 1 and 2, from what was seen."""
        step = ((1 << _COUNT_BITS) - self.size) // max(1, self.at)
        counts = self.counts.reshape(self.n, self.size)
        sums = self.sums.reshape(self.n, self.size + 1)
        for k in range(0, self.n, 16):
            part = counts[k : k + 16] * np.uint32(step)
            part += np.uint32(1)
            np.cumsum(part, axis=1, out=sums[k : k + 16, 1:])
        sums[:, -1] = 1 << _COUNT_BITS
        ends = sums[:, _SIDE::_SIDE].astype(np.int64)
        self.buckets = (ends + (self.lane[:, None] << 32)).reshape(-1)
        self.trust1, self.trust2 = self._trust(self.tries1), self._trust(self.tries2)

    def _trust(self, tries: np.ndarray) -> np.ndarray:
        missed, hit = tries.reshape(4, 2, self.n).transpose(1, 0, 2)
        trust = (_FULL - 64) * hit // (hit + missed)
        trust[0] = 0
        return trust.reshape(-1)

    def predict(self) -> None:
        """Candidates of orders 1 and 2 and the end of their shares."""
        if self.at in _REBUILDS:
            self._rebuild()
        mixed = self.last1 * 40503
        self.i1 = self.base + ((mixed >> 2) & (_SLOTS - 1))
        self.i2 = self.base + ((mixed + self.last2 * 30011 >> 3) & (_SLOTS - 1))
        e1, e2 = self.seen1.take(self.i1).astype(np.int64), self.seen2.take(self.i2).astype(np.int64)
        self.c1, self.c2 = e1 & 0xFFFF, e2 & 0xFFFF
        self.k1, self.k2 = (e1 >> _ID_BITS) * self.n, (e2 >> _ID_BITS) * self.n
        p2 = self.trust2.take(self.k2 + self.lane)
        p1 = (_FULL - p2) * self.trust1.take(self.k1 + self.lane) >> _SHARE_BITS
        p1 *= self.c1 != self.c2
        self.left = _FULL - p2 - p1
        self.end2 = p2 << _COUNT_BITS
        self.end1 = p2 + p1 << _COUNT_BITS

    def share(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each id's share of 2**30."""
        at = self.base0s + ids
        below = self.sums.take(at).astype(np.int64)
        start = self.end1 + below * self.left
        length = (self.sums.take(at + 1) - below) * self.left
        is1 = (ids == self.c1) & (self.end1 > self.end2)
        start = np.where(is1, self.end2, start)
        length = np.where(is1, self.end1 - self.end2, length)
        is2 = (ids == self.c2) & (self.end2 > 0)
        return np.where(is2, 0, start), np.where(is2, self.end2, length)

    def find(self, target: np.ndarray) -> np.ndarray:
        """The id whose share holds the target."""
        plain = np.maximum(target - self.end1, 0) // self.left
        bucket = np.searchsorted(self.buckets, plain + (self.lane << 32), side="right")
        first = bucket * _SIDE + self.lane  # of a lane's sums there is one more
        ends = self.sums.take(first[:, None] + np.arange(1, _SIDE))
        inside = np.add.reduce(ends <= plain[:, None], axis=1, dtype=np.uint8)
        ids = first - self.base0s + inside
        ids = np.where(target < self.end1, self.c1, ids)
        return np.where(target < self.end2, self.c2, ids)

    def update(self, ids: np.ndarray) -> None:
        self.seen1[self.i1] = self._learn(ids, self.c1, self.k1, self.tries1)
        self.seen2[self.i2] = self._learn(ids, self.c2, self.k2, self.tries2)
        self.counts[self.base0 + ids] += 1
        self.last2, self.last1 = self.last1, ids
        self.at += 1

    def _learn(self, ids: np.ndarray, candidate: np.ndarray, state: np.ndarray, tries: np.ndarray) -> np.ndarray:
        hit = (ids == candidate) & (state > 0)
        tries[2 * state + hit * self.n + self.lane] += 1
        sure = np.where(hit, np.minimum(state + self.n, 3 * self.n), self.n) // self.n
        return ids | sure << _ID_BITS


def encode_blocks(blocks: Sequence[np.ndarray]) -> list[bytes]:
    """The alphabet and coded 32-bit words of each block of 1 to 8192 ids of 32 bits."""
    lengths = np.array([len(b) for b in blocks])
    lanes, steps = len(blocks), int(lengths.max(initial=0))
    if steps > MOST_IDS:
        raise ValueError(f"a block holds {MOST_IDS} ids at most")
    ids = np.zeros((steps, lanes), dtype=np.int64)
    heads = []
    for k, block in enumerate(blocks):
        alphabet, ids[: len(block), k] = np.unique(block, return_inverse=True)
        packed = zlib.compress(np.diff(alphabet.astype(np.int64), prepend=0).astype("<u4").tobytes(), 1)
        heads.append(_HEAD.pack(len(packed)) + packed)
    mixer = Mixer(lanes)
    low = np.zeros(lanes, dtype=np.uint64)
    span = np.full(lanes, np.iinfo(np.uint64).max, dtype=np.uint64)
    words = np.zeros((lanes, steps + 4), dtype="<u4")
    used = np.zeros(lanes, dtype=np.int64)
    for at in range(steps):
        mixer.predict()
        start, length = mixer.share(ids[at])
        unit = span >> _COARSE
        live = at < lengths
        moved = low + unit * start.astype(np.uint64) * live
        for k in np.flatnonzero(moved < low):
            _carry(words[k], used[k])
        low = moved
        span = np.where(live, unit * length.astype(np.uint64), span)
        out = np.flatnonzero(span < _LEAST)
        words[out, used[out]] = low[out] >> _WORD
        used[out] += 1
        low[out] <<= _WORD
        span[out] <<= _WORD
        mixer.update(ids[at])
    words[mixer.lane, used] = low >> _WORD
    words[mixer.lane, used + 1] = low & (_LEAST - np.uint64(1))
    return [heads[k] + words[k, : used[k] + 2].tobytes() for k in range(lanes)]


def _carry(words: np.ndarray, used: int) -> None:
    """Add one to the number that the words written so far spell."""
    at = used - 1
    while words[at] == 0xFFFFFFFF:
        words[at] = 0
        at -= 1
    words[at] += 1


def decode_blocks(coded: Sequence[bytes], lengths: Sequence[int]) -> list[np.ndarray]:
    """The ids of each block; the reverse of ``encode_blocks``."""
    lanes, steps, counts = len(coded), max(lengths, default=0), np.asarray(lengths)
    words = np.zeros((lanes, max((len(c) for c in coded), default=0) // 4 + 2), dtype=np.uint64)
    alphabets = []
    for k, data in enumerate(coded):
        end = _HEAD.size + _HEAD.unpack_from(data)[0]
        alphabets.append(np.cumsum(np.frombuffer(zlib.decompress(data[_HEAD.size : end]), dtype="<u4"), dtype=np.uint32))
        words[k, : (len(data) - end) // 4] = np.frombuffer(data, dtype="<u4", offset=end)
    mixer = Mixer(lanes)
    span = np.full(lanes, np.iinfo(np.uint64).max, dtype=np.uint64)
    code = words[:, 0] << _WORD | words[:, 1]
    read = np.full(lanes, 2, dtype=np.int64)
    ids = np.zeros((steps, lanes), dtype=np.int64)
    last = np.int64((1 << _ALL_BITS) - 1)
    for at in range(steps):
        mixer.predict()
        unit = span >> _COARSE
        live = at < counts
        target = np.minimum((code // unit).astype(np.int64), last)
        symbols = mixer.find(target) * live
        start, length = mixer.share(symbols)
        code = code - unit * start.astype(np.uint64) * live
        span = np.where(live, unit * length.astype(np.uint64), span)
        more = np.flatnonzero(span < _LEAST)
        code[more] = code[more] << _WORD | words[more, read[more]]
        read[more] += 1
        span[more] <<= _WORD
        ids[at] = symbols
        mixer.update(symbols)
    return [alphabets[k][ids[:n, k]].astype("<u4") for k, n in enumerate(lengths)]
