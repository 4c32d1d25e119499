"""Adaptive context-mixing range coder for token ids, in independent checksummed blocks.

A block is cut into lanes of ``STEPS`` ids. All lanes advance together, one id per step, so
each step is a handful of array operations; they share one model, which learns from all ids
of the steps before. Nothing carries over from block to block.

Predictions: order 2 and order 1 each name the id last seen after their context, with a
confidence that grows while they are right; order 0 has adaptive frequencies. The three are
mixed with weights learnt per pair of confidences: an id takes a share of the range that
order 2 or order 1 has for the id it names, or else its order-0 part of the third share.

Block layout, little-endian: magic, ``n`` ids, alphabet size, crc32 of the ids as uint32,
number of lanes, words per lane (uint16 each), then the lanes' 16-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"WPT1"
HEADER = struct.Struct("<4sIIII")
STEPS = 256

#: Slots of the order-2 table.
ORDER2_BITS = 18
#: The shares of the three predictions add up to 2 ** 14.
SHARE_BITS = 14
#: Order-0 frequency gained per occurrence.
GAIN = 24
#: The model's shares and frequencies are brought up to date at each of the first steps,
#: then every so many.
EARLY, EVERY = 8, 8
#: Buckets in which ids are looked up when decoding.
BUCKET_BITS = 16

#: The range is at least 2 ** 48, room for a share and a frequency.
_LEAST = np.uint64(1 << 48)
_TOP = np.uint64(48)
_WORD = np.uint64(16)
_SHARE = np.uint64(SHARE_BITS)


class Model:
    """What has been learnt in a block so far.

    An entry of a context table is four times the id it names plus its confidence (0 to 3).
    """

    def __init__(self, alphabet: int) -> None:
        self.one = np.full(alphabet, alphabet * 4, np.int32)
        self.two = np.full(1 << ORDER2_BITS, alphabet * 4, np.int32)
        self.seen: list[np.ndarray] = []
        self.counts = np.ones(alphabet, np.int64)
        self.hits = np.full((32, 3), 2, np.int64)
        self.step = 0
        self._tabulate()

    def _tabulate(self) -> None:
        if self.seen:
            self.counts += GAIN * np.bincount(np.concatenate(self.seen), minlength=len(self.counts))
            self.seen = []
        self.cumulative = np.zeros(len(self.counts) + 1, np.uint64)
        np.cumsum(self.counts.view(np.uint64), out=self.cumulative[1:])
        self.first = None
        shares = 1 + self.hits * ((1 << SHARE_BITS) - 3) // self.hits.sum(axis=1, keepdims=True)
        shares[:, 2] += (1 << SHARE_BITS) - shares.sum(axis=1)
        starts = np.cumsum(shares, axis=1) - shares
        self.shares, self.starts = shares.astype(np.uint64).ravel(), starts.astype(np.uint64).ravel()
        self.second, self.third = self.starts[1::3].copy(), self.starts[2::3].copy()

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id whose part of the order-0 range holds each value.

        The range is cut into equal buckets with the id at the start of each; a value that is
        past that id's part is searched for.
        """
        if self.first is None:
            self.shift = np.uint64(max(0, int(self.cumulative[-1]).bit_length() - BUCKET_BITS))
            size = (np.uint64(1) << self.shift) - np.uint64(1)
            starts = ((self.cumulative + size) >> self.shift).view(np.int64)
            self.first = np.repeat(np.arange(len(self.counts), dtype=np.int32), np.diff(starts))
        value = np.minimum(value, self.cumulative[-1] - np.uint64(1))
        found = self.first[(value >> self.shift).view(np.int64)].astype(np.int64)
        past = np.flatnonzero(value >= self.cumulative[found + 1])
        found[past] = np.searchsorted(self.cumulative, value[past], side="right") - 1
        return found

    def predict(self, before: np.ndarray, last: np.ndarray) -> None:
        slot = (before * 40503 + last).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.last, self.slot = last, (slot >> np.uint64(64 - ORDER2_BITS)).view(np.int64)
        one, two = self.one[last], self.two[self.slot]
        self.guess_one, self.guess_two = one >> 2, two >> 2
        self.sure_one, self.sure_two = one & 3, two & 3
        self.context = (self.sure_two << 3) + (self.sure_one << 1) + (self.guess_one == self.guess_two)

    def kind(self, ids: np.ndarray) -> np.ndarray:
        """Which prediction names the id: order 2, order 1 or only order 0."""
        missed = (ids != self.guess_two).view(np.int8)
        return (missed << 1) - (missed & (ids == self.guess_one).view(np.int8))

    def learn(self, ids: np.ndarray, mixed: np.ndarray) -> None:
        few = ids.astype(np.int32)
        named = few << 2
        self.one[self.last] = named + (few == self.guess_one) * np.minimum(self.sure_one + 1, 3)
        self.two[self.slot] = named + (few == self.guess_two) * np.minimum(self.sure_two + 1, 3)
        self.hits += np.bincount(mixed, minlength=96).reshape(32, 3)
        self.seen.append(ids)
        self.step += 1
        if self.step < EARLY or self.step % EVERY == 0:
            self._tabulate()


def _lanes(n: int) -> tuple[int, int]:
    """Number of lanes, and the length of the last one."""
    lanes = -(-n // STEPS)
    return lanes, n - (lanes - 1) * STEPS


def encode(ids: np.ndarray) -> bytes:
    """One block; ``ids`` are non-negative integers below 2 ** 20."""
    ids = np.asarray(ids).astype("<u4", copy=False)
    n = len(ids)
    alphabet = int(ids.max()) + 1 if n else 1
    checksum = zlib.crc32(ids.tobytes())
    lanes, tail = _lanes(n)
    if not n:
        return HEADER.pack(MAGIC, 0, alphabet, checksum, 0)
    grid = np.zeros(lanes * STEPS, np.uint32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, STEPS).T)
    model = Model(alphabet)
    before = last = np.zeros(lanes, np.int64)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    # A row holds the words of the same number of all lanes, which are near each other in time.
    words, used = np.zeros((4 * STEPS + 8, lanes), np.uint16), np.zeros(lanes, np.int64)
    for step in range(STEPS if lanes > 1 else tail):
        # The last lane may end early; the others go on without it.
        live = lanes if step < tail else lanes - 1
        now = grid[step][:live].astype(np.int64)
        model.predict(before[:live], last[:live])
        kind = model.kind(now)
        mixed = model.context * 3 + kind
        unit = span[:live] >> _SHARE
        at, width = low[:live] + unit * model.starts[mixed], unit * model.shares[mixed]
        rest = np.flatnonzero(kind == 2)
        unit = width[rest] // model.cumulative[-1]
        start = model.cumulative[now[rest]]
        at[rest] += unit * start
        width[rest] = unit * (model.cumulative[now[rest] + 1] - start)
        over = np.flatnonzero(at < low[:live])
        if len(over):
            _carry(words, over, used[over] - 1)
        small = np.flatnonzero(width < _LEAST)
        while len(small):
            some = at[small]
            words[used[small], small] = some >> _TOP
            used[small] += 1
            at[small] = some << _WORD
            width[small] <<= _WORD
            small = small[width[small] < _LEAST]
        low[:live], span[:live] = at, width
        model.learn(now, mixed)
        before, last = last, now
    lane = np.arange(lanes)
    for shift in (48, 32, 16, 0):
        words[used, lane] = (low >> np.uint64(shift)) & np.uint64(0xFFFF)
        used += 1
    words = words[:used.max()].T
    filled = words[np.arange(words.shape[1]) < used[:, None]]
    return HEADER.pack(MAGIC, n, alphabet, checksum, lanes) + used.astype("<u2").tobytes() + filled.astype("<u2").tobytes()


def _carry(words: np.ndarray, lane: np.ndarray, at: np.ndarray) -> None:
    while len(lane):
        words[at, lane] += np.uint16(1)
        more = words[at, lane] == 0
        lane, at = lane[more], at[more] - 1


def decode(block: bytes) -> np.ndarray:
    """The ids of a block as uint32; raises ``ValueError`` if it is damaged."""
    magic, n, alphabet, checksum, lanes = HEADER.unpack_from(block)
    if magic != MAGIC or _lanes(n)[0] != lanes:
        raise ValueError("not a token block")
    used = np.frombuffer(block, "<u2", lanes, HEADER.size).astype(np.int64)
    words = np.frombuffer(block, "<u2", offset=HEADER.size + 2 * lanes)
    if len(words) != used.sum() or (n and used.min() < 4):
        raise ValueError("token block of a wrong length")
    ids = np.zeros(0, np.uint32)
    if n:
        tail = _lanes(n)[1]
        model = Model(alphabet)
        at = np.cumsum(used) - used
        words = np.concatenate([words, np.zeros(8, np.uint16)])
        code = np.zeros(lanes, np.uint64)
        for _ in range(4):
            code = (code << _WORD) | words[at]
            at += 1
        span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        grid = np.zeros((STEPS, lanes), np.uint32)
        before = last = np.zeros(lanes, np.int64)
        for step in range(STEPS if lanes > 1 else tail):
            live = lanes if step < tail else lanes - 1
            model.predict(before[:live], last[:live])
            unit = span[:live] >> _SHARE
            rest_code, context = code[:live], model.context
            kind = (rest_code >= unit * model.second[context]) * 1 + (rest_code >= unit * model.third[context])
            mixed = context * 3 + kind
            rest_code, width = rest_code - unit * model.starts[mixed], unit * model.shares[mixed]
            now = np.where(kind == 0, model.guess_two, model.guess_one).astype(np.int64)
            rest = np.flatnonzero(kind == 2)
            unit = width[rest] // model.cumulative[-1]
            now[rest] = found = model.find(rest_code[rest] // unit)
            start = model.cumulative[found]
            rest_code[rest] -= unit * start
            width[rest] = unit * (model.cumulative[found + 1] - start)
            small = np.flatnonzero(width < _LEAST)
            while len(small):
                rest_code[small] = (rest_code[small] << _WORD) | words.take(at[small], mode="clip")
                at[small] += 1
                width[small] <<= _WORD
                small = small[width[small] < _LEAST]
            code[:live], span[:live] = rest_code, width
            if now.max() >= alphabet or not width.all():
                raise ValueError("damaged token block")
            model.learn(now, mixed)
            grid[step, :live] = now
            before, last = last, now
        ids = grid.T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4", copy=False).tobytes()) != checksum:
        raise ValueError("token block fails its checksum")
    return ids
