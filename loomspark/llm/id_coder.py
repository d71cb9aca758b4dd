"""Adaptive context-mixing range coder for token ids, in blocks.

Each block is coded on its own: its model starts anew, and a CRC-32 of the ids guards it.  A model
predicts the next id by
- order 2: the id that lately followed the two ids before (a hashed table),
- order 1: the id that lately followed the id before,
- order 0: how often each id of the block has come, as a cumulative table over all ids seen.
How likely the id of order 2 and, failing it, that of order 1 is right depends on how often each
was right lately, on whether they agree, and on how frequent order 0 holds them for.  Each of these
views keeps an adaptive estimate; a mixer adds them in the logistic domain with weights that
learn, and what the joint context has seen so far corrects the sum.  One interval of the range coder
then codes an id whole: the order-2 id, the order-1 id, or an id by its order-0 share of what is left.
An id that the block has not seen is escaped, and 16 or 32 evenly likely bits follow.

A block is cut into lanes of equal length that share the model and are coded side by side, so a step
of the coder is a numpy call over all lanes; what the lanes of a step learn is known from the next
step on.  Estimates, weights and shares are renewed after a step at first, later after up to
EVERY steps.  All arithmetic is on integers and tables, so any machine decodes what another coded.

The range coder keeps (low, range) of 64 bits for a lane and gives out 16 bits when the range falls
below 2**32; where these are not settled by then, the larger part of the range is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 22  # ids of a block at most
LANES = 8192
LANE = 256  # ids of a lane at least, if the block has as many
EVERY = 16
BITS1, BITS2 = 16, 18  # of the tables of order 1 and order 2
SHARE = 16  # bits of the order-0 shares
SEEN = 1 << 15  # ids with an order-0 share at most; others are escaped
LEAST = 32  # of 4096, the smallest part that an outcome gets

_U = np.uint64
_TOTAL, _16, _32, _48 = _U(12 + SHARE), _U(16), _U(32), _U(48)
_BOT, _LOW48 = _U(1 << 32), _U((1 << 48) - 1)

# logistic tables in fixed point: 12-bit probabilities, domain -2047..2047 (8 bits after the point)
_x = np.arange(-2048, 2048) / 256
_SQUASH = np.clip(np.rint(4096 / (1 + np.exp(-_x))), 1, 4095).astype(np.int64)
_STRETCH = np.clip(np.searchsorted(_SQUASH, np.arange(4096)), 0, 4095).astype(np.int64) - 2048

CELLS = (8, 8, 2, 4, 4)  # confidence of order 2, of order 1, agreement, order-0 rank of either id
N_CELLS = 8 * 8 * 2 * 4 * 4


class _Mixer:
    """The probability of one outcome in each cell of CELLS, from the views of the three orders."""

    VIEWS = ((1, 3, 4), (0, 3, 4), (0, 1))  # what is summed over: order 2, order 1 and order 0 each keep their own part

    def __init__(self):
        self.hits, self.all = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
        self.weights = np.full(3, 1 << 15, np.int64)
        self.renew()

    def renew(self) -> None:
        views = []
        for axes in self.VIEWS:
            h, n = self.hits.sum(axes, keepdims=True), self.all.sum(axes, keepdims=True)
            views.append(np.broadcast_to(_STRETCH[((2 * h + 1) << 12) // (2 * n + 8)], CELLS))
        self.views = views
        dot = sum(int(w) * v for w, v in zip(self.weights, views, strict=True)) >> 16
        self.mixed = _SQUASH[np.clip(dot, -2047, 2047) + 2048]
        self.p = np.clip((self.mixed * 64 + (self.hits << 12)) // (64 + self.all), 1, 4095)

    def learn(self, hits: np.ndarray, every: np.ndarray) -> None:
        """Take in the numbers of outcomes in each cell."""
        hits, every = hits.reshape(CELLS), every.reshape(CELLS)
        wrong = (hits << 12) - every * self.mixed
        n = int(every.sum())
        if n:
            for i, v in enumerate(self.views):
                step = int((wrong * v).sum()) // n >> 2
                self.weights[i] = min(max(int(self.weights[i]) + step, 0), 1 << 17)
        self.hits += hits
        self.all += every
        if self.all.max() > 1 << 16:
            self.hits >>= 1
            self.all >>= 1
        self.renew()


#: What becomes of an entry's confidence: [it was wrong, it was right] by confidence; entries below 2 give way when wrong.
_CHANGE = np.array([[0, 1], [0, 1], [-2, 1], [-2, 1], [-2, 1], [-2, 1], [-2, 1], [-2, 0]], np.int64).ravel()
_STAYS = np.array([[False, True], [False, True]] + [[True, True]] * 6).ravel()


class _Model:
    """What is known before a step; ids are numbers in order of first appearance, from 1, and 0 is an unseen one.

    An entry of a table is an id times 8 and the confidence in it; -8 is none.
    """

    def __init__(self, lanes: int):
        self.t1, self.t2 = np.full(1 << BITS1, -8), np.full(1 << BITS2, -8)
        self.p1, self.p2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.hit2, self.hit1 = _Mixer(), _Mixer()
        self.known = 1
        self.count, self.rank = np.ones(1024, np.int64), np.zeros(1025, np.int64)
        self.waiting: list[np.ndarray] = []
        self.missed: list[np.ndarray] = []
        self.steps, self.next = 0, 1
        self._renew()

    def _renew(self) -> None:
        """Shares, ranks and parts for the next steps."""
        n = min(self.known, SEEN)
        count = self.count[:n]
        f = 1 + count * ((1 << SHARE) - n) // int(count.sum())
        f[: (1 << SHARE) - int(f.sum())] += 1
        self.sizes, self.f, self.cum = f, f.astype(_U), (np.cumsum(f) - f).astype(_U)
        self.rank[:n] = np.minimum(np.searchsorted([32, 256, 1024], f, "right"), 3)
        a = np.clip(self.hit2.p, LEAST, 4096 - 2 * LEAST)
        b = np.clip((4096 - a) * self.hit1.p >> 12, LEAST, 4096 - LEAST - a)
        b[:, :, 1] = 0
        a, b = a.ravel(), b.ravel()
        self.rest = (4096 - a - b).astype(_U)
        self.a, self.b, self.ab = (x.astype(_U) << _U(SHARE) for x in (a, b, a + b))
        self.slots = None

    def predict(self) -> np.ndarray:
        """Set the ids of order 2 and 1; the cell of each lane."""
        self.i1 = self.p1 & ((1 << BITS1) - 1)
        i2 = self.p2 * 40503
        i2 += self.p1 * 7919
        i2 &= (1 << BITS2) - 1
        self.i2 = i2
        e2, e1 = self.t2[i2], self.t1[self.i1]
        self.e2, self.e1 = e2, e1
        self.g2, self.g1 = e2 >> 3, e1 >> 3
        self.c2, self.c1 = e2 & 7, e1 & 7
        cell = self.c2 << 3
        cell |= self.c1
        cell <<= 1
        cell += self.g2 == self.g1
        cell <<= 2
        cell |= self.rank[self.g2]
        cell <<= 2
        cell |= self.rank[self.g1]
        self.cell = cell
        return cell

    def learn(self, x: np.ndarray, is2: np.ndarray, is1: np.ndarray, missed: np.ndarray) -> None:
        """Take in the ids; one that was predicted stays while it is often right.

        is1: the order-1 id is right and not that of order 2.  missed: the numbers that order 0 coded.
        """
        key = self.cell << 2
        key += is2
        key[is1] += 2
        self.waiting.append(key)
        self.missed.append(missed)
        fresh = x << 3
        for t, i, e, conf, right in ((self.t2, self.i2, self.e2, self.c2, is2), (self.t1, self.i1, self.e1, self.c1, self.g1 == x)):
            conf <<= 1
            conf += right
            e += _CHANGE[conf]
            t[i] = np.where(_STAYS[conf], e, fresh)
        self.p2, self.p1 = self.p1, x
        self.steps += 1
        if self.steps == self.next:
            self.next += min(max(1, self.steps // 4), EVERY)
            cells = np.bincount(np.concatenate(self.waiting), minlength=4 * N_CELLS).reshape(N_CELLS, 4)
            self.count[: self.known] += 16 * np.bincount(np.concatenate(self.missed), minlength=self.known)
            every = cells.sum(1)
            self.hit2.learn(cells[:, 1], every)
            apart = (every - cells[:, 1]).reshape(CELLS).copy()
            apart[:, :, 1] = 0
            self.hit1.learn(cells[:, 2], apart)
            self.waiting, self.missed = [], []
            self._renew()

    def room(self, more: int) -> int:
        """Number ``more`` new ids; the first number."""
        first = self.known
        self.known += more
        if self.known > len(self.count):
            self.count = np.append(self.count, np.ones(self.known, np.int64))
            self.rank = np.append(self.rank, np.zeros(len(self.count) + 1 - len(self.rank), np.int64))
        return first

    def by_slot(self) -> np.ndarray:
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return self.slots

    def seen(self, x: np.ndarray) -> np.ndarray:
        """The numbers that have a share; 0 for others."""
        return x if self.known <= len(self.f) else np.where(x < len(self.f), x, 0)

    def intervals(self, cell: np.ndarray, coded: np.ndarray, is2: np.ndarray, hit: np.ndarray, rest: np.ndarray, ab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each lane's outcome starts and its size; hit: the lanes that order 2 or 1 was right in."""
        start = self.cum[coded]
        start *= rest
        start += ab
        size = self.f[coded]
        size *= rest
        own, first = cell[hit], is2[hit]
        a = self.a[own]
        start[hit] = np.where(first, _U(0), a)
        size[hit] = np.where(first, a, self.b[own])
        return start, size

    def narrow(self, lanes: int) -> None:
        self.p1, self.p2 = self.p1[:lanes], self.p2[:lanes]


class _Coder:
    """low and range of all lanes."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)

    def take(self, start: np.ndarray, size: np.ndarray, r: np.ndarray, k: np.ndarray | slice) -> None:
        self.low[k] += start * r
        self.range[k] = size * r
        self._settle(k)

    def _settle(self, k: np.ndarray | slice) -> None:
        k = np.flatnonzero(self.range < _BOT) if isinstance(k, slice) else k[self.range[k] < _BOT]
        while len(k):
            low, size = self.low[k], self.range[k]
            upto = (_LOW48 + _U(1)) - (low & _LOW48)
            split = np.flatnonzero(size > upto)
            if len(split):
                over = size[split] - upto[split]
                right = over > upto[split]
                low[split] += np.where(right, upto[split], _U(0))
                size[split] = np.where(right, over, upto[split])
            self._shift(k, low)
            self.low[k] = low << _16
            size <<= _16
            self.range[k] = size
            k = k[size < _BOT]


class _Out(_Coder):
    def __init__(self, lanes: int, steps: int):
        super().__init__(lanes)
        self.words, self.at = np.zeros((lanes, steps + 64), np.uint16), np.zeros(lanes, np.int64)

    def _shift(self, k: np.ndarray, low: np.ndarray) -> None:
        at = self.at[k]
        if int(at.max()) + 4 >= self.words.shape[1]:
            self.words = np.pad(self.words, ((0, 0), (0, self.words.shape[1])))
        self.words[k, at] = low >> _48
        self.at[k] = at + 1

    def narrow(self, lanes: int) -> None:
        self.rest = self.low[lanes:].copy()
        self.low, self.range = self.low[:lanes], self.range[:lanes]

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of all lanes in order, and their numbers: 32 more bits tell a lane's range apart."""
        low = np.concatenate([self.low, getattr(self, "rest", np.zeros(0, _U))])
        last = low + (_BOT - _U(1)) >> _32
        k = np.arange(len(low))
        if int(self.at.max()) + 2 > self.words.shape[1]:
            self.words = np.pad(self.words, ((0, 0), (0, 2)))
        self.words[k, self.at] = last >> _16
        self.words[k, self.at + 1] = last & _U(0xFFFF)
        self.at += 2
        return self.words[np.arange(self.words.shape[1]) < self.at[:, None]], self.at


class _In(_Coder):
    def __init__(self, words: np.ndarray, count: np.ndarray):
        super().__init__(len(count))
        n = len(count)
        self.words = np.zeros((n, int(count.max()) + 4), np.uint16)
        self.words[np.arange(self.words.shape[1]) < count[:, None]] = words
        first = self.words[:, :4].astype(_U)
        self.code = (first[:, 0] << _48) | (first[:, 1] << _32) | (first[:, 2] << _16) | first[:, 3]
        self.at = np.full(n, 4)

    def _shift(self, k: np.ndarray, low: np.ndarray) -> None:
        at = self.at[k]
        self.code[k] = (self.code[k] << _16) | self.words[k, np.minimum(at, self.words.shape[1] - 1)]
        self.at[k] = at + 1

    def narrow(self, lanes: int) -> None:
        self.low, self.range, self.code, self.at = self.low[:lanes], self.range[:lanes], self.code[:lanes], self.at[:lanes]


def _shape(n: int) -> tuple[int, int, int]:
    """Lanes, steps and the length of the last lane."""
    steps = -(-n // min(max(n // LANE, 1), LANES))
    lanes = -(-n // steps)
    return lanes, steps, n - steps * (lanes - 1)


ALL = slice(None)

#: Number of ids, CRC-32 of the ids as little-endian 32-bit integers, bits of an escaped id, number of words of each lane, words.
Block = tuple[int, int, int, bytes, bytes]


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and the place of each id among them."""
    most = int(ids.max())
    if most >= 1 << 22:
        return np.unique(ids, return_inverse=True)
    have = np.zeros(most + 1, bool)
    have[ids] = True
    return np.flatnonzero(have), (np.cumsum(have, dtype=np.int32) - 1)[ids]


def encode_block(ids: np.ndarray) -> Block:
    ids = np.ascontiguousarray(ids, "<u4")
    lanes, steps, last = _shape(len(ids))
    values, where = _numbered(ids)
    bits = 16 if int(values[-1]) < 1 << 16 else 32
    grid = np.zeros((lanes, steps), np.int32)
    grid.ravel()[: len(ids)] = where
    columns = np.ascontiguousarray(grid.T)
    number = np.zeros(len(values), np.int64)
    model, coder = _Model(lanes), _Out(lanes, steps)
    for s in range(steps):
        if s == last:
            model.narrow(lanes - 1)
            coder.narrow(lanes - 1)
        own = columns[s, : len(coder.low)].astype(np.int64)
        x = number[own]
        cell = model.predict()
        is2, is1 = model.g2 == x, model.g1 == x
        is1 &= ~is2
        missed = ~(is2 | is1)
        coded = model.seen(x)
        coder.take(*model.intervals(cell, coded, is2, np.flatnonzero(~missed), model.rest[cell], model.ab[cell]), coder.range >> _TOTAL, ALL)
        by_share = coded[missed]
        if not by_share.all():
            out = np.flatnonzero(missed & (coded == 0))
            raw = values[own[out]].astype(_U)
            for shift in range(bits - 16, -1, -16):
                coder.take((raw >> _U(shift)) & _U(0xFFFF), _U(1), coder.range[out] >> _16, out)
            new = np.unique(own[out][x[out] == 0])
            number[new] = model.room(len(new)) + np.arange(len(new))
            x[out] = number[own[out]]
        model.learn(x, is2, is1, by_share)
    words, count = coder.finish()
    return len(ids), zlib.crc32(ids), bits, count.astype("<u2").tobytes(), words.astype("<u2").tobytes()


def decode_block(block: Block) -> np.ndarray:
    """The ids; ValueError if the checksum is wrong or the block makes no sense."""
    n, crc, bits, count, words = block
    lanes, steps, last = _shape(n)
    count, words = np.frombuffer(count, "<u2").astype(np.int64), np.frombuffer(words, "<u2")
    if len(count) != lanes or int(count.sum()) != len(words):
        raise ValueError("a block is damaged")
    model, coder = _Model(lanes), _In(words, count)
    columns = np.zeros((steps, lanes), np.int32)
    values = np.zeros(1, np.uint32)
    numbers: dict[int, int] = {}
    most = _U((1 << 12 + SHARE) - 1)
    for s in range(steps):
        if s == last:
            model.narrow(lanes - 1)
            coder.narrow(lanes - 1)
        cell = model.predict()
        ab, rest = model.ab[cell], model.rest[cell]
        r = coder.range >> _TOTAL
        v = coder.code - coder.low
        v //= r
        np.minimum(v, most, out=v)
        is2, missed = v < model.a[cell], v >= ab
        hit = np.flatnonzero(~missed)
        is1 = ~(is2 | missed)
        slot = (v - ab).astype(np.float64)
        slot /= rest  # exact: below 2**28 over at most 2**12, so no quotient rounds up to a whole number
        slot[hit] = 0
        coded = model.by_slot()[slot.astype(np.int64)]
        x = coded.copy()
        x[hit] = np.where(is2[hit], model.g2[hit], model.g1[hit])
        coder.take(*model.intervals(cell, coded, is2, hit, rest, ab), r, ALL)
        by_share = coded[missed]
        if not by_share.all():
            out = np.flatnonzero(missed & (coded == 0))
            raw = np.zeros(len(out), np.int64)
            for _ in range(bits // 16):
                r = coder.range[out] >> _16
                half = np.minimum((coder.code[out] - coder.low[out]) // r, _U(0xFFFF))
                coder.take(half, _U(1), r, out)
                raw = (raw << 16) | half.astype(np.int64)
            new = [i for i in np.unique(raw).tolist() if i not in numbers]
            first = model.room(len(new))
            numbers.update(zip(new, range(first, first + len(new)), strict=True))
            values = np.append(values, np.array(new, np.uint32))
            x[out] = [numbers[i] for i in raw.tolist()]
        model.learn(x, is2, is1, by_share)
        columns[s, : len(x)] = x
    ids = values[np.ascontiguousarray(columns.T).ravel()[:n]].astype("<u4")
    if zlib.crc32(ids) != crc:
        raise ValueError("a block is damaged")
    return ids


def encode_blocks(ids: np.ndarray) -> Iterator[Block]:
    for a in range(0, len(ids), BLOCK):
        yield encode_block(ids[a : a + BLOCK])
