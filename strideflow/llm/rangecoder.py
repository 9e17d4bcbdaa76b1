"""Adaptive range coder for token ids: order-0 to order-2 predictions, in blocks that stand alone.

A block lays its ids in lanes of ``LANE`` ids that are coded side by side; the model belongs to the block
and learns after each step from the ids of all lanes.  A step codes for every lane whether the id is the
one last seen behind the same two ids (order 2), or behind the same id (order 1), or neither.  How much of
the range each answer gets is learned for every mix of the two predictions' confidences.  Ids that neither
foretold are coded by their frequency in the block so far (order 0).
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
LANE = 256
#: Steps between two renewals of the order-0 table; the first ones come sooner.
RENEW = 16

_U = np.uint64
_TOP, _WORD, _LOW = _U(1 << 48), _U(16), _U((1 << 48) - 1)
_SLOTS = 18
_TURN = 16  # steps of all lanes that are laid out at once
_HASH1, _HASH2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_UNIT = 16  # bits of the range that the first answer divides
_FULL = _U(0xFFFFFFFFFFFFFFFF)


class _Model:
    """What the lanes have learned; a prediction and its confidence (0 to 3) share one number."""

    def __init__(self, vocabulary: int, lanes: int):
        self.vocabulary = vocabulary
        self.order2, self.order1 = np.zeros(1 << _SLOTS, np.int32), np.zeros(vocabulary, np.int32)
        self.answers = np.ones((32, 3), np.int64)
        self.answers[:, 2] = 2
        self.counts = np.zeros(vocabulary, np.int64)
        self.before1, self.before2 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.bits = max(19, int(vocabulary).bit_length() + 3)
        self.waiting: list[np.ndarray] = []
        self.steps = 0
        # the place behind the last id stands for no id: all of the range
        self.upto, self.shares = np.zeros(vocabulary + 1, np.uint32), np.ones(vocabulary + 1, np.uint32)
        self._renew()

    def _renew(self) -> None:
        """Shares of ``2 ** bits`` for all ids: 1 for each, the rest by occurrences so far."""
        room, seen = (1 << self.bits) - self.vocabulary, 0
        if self.waiting:
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=self.vocabulary)
            self.waiting, seen = [], int(self.counts.sum())
        self.shares[:-1] = (self.counts * ((room << 24) // seen) >> 24) + 1 if seen else (1 << self.bits) // self.vocabulary
        np.cumsum(self.shares[:-2], out=self.upto[1:-1])
        self._at = None

    def at(self) -> np.ndarray:
        """The id of every share, for decoding; the few shares that rounding leaves are never coded."""
        if self._at is None:
            self._at = np.repeat(np.arange(self.vocabulary, dtype=np.uint16 if self.vocabulary <= 65536 else np.int32), self.shares[:-1])
        return self._at

    def predict(self, lanes: int) -> None:
        """Predicted ids ``p2`` and ``p1`` of order 2 and 1, and the places of their confidences in the tables of :meth:`ranges`."""
        last = self.before1[:lanes]
        slot = (last.view(np.uint32) * _HASH1 + self.before2[:lanes].view(np.uint32) * _HASH2) >> np.uint32(32 - _SLOTS)
        self.slot, self.c1 = slot.astype(np.int64), last.astype(np.int64)
        self.packed2, self.packed1 = self.order2.take(self.slot), self.order1.take(self.c1)
        self.p2, self.p1 = self.packed2 >> 2, self.packed1 >> 2
        self.sure2, self.sure1 = self.packed2 & 3, self.packed1 & 3
        self.cell = (self.sure2 * 12 + self.sure1 * 3 + (self.p1 == self.p2).astype(np.int32) * 48).astype(np.int64)

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of every answer's range by cell: confidences and answer."""
        width = np.empty((32, 3), np.int64)
        width[:, :2] = self.answers[:, :2] * ((1 << _UNIT) - 3) // self.answers.sum(axis=1, keepdims=True) + 1
        width[:, 2] = (1 << _UNIT) - width[:, 0] - width[:, 1]
        return (np.cumsum(width, axis=1) - width).reshape(-1).astype(_U), width.reshape(-1).astype(_U)

    def learn(self, ids: np.ndarray, cell: np.ndarray) -> None:
        """``cell``: that of the answers."""
        lanes = len(ids)
        self.answers += 2 * np.bincount(cell, minlength=96).reshape(32, 3)
        fresh = ids << 2
        for table, at, packed, foretold, sure in ((self.order2, self.slot, self.packed2, self.p2, self.sure2), (self.order1, self.c1, self.packed1, self.p1, self.sure1)):
            missed = np.where(sure == 0, fresh, packed - 1)
            table[at] = np.where(foretold == ids, np.minimum(packed + 1, packed | 3), missed)
        self.waiting.append(ids)
        self.steps += 1
        if self.steps % RENEW == 0 or self.steps in (1, 2, 4, 8):
            self._renew()
        self.before2[:lanes] = self.c1
        self.before1[:lanes] = ids


def _shape(count: int) -> tuple[int, np.ndarray]:
    """Lanes, and how many of them take part in each step: all, but the last lane may be shorter."""
    lanes = max(1, -(-count // LANE))
    short = count - (lanes - 1) * LANE
    steps = np.full(min(count, LANE), lanes)
    steps[short:] -= 1
    return lanes, steps


class _Ranges:
    """One range (low, span) a lane; ``move`` passes on the lanes whose top word is settled.

    A span is at least 2**48 between ids, so an answer and an id can be coded one after the other.  A span
    that gets smaller across a border of the top word is cut at that border; no carry is ever needed.
    """

    def __init__(self, lanes: int):
        self.low, self.span = np.zeros(lanes, _U), np.full(lanes, _FULL, _U)

    def narrow(self, n: int, unit: np.ndarray, begin: np.ndarray, width: np.ndarray) -> None:
        self.low[:n] += unit * begin
        np.multiply(unit, width, out=self.span[:n])

    def settle(self, n: int, move) -> None:
        live = np.flatnonzero(self.span[:n] < _TOP)
        while len(live):
            low, span = self.low.take(live), self.span.take(live)
            across = (low ^ (low + span)) >= _TOP
            span = np.where(across, (~low + _U(1)) & _LOW, span)
            move(live, low)
            span <<= _WORD
            self.low[live], self.span[live] = low << _WORD, span
            live = live[span < _TOP]


def encode(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of 16 bits of all lanes, one lane behind the other, and their number in each lane."""
    lanes, steps = _shape(len(ids))
    table = np.zeros(lanes * LANE, np.int32)
    table[: len(ids)] = ids
    table = table.reshape(lanes, LANE)
    model, ranges = _Model(vocabulary, lanes), _Ranges(lanes)
    owners, words = [], []
    kind = np.uint16 if lanes <= 1 << 16 else np.int64

    def put(live: np.ndarray, low: np.ndarray) -> None:
        owners.append(live.astype(kind))
        words.append((low >> _U(48)).astype(np.uint16))

    for step, n in enumerate(steps):
        if step % _TURN == 0:
            columns = np.ascontiguousarray(table[:, step : step + _TURN].T)
        x = columns[step % _TURN, :n]
        model.predict(n)
        begin, width = model.ranges()
        missed = x != model.p2
        answer = missed + (missed & (x != model.p1)).view(np.int8)
        cell = model.cell + answer
        ranges.narrow(n, ranges.span[:n] >> _U(_UNIT), begin.take(cell), width.take(cell))
        neither = answer == 2
        coded = np.where(neither, x, vocabulary)
        ranges.narrow(n, ranges.span[:n] >> (neither * _U(model.bits)), model.upto.take(coded), model.shares.take(coded))
        ranges.settle(n, put)
        model.learn(x, cell)
    # a multiple of 2**48 lies in every range, or its begin is one
    put(np.arange(lanes), np.where(ranges.low == 0, _U(0), ranges.low + _LOW))
    owner = np.concatenate(owners)
    return np.concatenate(words)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=lanes)


def decode(words: np.ndarray, used: np.ndarray, count: int, vocabulary: int) -> np.ndarray:
    """The ids that ``encode`` was given."""
    lanes, steps = _shape(count)
    at = np.cumsum(used) - used
    end = at + used
    words = np.append(words, np.uint16(0)).astype(np.uint16)
    model, ranges, code = _Model(vocabulary, lanes), _Ranges(lanes), np.zeros(lanes, _U)

    def fetch(live: np.ndarray, _: object) -> None:
        places = at.take(live)
        code[live] = code.take(live) << _WORD | words.take(places, mode="clip") * (places < end.take(live))
        at[live] = places + 1

    for _ in range(4):
        fetch(np.arange(lanes), None)
    out, turn = np.zeros((lanes, LANE), np.int32), np.zeros((_TURN, lanes), np.int32)
    for step, n in enumerate(steps):
        model.predict(n)
        begin, width = model.ranges()
        unit, over = ranges.span[:n] >> _U(_UNIT), code[:n] - ranges.low[:n]
        answer = (over >= begin.take(model.cell + 1) * unit).view(np.int8) + (over >= begin.take(model.cell + 2) * unit).view(np.int8)
        cell = model.cell + answer
        ranges.narrow(n, unit, begin.take(cell), width.take(cell))
        neither = answer == 2
        x = np.where(answer == 0, model.p2, model.p1)
        missed = np.flatnonzero(neither)
        value = (code.take(missed) - ranges.low.take(missed)) // (ranges.span.take(missed) >> _U(model.bits))
        x[missed] = model.at().take(value.astype(np.int64), mode="clip")
        coded = np.where(neither, x, vocabulary)
        ranges.narrow(n, ranges.span[:n] >> (neither * _U(model.bits)), model.upto.take(coded), model.shares.take(coded))
        ranges.settle(n, fetch)
        model.learn(x, cell)
        turn[step % _TURN, :n] = x
        if (step + 1) % _TURN == 0 or step + 1 == len(steps):
            out[:, step - step % _TURN : step + 1] = turn[: step % _TURN + 1].T
    return out.reshape(-1)[:count]
