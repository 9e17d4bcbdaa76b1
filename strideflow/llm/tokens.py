"""Token ids of whole texts: distinct word units are encoded once per worker and looked up after that."""

from __future__ import annotations

import sys
from itertools import repeat
from types import ModuleType

import numpy as np
import pyarrow as pa

from .common import SPACE, column_bytes, lower_ascii, pick_bytes, word_bounds

#: Distinct units a worker remembers; beyond that it starts anew.
REMEMBERED = 1_000_000
ENCODE_AT_ONCE = 4096

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION = np.zeros(256, bool)
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _PUNCTUATION[_a:_b] = True

#: What a byte is, as bits: white space or a separator, a letter, punctuation, white space that opens a unit.
_BLANK, _ALPHA, _SIGN, _OPENS = 1, 2, 4, 8
_KINDS = (
    (SPACE | np.isin(np.arange(256), (28, 29, 30, 31))) * _BLANK + _LETTER * _ALPHA + _PUNCTUATION * _SIGN + np.isin(np.arange(256), (9, 10, 13, 32)) * _OPENS
).astype(np.uint8).tobytes()

def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: visible ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = np.array([ord(c) for _, c in sorted(_byte_letters().items())], "<u2")


class UnitEncoder:
    """Ids of a byte-pair tokenizer whose pre-tokenizer is the usual letters / digits / rest pattern.

    No token of such a tokenizer spans a cut in front of white space that follows a visible character,
    nor one between a letter and the punctuation after it.  So a text is cut there, equal units are
    encoded once, and the ids are joined again.  ``drops_space`` says that the pre-tokenizer discards white
    space (it is left out of the units then) and lower-cases.  A text that holds one of the tokenizer's
    added tokens is a unit of its own.
    """

    def __init__(self, path: str, drops_space: bool, end_id: int):
        import tokenizers

        self.end_id = end_id
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.drops_space = drops_space
        self.added = [str(x.content).encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        #: Place of every known unit; it has the ids from ``edges[place]`` on.  Place 0 is the id behind each text.
        self.known: dict[bytes | None, int] = {None: 0}
        self.ids = np.zeros(1 << 20, np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32)
        self.edges = np.zeros(1 << 18, np.int64)
        self.ids[0], self.edges[1] = self.end_id, 1

    def _plain(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which units are one word or (where space is kept: with one space in front) one word or one run of punctuation."""
        kinds = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
        if self.drops_space:
            alpha, lowest, gap = (data >= 97) & (data <= 122), 0x9F, 0xB7
        else:
            alpha, lowest, gap = (kinds & _ALPHA) > 0, 0x80, 0x97
        second = (data >= lowest) & (data <= 0xBF) & (data != gap) & (data != 0xB7)
        pair = np.concatenate([data[:-1] == 0xC3, [False]]) & np.concatenate([second[1:], [False]])
        alpha |= pair | np.concatenate([[False], pair[:-1]])
        first = starts[:-1]
        size = np.diff(starts)
        if self.drops_space:
            return np.add.reduceat(alpha, first, dtype=np.int64) == size
        size = size - (data[first] == 32)
        signs = np.add.reduceat((kinds & _SIGN) > 0, first, dtype=np.int64)
        return (size > 0) & ((np.add.reduceat(alpha, first, dtype=np.int64) == size) | (signs == size))

    def _learn(self, units: list[bytes]) -> None:
        """Encode units that are not known yet."""
        merge = self.tokenizer.model.tokenize
        starts = np.zeros(len(units) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, units), np.int64, len(units)), out=starts[1:])
        data = np.frombuffer(b"".join(units), np.uint8)
        plain = self._plain(data, starts)
        order = np.argsort(~plain, kind="stable")
        # one pre-token each: the merges can run at once
        letters = _BYTE_LETTERS[data].tobytes().decode("utf-16-le")
        words = [letters[a:b] for a, b in zip(starts[:-1][plain].tolist(), starts[1:][plain].tolist())]
        units = [units[i] for i in order.tolist()]
        for first in range(0, len(units), ENCODE_AT_ONCE):
            some = units[first : first + ENCODE_AT_ONCE]
            merged = max(0, min(len(some), len(words) - first))
            ids, sizes = [], []
            for tokens in map(merge, words[first : first + merged]):
                sizes.append(len(tokens))
                ids += [t.id for t in tokens]
            for x in self.tokenizer.encode_batch_fast([u.decode("utf-8", "replace") for u in some[merged:]], add_special_tokens=False):
                sizes.append(len(x.ids))
                ids += x.ids
            known = len(self.known)
            if known + len(some) + 1 > len(self.edges):
                self.edges = np.concatenate([self.edges, np.zeros_like(self.edges)])
            self.edges[known + 1 : known + len(some) + 1] = self.edges[known] + np.cumsum(sizes)
            end = int(self.edges[known + len(some)])
            while end > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.edges[known] : end] = ids
            self.known.update(zip(some, range(known, known + len(some))))

    def _places(self, words: pa.Array) -> np.ndarray:
        """Place of each distinct unit; new ones are learned, after all were forgotten if there are too many."""
        data, starts = column_bytes(words)
        raw, edges = data.tobytes(), starts.tolist()
        units = [raw[a:b] for a, b in zip(edges, edges[1:])]
        places = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(places < 0)
        if len(self.known) + len(new) > REMEMBERED:
            self._reset()
            new = np.arange(len(units))
        if len(new):
            missing = [units[i] for i in new.tolist()]
            self._learn(missing)
            places[new] = np.fromiter(map(self.known.__getitem__, missing), np.int64, len(missing))
        return places

    def _units(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of every unit."""
        whole = np.zeros(len(starts) - 1, bool)
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                whole[np.searchsorted(starts, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        kinds = np.frombuffer(raw.translate(_KINDS), np.uint8)
        if self.drops_space:
            first, last = word_bounds(data, starts)
            cuts = np.zeros(len(data) + 1, bool)
            cuts[first] = True
            opens, inside = cuts, ~SPACE[data]
        else:
            opens, inside = np.zeros(len(data) + 1, bool), np.ones(len(data), bool)
            opens[starts[:-1][np.diff(starts) > 0]] = True
        if len(data) > 1:
            before, before2 = data[:-1], np.concatenate([np.zeros(1, np.uint8), data[:-2]])
            if not self.drops_space:
                hidden = (kinds[:-1] & _BLANK).view(bool) | ((before2 == 0xC2) & ((before == 0x85) | (before == 0xA0)))
                hidden |= (before >= 128) & ((before2 == 0x9A) | (before2 == 0x80) | (before2 == 0x81))
                opens[1:-1] |= ((kinds[1:] & _OPENS) > 0) & ~hidden
            letter = ((kinds[:-1] & _ALPHA) > 0) | ((before2 == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
            opens[1:-1] |= letter & ((kinds[1:] & _SIGN) > 0)
            if not self.drops_space:  # a single line end between a visible character and a letter is a token
                single = opens[1:-2] & (data[1:-1] == 10) & (((kinds[2:] & _ALPHA) > 0) | (data[2:] == 0xC3))
                opens[2:-1] |= single
        if whole.any():
            for i in np.flatnonzero(whole):
                opens[starts[i] : starts[i + 1]] = False
                inside[starts[i] : starts[i + 1]] = True
                opens[starts[i]] = True
        first = np.flatnonzero(opens[:-1] & inside)
        last = np.concatenate([first[1:], [len(data)]]).astype(np.int64) if len(first) else first
        if self.drops_space and len(first):
            solid = np.concatenate([[0], np.cumsum(inside)])
            # a unit ends where the white space behind it begins
            nxt = np.searchsorted(solid, solid[last], "left")
            last = nxt
        return first, last

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and the bounds of the texts in them."""
        data, starts = column_bytes(texts)
        first, last = self._units(data, starts)
        shown = _lowered(data) if self.drops_space and not self._has_added(data) else data
        coded = pick_bytes(shown, first, last).dictionary_encode()
        slots = self._places(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        units = np.searchsorted(first, starts)
        texts_n = len(starts) - 1
        order = np.zeros(len(codes) + texts_n, np.int64)
        ends = units[1:] + np.arange(texts_n)
        held = np.ones(len(order), bool)
        held[ends] = False
        if len(codes):
            order[held] = slots[codes]
        sizes = (self.edges[1:] - self.edges[:-1])[order]
        upto = np.zeros(len(order) + 1, np.int64)
        np.cumsum(sizes, out=upto[1:])
        bounds = np.concatenate([[0], upto[ends + 1]])
        at = np.repeat(self.edges[order] - upto[:-1], sizes)
        at += np.arange(len(at))
        return self.ids[at], bounds

    def _has_added(self, data: np.ndarray) -> bool:
        raw = data.tobytes()
        return any(token in raw for token in self.added)


def _lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case; the tokenizer lowers the others itself."""
    out = lower_ascii(data)
    if len(out) > 1:
        out[1:] += np.where((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97), 32, 0).astype(np.uint8)
    return out


def encoder(path: str, drops_space: bool, end_id: int) -> UnitEncoder:
    """The encoder of this worker.

    Functions of this package reach a worker by value, each task with module variables of its own; what the next
    task shall find hangs on a module that lives as long as the process.
    """
    kept = sys.modules.setdefault("_strideflow_encoders", ModuleType("_strideflow_encoders")).__dict__
    key = f"{path} {drops_space} {end_id}"
    if key not in kept:
        kept[key] = UnitEncoder(path, drops_space, end_id)
    return kept[key]
