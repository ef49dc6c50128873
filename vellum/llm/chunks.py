"""Vectorised byte runs: words of many texts as 128-bit hashes, and a numpy table that numbers them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from vellum.llm.common import mix64

_rng = np.random.default_rng(20240611)  # any fixed seed: the hash must be the same in every task
_BYTE_VALUES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = (_rng.integers(0, 1 << 61, 2, dtype=np.uint64) << np.uint64(3)) | np.uint64(5)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """Powers of the two bases and of their inverses modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.down = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def need(self, n: int) -> None:
        for k in (0, 1):
            base = int(_BASES[k])
            for store, b in ((self.up, base), (self.down, _inverse(base))):
                while len(store[k]) < n:
                    step = np.uint64(pow(b, len(store[k]), 1 << 64))
                    store[k] = np.concatenate([store[k], store[k] * step])


_POWERS = _Powers()


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int = 2) -> list[np.ndarray]:
    """``lanes`` independent 64-bit hashes of each non-empty byte run ``data[start:end]``; runs are
    in order and do not overlap. Equal runs have equal hashes wherever they stand."""
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in range(lanes)]
    _POWERS.need(len(data) + 1)
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[::2], cuts[1::2] = starts, ends
    out = []
    length = (ends - starts).astype(np.uint64)
    for k in range(lanes):
        weighted = np.zeros(len(data) + 1, np.uint64)
        np.multiply(_BYTE_VALUES[k][data], _POWERS.up[k][: len(data)], out=weighted[:-1])
        total = np.add.reduceat(weighted, cuts)[::2] * _POWERS.down[k][starts]
        out.append(mix64(total + length))
    return out


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array with a newline after each, and the start of each text (one more
    start than texts)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return data, np.concatenate([[0], np.cumsum(sizes)])


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


class KeyTable:
    """Numbers 128-bit keys 0, 1, 2, ... in an open-addressing numpy table; all calls are batched."""

    def __init__(self, bits: int = 16) -> None:
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.bits, self.count = bits, 0
        self.key = np.zeros(1 << bits, np.uint64)
        self.check = np.zeros(1 << bits, np.uint64)
        self.number = np.full(1 << bits, -1, np.int64)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        mask = np.int64((1 << self.bits) - 1)
        at = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        number = self.number[at]
        same = (self.key[at] == key) & (self.check[at] == check)
        out = np.where(same, number, -1)
        open_ = np.flatnonzero(~same & (number >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            slot = at[open_]
            number = self.number[slot]
            same = (self.key[slot] == key[open_]) & (self.check[slot] == check[open_]) & (number >= 0)
            out[open_[same]] = number[same]
            open_ = open_[~same & (number >= 0)]
        return out

    def _place(self, key: np.ndarray, check: np.ndarray, number: np.ndarray) -> None:
        mask = np.int64((1 << self.bits) - 1)
        at = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            free = self.number[at[left]] < 0
            claim = left[free]
            self.number[at[claim]] = number[claim]  # of several on one slot the last one stays
            won = claim[self.number[at[claim]] == number[claim]]
            self.key[at[won]], self.check[at[won]] = key[won], check[won]
            lost = np.ones(len(key), bool)
            lost[won] = False
            left = left[lost[left]]
            at[left] = (at[left] + 1) & mask

    def add(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Numbers for distinct new keys, in their order."""
        if 2 * (self.count + len(key)) > len(self.key):
            used = np.flatnonzero(self.number >= 0)
            old = self.key[used], self.check[used], self.number[used]
            bits = max(self.bits + 1, int(4 * (self.count + len(key))).bit_length())
            count = self.count
            self.clear(bits)
            self._place(*old)
            self.count = count
        number = np.arange(self.count, self.count + len(key))
        self._place(key, check, number)
        self.count += len(key)
        return number

    def number_all(self, key: np.ndarray, check: np.ndarray, new: Callable[[np.ndarray], None]) -> np.ndarray:
        """The number of every key; ``new`` is called once with the places of the first occurrences
        of unknown keys, in number order."""
        out = self.find(key, check)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            _, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
            places = missing[first]
            number = self.add(key[places], check[places])
            new(places)
            out[missing] = number[back]
        return out
