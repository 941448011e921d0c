"""The ids of many words at once: each distinct word is encoded once, and found again by its bytes."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np

from .common import mix

BYTE_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class WordTable:
    """A number for each word of up to SHORT bytes, probed for many words at once; a word is known by all its bytes."""

    SHORT = 16

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.size, self.number = np.zeros(1 << bits, np.int8), np.full(1 << bits, -1, np.int32)  # size 0: a free slot

    @staticmethod
    def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last eight bytes (the last only of words longer than eight) and size of each word."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        size = ends - starts
        low = eight[starts] & BYTE_MASKS[np.minimum(size, 8)]
        high = np.where(size > 8, eight[np.maximum(ends - 8, 0)], np.uint64(0))
        return low, high, size

    def _homes(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (mix(low + mix(high + size.astype(np.uint64))) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of some words; -1 for those it does not know."""
        out, at, left = np.full(len(low), -1, np.int64), self._homes(low, high, size), np.arange(len(low))
        while len(left):
            there = self.size[at]
            hit = (self.low[at] == low[left]) & (self.high[at] == high[left]) & (there == size[left])
            out[left[hit]] = self.number[at[hit]]
            on = ~hit & (there != 0)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, number: np.ndarray) -> None:
        """Different words that it does not know yet."""
        at, left = self._homes(low, high, size), np.arange(len(low))
        while len(left):
            free = self.size[at] == 0
            slot, who = at[free], left[free]
            self.number[slot] = number[who]  # of several that want a slot one gets it
            won = np.zeros(len(left), bool)
            won[free] = self.number[slot] == number[who]
            slot, who = at[won], left[won]
            self.low[slot], self.high[slot], self.size[slot] = low[who], high[who], size[who]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)


class WordIds:
    """Texts to ids, word by word; of so many words the ids are remembered, other words are encoded for each call anew."""

    def __init__(self, ids_of: Callable[[str], list[int]], split: Callable[[str], list[str]], kind: type, remembered: int):
        self.ids_of, self.split, self.kind, self.remembered = ids_of, split, kind, remembered
        self.table, self.long = WordTable(), {}
        # The ids of word k are pool[starts[k] : starts[k + 1]].
        self.pool, self.starts = np.zeros(0, kind), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        rows = list(map(self.split, texts))
        words = list(itertools.chain.from_iterable(rows))
        if not words:
            return [np.zeros(0, self.kind)] * len(texts)
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        ends = np.cumsum(np.array(list(map(len, words)), np.int64))
        if ends[-1] < len(data):  # ends in characters to ends in bytes
            ends = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[ends]
        keys = WordTable.keys(data, np.append(0, ends[:-1]), ends)
        number = self.table.find(*keys)
        known = len(self.starts) - 1
        at = np.flatnonzero(number < 0)
        # Different unknown words are numbered as they come, so a word's first place is where the number rises.
        order: dict[str, int] = {}
        which = np.array([order.setdefault(words[k], len(order)) for k in at.tolist()], np.int64)
        own, new = [], {}
        for w in order:
            n = self.long.get(w)
            if n is None:
                n = new[w] = known + len(new)
            own.append(n)
        if order:
            own = np.array(own, np.int64)
            number[at] = own[which]
            first = at[np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))][own >= known]
        if new:
            made, sizes = [], []
            for w in new:
                made += self.ids_of(w)
                sizes.append(len(made))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.array(sizes, np.int64)])
            self.pool = np.concatenate([self.pool, np.array(made, self.kind)])
        begins = self.starts[number]
        sizes = self.starts[number + 1] - begins
        done = np.cumsum(sizes)
        ids = self.pool[np.repeat(begins - done + sizes, sizes) + np.arange(int(done[-1]))]
        if known + len(new) > self.remembered:  # the new words served this call alone
            self.pool, self.starts = self.pool[: self.starts[known]].copy(), self.starts[: known + 1].copy()
        elif new:
            short = keys[2][first] <= WordTable.SHORT
            self.table.add(*(k[first[short]] for k in keys), known + np.flatnonzero(short))
            self.long.update((w, n) for (w, n), x in zip(new.items(), short, strict=True) if not x)
        cuts = np.append(0, done)[np.cumsum([0, *map(len, rows)])]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
