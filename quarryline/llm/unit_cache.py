"""Encoding by units: texts cut where no token can cross, each distinct unit encoded once per worker process."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np

#: Units that a worker keeps at most; then it starts afresh, which costs time and changes no result.
KEEP = 1_200_000


class UnitCache:
    """encode(units) gives all their ids in a row, and how many each has."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep: int = KEEP):
        self.encode, self.keep = encode, keep
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint16)
        self.ends = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, units: list[str]) -> None:
        ids, counts = self.encode(units)
        first = len(self.place)
        if len(ids) and ids.max() > np.iinfo(self.ids.dtype).max:
            self.ids = self.ids.astype(np.uint32)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), self.ids.dtype)])
        if first + len(units) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), len(units)), np.int64)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[first + 1 : first + len(units) + 1] = self.used + np.cumsum(counts)
        self.used += len(ids)
        self.place.update(zip(units, range(first, first + len(units)), strict=True))

    def lookup(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units in order, and how many each unit has."""
        if len(self.place) > self.keep:
            self.clear()
        at = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            self._add(list(dict.fromkeys(units[i] for i in missing)))
            at[missing] = [self.place[units[i]] for i in missing]
        counts = self.ends[at + 1] - self.ends[at]
        total = int(counts.sum())
        source = np.arange(total) + np.repeat(self.ends[at] - (np.cumsum(counts) - counts), counts)
        return self.ids[source].astype(np.uint32), counts


class HashedUnits:
    """The same over units given as bytes, by two hashes of 64 bits each: a table of fixed size holds them, where a
    new unit takes the slot of the one before it. No text is kept, so a worker remembers millions of units."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], bits: int = 22, keep_ids: int = 24_000_000):
        self.encode, self.bits, self.keep_ids = encode, bits, keep_ids
        self.clear()

    def clear(self) -> None:
        self.one, self.two = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.place = np.full(1 << self.bits, -1, np.int32)
        self.ids = np.zeros(1 << 16, np.uint16)
        self.ends = np.zeros(1 << 14, np.int32)
        self.units = self.used = 0

    def _add(self, units: list[str]) -> np.ndarray:
        """Numbers of new units."""
        ids, counts = self.encode(units)
        first = self.units
        if len(ids) and ids.max() > np.iinfo(self.ids.dtype).max:
            self.ids = self.ids.astype(np.uint32)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids) // 2, len(ids)), self.ids.dtype)])
        if first + len(units) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends) // 2, len(units)), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[first + 1 : first + len(units) + 1] = self.used + np.cumsum(counts)
        self.used += len(ids)
        self.units += len(units)
        return np.arange(first, self.units)

    def lookup(self, one: np.ndarray, two: np.ndarray, lasting: np.ndarray, text_of: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units in order, and how many each has. Units that aren't ``lasting`` are encoded anew;
        text_of(at) gives the texts of some units."""
        if self.used > self.keep_ids:
            self.clear()
        slot = (one >> np.uint64(64 - self.bits)).astype(np.int64)
        at = np.where((self.one[slot] == one) & (self.two[slot] == two) & lasting, self.place[slot], -1).astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            a, b = one[missing], np.where(lasting[missing], two[missing], missing.astype(np.uint64))
            order = np.lexsort((b, a))
            new = np.ones(len(order), bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            first = missing[order[new]]
            numbers = self._add(text_of(first))
            at[missing[order]] = numbers[np.cumsum(new) - 1]
            kept = lasting[first]
            first, numbers = first[kept], numbers[kept]
            # Where two new units meet in a slot, all three columns must hold the same one.
            _, last = np.unique(slot[first], return_index=True)
            first, numbers = first[last], numbers[last]
            self.one[slot[first]], self.two[slot[first]], self.place[slot[first]] = one[first], two[first], numbers
        counts = (self.ends[at + 1] - self.ends[at]).astype(np.int64)
        source = np.arange(int(counts.sum())) + np.repeat(self.ends[at] - (np.cumsum(counts) - counts), counts)
        return self.ids[source].astype(np.uint32), counts
